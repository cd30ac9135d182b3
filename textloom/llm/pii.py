"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value is validated (check digits, calendar, ranges), turned into an integer of its format's
domain, permuted there by a keyed Feistel network and written back in the format it came in. The
result is valid in the same format, and a value maps to the same pseudonym in every document,
however it is punctuated.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import slices

ROUNDS = 8
# Only for tests and trial runs on one machine: whoever knows the key can undo the permutation.
DEFAULT_KEY = b"textloom pseudonyms"
KEY_SETTING = "spark.textloom.pii.key"
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

# Each pattern starts with a plain class, which the regular expression engine can search for fast;
# the look-behind after it keeps matches from starting inside a word or number.
_PATTERNS = (
    ("iban", rb"[A-Z](?<![0-9A-Za-z_].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z_])"),
    ("card", rb"[0-9](?<![0-9A-Za-z_].)[0-9]{12,18}(?![0-9A-Za-z_])"),
    ("card", rb"[0-9](?<![0-9A-Za-z_].)[0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?(?![0-9A-Za-z_])"),
    ("card", rb"[0-9](?<![0-9A-Za-z_].)[0-9]{3}([ -])[0-9]{6}\1[0-9]{5}(?![0-9A-Za-z_])"),
    ("ssn", rb"[0-9](?<![0-9A-Za-z_-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_-])"),
    ("date", rb"[12](?<![0-9A-Za-z_./-].)[0-9]{3}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?=T[0-2][0-9](?![A-Za-z_])|(?![0-9A-Za-z_/-]|\.[0-9]))"),
    ("date", rb"[0-9](?<![0-9A-Za-z_./-].)[0-9]?([-/.])[0-9]{1,2}\1[12][0-9]{3}(?=T[0-2][0-9](?![A-Za-z_])|(?![0-9A-Za-z_/-]|\.[0-9]))"),
    ("phone", rb"\+(?<![0-9A-Za-z_+].)[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){4,13}(?![0-9A-Za-z_])"),
    ("phone", rb"[(](?<![0-9A-Za-z_+].)[0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z_])"),
    ("phone", rb"[0-9](?<![0-9A-Za-z_+.(-].)[0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9A-Za-z_-]|\.[0-9])"),
    ("ip", rb"[0-9](?<![0-9A-Za-z_.].)[0-9]{0,2}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_]|\.[0-9])"),
)
PATTERNS = tuple((kind, re.compile(pattern, re.DOTALL)) for kind, pattern in _PATTERNS)
# Issuer ranges: digits in front (first, last), and the lengths of such numbers.
_ISSUERS = (
    (4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)),
    (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14,)), (3528, 3589, (16,)), (6011, 6011, (16, 19)),
    (622126, 622925, (16, 19)), (644, 659, (16, 19)),
)
_MAIL_DOMAIN = re.compile(rb"@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,63}(?![0-9A-Za-z_])")
_MAIL_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]{1,64}$")
_DIGIT = re.compile(rb"[0-9]")


def permute(value: int, size: int, key: bytes, tweak: bytes = b"") -> int:
    """The image of ``value`` under a keyed permutation of range(size).

    A balanced Feistel network over the next even number of bits; images outside of the range are
    permuted again until one is inside.
    """
    if not 0 <= value < size:
        raise ValueError("value outside of its domain")
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low, n_bytes = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & low
        for turn in range(ROUNDS):
            message = bytes([turn]) + right.to_bytes(n_bytes, "big") + tweak
            mask = int.from_bytes(blake2b(message, key=key, digest_size=min(64, n_bytes + 8)).digest(), "big") & low
            left, right = right, left ^ mask
        value = left << half | right
        if value < size:
            return value


def _digits(text: bytes) -> str:
    return _keep(text, b"0123456789")


def _keep(text: bytes, allowed: bytes) -> str:
    return bytes(c for c in text if c in allowed).decode()


def _relaid(text: bytes, new: str) -> bytes:
    """``new`` in the places of the letters and digits of ``text``."""
    fresh = iter(new.encode())
    return bytes(next(fresh) if chr(c).isalnum() else c for c in text)


def _digit_string(digits: str, key: bytes, tweak: bytes) -> str:
    if not digits:
        return ""
    return str(permute(int(digits), 10 ** len(digits), key, tweak + bytes([len(digits)]))).zfill(len(digits))


def _classes(text: str, key: bytes, tweak: bytes) -> str:
    """Permute a string among those with digits, small and capital letters in the same places."""
    bases = [(48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) for c in text]
    value, size = 0, 1
    for c, (first, radix) in zip(text, bases, strict=True):
        value, size = value * radix + ord(c) - first, size * radix
    shape = bytes(first for first, _ in bases)
    value, out = permute(value, size, key, tweak + shape) if size > 1 else value, []
    for first, radix in reversed(bases):
        value, place = divmod(value, radix)
        out.append(chr(first + place))
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _card(text: bytes, key: bytes) -> bytes | None:
    digits = _digits(text)
    issuer = next((str(a) for a, b, n in _ISSUERS if len(digits) in n and a <= int(digits[: len(str(a))]) <= b), None)
    if issuer is None or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    kept = digits[: len(issuer)]
    payload = kept + _digit_string(digits[len(kept) : -1], key, b"card" + kept.encode())
    return _relaid(text, payload + luhn_digit(payload))


def _iban(text: bytes, key: bytes) -> bytes | None:
    flat = text.replace(b" ", b"").decode()
    country, check, rest = flat[:2], flat[2:4], flat[4:]
    if not 15 <= len(flat) <= 34 or iban_check(country, rest) != check:
        return None
    rest = _classes(rest, key, b"iban" + country.encode())
    return _relaid(text, country + iban_check(country, rest) + rest)


def _ssn(text: bytes, key: bytes) -> bytes | None:
    area, group, serial = (int(x) for x in text.split(b"-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(value, 898 * 99 * 9999, key, b"ssn"), 9999)
    area, group = divmod(value, 99)
    return b"%03d-%02d-%04d" % (area + 1 + (area >= 665), group + 1, serial + 1)


def _date(text: bytes, key: bytes) -> bytes | None:
    mark = next(chr(c) for c in text if not chr(c).isdigit())
    parts = text.decode().split(mark)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))  # places of year, month, day
    for order in orders:
        try:
            day = date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        day = _FIRST_DAY + permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, b"date")
        new = date.fromordinal(day)
        padded = all(len(p) > 1 for p in parts)
        for i, x in zip(order, (new.year, new.month, new.day), strict=True):
            parts[i] = f"{x:02d}" if padded else str(x)
        return mark.join(parts).encode()
    return None


def _phone(text: bytes, key: bytes) -> bytes | None:
    digits = _digits(text)
    if text.startswith(b"+"):
        if not 8 <= len(digits) <= 15:
            return None
        country = digits[: 1 if digits[0] in "17" else 2]
        rest = digits[len(country) :]
        return _relaid(text, country + _digit_string(rest, key, b"phone" + country.encode()))
    return _relaid(text, _digit_string(digits, key, b"phone1"))


def _ip(text: bytes, key: bytes) -> bytes | None:
    octets = [int(x) for x in text.split(b".")]
    if max(octets) > 255:
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ip")
    return b".".join(b"%d" % x for x in value.to_bytes(4, "big"))


def _mail(text: bytes, key: bytes) -> bytes | None:
    local, _, domain = text.rpartition(b"@")
    plain = "".join(c for c in local.decode() if c.isalnum())
    return _relaid(local, _classes(plain, key, b"mail" + domain.lower())) + b"@" + domain if plain else None


VALIDATED: dict[str, Callable[[bytes, bytes], bytes | None]] = {
    "mail": _mail, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone, "ip": _ip,
}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, text: bytes, key: bytes) -> bytes | None:
    """The pseudonym of a value, or None if it is not a valid one of its kind."""
    return VALIDATED[kind](text, key)


def replacements(data: bytes, key: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, pseudonym) of the values in a text, in bytes, ascending, not overlapping.

    Where matches overlap the earlier one counts, of equal starts the longer one.
    """
    found = []
    if b"@" in data:
        for domain in _MAIL_DOMAIN.finditer(data):
            local = _MAIL_LOCAL.search(data, max(0, domain.start() - 64), domain.start())
            if local:
                found.append((local.start(), domain.end(), "mail"))
    if _DIGIT.search(data):
        for kind, pattern in PATTERNS:
            if kind == "iban":  # one may start inside the match of another, which takes in what follows
                at = 0
                while m := pattern.search(data, at):
                    found.append((*m.span(), kind))
                    at = m.start() + 4
                continue
            found += [(*m.span(), kind) for m in pattern.finditer(data)]
    out, end = [], 0
    for start, stop, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if start < end:
            continue
        for own in _iban_stops(data, start, stop) if kind == "iban" else (stop,):
            if (new := pseudonym(kind, data[start:own], key)) is not None:
                out.append((start, own, kind, new))
                end = own
                break
    return out


def _iban_stops(data: bytes, start: int, stop: int) -> Iterator[int]:
    """Where an IBAN may end: after the whole match, or before any of its blanks, the longest first, as
    a match takes in a following short word. At most ten."""
    while stop > start:
        yield stop
        stop = data.rfind(b" ", start, stop)


def replace(data: bytes, key: bytes) -> tuple[bytes, int]:
    """(text with pseudonyms, number of values)."""
    found, parts, at = replacements(data, key), [], 0
    for start, end, _, new in found:
        parts += [data[at:start], new]
        at = end
    return b"".join([*parts, data[at:]]) if found else data, len(found)


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting ``spark.textloom.pii.key``. Only a local session may do without."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key.encode()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {KEY_SETTING} to a secret key of 1 to 64 bytes.")
    return DEFAULT_KEY


_OWN_KEYS: dict[str, bytes] = {}


def job_key(spark: SparkSession) -> bytes:
    """``session_key``, or without one on a cluster a secret key drawn for this application.

    Pseudonyms are then linked over all tables of the application, and with those of no other one;
    nobody can undo them.
    """
    try:
        return session_key(spark)
    except ValueError:
        return _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymise(text: Column, key: bytes = DEFAULT_KEY) -> Column:
    """Struct of ``text`` with personal values replaced and ``n_values``, their number (long).

    Replaced are mail addresses (the part before the at sign), IBANs and card numbers with right
    check digits, US social security numbers, dates from 1900 to 2099, phone numbers and IPv4
    addresses. A date of two small numbers and a year is read day first (03/04/2024 is 3 April).
    Where patterns overlap, the value that begins first is taken, of those that begin together the
    longest. Everything else stays as it is, byte by byte, in texts of any length. A null text stays null with 0 values;
    equal texts give equal results. ``key`` (1 to 64 bytes) selects the permutation; keep it secret.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("key must have 1 to 64 bytes")
    fields = [T.StructField("text", T.StringType()), T.StructField("n_values", T.LongType())]

    @arrow_udf(T.StructType(fields))
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            done = [(None, 0) if x is None else replace(x, key) for x in batch.to_pylist()]
            # Viewed, not cast: a cast fails on a text with bytes that are no UTF-8.
            texts = pa.array([x for x, _ in done], pa.binary()).view(pa.string())
            yield pa.StructArray.from_arrays([texts, pa.array([n for _, n in done], pa.int64())], ["text", "n_values"])

    return compute.asNondeterministic()(text.cast("binary"))
