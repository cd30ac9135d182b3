"""Secret scan: fixed patterns, and a linear-chain conditional random field over words.

Words are tagged as begin, inside or outside of a secret from their shape, their neighbours and the
document; tags are decoded by Viterbi. The field learns from the values that the patterns match, on a
bounded sample, and finds what looks or stands like them without matching a pattern. So that it does
not just learn the patterns again, it also sees the same values without the words that gave them
away, or in other alphabets; and so that it leaves other odd words alone, it sees the oddest words of
clean texts, and made-up numbers, versions and addresses.
"""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import bytes_of, materialize, slices, unicode_offsets

KINDS = ("assign", "access", "hex", "crf")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
# Windows of so many texts with matches and of as many without train the field: the first by hash.
MAX_TRAINING = 300
# Of texts without a match only one in so many is looked at for that.
CLEAN_SHARE = 8
WINDOW, WINDOWS = 12, 2  # words on either side of a training match; windows of a text
STEPS, RATE, L2 = 60, 0.2, 1e-4
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

# The fixed patterns of the base rules.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_KEYWORD = re.compile(b"|".join(KEYWORDS))
_TRIM = b"\"'`.,;:!?()[]{}<>#$%&*|="

_HEX_RUNS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_SHAPE = bytes(
    b if b in b" \t\n\x0b\x0c\r" else 48 if 48 <= b <= 57 else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128
    else b for b in range(256)
)


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches in bytes, by start, then kind as listed."""
    found = []
    lower = data.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(data) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in data:
        found += [(*m.span(), "access") for m in ACCESS.finditer(data) if m.end() - m.start() >= MIN_ACCESS]
    if b"x" * MIN_HEX in data.translate(_HEX_RUNS):
        found += [(*m.span(), "hex") for m in HEX.finditer(data)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _entropy(word: bytes) -> float:
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def is_plain(shape: bytes) -> bool:
    """Whether a word of this shape is looked at by its shape alone."""
    return len(shape) < 20 and b"0" not in shape and not any(c in shape for c in (b"=", b":", b"_", b"/", b"+", b'"', b"'"))


@lru_cache(maxsize=50_000)
def word_features(word: bytes) -> tuple[str, ...]:
    """Names of a word's own features."""
    shape = word.translate(_SHAPE)
    core = word.strip(_TRIM)
    classes = "".join(c for c in "0aA" if c.encode() in shape)
    short = re.sub(rb"(.)\1+", rb"\1", shape)[:8].decode("latin-1")
    out = [f"class={classes}", f"shape={short}", f"size={min(len(core), 48) // 4}"]
    if is_plain(shape):
        return (*out, "plain")
    out.append(f"entropy={int(2 * _entropy(core)) if core else -1}")
    out.append(f"digits={10 * sum(c in b'0123456789' for c in core) // max(1, len(core))}")
    if core and not core.strip(b"0123456789abcdefABCDEF"):
        out.append("all=hex")
    elif core and not core.strip(b"0123456789+-(). /"):
        out.append("all=number")
    elif core and not core.strip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"):
        out.append("all=base64")
    out += [f"quoted={word[:1] in (b'"', b"'")}", f"sign={word in (b'=', b':')}"]
    out += [f"has={c.decode()}" for c in (b"=", b":", b"@", b"/", b"_") if c in word]
    if b"0" in shape and len(core) >= 16:
        out.append("long")
    return tuple(out)


def features_of(word: bytes) -> tuple[str, ...]:
    """Own features, with the keyword one; a plain word counts by its shape."""
    shape = word.translate(_SHAPE)
    own = word_features(shape if is_plain(shape) else word)
    return (*own, "keyword") if _KEYWORD.search(word.lower()) else own


def file_features(data: bytes) -> tuple[str, ...]:
    signs = sum(map(data.count, (b"=", b"{", b"}", b";")))
    return (f"file signs={min(5, (1000 * signs // max(1, len(data))))}", f"file size={min(5, len(data).bit_length() // 3)}")


@dataclass
class SecretField:
    """Weights of the field: (feature, tag) scores for a word, its neighbours and the document, and
    the transitions from tag to tag; tags before the first and after the last word are outside."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def __post_init__(self) -> None:
        # The most that transitions around a word can gain by leaving outside.
        best = np.array([[(self.moves[a] + self.moves[:, b]).max() for b in range(3)] for a in range(3)])
        self.slack = float((best - (self.moves[:, [0]] + self.moves[[0], :])).max())
        self._rows: dict[bytes, int] = {}
        self._table = np.zeros((1024, 9))

    def scores(self, features: tuple[str, ...], place: str) -> np.ndarray:
        known = [i for f in features if (i := self.names.get(place + f)) is not None]
        return self.weights[known].sum(axis=0) if known else np.zeros(3)

    def row(self, word: bytes) -> int:
        """Row of a word's scores: for itself, for the word after it and for the word before it."""
        found = self._rows.get(word)
        if found is None:
            if len(self._rows) >= 200_000:
                self._rows.clear()
            found = self._rows[word] = len(self._rows)
            if found >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            own = features_of(word)
            self._table[found] = np.concatenate([self.scores(own, p) for p in ("", "before ", "after ")])
        return found

    def tags(self, data: bytes) -> tuple[list[bytes], np.ndarray]:
        """Words of a text and their most likely tags."""
        words = data.split()
        shapes = data.translate(_SHAPE).split()
        if not words:
            return words, np.zeros(0, np.int64)
        if len(self._rows) + len(words) > 200_000:
            self._rows.clear()
        known = self._rows
        keyed = {words[i] for i in _keyword_words(data, words)}
        keys = [w if w in keyed or not _plain(s) else s for w, s in zip(words, shapes, strict=True)]
        rows = np.array([known[k] if k in known else self.row(k) for k in keys])
        table = self._table
        emit = table[rows, :3] + self.scores(file_features(data), "")
        emit[1:] += table[rows[:-1], 3:6]
        emit[:-1] += table[rows[1:], 6:9]
        # Where outside wins by more than any transitions can give, the best path is outside.
        open_ = np.flatnonzero(emit[:, 0] - emit[:, 1:].max(axis=1) <= self.slack)
        tags = np.zeros(len(words), np.int64)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            tags[run] = self.viterbi(emit[run])
        return words, tags

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        """Best tags of a run of words between outside ones."""
        best, back = self.moves[OUTSIDE] + emit[0], []
        for scores in emit[1:]:
            through = best[:, None] + self.moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + scores
        tags = [int((best + self.moves[:, OUTSIDE]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return np.array(tags[::-1])


@lru_cache(maxsize=100_000)
def _plain(shape: bytes) -> bool:
    return is_plain(shape)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, in bytes."""
    codes = np.frombuffer(data, np.uint8)
    inside = (codes != 32) & ((codes < 9) | (codes > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _keyword_words(data: bytes, words: list[bytes]) -> list[int]:
    lower = data.lower()
    if not any(k in lower for k in KEYWORDS):
        return []
    return [i for i, w in enumerate(words) if _KEYWORD.search(w.lower())]


def spans(data: bytes, model: SecretField) -> list[tuple[int, int, str]]:
    """Pattern matches and the field's further spans in bytes, by start, then kind as listed.

    A span of the field that overlaps a match is left out."""
    base = base_spans(data)
    words, tags = model.tags(data)
    found: list[tuple[int, int, str]] = []
    if tags.any():
        starts, ends = word_bounds(data)
        begins = np.flatnonzero((tags == BEGIN) | ((tags == INSIDE) & (np.concatenate([[0], tags[:-1]]) == OUTSIDE)))
        for first in begins:
            last = first
            while last + 1 < len(tags) and tags[last + 1] == INSIDE:
                last += 1
            text = data[starts[first] : ends[last]]
            left = len(text) - len(text.lstrip(_TRIM))
            start, end = int(starts[first]) + left, int(starts[first]) + max(left, len(text.rstrip(_TRIM)))
            if start < end and not any(a < end and start < b for a, b, _ in base):
                found.append((start, end, "crf"))
    return sorted(base + found, key=lambda x: (x[0], KINDS.index(x[2])))


@dataclass(frozen=True)
class Window:
    """Words of a training window with their tags, and the features of its document."""

    words: tuple[bytes, ...]
    tags: tuple[int, ...]
    whole: tuple[str, ...]


def _oddness(word: bytes) -> float:
    """How much a word looks like a value."""
    return 0.0 if is_plain(word.translate(_SHAPE)) else _entropy(word.strip(_TRIM)) * min(len(word), 64) if word.strip(_TRIM) else 0.0


def windows_of(data: bytes) -> list[Window]:
    """Windows around the values of the pattern matches; without a match, one around the oddest word."""
    starts, ends = word_bounds(data)
    words, tags, whole, centres = data.split(), np.zeros(len(starts), np.int64), file_features(data), []
    found = base_spans(data)
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(data) if len(m[2]) >= MIN_VALUE] if found else []
    for start, end in sorted(values + [(a, b) for a, b, kind in found if kind != "assign"]):
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        if not tags[first:last].any():
            tags[first:last], tags[first] = INSIDE, BEGIN
            centres.append(int(first))
    if not centres and words:
        centres = [max(range(len(words)), key=lambda i: (_oddness(words[i]), -i))]
    out = []
    for at in centres[:WINDOWS]:
        part = slice(max(0, at - WINDOW), at + WINDOW)
        out.append(Window(tuple(words[part]), tuple(tags[part].tolist()), whole))
    return out


def _remade(value: bytes, rng: random.Random) -> bytes:
    """A value of the same length in another alphabet."""
    raw = rng.randbytes(len(value))
    made = (value.upper(), base64.b64encode(raw), base64.urlsafe_b64encode(raw), raw.hex().encode(), raw.hex().upper().encode())
    return rng.choice(made)[: len(value)]


def _strange(rng: random.Random) -> bytes:
    """A word with digits or signs that is no secret."""

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    hexes = rng.randbytes(20).hex()
    return rng.choice([
        f"https://www.example.com/{digits(4)}/{hexes}", f"http://example.org/a/{hexes[:12]}.html?id={digits(6)}",
        f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z",
        f"+1-{digits(3)}-{digits(3)}-{digits(4)}", digits(rng.randint(3, 18)), f"#{digits(5)}", f"{digits(3)}.{digits(2)}.{digits(1)}.{digits(3)}",
        f"user{digits(3)}@example.com", f"ISBN-{digits(13)}", f"img_{digits(8)}.jpg", f"x={digits(2)};", f"{hexes[:7]}", f"{digits(2)}%",
        f"DE{digits(20)}", f"{digits(4)}/{digits(4)}", f"a_{digits(2)}_b", f"${digits(3)}.{digits(2)}",
    ]).encode()


_GAVE_AWAY = re.compile(rb"[:=]|" + _KEYWORD.pattern, re.IGNORECASE)


def _variants(window: Window) -> Iterator[Window]:
    """A window, and the same without what gave the value away, or with an odd word that is none."""
    yield window
    words, tags = list(window.words), list(window.tags)
    rng = random.Random(b" ".join(words))
    plain = [w for w in words if is_plain(w.translate(_SHAPE)) and not _KEYWORD.search(w.lower())] or [b"the"]
    if not any(tags):
        words[rng.randrange(len(words))] = _strange(rng)
        yield Window(tuple(words), window.tags, window.whole)
        return
    at = tags.index(BEGIN)
    value = words[at].strip(_TRIM)
    value = (re.split(rb"[:=]", value.rstrip(b"=")) or [value])[-1].strip(_TRIM)
    if len(value) < 16 or not any(c in b"0123456789" for c in value) or INSIDE in tags[at : at + 2]:
        return  # by itself it need not be a secret
    for kind in ("bare", "said", "remade", "remade", "named", "named"):
        own = list(words)
        made = value if kind == "bare" else _remade(value, rng)
        own[at] = rng.choice((b"%b", b'"%b"', b"%b.", b"'%b',")) % made
        if kind == "named":  # by a word that is no keyword
            name = rng.choice(plain).strip(_TRIM) or b"x"
            own[at] = rng.choice((name, name.upper())) + rng.choice((b"=", b":", b'="')) + made
        for i in range(max(0, at - 3), at):
            if _GAVE_AWAY.search(own[i]):
                # What was a sign becomes a plain word; a keyword may stay, without a sign.
                stays = kind == "said" and _KEYWORD.search(own[i].lower())
                own[i] = own[i].strip(_TRIM) if stays else rng.choice(plain)
        yield Window(tuple(own), window.tags, window.whole)


def train(windows: Iterable[Window]) -> SecretField:
    """Fit the field by gradient steps on the likelihood of the windows' tags."""
    seen = [x for w in windows if w.words for x in _variants(w)]
    if not any(tag for w in seen for tag in w.tags):
        return SecretField()
    examples = [([features_of(x) for x in w.words], w.tags, w.whole) for w in seen]
    names: dict[str, int] = {}
    rows, columns = [], []
    size, longest = len(examples), max(len(x[0]) for x in examples)
    gold, real = np.zeros((size, longest), np.int64), np.zeros((size, longest), bool)
    for i, (own, tags, whole) in enumerate(examples):
        gold[i, : len(tags)], real[i, : len(tags)] = tags, True
        for t in range(len(own)):
            before = own[t - 1] if t else ()
            after = own[t + 1] if t + 1 < len(own) else ()
            named = [*own[t], *whole, *("before " + f for f in before), *("after " + f for f in after)]
            ids = [names.setdefault(f, len(names)) for f in named]
            rows += [i * longest + t] * len(ids)
            columns += ids
    rows, columns = np.array(rows), np.array(columns)
    n = len(names)
    theta = np.zeros(3 * n + 9)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    flat = real.ravel()

    def totals(by_word: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(columns, by_word[rows, k], n) for k in range(3)], axis=1)

    hard = np.eye(3)[gold] * real[..., None]
    steps = real[:, :-1] & real[:, 1:]
    gold_words = totals(hard.reshape(-1, 3))
    gold_moves = np.einsum("nta,ntb,nt->ab", hard[:, :-1], hard[:, 1:], steps)
    ends = real.sum(axis=1) - 1
    for step in range(1, STEPS + 1):
        weights, moves = theta[: 3 * n].reshape(n, 3), theta[3 * n :].reshape(3, 3)
        emit = np.stack([np.bincount(rows, weights[columns, k], size * longest) for k in range(3)], axis=1)
        emit = np.where(flat[:, None], emit, 0).reshape(size, longest, 3)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = moves[OUTSIDE] + emit[:, 0]
        for t in range(1, longest):
            go = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], go, ahead[:, t - 1])
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                go = np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            else:
                go = np.zeros((size, 3))
            behind[:, t] = np.where((ends == t)[:, None], moves[:, OUTSIDE], np.where((ends > t)[:, None], go, 0))
        total = np.logaddexp.reduce(ahead[:, 0] + behind[:, 0], axis=1)
        soft = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        pair = ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        soft_moves = (np.exp(np.minimum(pair, 0)) * steps[..., None, None]).sum(axis=(0, 1))
        edge = soft[:, 0].sum(axis=0) - hard[:, 0].sum(axis=0)
        last = (soft[np.arange(size), ends] - hard[np.arange(size), ends]).sum(axis=0)
        slope_moves = soft_moves - gold_moves
        slope_moves[OUTSIDE] += edge
        slope_moves[:, OUTSIDE] += last
        slope = np.append((totals(soft.reshape(-1, 3)) - gold_words).ravel(), slope_moves.ravel()) / size
        slope += L2 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return SecretField(names, theta[: 3 * n].reshape(n, 3).copy(), theta[3 * n :].reshape(3, 3).copy())


_WINDOWS = "h long, marked boolean, words array<binary>, tags array<int>, whole array<string>"


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows of every text with a match, and of a share of the others."""
    kinds = [pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = ["h", "marked", "words", "tags", "whole"]
    for batch in batches:
        out = []
        for h, x in zip(batch.column("h").to_pylist(), batch.column("data"), strict=True):
            data = x.as_py()
            marked = bool(base_spans(data))
            if marked or h % CLEAN_SHARE == 0:
                out += [(h, marked, w.words, w.tags, w.whole) for w in windows_of(data)]
        columns = zip(*out, strict=True) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def fit(docs: DataFrame, *, text_col: str = "text", max_training: int = MAX_TRAINING) -> SecretField:
    """Train on windows of at most ``max_training`` texts that hold a match, however rare these are, and of
    as many others, the first of each by the hash of the text. One pass over all texts writes the
    windows; the driver gets the chosen ones. An empty table gives a field that tags nothing."""
    text = F.col(text_col)
    hashed = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("h"), bytes_of(text).alias("data"))
    found = materialize(hashed.mapInArrow(_windows, _WINDOWS), "secret-windows")
    # Copies of a text are one.
    texts = found.select("marked", "h").distinct()
    sizes = {r["marked"]: r["count"] for r in texts.groupBy("marked").count().collect()}
    chosen = []
    for marked, n in sorted(sizes.items()):
        # First a generous share by hash, so that what is ranked stays small whatever the input's size.
        share = int(min(1.0, 8 * max_training / n) * (1 << 20))
        part = texts.where((F.col("marked") == marked) & (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share))
        chosen.append(part.orderBy("h").limit(max_training))
    if not chosen:
        return SecretField()
    drawn = materialize(reduce(DataFrame.unionAll, chosen), "secret-training")
    sample = found.join(F.broadcast(drawn), ["h", "marked"]).distinct().orderBy("h", "words").collect()
    if sizes.get(True) and not any(r["marked"] for r in sample):
        raise ValueError("texts hold matches, but none was drawn")
    return train(Window(tuple(map(bytes, r["words"])), tuple(r["tags"]), tuple(r["whole"])) for r in sample)


_SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def secret_spans(text: Column, model: SecretField) -> Column:
    """Array of (kind, start, end) in code points, end exclusive, by start, then kind as in ``KINDS``.

    Kinds are the patterns ``assign``, ``access`` and ``hex``, leftmost and not overlapping within a
    kind, and ``crf`` for what the field adds. Null, empty and blank texts have no span.
    """

    @arrow_udf(T.ArrayType(_SPAN))
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            out = []
            for x in batch:
                data = x.as_py()
                found = spans(data, model)
                places = sorted({p for a, b, _ in found for p in (a, b)})
                at = dict(zip(places, unicode_offsets(data, places), strict=True))
                out.append([{"kind": k, "start": at[a], "end": at[b]} for a, b, k in found])
            yield pa.array(out, kind)

    return compute.asNondeterministic()(bytes_of(text))
