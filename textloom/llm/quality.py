"""Quality rules: basic counts, and how well a public vocabulary fits the text (fertility)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import slices

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
VOCABULARY = "piece_bpe_32k.model"
_BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Accepted range of characters per token, share of byte-fallback tokens, token entropy, and entropy
    per character, which random characters raise above what fluent text reaches."""

    min_chars: float
    max_chars: float
    max_byte_share: float
    min_entropy: float
    max_bits: float


# Accepted bands by script, set around what fluent text measures. Where a vocabulary knows few of a
# script's letters, text of it takes several byte tokens a character, which is no fault of the text.
BANDS = {
    "latin": Band(1.7, 7.0, 0.2, 4.0, 3.7),
    "latin_marked": Band(1.0, 7.0, 0.2, 4.0, 6.0),
    "greek": Band(0.7, 4.0, 0.2, 3.5, 5.5),
    "cyrillic": Band(1.4, 6.0, 0.2, 4.0, 4.2),
    "arabic": Band(0.7, 4.0, 0.3, 3.5, 6.2),
    "hebrew": Band(0.7, 4.0, 0.3, 3.5, 5.7),
    "devanagari": Band(0.6, 4.0, 0.4, 3.5, 7.5),
    "kana": Band(0.65, 4.0, 0.4, 4.0, 8.0),
    "han": Band(0.5, 4.0, 0.6, 4.0, 11.0),
    "hangul": Band(0.5, 4.0, 0.6, 4.0, 10.0),
    "thai": Band(0.7, 4.0, 0.3, 3.5, 6.5),
    "georgian": Band(0.7, 4.0, 0.3, 3.5, 6.5),
    "tamil": Band(0.7, 4.0, 0.4, 3.5, 6.5),
    "unlisted": Band(0.25, 6.0, 1.0, 3.0, 20.0),
}
# Of the characters in words at least so many are letters; a text without letters fails ("other").
MIN_LETTER_SHARE = 0.25
# Latin text with over this share of letters beyond ASCII has a band of its own.
MARKED_SHARE = 0.1
# Texts of fewer tokens have too small an entropy to be judged by it.
MIN_TOKENS_FOR_ENTROPY = 64
# First and last code points of the scripts' letters.
_RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
}


_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def script_and_letters(text: str) -> tuple[str, int]:
    """The script with most letters ("other" if there are none), and the number of all letters."""
    if text.isascii():
        n = len(text.encode().translate(None, _NOT_LETTERS))
        return ("latin" if n else "other"), n
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {s: sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in r) for s, r in _RANGES.items()}
    listed = np.zeros(len(codes), bool)
    for ranges in _RANGES.values():
        for a, b in ranges:
            listed |= (codes >= a) & (codes <= b)
    # Letters and their marks of any other script count under the first word of their Unicode names.
    for code, n in zip(*np.unique(codes[~listed & (codes > 127)], return_counts=True), strict=True):
        if unicodedata.category(chr(code))[0] in "LM":
            script = unicodedata.name(chr(code), "unlisted").split()[0].lower()
            counts[script] = counts.get(script, 0) + int(n)
    best = max(counts, key=counts.__getitem__)
    return (best if counts[best] else "other"), sum(counts.values())


def script_of(text: str) -> str:
    """The script with most letters; "other" if there are none."""
    return script_and_letters(text)[0]


def band_of(script: str, text: str, bands: dict[str, Band]) -> Band | None:
    """The band a text is judged by; None, for a text without letters, means that it fails."""
    if script == "latin" and not text.isascii() and "latin_marked" in bands:
        own = sum(map(str.isalpha, text))
        plain = len(text.encode("ascii", "ignore").translate(None, _NOT_LETTERS))
        script = "latin_marked" if own - plain > MARKED_SHARE * own else script
    return None if script == "other" else bands.get(script, bands.get("unlisted"))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, windows compared by hash."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = hashes[:n].copy()
    for i in range(1, window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += repeated
    edges[window : window + n] -= repeated
    return int((np.cumsum(edges) > 0).sum())


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return pieces, np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())], bool)


_FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()),
    ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()),
)
_SPARK = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType()}
SCHEMA = T.StructType([T.StructField(name, _SPARK[kind]) for name, kind in _FIELDS])


def measure(text: str, path: str, bands: dict[str, Band] = BANDS) -> tuple:
    """The values of ``SCHEMA`` for one text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n_words, word_chars = len(words), len(text) - sum(map(data.count, (bytes([b]) for b in _BLANKS)))
    lines = [line for line in data.split(b"\n") if line.strip(_BLANKS)]
    repeat = repeated_words(words)
    pieces, is_byte = _vocabulary(path)
    ids = np.array(pieces.encode(text), np.int64)
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(0, np.int64)
    shares = counts[counts > 0] / max(1, n)
    entropy = float(-(shares * np.log2(shares)).sum()) + 0.0
    per_token, byte_share = word_chars / max(1, n), float(is_byte[ids].sum()) / max(1, n)
    base_failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * n_words
    script, letters = script_and_letters(text)
    band = band_of(script, text, bands)
    fits = band is not None and letters >= MIN_LETTER_SHARE * word_chars
    fits = fits and band.min_chars <= per_token <= band.max_chars and byte_share <= band.max_byte_share
    fits = fits and (n < MIN_TOKENS_FOR_ENTROPY or band.min_entropy <= entropy <= band.max_bits * per_token)
    symbols = sum(data.count(bytes([s])) for s in SYMBOLS)
    dup_lines = len(lines) - len(set(lines))
    return (
        n_words, word_chars, symbols, dup_lines, repeat, n, per_token, byte_share, entropy, script,
        base_failed, fits and not base_failed,
    )


def quality(text: Column, path: str | None = None, bands: dict[str, Band] | None = None) -> Column:
    """Struct of basic counts, fertility measures and the verdict ``kept`` of a text.

    Words are runs without ASCII white space. A text fails the basic rules with fewer than
    ``MIN_WORDS`` words or with over ``MAX_REPEATED_PERCENT`` percent of words in repeated windows of
    five; otherwise it is kept if characters (in words) per token, the share of byte-fallback tokens
    and the entropy of the tokens, also per character, lie within the band of its main script. Texts
    without or with few letters fail. Null and empty texts have zero counts and fail; equal texts get
    equal values.
    """
    path, bands = path or public_tokenizers.path(VOCABULARY), bands or BANDS

    @arrow_udf(SCHEMA)
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            values = list(zip(*(measure(x.as_py(), path, bands) for x in batch), strict=True))
            values = values or [[] for _ in _FIELDS]
            arrays = [pa.array(v, kind) for v, (_, kind) in zip(values, _FIELDS, strict=True)]
            yield pa.StructArray.from_arrays(arrays, [name for name, _ in _FIELDS])

    return compute.asNondeterministic()(F.coalesce(text, F.lit("")))
