"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ
in two bits at most agree fully in one segment (pigeonhole), and in every other segment they differ
by two bits at most. Words of 23 bits within distance two have a word within distance one of both,
so the codewords of the perfect (23, 12) Golay code to which a segment and its one-bit neighbours
decode, one or six in number, have a member in common. A key is therefore an intact segment together
with one codeword index of the next segment: 33 or 34 selective bits, up to 18 keys a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import bytes_of, materialize, slices
from textloom.llm.components import connected_components

MAX_DISTANCE = 2
SHINGLE_WORDS = 3
SEED = 42
# Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code, and its sizes.
GENERATOR = 0b101011100011
CODE_BITS, INDEX_BITS, CHECK_BITS = 23, 12, 11
# (shift, bits) of the segments, from the low end.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Keys held by more fingerprints than this are resolved by one-bit neighbours instead of pairs.
PAIR_LIMIT = 32
_HASHES_AT_ONCE = 1 << 16


def fingerprint_of(data: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one UTF-8 text, unsigned; see :func:`fingerprint`."""
    words = data.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    size = min(shingle_words, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    total = len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _HASHES_AT_ONCE):
        part = hashes[start : start + _HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """64-bit SimHash as a long (the bits of the unsigned value).

    A-Z become lower case, words are runs without ASCII white space, shingles are ``shingle_words``
    words joined by a space, repeats included (the whole sequence if there are fewer). A bit is set
    if it is set in over half of the shingles' XXH64 values. Null, empty and blank texts have
    fingerprint zero.
    """

    @arrow_udf("long")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            found = [fingerprint_of(x.as_py(), shingle_words) for x in batch]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return compute.asNondeterministic()(bytes_of(text))


def _remainder(word: int) -> int:
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECK_BITS
    return word


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of every 12-bit upper part, flips to the nearby codewords by syndrome).

    Row ``s`` of the second table holds the bit patterns that lead from a word of syndrome ``s`` to
    the codewords of its one-bit neighbourhood, repeated to fill six places.
    """
    unit = [_remainder(1 << bit) for bit in range(CODE_BITS)]
    error = {0: 0}
    for weight in (1, 2, 3):
        for bits in combinations(range(CODE_BITS), weight):
            syndrome = 0
            for bit in bits:
                syndrome ^= unit[bit]
            error[syndrome] = sum(1 << bit for bit in bits)
    flips = np.zeros((1 << CHECK_BITS, 6), np.int64)
    for syndrome in range(1 << CHECK_BITS):
        near = [error[syndrome]]
        for bit in range(CODE_BITS):
            flip = error[syndrome ^ unit[bit]] ^ 1 << bit
            if flip not in near:
                near.append(flip)
        flips[syndrome] = near + near[:1] * (6 - len(near))
    upper = np.array([_remainder(i << CHECK_BITS) for i in range(1 << INDEX_BITS)], np.int64)
    return upper, flips


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The six (partly repeated) codeword indices near each 23-bit word."""
    upper, flips = _decoder()
    syndrome = upper[words >> CHECK_BITS] ^ words & (1 << CHECK_BITS) - 1
    return (words[:, None] ^ flips[syndrome]) >> CHECK_BITS


def golay_keys(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 18) keys of n fingerprints; a fingerprint's keys may repeat."""
    unsigned = fingerprints.astype(np.int64).view(np.uint64)
    parts = [(unsigned >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    keys = []
    for i, part in enumerate(parts):
        indices = codeword_indices(parts[(i + 1) % len(parts)])
        keys.append((i << 22 | part)[:, None] << INDEX_BITS | indices)
    return np.concatenate(keys, axis=1)


@arrow_udf(T.ArrayType(T.LongType()))
def _keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(batches):
        keys = golay_keys(batch.to_numpy(zero_copy_only=False))
        ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))


def _links(prints: DataFrame, pair_limit: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly the distinct fingerprints within two bits."""
    keyed = prints.select("fp", F.explode(F.array_distinct(_keys("fp"))).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1")
    keyed = materialize(keyed.join(shared, "key"), "keyed")
    few = keyed.where(F.col("count") <= pair_limit)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
        .select("a", "b")
    )
    # Two fingerprints are within two bits exactly if they share a word within one bit of both, and
    # all that share such a word are within two bits of each other: a star replaces the pairs.
    many = keyed.where(F.col("count") > pair_limit).select("fp").distinct()
    flips = F.concat(
        F.array(F.lit(0).cast("long")),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    spread = many.select("fp", F.explode(flips).alias("flip"))
    spread = spread.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    centres = spread.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n"))
    centres = centres.where("n > 1").drop("n")
    stars = spread.join(centres, "middle").where(F.col("fp") != F.col("b"))
    return pairs.unionAll(stars.select(F.col("fp").alias("a"), "b"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints that differ in two bits at most are linked; ``component_id`` is the smallest id
    reachable. Equal fingerprints are one node, so copies cost nothing. Rows with the same id are
    rows of their own; null ids are carried and never the smallest unless a component has no other.
    Null, empty and blank texts share fingerprint zero and thus link. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle_words).alias("fp"))
    rows = materialize(rows, "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("low"))
    classes = connected_components(_links(prints, pair_limit))
    classes = prints.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")
    )
    classes = materialize(classes, "classes")
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest id.

    Rows that share an id are one document, of which one row stays: that with the smallest hash of the
    text, then of all columns, so that equal rows alone are chosen by chance. Rows with a null id can't
    be told apart from copies of other rows; all of them stay. All columns pass through.
    """
    named = docs.where(F.col(id_col).isNotNull())
    found = near_duplicates(named, id_col=id_col, text_col=text_col)
    stay = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = named.join(stay, id_col, "left_semi")
    nameless = docs.where(F.col(id_col).isNull())
    # Ids alone tell whether any is repeated; only rows of those are compared.
    repeated = materialize(named.groupBy(id_col).count().where("count > 1").select(id_col), "repeated-ids")
    if repeated.isEmpty():
        return kept.select(*docs.columns).unionByName(nameless)
    order = F.struct(F.xxhash64(text_col), F.xxhash64(*docs.columns))
    rows = kept.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
    once = kept.join(repeated, id_col, "left_anti")
    once = once.select(*docs.columns)
    return once.unionByName(rows.select("__row.*")).unionByName(nameless)
