"""Exact top-n retrieval that settles most pairs by a bound, over an index of the stored vectors.

The index turns the unit vectors so that their first components carry most of their length (the
main axes of all stored vectors), and keeps the length of what lies behind each level. For a query
and a row the product of the first components, plus the product of the lengths of the rest, is the
best cosine that the pair can have. Pairs that cannot reach a query's n-th best so far are done with
after the first levels; only the others are followed to the last component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom import fixed
from textloom.operators.retrieve import BROADCAST_VALUES, KEY, SIMILARITY_DIGITS, check_top_n
from textloom.session import materialize

# Shares of the components at which a pair is looked at again.
LEVELS = (1 / 4, 1 / 2, 3 / 4)
# Below this share of a tile its pairs are followed one by one, above it as a product of matrices; and
# tiles without the levels at most, after one that these did not thin out so far.
_FEW, _WAIT = 0.02, 32
# Pairs at once, and rows of the first tile of a task.
_TILE, _FIRST = 1 << 20, 64
# Queries that are searched for together: with the first tile, they set what a task holds.
_TOGETHER = 4096
# What rounding may cost a bound; similarities are compared to SIMILARITY_DIGITS places.
_SLACK = 10.0**-SIMILARITY_DIGITS


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(norms > 0, norms, 1.0)[:, None]


def level_ends(size: int) -> list[int]:
    """Numbers of components at the levels, the last one being all."""
    return sorted({max(1, round(size * share)) for share in LEVELS} | {size}) if size else [0]


class BoundedSearch:
    """The best rows of a block of queries, unit vectors along the axes of the index.

    Pairs are bounded in single precision, with room for its rounding; those that stay are multiplied
    in double precision, which alone decides. ``scored`` counts the pairs that were followed to the
    last component, of ``possible`` ones; ``multiplied`` counts the products of components.
    """

    def __init__(self, queries: np.ndarray, top_n: int):
        self.top_n, self.n_queries = top_n, len(queries)
        self.ends = level_ends(queries.shape[1])
        # A zero vector is level with every row: the first rows by key are its best ones.
        self.live = np.flatnonzero(queries.any(axis=1))
        self.firsts: list[tuple] = []
        self.queries = queries[self.live]
        self.coarse = self.queries.astype(np.float32)
        self.rest = [np.sqrt((self.queries[:, e:] ** 2).sum(axis=1)).astype(np.float32) for e in self.ends]
        self.slack = _SLACK + (queries.shape[1] + 8) * 2.0**-22
        self.least = np.full(len(self.live), -np.inf)
        # Of every query its best rows so far, best first: similarities and keys.
        self.top = np.full((len(self.live), top_n), -np.inf)
        self.keys = np.empty((len(self.live), top_n), object)
        self.multiplied = self.scored = self.possible = 0
        self._step, self._plain, self._wait = _FIRST, 0, 0

    @property
    def best(self) -> list[list[tuple[float, tuple]]]:
        """Of every query: (minus similarity, key), at most top_n, best first."""
        out = [[(-0.0, key) for key in self.firsts]] * self.n_queries
        for i, scores, keys in zip(self.live.tolist(), self.top.tolist(), self.keys.tolist(), strict=True):
            out[i] = [(-s, key) for s, key in zip(scores, keys, strict=True) if key is not None]
        return out

    def offer(self, rows: np.ndarray, keys: list[tuple] | np.ndarray) -> None:
        """Rows in the order of their keys."""
        keys = keys if isinstance(keys, np.ndarray) else np.fromiter(keys, object, len(keys))
        if len(self.live) < self.n_queries:
            self.firsts = sorted(self.firsts + keys[: self.top_n].tolist())[: self.top_n]
        largest, start = max(_FIRST, _TILE // max(1, len(self.queries))), 0
        while start < len(rows) and len(self.live):
            self._tile(rows[start : start + self._step], keys[start : start + self._step])
            # A small tile first, which raises what the others have to reach.
            start, self._step = start + self._step, min(2 * self._step, largest)

    def _tile(self, rows: np.ndarray, keys: np.ndarray) -> None:
        size, coarse = rows.shape[1], rows.astype(np.float32)
        self.possible += len(self.queries) * len(rows)
        floor = (self.least - self.slack).astype(np.float32)[:, None]
        known = np.isfinite(self.least).all()
        levels = list(zip(self.ends, self.rest, strict=True))
        tried, levels = not self._plain, levels[-1:] if self._plain else levels
        self._plain = max(0, self._plain - 1)
        partial, before = None, 0
        for end, rest in levels:
            more = self.coarse[:, before:end] @ coarse[:, before:end].T
            partial = more if partial is None else np.add(partial, more, out=partial)
            self.multiplied += more.size * (end - before)
            behind = np.sqrt((rows[:, end:] ** 2).sum(axis=1)).astype(np.float32)
            stays = (partial + np.outer(rest, behind) if end < size else partial) >= floor
            before = end
            if np.count_nonzero(stays) < _FEW * stays.size:
                break
        if tried and known:
            # Where the bounds settle little, whole products are cheaper; they are tried again later.
            self._wait = min(_WAIT, max(1, 2 * self._wait)) if before == size else 0
            self._plain = self._wait
        q, r = np.divmod(np.flatnonzero(stays), len(rows))
        self.scored += stays.size if before == size else len(q)
        self.multiplied += len(q) * size
        scores = np.empty(len(q))
        for at in range(0, len(q), 1 << 16):
            cut = slice(at, at + (1 << 16))
            scores[cut] = np.einsum("ij,ij->i", self.queries[q[cut]], rows[r[cut]])
        self._keep(q, r, np.round(scores, SIMILARITY_DIGITS) + 0.0, keys)

    def _keep(self, q: np.ndarray, r: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        good = scores >= self.least[q]
        q, r, scores = q[good], r[good], scores[good]
        if not len(q):
            return
        order = np.lexsort((r, -scores, q))
        q, r, scores = q[order], r[order], scores[order]
        touched, starts, line = np.unique(q, return_index=True, return_inverse=True)
        place = np.arange(len(q)) - starts[line]
        # However many rows are level, the first n of them by key are enough.
        good = place < self.top_n
        new, names = np.full((len(touched), self.top_n), -np.inf), np.empty((len(touched), self.top_n), object)
        new[line[good], place[good]], names[line[good], place[good]] = scores[good], keys[r[good]]
        both, names = np.hstack([self.top[touched], new]), np.hstack([self.keys[touched], names])
        order = np.argsort(-both, axis=1, kind="stable")
        both, names = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
        # Held and new rows that are level meet in the order of their keys.
        level = (both[:, 1:] == both[:, :-1]) & np.isfinite(both[:, 1:]) & ((order[:, 1:] < self.top_n) != (order[:, :-1] < self.top_n))
        for i in np.flatnonzero(level.any(axis=1)):
            some = np.isfinite(both[i])
            held = sorted([*zip((-both[i, some]).tolist(), names[i, some].tolist(), strict=True)])
            both[i, some], names[i, some] = [-s for s, _ in held], np.fromiter((key for _, key in held), object, len(held))
        self.top[touched], self.keys[touched] = both[:, : self.top_n], names[:, : self.top_n]
        self.least[touched] = self.top[touched, -1]


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sum of the unit vectors' outer products."""
    total = None
    for batch in batches:
        if len(batch):
            units = unit_rows(_matrix(batch.column(0)))
            total = units.T @ units if total is None else total + units.T @ units
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist())], names=["i", "row"])


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: a written table ``source, chunk_number, turned`` of unit vectors along the columns of
    ``axes``, which the driver holds: as many numbers as dimensions squared."""

    rows: DataFrame
    axes: np.ndarray

    def search(self, queries: DataFrame, top_n: int = fixed.TOP_N, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
        """``request_id, rank, source, chunk_number, similarity``, as ``retrieve.top_matches`` has them.

        Queries (``request_id, embedding``) go over the index in blocks of at most
        ``broadcast_values`` numbers, each block in one pass that moves nothing but its best rows.
        """
        check_top_n(top_n)
        asked = queries.select("request_id", "embedding")
        kinds = [self.rows.schema[c].dataType for c in KEY]
        schema = T.StructType([asked.schema["request_id"], *[T.StructField(n, k) for n, k in zip(KEY, kinds, strict=True)], T.StructField("similarity", T.DoubleType())])
        per_block = max(1, broadcast_values // max(1, len(self.axes)))
        n_blocks = max(1, -(-asked.count() // per_block))
        if n_blocks > 1:
            asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("request_id"), F.lit(n_blocks))), "query-blocks")
        found = None
        for number in range(n_blocks):
            block = (asked.where(F.col("block") == number) if n_blocks > 1 else asked).select("request_id", "embedding").toArrow()
            part = self._pass(block, top_n, schema)
            # Each pass is written, so that only one block is held at a time.
            part = materialize(part, "matches") if n_blocks > 1 else part
            found = part if found is None else found.unionByName(part)
        best = W.partitionBy("request_id").orderBy(F.desc("similarity"), *KEY)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
        return ranked.select("request_id", "rank", *KEY, "similarity")

    def _pass(self, block: pa.Table, top_n: int, schema: T.StructType) -> DataFrame:
        ids = block.column("request_id").combine_chunks()
        some = len(block) and len(self.axes)
        turned = unit_rows(_matrix(block.column("embedding").combine_chunks())) @ self.axes if some else np.zeros((0, 0))
        shared = self.rows.sparkSession.sparkContext.broadcast((ids, turned))
        kinds = [to_arrow_type(f.dataType) for f in schema]
        names = schema.names

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, turned = shared.value
            searches = [BoundedSearch(turned[at : at + _TOGETHER], top_n) for at in range(0, len(turned), _TOGETHER)]
            for batch in batches:
                if len(batch) and len(turned):
                    batch = batch.sort_by([(name, "ascending") for name in KEY])
                    keys = np.fromiter(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), object, len(batch))
                    rows = _matrix(batch.column(2))
                    for search in searches:
                        search.offer(rows, keys)
            best = [held for search in searches for held in search.best]
            at = [i for i, held in enumerate(best) for _ in held]
            held = [(*key, -s) for rows in best for s, key in rows]
            columns = list(zip(*held, strict=True)) or [()] * 3
            taken = ids.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.cast(kinds[0]), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], names=names
            )

        return self.rows.select(*KEY, "turned").mapInArrow(run, schema)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        axes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(self.axes)], "i int, row array<double>")
        axes.coalesce(1).write.mode("overwrite").parquet(f"{path}/axes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        axes = spark.read.parquet(f"{path}/axes").orderBy("i").collect()
        return cls(spark.read.parquet(f"{path}/rows"), np.array([r["row"] for r in axes]).reshape(len(axes), -1))


def build_index(store: DataFrame) -> VectorIndex:
    """Index ``source, chunk_number, embedding``, all vectors of one length. Two passes over the store:
    one sums up the axes, one turns the vectors; no row moves. An empty store has an empty index."""
    held = store.select(*KEY, F.col("embedding").cast("array<double>").alias("embedding"))
    sums = held.select("embedding").mapInArrow(_products, "i int, row array<double>")
    size = held.select(F.size("embedding")).first()
    size = size[0] if size else 0
    axes = np.eye(size)
    if size:
        total = sums.groupBy("i").agg(*[F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(size)]).orderBy("i").collect()
        axes = np.ascontiguousarray(np.linalg.eigh(np.array([r[1:] for r in total]))[1][:, ::-1])
    kinds = [to_arrow_type(held.schema[c].dataType) for c in KEY]

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = unit_rows(_matrix(batch.column(2))) @ axes if len(batch) else np.zeros((0, size))
            ends = np.arange(len(turned) + 1, dtype=np.int32) * size
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(turned.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), batch.column(1).cast(kinds[1]), lists], names=[*KEY, "turned"])

    schema = T.StructType([held.schema[KEY[0]], held.schema[KEY[1]], T.StructField("turned", T.ArrayType(T.DoubleType()))])
    return VectorIndex(materialize(held.mapInArrow(turn, schema), "vector-index"), axes)
