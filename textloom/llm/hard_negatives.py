"""Hard-negative mining with segment summaries that bound inner products.

A vector is cut into segments; of each its mean and its deviation (the length of what differs from
the mean) are stored, for few long segments and for many short ones. Over a segment of L components
the product of two vectors is L times the product of the means, plus or minus at most the product
of the deviations. Summed over the few segments this bounds the score of a pair; pairs that may
still matter are bounded again over the many segments, and only what is left is scored exactly.

The anchors are held in blocks of bounded size against all rows, which stay where they are: a task
keeps the best rows of every anchor and sends these alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.session import spread

SEGMENTS = (4, 16)
# Numbers of anchor vectors in a block, which the driver and every task hold.
BLOCK_NUMBERS = 1 << 21
# One row in so many is scored first, for the scores that the best rows reach at least.
SEED_SHARE = 64
# Quantised components beyond this are set to it, so that scores are longs.
LARGEST = 1 << 24
_TILE, _PAIRS, _NONE = 1 << 20, 1 << 15, 1 << 62


def segment_starts(size: int, segments: int) -> np.ndarray:
    """First components of at most ``segments`` segments of nearly equal length."""
    return np.unique(np.arange(segments) * size // segments) if size else np.zeros(0, np.int64)


def summarise(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the segments of every row."""
    starts = segment_starts(vectors.shape[1], segments)
    if not len(starts):
        return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
    sizes = np.diff(np.append(starts, vectors.shape[1]))
    values = vectors.astype(np.float64)
    means = np.add.reduceat(values, starts, axis=1) / sizes
    rest = values - np.repeat(means, sizes, axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


@dataclass(frozen=True)
class Summaries:
    """Vectors of one length with their summaries; ``levels`` from few segments to many, the means times
    the root of the segment's length, so that their products need no factor."""

    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    norms: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> Summaries:
        size, scaled = vectors.shape[1], []
        for segments, (means, deviations) in zip(SEGMENTS, levels, strict=True):
            lengths = np.diff(np.append(segment_starts(size, segments), size))
            scaled.append((means * np.sqrt(lengths), deviations))
        return Summaries(vectors, scaled, np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)))

    def part(self, rows: slice) -> Summaries:
        return Summaries(self.vectors[rows], [(m[rows], d[rows]) for m, d in self.levels], self.norms[rows])


class Anchors:
    """A block of anchors of one vector length, their bands, and the best rows found for every band.

    A band is a range of scores, ``floors`` to ``caps``, of which the ``k`` best rows are wanted; no
    band: a floor above the cap.
    """

    def __init__(self, ids, labels, of: Summaries, floors: np.ndarray, caps: np.ndarray, k: int, same_label: bool):
        self.ids, self.labels, self.of = ids, labels, of
        self.floors, self.caps, self.k, self.same_label = floors.copy(), caps, k, same_label
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in row] for row in floors]
        self.least, self.most = np.full(len(ids), _NONE), np.full(len(ids), -_NONE)
        self._limits(range(len(ids)))
        self.bounded = self.refined = self.scored = 0
        self.step = 64

    def _limits(self, rows: Iterable[int]) -> None:
        """Least and largest score that any band of an anchor still wants."""
        for a in rows:
            open_ = self.floors[a] <= self.caps[a]
            self.least[a] = self.floors[a][open_].min(initial=_NONE)
            self.most[a] = self.caps[a][open_].max(initial=-_NONE)

    def offer(self, ids: np.ndarray, labels: np.ndarray, rows: Summaries) -> None:
        largest, start = max(16, _TILE // max(1, len(self.ids))), 0
        while start < len(ids):
            part = slice(start, start + self.step)
            self._tile(ids[part], labels[part], rows.part(part))
            # First few rows, which raise the floors for the others.
            start, self.step = part.stop, min(2 * self.step, largest)

    def _tile(self, ids: np.ndarray, labels: np.ndarray, rows: Summaries) -> None:
        of = self.of
        pairs = (self.labels[:, None] == labels[None, :]) == self.same_label
        pairs &= self.ids[:, None] != ids[None, :]
        self.bounded += int(pairs.sum())
        # What rounding may cost: scores are whole numbers.
        slack = 1e-9 * of.norms.max(initial=0) * rows.norms.max(initial=0) + 1e-3
        least, most = self.least - slack, self.most + slack
        middle = of.levels[0][0] @ rows.levels[0][0].T
        spread_ = of.levels[0][1] @ rows.levels[0][1].T
        pairs &= (middle + spread_ >= least[:, None]) & (middle - spread_ <= most[:, None])
        # Products of whole numbers and all their sums are exact in doubles up to 2**53.
        exact = of.norms.max(initial=0) * rows.norms.max(initial=0) < 2.0**52
        kind = np.float64 if exact else np.int64
        a_all, b_all = np.nonzero(pairs)
        for start in range(0, len(a_all), _PAIRS):
            a, b = a_all[start : start + _PAIRS], b_all[start : start + _PAIRS]
            for (means, deviations), (other, others) in zip(of.levels[1:], rows.levels[1:], strict=True):
                self.refined += len(a)
                middle = np.einsum("ij,ij->i", means[a], other[b])
                spread_ = np.einsum("ij,ij->i", deviations[a], others[b])
                stays = (middle + spread_ >= self.least[a] - slack) & (middle - spread_ <= self.most[a] + slack)
                a, b = a[stays], b[stays]
            self.scored += len(a)
            scores = np.einsum("ij,ij->i", of.vectors[a].astype(kind), rows.vectors[b].astype(kind)).astype(np.int64)
            wanted = (scores >= self.least[a]) & (scores <= self.most[a])
            self._keep(a[wanted], ids[b[wanted]], scores[wanted])

    def _keep(self, a: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs come in order of anchors."""
        ends = np.flatnonzero(np.diff(a)) + 1
        for part in np.split(np.arange(len(a)), ends):
            if not len(part):
                continue
            anchor, changed = a[part[0]], False
            new = list(zip((-scores[part]).tolist(), ids[part].tolist(), strict=True))
            for band, held in enumerate(self.best[anchor]):
                low, high = self.floors[anchor, band], self.caps[anchor, band]
                fit = [x for x in new if low <= -x[0] <= high]
                if fit:
                    held = self.best[anchor][band] = sorted(held + fit)[: self.k]
                    if len(held) == self.k and -held[-1][0] > low:
                        # What scores less is out; what scores the same may have the smaller id.
                        self.floors[anchor, band], changed = -held[-1][0], True
            if changed:
                self._limits([anchor])

    def found(self) -> Iterator[tuple[int, int, int]]:
        """(anchor, row, score), once for all bands of an anchor."""
        for anchor, bands in zip(self.ids.tolist(), self.best, strict=True):
            for score, row in set().union(*bands):
                yield anchor, row, -score


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), kind)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("vector").value_lengths().to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


def _summaries(batch: pa.RecordBatch) -> Summaries:
    levels = []
    for i in range(len(SEGMENTS)):
        levels.append((_matrix(batch.column(f"means_{i}"), np.float64), _matrix(batch.column(f"deviations_{i}"), np.float64)))
    return Summaries.of(_matrix(batch.column("vector"), np.int64), levels)


def _stored(scale: float):
    """A mapInArrow function: quantised vectors with their summaries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_length(batch):
                raw = _matrix(part.column("vector"), np.float64)
                with np.errstate(over="ignore"):
                    vectors = np.clip(np.floor(scale * raw), -LARGEST, LARGEST).astype(np.int32)

                def lists(values: np.ndarray) -> pa.Array:
                    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))

                columns = {"id": part.column("id"), "label": part.column("label"), "vector": lists(vectors)}
                for i, segments in enumerate(SEGMENTS):
                    columns[f"means_{i}"], columns[f"deviations_{i}"] = map(lists, summarise(vectors, segments))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def store(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: float = 256) -> DataFrame:
    """A written table (id, label, vector of floor(scale * x), means and deviations of its segments).

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part.
    Of rows with the same id the smallest (label, vector) stays.
    """
    usable = F.forall(F.col("vector"), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable)
    # Only rows of repeated ids move.
    repeated = materialize(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if not repeated.isEmpty():
        again = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"))
        rows = rows.join(repeated, "id", "left_anti").unionByName(again.select("id", "x.*"))
    schema = "id long, label long, vector array<int>"
    for i in range(len(SEGMENTS)):
        schema += f", means_{i} array<double>, deviations_{i} array<double>"
    return materialize(spread(rows).mapInArrow(_stored(scale), schema), "summaries")


def _scan(rows: DataFrame, blocks, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, row_id, score): what the tasks' partitions have best, for a broadcast block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {size: Anchors(*block, k, same_label) for size, block in blocks.value.items()}
        for batch in batches:
            for size, part in _by_length(batch):
                if size in by_size:
                    columns = [part.column(c).to_numpy() for c in ("id", "label")]
                    by_size[size].offer(*columns, _summaries(part))
        for anchors in by_size.values():
            found = list(zip(*anchors.found(), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["anchor_id", "row_id", "score"])

    return rows.mapInArrow(run, "anchor_id long, row_id long, score long")


def _block(anchors: DataFrame, bands: DataFrame) -> dict[int, tuple]:
    """Arrays of a block of anchors, by vector length."""
    held = bands.groupBy("anchor_id").agg(F.collect_list(F.struct("band", "floor", "cap")).alias("bands"))
    table = anchors.join(held, F.col("id") == F.col("anchor_id")).drop("anchor_id").toArrow()
    blocks = {}
    for batch in table.combine_chunks().to_batches():
        for size, part in _by_length(batch):
            of = [part.column(c).to_numpy() for c in ("id", "label")]
            rows = part.column("bands").to_pylist()
            width = max(len(r) for r in rows)
            floors, caps = np.full((len(rows), width), _NONE), np.full((len(rows), width), -_NONE)
            for i, row in enumerate(rows):
                for j, band in enumerate(row):
                    floors[i, j], caps[i, j] = band["floor"], band["cap"]
            blocks[size] = (*of, _summaries(part), floors, caps)
    return blocks


def _ranked(found: DataFrame, bands: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "row_id")
    fits = found.join(bands, "anchor_id").where(F.col("score").between(F.col("floor"), F.col("cap")))
    return fits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(rows: DataFrame, anchors: DataFrame, bands: DataFrame, k: int, same_label: bool, n_blocks: int) -> DataFrame:
    """The ``k`` best rows of every band, ranked: columns of ``bands`` and (row_id, score, rank)."""
    context, done = rows.sparkSession.sparkContext, []
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0)

    def scanned(part: DataFrame, of: DataFrame, bands: DataFrame, name: str) -> DataFrame:
        block = context.broadcast(_block(of, bands))
        found = materialize(_scan(part, block, k, same_label), name)
        block.destroy()
        return _ranked(found, bands, k)

    for number in range(n_blocks):
        mine = F.pmod(F.xxhash64("anchor_id"), F.lit(n_blocks)) == number
        of = anchors.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == number)
        some = bands.where(mine)
        # The k-th best of a part of the rows is a floor for the k-th best of all.
        reached = scanned(sample, of, some, "seeds").where(F.col("rank") == k).select("anchor_id", "band", "score")
        raised = some.join(reached, ["anchor_id", "band"], "left")
        raised = materialize(raised.withColumn("floor", F.greatest("floor", "score")).drop("score"), "bands")
        done.append(materialize(scanned(rows, of, raised, "found"), "ranked"))
    return reduce(DataFrame.unionByName, done)


def _floor_percent(score: str, percent: int) -> str:
    """SQL: ``percent`` of a whole number, rounded down."""
    return f"(({score}) * {percent} - pmod(({score}) * {percent}, 100)) div 100"


def mine(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: float = 256, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``anchors`` (over ``id``) holds. A score is the inner product of
    floor(scale * x) of two vectors of one length; higher ones come first, ties by smaller id. The
    positives of an anchor are its ``n_positives`` best other rows with its label, the negatives of
    a positive the ``n_negatives`` best rows with another label that score ``low`` to ``high`` percent
    of it (all, if fewer). Every anchor is held against every row.

    Rows without an id or a label, without a vector, or with a null or non-finite component, take no
    part; of rows with one id, one does (see ``store``); quantised components beyond 2**24 count as
    2**24, so that scores fit a long; other columns are ignored; an empty table gives no rows.
    """
    rows = store(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale)
    own = materialize(rows.where(anchors), "anchors")
    numbers = own.agg(F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(1))), F.lit(0)).cast("long")).first()[0]
    n_blocks = max(1, -(-numbers // BLOCK_NUMBERS))
    everything = own.select(
        F.col("id").alias("anchor_id"), F.lit(0).cast("long").alias("band"), F.lit(-_NONE).alias("floor"), F.lit(_NONE).alias("cap")
    )
    positives = _best(rows, own, everything, n_positives, True, n_blocks)
    bands = positives.selectExpr(
        "anchor_id", "cast(rank AS long) AS band", "row_id AS positive_id", "score AS positive_score",
        f"-({_floor_percent('-score', low)}) AS floor", f"{_floor_percent('score', high)} AS cap",
    )
    bands = materialize(bands, "positives")
    found = _best(rows, own, bands, n_negatives, False, n_blocks)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
