"""Packing of token sequences: bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import bytes_of, materialize
from textloom.llm.tokens import BYTE_BPE, byte_bpe

CAPACITY = 1024
OPEN_BINS = 4096
# Rows placed longest first; bounded by an Arrow batch.
WINDOW = 4096
TAILS_PER_TASK = 100_000
# Sequence ids: task in the upper bits, the number of the bin in its task in the lower ones.
_TASK_BITS = 36
_PIECE = ("piece", "start", "length", "ids_crc32")


class BestFit:
    """At most ``open_bins`` open bins; a bitset holds the free spaces that open bins have.

    An item goes to the open bin with the least sufficient space, else to a new bin; if that would
    be one too many, the fullest bin closes first.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be at least 1")
        self.capacity, self.open_bins = capacity, open_bins
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces = 0  # bit f: some open bin has f free
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        bin_ = stack.pop()
        if not stack:
            self.spaces &= ~(1 << space)
        return bin_

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item."""
        if length > self.capacity:
            raise ValueError(f"item of {length} exceeds the capacity {self.capacity}")
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.n_open == self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.n_open -= 1
            space, bin_ = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        left = space - length
        if left:
            self.by_space[left].append(bin_)
            self.spaces |= 1 << left
        else:
            self.n_open -= 1
        return bin_, self.capacity - space

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, filled) of the open bins."""
        return [(b, self.capacity - space) for space, bins in enumerate(self.by_space) for b in bins]


def cut(docs: DataFrame, *, ids_col: str = "ids", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the columns of ``docs`` with ``ids_col`` holding the piece's ids, and
    ``piece`` (from 0), ``start`` and ``length`` (long; columns of these names are replaced).

    Only arrays longer than ``capacity`` are cut, into pieces of that length; the first may be
    shorter. A null or empty array is one empty piece.
    """
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    n = F.size(ids)
    count = F.greatest(F.lit(1), F.ceil(n / capacity).cast("int"))
    first = n - (count - 1) * capacity

    def piece(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(first + (i - 1) * capacity)
        length = F.when(i == 0, first).otherwise(capacity)
        return F.struct(
            i.alias("piece"), start.cast("long").alias("start"), length.cast("long").alias("length"),
            F.slice(F.col(ids_col), start + 1, length).alias("ids"),
        )

    own = ("piece", "start", "length")
    kept = [c for c in docs.columns if c not in own]
    whole = docs.withColumn(ids_col, ids)
    rows = whole.select(*kept, F.explode(F.transform(F.sequence(F.lit(0), count - 1), piece)).alias("__piece"))
    return rows.select(
        *[F.col("__piece.ids").alias(c) if c == ids_col else F.col(c) for c in kept],
        *[F.col(f"__piece.{c}").alias(c) for c in own],
    )


@arrow_udf(T.LongType())
def ids_crc32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """CRC-32, unsigned, of ids written as little-endian unsigned 32-bit integers."""
    for batch in batches:
        values = batch.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = batch.offsets.to_numpy()
        yield pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def _cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: only the first may be shorter than the capacity."""
    count = max(1, -(-n // capacity))
    return [n - (count - 1) * capacity, *[capacity] * (count - 1)]


def _piece_rows(batches: Iterable[pa.RecordBatch], vocabulary: str | None, end_id: int | None, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of texts, without their ids: a window of about ``WINDOW`` pieces at a time."""
    bpe = byte_bpe(vocabulary or public_tokenizers.path(BYTE_BPE))
    tail = np.array([] if end_id is None else [end_id], "<u4")
    for batch in batches:
        texts, kept = batch.column("__text"), batch.drop_columns(["__text"])
        rows: list[int] = []
        own: list[tuple] = []

        def window(kept: pa.RecordBatch = kept, rows: list = rows, own: list = own) -> pa.RecordBatch:
            part = kept.take(pa.array(rows, pa.int64()))
            numbers = list(zip(*own, strict=True))
            columns = [pa.array(numbers[0], pa.int32()), *[pa.array(x, pa.int64()) for x in numbers[1:]], pa.array(numbers[2], pa.int64())]
            rows.clear()
            own.clear()
            return pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *_PIECE, "__length"])

        for i, text in enumerate(texts):
            ids = bpe.encode_to_numpy(text.as_py().decode("utf-8", "replace"), allowed_special="all").astype("<u4", copy=False)
            ids, start = np.concatenate([ids, tail]), 0
            for piece, length in enumerate(_cut_lengths(len(ids), capacity)):
                rows.append(i)
                own.append((piece, start, length, zlib.crc32(ids[start : start + length])))
                start += length
            if len(rows) >= WINDOW:
                yield window()
        if rows:
            yield window()


def _packer(capacity: int, open_bins: int):
    """A mapInArrow function: adds (sequence_id, offset); a task's open bins follow as marker rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, schema = BestFit(capacity, open_bins), None
        base = TaskContext.get().partitionId() << _TASK_BITS
        for batch in batches:
            lengths = batch.column("__length").to_numpy()
            found = np.zeros((len(lengths), 2), np.int64)
            for start in range(0, len(lengths), WINDOW):
                for i in np.argsort(-lengths[start : start + WINDOW], kind="stable") + start:
                    found[i] = packer.add(int(lengths[i]))
            schema = batch.schema
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found[:, 0] + base), pa.array(found[:, 1]), pa.array([False] * len(lengths))],
                names=[*schema.names, "__bin", "__at", "__open"],
            )
        tails = packer.still_open()
        if tails:
            arrays = [pa.nulls(len(tails), f.type) for f in schema]
            arrays[schema.get_field_index("__length")] = pa.array([x for _, x in tails], pa.int64())
            bins = pa.array([b + base for b, _ in tails], pa.int64())
            zero = pa.array([0] * len(tails), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*arrays, bins, zero, pa.array([True] * len(tails))],
                names=[*schema.names, "__bin", "__at", "__open"],
            )

    return run


def _text_packer(vocabulary: str | None, end_id: int | None, capacity: int, open_bins: int):
    """The same from texts: one pass from text to place, so that ids never leave the task."""
    place = _packer(capacity, open_bins)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return place(_piece_rows(batches, vocabulary, end_id, capacity))

    return run


def _placed_schema(fields: list[T.StructField]) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType, True) for f in fields]
    return T.StructType([*fields, T.StructField("__bin", T.LongType()), T.StructField("__at", T.LongType()), T.StructField("__open", T.BooleanType())])


def _place(rows: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    return rows.mapInArrow(_packer(capacity, open_bins), _placed_schema(rows.schema.fields))


def pack(
    pieces: DataFrame, *, length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (long; columns of these names are replaced).

    Pieces of a sequence lie side by side from offset 0 and fill at most ``capacity``. Every task
    packs the rows of its partition online in constant memory: windows of ``WINDOW`` rows as they
    come, the longest of a window first. The bins that tasks leave open
    are then packed again, as items, so that many small partitions don't leave many half-empty
    sequences; only their ids and fill move. A null length counts as 0; a longer piece than
    ``capacity`` is an error. An empty table stays empty.
    """
    rows = pieces.drop("sequence_id", "offset").withColumn("__length", F.coalesce(length_col, F.lit(0)).cast("long"))
    return _settled(materialize(_place(rows, capacity, open_bins), "packed"), capacity, open_bins)


def pack_texts(
    docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None, end_id: int | None = None,
    capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
) -> DataFrame:
    """The other columns of ``docs`` with ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece
    of the byte-level BPE ids of its text, then ``end_id``, and its ``sequence_id`` and ``offset``.

    Pieces are those of ``cut``, places those of ``pack``; columns of these names are replaced. Ids
    are made, cut, summed up and placed in one pass and never leave their task. A null text counts as
    empty; an empty table stays empty.
    """
    gone = {*_PIECE, "sequence_id", "offset", text_col}
    kept = [c for c in docs.columns if c not in gone]
    rows = docs.select(*kept, bytes_of(F.col(text_col)).alias("__text"))
    kinds = [T.IntegerType(), *[T.LongType()] * 4]
    own = [T.StructField(n, k) for n, k in zip((*_PIECE, "__length"), kinds, strict=True)]
    schema = _placed_schema([*(rows.schema[c] for c in kept), *own])
    run = _text_packer(vocabulary, end_id, capacity, open_bins)
    return _settled(materialize(rows.mapInArrow(run, schema), "packed"), capacity, open_bins)


def _settled(placed: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Pieces with their places, the bins that tasks left open being packed again."""
    tails = placed.where("__open").select(F.col("__bin").alias("tail"), "__length")
    tasks = -(-tails.count() // TAILS_PER_TASK)
    again = _place(tails.repartition(max(1, tasks)), capacity, open_bins).where("NOT __open")
    # Ids of the second round are below zero, those of the first are not.
    moved = again.select("tail", (-F.col("__bin") - 1).alias("to"), F.col("__at").alias("shift"))
    moved = materialize(moved, "packed-tails")
    done = placed.where("NOT __open").join(moved, F.col("__bin") == F.col("tail"), "left")
    kept = [c for c in placed.columns if not c.startswith("__")]
    return done.select(
        *kept,
        F.coalesce("to", "__bin").alias("sequence_id"),
        (F.col("__at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
