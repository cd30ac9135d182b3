"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import materialize, scratch_path

__all__ = ["bytes_of", "materialize", "read", "scratch_path", "slices", "text_batches", "unicode_offsets"]


# Rows of whole texts that Spark hands to Python at once; its own default is 10,000.
TEXT_ROWS = 1000
# Bytes of text that an Arrow function takes at once, unless a single text is longer.
SLICE_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold no more than ``TEXT_ROWS`` rows: both the JVM's and Python's
    copies of a batch then stay small beside an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; see ``text_batches``."""
    text_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def slices(batches: Iterator[pa.Array], rows: int = 1000, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The batches of an Arrow function in smaller parts, by rows and, for texts, by bytes, so that
    whole texts and what is made of them stay small in memory."""
    for batch in batches:
        start = 0
        sized = pa.types.is_string(batch.type) or pa.types.is_binary(batch.type)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy()) if sized else None
        while start < len(batch):
            stop = start + rows
            if sized:
                before = ends[start - 1] if start else 0
                stop = min(stop, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def unicode_offsets(data: bytes, positions: list[int]) -> list[int]:
    """Code-point offsets of ascending byte positions in UTF-8 ``data``."""
    if data.isascii():
        return positions
    out, seen, at = [], 0, 0
    for position in positions:
        at += len(data[seen:position].decode("utf-8", "replace"))
        seen = position
        out.append(at)
    return out
