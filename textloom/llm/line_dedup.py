"""Corpus-wide removal of repeated lines with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize, scratch_path

MIN_CHARS = 40
MIN_DOCUMENTS = 5
BATCHES = 4
FANOUT = 2
BLANKS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Stands for a null id: below every other, as null sorts first.
_NULL_ID = -(1 << 63)
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    stripped = F.btrim(line, F.lit(BLANKS))
    # lower() touches nothing but A-Z in pure ASCII, and is much faster than translate().
    ascii_only = F.octet_length(stripped) == F.length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _UPPER.lower()))


def _hashes(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Line hashes (``h1``, ``h2``) with the document that keeps the line, in levelled sorted runs.

    A run is a table bucketed and sorted by the hash pair, so that a batch shuffled once by the same
    hash meets every run in a merge join without moving it. ``fanout`` runs of a level are merged
    into one run of the next. Tables lie in shared storage, below ``path``.
    """

    def __init__(self, spark: SparkSession, *, fanout: int = FANOUT, path: str | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch_path(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, *_KEY)
            .sortWithinPartitions(*_KEY)
            .write.option("path", f"{self.path}/{name}")
            .bucketBy(self.buckets, *_KEY)
            .sortBy(*_KEY)
            .saveAsTable(name)
        )
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Add one row per new hash pair of ``batch`` (h1, h2, doc_id); returns the rows that were new.

        Of several rows with the same hash the largest ``doc_id`` is taken.
        """
        fresh = batch.groupBy(*_KEY).agg(F.max("doc_id").alias("doc_id")).repartition(self.buckets, *_KEY)
        for run in (run for level in self.levels for run in level):
            fresh = fresh.join(self.spark.table(run).hint("merge"), _KEY, "left_anti")
        name = self._write(fresh)
        self.levels[0].append(name)
        added = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/{name}")
        self._compact()
        return added

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) < self.fanout:
                continue
            runs, self.levels[depth] = self.levels[depth], []
            merged = self.spark.table(runs[0])
            for run in runs[1:]:
                merged = merged.unionAll(self.spark.table(run))
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._write(merged))
            # The last added run's files are still read by the caller; external files stay anyway.
            self._forget(runs)

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def close(self) -> None:
        """Forget the tables."""
        for level in self.levels:
            self._forget(level)
        self.levels = [[]]


def _dropped(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int, batches: int) -> DataFrame:
    """(h1, h2, doc_id) of the lines each document loses."""
    spark = docs.sparkSession
    long = F.filter(_lines(F.col(text_col)), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars)
    found = docs.select(
        F.coalesce(F.col(id_col), F.lit(_NULL_ID)).alias("doc_id"),
        F.explode(F.array_distinct(F.transform(long, _hashes))).alias("h"),
    )
    found = materialize(found.select("doc_id", "h.*"), "line-hashes")
    frequent = found.groupBy(*_KEY).count().where(F.col("count") >= min_documents).select(*_KEY)
    # Written, so that the join below reads both sides anew and a very common line can be split.
    frequent = materialize(frequent, "frequent-lines")
    found = materialize(found.join(frequent, _KEY), "repeated-lines")
    shares = [F.lit(i / batches) for i in range(batches - 1, 0, -1)]
    limits = found.agg(F.percentile_approx("doc_id", F.array(*shares)).alias("x")).first()["x"] if shares else []
    runs, path = LineRuns(spark), scratch_path(spark, "dropped-lines")
    doc_id, upper = F.col("doc_id"), None
    try:
        # From the largest ids down: whoever comes first keeps the line.
        for lower in [*(limits or []), None]:
            batch = found
            if upper is not None:
                batch = batch.where(doc_id < upper)
            if lower is not None:
                batch = batch.where(doc_id >= lower)
                upper = lower
            added = runs.add(batch)
            batch.join(added, [*_KEY, "doc_id"], "left_anti").write.mode("append").parquet(path)
    finally:
        runs.close()
    return spark.read.schema(found.select("doc_id", *_KEY).schema).parquet(path)


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``.

    Lines are split at ``\\n`` (a null or empty text is one empty line). Lines whose key has at
    least ``min_chars`` code points and is found in at least ``min_documents`` rows go, all of them,
    except in the largest id that holds the key. Other lines stay, joined by ``\\n``. Rows that
    repeat an id count as documents of their own and are treated alike; a null id is below all
    others. An empty table stays empty; other columns pass through. ``counts`` names two columns for
    the lines before and the lines dropped; columns of these names are replaced.

    Keys are compared by 128 bits of hash. Only hashes and ids of repeated lines are batched through
    :class:`LineRuns`; texts move once, to meet the list of their own dropped keys.
    """
    gone = _dropped(docs, id_col, text_col, min_chars, min_documents, batches)
    gone = gone.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct(*_KEY)).alias("__gone"))
    kept_columns = [c for c in docs.columns if not counts or c not in counts]
    joined = docs.join(gone, F.coalesce(F.col(id_col), F.lit(_NULL_ID)) == F.col("__doc"), "left")
    lines = _lines(F.col(text_col))
    kept = F.when(
        F.col("__gone").isNotNull(),
        F.filter(
            lines,
            lambda line: (F.length(F.btrim(line, F.lit(BLANKS))) < min_chars)
            | ~F.array_contains(F.col("__gone"), _hashes(line)),
        ),
    ).otherwise(lines)
    joined = joined.withColumns({"__before": F.size(lines).cast("long"), "__kept": kept})
    out = [
        (F.array_join("__kept", "\n") if c == text_col else F.col(c)).alias(c) for c in kept_columns
    ]
    if counts:
        out += [
            F.col("__before").alias(counts[0]),
            (F.col("__before") - F.size("__kept")).cast("long").alias(counts[1]),
        ]
    return joined.select(*out)
