"""Labelled data: selection, counts, label checks, stratified hold-out, weighted union."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom import fixed
from textloom.checks import require_columns
from textloom.session import materialize


def training_pairs(
    df: DataFrame, text_col: str = "description", label_col: str = "service", *keep: str
) -> DataFrame:
    """``text, label`` (and any columns named in ``keep``)."""
    require_columns(df, (text_col, label_col))
    return df.select(*keep, F.col(text_col).alias("text"), F.col(label_col).alias("label"))


def rows_per_label(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def distinct_labels(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("label").alias("n_labels"))


def rows_of_label(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col("label") == label)


def unknown_labels(candidates: DataFrame, known: DataFrame, label_col: str = "service") -> DataFrame:
    """Distinct labels of ``candidates`` that ``known`` lacks."""
    return (
        candidates.select(label_col)
        .distinct()
        .join(known.select(label_col).distinct(), label_col, "left_anti")
    )


def check_labels(candidates: DataFrame, known: DataFrame, label_col: str = "service") -> None:
    unknown = sorted(r[0] for r in unknown_labels(candidates, known, label_col).collect())
    if unknown:
        raise ValueError(fixed.UNKNOWN_SERVICES.format(services=unknown))


def balanced_weights(df: DataFrame) -> DataFrame:
    """``label, n, weight`` with weight = rows / (labels * rows of the label)."""
    counts = rows_per_label(df)
    everything = W.partitionBy()
    return counts.select(
        "label",
        "n",
        (
            F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
        ).alias("weight"),
    )


def weighted_union(
    base: DataFrame, extra: DataFrame, weight: int = fixed.INTENT_WEIGHT
) -> DataFrame:
    """All rows of ``base`` and ``weight`` copies of each row of ``extra``; adds ``copy``.

    ``copy`` is 0 for base rows and 1..weight for the copies, so ids stay unique together with it.
    """
    if weight < 1:
        raise ValueError(fixed.WEIGHT_POSITIVE)
    copies = extra.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(weight))))
    return base.withColumn("copy", F.lit(0)).unionByName(copies)


# Hex digits of the hash that make a bucket: 65,536 buckets per label.
_BUCKET_DIGITS = 4


@dataclass(frozen=True)
class Split:
    """``parts``: all rows with ``part``, 'train' or 'test', in one scan; the others are its two halves."""

    parts: DataFrame
    columns: tuple[str, ...]

    @property
    def train(self) -> DataFrame:
        return self.parts.where("part = 'train'").select(*self.columns)

    @property
    def test(self) -> DataFrame:
        return self.parts.where("part = 'test'").select(*self.columns)


def place_key(id_col: str, seed: int) -> Column:
    """The pseudo-random, layout-independent sort key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def label_quotas(label_counts: DataFrame, test_share: float = fixed.TEST_SHARE) -> DataFrame:
    """``label, n, quota``: test rows per label by largest remainder, ties by label.

    The test size is the share of all rows, rounded up. Sorting all labels in one task is fine:
    there is one row per label.
    """
    everything = W.partitionBy()
    shares = label_counts.withColumn("total", F.sum("n").over(everything)).withColumn(
        "n_test", F.ceil(F.col("total") * F.lit(test_share)).cast("long")
    )
    # Wide integer arithmetic keeps quotients and remainders exact.
    product = F.col("n").cast("decimal(18,0)") * F.col("n_test").cast("decimal(18,0)")
    exact = shares.withColumn("product", product).select(
        "label",
        "n",
        "n_test",
        F.expr("product div total").alias("whole"),
        F.expr("product % total").alias("rest"),
    )
    open_seats = F.col("n_test") - F.sum("whole").over(everything)
    rank = F.row_number().over(W.orderBy(F.desc("rest"), "label"))
    return exact.select(
        "label",
        "n",
        (F.col("whole") + F.when(rank <= open_seats, 1).otherwise(0)).alias("quota"),
    )


def stratified_split(
    df: DataFrame,
    id_col: str,
    test_share: float = fixed.TEST_SHARE,
    seed: int = fixed.RANDOM_SEED,
) -> Split:
    """Exact stratified hold-out: per label the ``quota`` rows with the smallest hash.

    Rows are counted per (label, hash bucket). Only the one bucket per label in which the quota falls
    is ranked, 1/65,536 of the label's rows, so a label holding a large part of the data is never
    sorted in one task; that gives the last row of the label's test set. Every row then finds its part
    by comparing itself to its label's last one, in one scan. ``id_col`` is unique.
    """
    # A row without a label belongs to no stratum: better to fail than to lose it in a join.
    no_label = F.raise_error(F.lit("Rows without a label cannot be split.")).cast("string")
    keyed = df.withColumns(
        {
            "label": F.coalesce(F.col("label").cast("string"), no_label),
            "_place": place_key(id_col, seed),
        }
    ).withColumn("_bucket", F.substring("_place", 1, _BUCKET_DIGITS))
    buckets = keyed.groupBy("label", "_bucket").agg(F.count("*").alias("_n"))
    quotas = label_quotas(buckets.groupBy("label").agg(F.sum("_n").alias("n")), test_share)
    below = F.coalesce(
        F.sum("_n").over(
            W.partitionBy("label").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    # The bucket where the quota falls: what is below it does not fill the quota, it does. A quota
    # of 0 falls before the first bucket.
    edges = materialize(
        buckets.withColumn("_below", below)
        .join(quotas, "label")
        .where(
            (F.col("_below") < F.greatest("quota", F.lit(1)))
            & (F.col("_below") + F.col("_n") >= F.greatest("quota", F.lit(1)))
        )
        .select(
            "label",
            F.col("_bucket").alias("_edge"),
            (F.col("quota") - F.col("_below")).alias("_take"),
            "n",
            "quota",
        ),
        "split-edges",
    )
    _check_split(edges)

    key = F.struct("_place", F.col(id_col).alias("_id"))
    ranked = keyed.join(edges.select("label", "_edge", "_take"), "label").where(
        F.col("_bucket") == F.col("_edge")
    )
    rank = F.row_number().over(W.partitionBy("label").orderBy("_place", id_col))
    last = ranked.withColumn("_rank", rank).where(F.col("_rank") == F.col("_take"))
    # A label without a quota has no last row: all of it is for training.
    last = materialize(
        edges.select("label").join(last.select("label", key.alias("_last")), "label", "left"),
        "split-last",
    )
    is_test = F.coalesce(key <= F.col("_last"), F.lit(False))
    parts = keyed.join(last, "label").select(
        *df.columns, F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("part")
    )
    return Split(parts, tuple(df.columns))


def _check_split(edges: DataFrame) -> None:
    seen = edges.agg(
        F.count("*").alias("labels"),
        F.min("n").alias("smallest"),
        F.sum("quota").alias("n_test"),
        F.sum(F.col("n") - F.col("quota")).alias("n_train"),
    ).first()
    if not seen.labels:
        raise ValueError("Cannot split an empty table.")
    if seen.smallest < 2:
        raise ValueError("Every label needs at least two rows.")
    if seen.n_test < seen.labels or seen.n_train < seen.labels:
        raise ValueError("Both sides of the split need at least as many rows as there are labels.")
