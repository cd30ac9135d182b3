import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import split


def labelled(spark, sizes):
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string")


def largest_remainder(sizes, share=0.2):
    total = sum(sizes.values())
    n_test = math.ceil(total * share)
    whole = {k: n * n_test // total for k, n in sizes.items()}
    rest = {k: n * n_test % total for k, n in sizes.items()}
    for k in sorted(sizes, key=lambda k: (-rest[k], k))[: n_test - sum(whole.values())]:
        whole[k] += 1
    return whole


@pytest.mark.parametrize(
    "sizes",
    [
        {"s3": 4, "lambda": 4, "rds": 4},
        {"a": 1000, "b": 7, "c": 333, "d": 61},
        {"big": 5000, "x": 12, "y": 5},
    ],
)
def test_split_sizes_are_exact_and_reproducible(spark, sizes):
    rows = labelled(spark, sizes)
    one = split.stratified_split(rows, "id")
    two = split.stratified_split(rows.repartition(5), "id")
    test = Counter(r.label for r in one.test.collect())
    assert test == Counter({k: v for k, v in largest_remainder(sizes).items() if v})
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(one.test) == ids(two.test) and ids(one.train) == ids(two.train)
    assert ids(one.test) | ids(one.train) == ids(rows) and not ids(one.test) & ids(one.train)
    other = split.stratified_split(rows, "id", seed=1)
    assert sum(sizes.values()) < 100 or ids(other.test) != ids(one.test)


def test_coarse_buckets_rank_within_the_edge_bucket(spark, monkeypatch):
    rows = labelled(spark, {"a": 200, "b": 100})
    fine = {r.id for r in split.stratified_split(rows, "id").test.collect()}
    monkeypatch.setattr(split, "_BUCKET_DIGITS", 1)
    coarse = {r.id for r in split.stratified_split(rows, "id").test.collect()}
    assert fine == coarse


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 1}, {"a": 2, "b": 2}])
def test_too_small_labels_are_errors(spark, sizes):
    with pytest.raises(ValueError):
        split.stratified_split(labelled(spark, sizes), "id")


def test_rows_without_label_are_not_lost_silently(spark):
    rows = labelled(spark, {"a": 9}).union(labelled(spark, {"b": 3}).withColumn("label", F.lit(None)))
    with pytest.raises(Exception, match="without a label"):
        split.stratified_split(rows, "id")


def test_weighted_union(spark):
    base, extra = labelled(spark, {"a": 2}), labelled(spark, {"b": 3})
    assert Counter(r.label for r in split.weighted_union(base, extra).collect()) == {"a": 2, "b": 9}
    assert split.weighted_union(base, extra, 1).count() == 5
    with pytest.raises(ValueError, match="at least 1"):
        split.weighted_union(base, extra, 0)


def test_label_checks_and_counts(spark):
    known, new = labelled(spark, {"a": 2, "b": 1}), labelled(spark, {"b": 1, "z": 2, "c": 1})
    split.check_labels(known, known, "label")
    with pytest.raises(ValueError, match=r"unknown services: \['c', 'z'\]"):
        split.check_labels(new, known, "label")
    assert tuple(split.distinct_labels(new).first()) == (4, 3)
    weights = {r.label: r.weight for r in split.balanced_weights(new).collect()}
    assert weights == {"b": 4 / 3, "c": 4 / 3, "z": 4 / 6}


def test_training_pairs(spark):
    df = spark.createDataFrame([("s3", "Op", "text")], "service string, operation string, description string")
    assert split.training_pairs(df).columns == ["text", "label"]
    with pytest.raises(ValueError, match="description"):
        split.training_pairs(df.drop("description"))
    assert split.rows_of_label(split.training_pairs(df), "s3").select(F.col("text")).first()[0] == "text"
