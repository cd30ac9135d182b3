import pytest
from pyspark.sql import functions as F

from textloom.operators import catalog
from textloom.plans.catalog_job import run_catalog_job
from textloom.sources.models import parse_service_models


def cleaned(records):
    return catalog.clean_operations(catalog.resolve_operations(records))


def test_values_are_standardised(operations):
    padded = operations.where("pos = 0").withColumns(
        {"service": F.lit(" S3 "), "operation": F.lit(" WeighParcel ")}
    )
    row = cleaned(padded).first()
    assert (row.service, row.operation, row.description) == ("s3", "WeighParcel", "Weighs a parcel.")


def test_duplicates_keep_the_first_and_case_matters(spark, operations):
    more = operations.where("pos = 0").withColumns({"pos": F.lit(5), "description": F.lit("later")})
    other = operations.where("pos = 0").withColumns({"pos": F.lit(6), "operation": F.lit("weighparcel")})
    rows = cleaned(operations.union(more).union(other)).collect()
    assert {(r.operation, r.description) for r in rows} == {
        ("WeighParcel", "Weighs a parcel."), ("RouteParcel", "Routes a parcel."), ("weighparcel", "Weighs a parcel."),
    }


def test_an_empty_record_does_not_hide_a_later_good_one(operations):
    empty = operations.where("pos = 0").withColumns({"pos": F.lit(-1), "description": F.lit("<p> </p>")})
    resolved = catalog.resolve_operations(operations.union(empty))
    assert catalog.clean_operations(resolved).count() == 2
    removed = [tuple(r) for r in catalog.removed_operations(resolved).collect()]
    assert removed == [("example", "WeighParcel", "empty", 1)]
    assert tuple(catalog.stage_counts(resolved).first()) == (3, 2, 1, 0)


def test_missing_column(operations):
    with pytest.raises(ValueError, match=r"Missing required columns: \['description'\]"):
        catalog.resolve_operations(operations.drop("description"))


def test_a_key_with_most_rows_is_reduced_before_the_shuffle(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    first = catalog.first_per_key(rows.withColumn("v", F.col("id") * 2), ["k"], ["id"])
    hot = first.where("k = 'hot'").first()
    assert (hot["first"]["v"], hot.n_duplicates) == (0, 6666)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


ORDERS = "list_pos int, pos long, small smallint"


def test_packed_order_sorts_like_the_columns(spark):
    numbers = [None, -(2**31), -5, -1, 0, 1, 7, 2**31 - 1]
    rows = [(a, b, c) for a in numbers for b in [*numbers[1:], 2**63 - 1, -(2**63)] for c in (None, -3, 3)]
    df = spark.createDataFrame(rows, ORDERS)
    least = {"list_pos": -(2**31), "pos": -(2**63), "small": -(2**31)}
    for order in (["pos"], ["list_pos", "small"], ["list_pos", "pos"], ["small"]):
        found = df.select(*order, catalog.packed_order(df, order).alias("p")).distinct().collect()
        keys = sorted((tuple(least[c] if r[c] is None else r[c] for c in order), r.p) for r in found)
        assert [p for _, p in keys] == sorted(p for _, p in keys)
        assert all((a[0] < b[0]) == (a[1] < b[1]) for a, b in zip(keys, keys[1:]))
    assert catalog.packed_order(df, ["pos", "pos"]) is None
    assert catalog.packed_order(df.withColumn("pos", F.lit("x")), ["pos"]) is None
    with pytest.raises(ValueError, match="do not fit one number"):
        catalog.resolve_operations(df, ["pos", "pos"])


def test_keys_are_resolved_by_a_hash_aggregate_without_texts(operations):
    keys = catalog.resolve_operations(operations).keys
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "description" not in plan.split("Exchange")[0]


def test_null_keys_and_ties_keep_one_record(spark, operations):
    null = operations.where("pos = 0").withColumn("service", F.lit(None).cast("string"))
    tied = operations.where("pos = 0").withColumn("description", F.lit("another"))
    rows = operations.union(null).union(null).union(tied).union(tied)
    resolved = catalog.resolve_operations(rows)
    kept = catalog.clean_operations(resolved).collect()
    assert sorted(str((r.service, r.operation)) for r in kept) == [
        "('example', 'RouteParcel')", "('example', 'WeighParcel')", "(None, 'WeighParcel')",
    ]
    assert tuple(catalog.stage_counts(resolved).first()) == (6, 3, 0, 3)
    assert {r.description for r in kept if r.service} <= {"Weighs a parcel.", "Routes a parcel.", "another"}


def test_catalogue_job_writes_raw_before_clean(spark, tmp_path):
    model = (
        '{"metadata": {"serviceFullName": " S ", "apiVersion": "1"}, "operations": '
        '{" A ": {"documentation": "<b>x</b>"}, "A": {"documentation": "y"}, "B": {}}}'
    )
    df = spark.createDataFrame([(" S3", 0, model)], "service string, list_pos int, model string")
    raw, clean = str(tmp_path / "raw"), str(tmp_path / "clean")
    result = run_catalog_job(parse_service_models(df), raw, clean)
    assert (result.n_raw, result.n_services, result.n_clean) == (3, 1, 1)
    assert [tuple(r) for r in result.clean.collect()] == [("s3", "S", "1", "A", "x")]
    assert spark.read.parquet(raw).count() == 3
    assert catalog.operations_per_service(parse_service_models(df)).first().n_operations == 3
