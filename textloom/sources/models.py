"""Nested service-model documents: one JSON document per service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from textloom import fixed
from textloom.checks import require_columns
from textloom.sources.files import read_files

MODEL_SCHEMA = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("serviceFullName", T.StringType()),
                    T.StructField("apiVersion", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "operations",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("documentation", T.StringType())]),
            ),
        ),
    ]
)

# Reads every file of a folder instead of a list.
ALL_SERVICES = "*"

# An allow-list this long is broadcast; a longer one is joined by shuffle.
BROADCAST_LIST_LENGTH = 10_000


def read_service_models(
    spark: SparkSession, folder: str, services: Sequence[str] | None = None
) -> DataFrame:
    """Parsed models plus ``list_pos`` from the files ``<folder>/<service>.json``.

    Only the files of the listed services are opened, each once; ``list_pos`` is the place in the
    list, so a name that is listed twice has its rows twice, and a name without a file fails the job.
    ``None`` means the default list, ``ALL_SERVICES`` every JSON file of the folder, by name.
    """
    services = fixed.DEFAULT_SERVICES if services is None else services
    if not services:
        empty = spark.createDataFrame([], "service string, model string, list_pos int")
        return parse_service_models(empty)
    if services != ALL_SERVICES:
        files = read_files(spark, folder, ".json", names=services)
        return parse_service_models(files.select(F.col("name").alias("service"), F.col("text").alias("model"), "list_pos"))
    models = read_files(spark, folder, ".json").select(
        F.regexp_replace("name", r"\.json$", "").alias("service"), F.col("text").alias("model")
    )
    # Names only, one per file, meet in the task that numbers them.
    names = models.select("service").distinct()
    place = F.row_number().over(W.orderBy("service")) - 1
    models = models.join(names.withColumn("list_pos", place.cast("int")), "service")
    return parse_service_models(models)


def parse_service_models(models: DataFrame) -> DataFrame:
    """Parse the JSON column ``model``; every other column is kept.

    Missing metadata or operations fail the job when the value is read, as there is no sensible
    record without them. A repeated operation name counts once, with its last value.
    """
    require_columns(models, ("service", "model"))
    kept = [c for c in models.columns if c != "model"]
    parsed = models.select(*kept, F.from_json("model", MODEL_SCHEMA).alias("m"))

    def present(path: str) -> Column:
        return F.coalesce(
            F.col(f"m.{path}"),
            F.raise_error(F.concat(F.lit(f"No {path} in service model: "), F.col("service"))),
        )

    return parsed.select(
        *kept,
        present("metadata.serviceFullName").alias("service_name"),
        present("metadata.apiVersion").alias("api_version"),
        _last_value_per_key(present("operations")).alias("operations"),
    )


def _last_value_per_key(m: Column) -> Column:
    """Map entries in document order; of a repeated key the last value at the first place."""
    keys, values = F.map_keys(m), F.map_values(m)
    distinct = F.array_distinct(keys)

    def entry(key: Column) -> Column:
        from_end = F.array_position(F.reverse(keys), key)
        at = (F.size(keys) - from_end + F.lit(1)).cast("int")
        return F.struct(key.alias("key"), F.element_at(values, at).alias("value"))

    return F.when(F.size(distinct) == F.size(keys), F.map_entries(m)).otherwise(
        F.transform(distinct, entry)
    )


def _positioned(df: DataFrame, services: Sequence[str]) -> DataFrame:
    listed = df.sparkSession.createDataFrame(
        [(name, position) for position, name in enumerate(services)],
        "service string, list_pos int",
    )
    # The list lives on the driver already, so its length is a proven bound.
    if len(services) <= BROADCAST_LIST_LENGTH:
        listed = F.broadcast(listed)
    return df.join(listed, "service")


def select_services(df: DataFrame, services: Sequence[str] | None = None) -> DataFrame:
    """Rows of the listed services plus ``list_pos``, their place in the list.

    ``None`` selects the default list, an empty list selects nothing, and a listed service without
    any row is an error (checked by one pass over the ``service`` column).
    """
    require_columns(df, ("service",))
    services = fixed.DEFAULT_SERVICES if services is None else list(services)
    rows = df.drop("list_pos")
    # At most one row per listed name comes back to the driver.
    seen = _positioned(rows.select("service"), services).select("service").distinct().collect()
    found = {row.service for row in seen}
    absent = [name for name in services if name not in found]
    if absent:
        raise ValueError(f"Unknown services: {absent}")
    return _positioned(rows, services)
