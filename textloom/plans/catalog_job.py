"""Catalogue job: models to raw records to clean records, two written tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom import fixed
from textloom.operators import catalog
from textloom.sources.tables import write_operations


@dataclass(frozen=True)
class CatalogResult:
    clean: DataFrame
    n_raw: int
    n_services: int
    n_clean: int


def run_catalog_job(models: DataFrame, raw_path: str, clean_path: str) -> CatalogResult:
    """Write the raw records, then the clean ones computed from the raw table.

    The raw table also keeps the two order columns: which duplicate came first is otherwise lost.
    Counts are observed by the very tasks that write, in the last stage of each job, where Spark
    counts a partition once however often it is tried; neither table is read again for them. The
    names of the services meet on the driver.
    """
    seen, left = Observation("raw"), Observation("clean")
    records = catalog.extract_operations(models)
    services = F.size(F.collect_set("service")).cast("long")
    write_operations(
        records.observe(seen, F.count(F.lit(1)).alias("n"), services.alias("n_services")), raw_path, extra=catalog.ORDER_COLUMNS
    )

    spark = models.sparkSession
    resolved = catalog.resolve_operations(spark.read.parquet(raw_path))
    write_operations(catalog.clean_operations(resolved).observe(left, F.count(F.lit(1)).alias("n")), clean_path)
    return CatalogResult(
        clean=spark.read.parquet(clean_path).select(*fixed.OPERATION_COLUMNS),
        n_raw=seen.get["n"],
        n_services=seen.get["n_services"],
        n_clean=left.get["n"],
    )
