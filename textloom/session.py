"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Runtime settings this library is planned for. They are only defaults: a cluster's own
# configuration (shuffle partitions, memory, broadcast threshold) always wins.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hash instead of sort in a shuffled join whose build partitions turned out this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Needed where it is neither installed for the workers nor in their working folder; of no effect on
    a cluster whose executors do not have that folder.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("textloom")
    settings = {
        **SESSION_DEFAULTS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a machine-local
    folder would be unreachable for the other executors, so a missing setting is an error.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_DIR} to a folder all executors can reach.")
    local_root = os.environ.get("TEXTLOOM_LOCAL_SCRATCH") or tempfile.mkdtemp(prefix="textloom-")
    os.environ["TEXTLOOM_LOCAL_SCRATCH"] = local_root
    return local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root, never used before."""
    return f"{scratch_root(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a table read in fewer splits than there are cores.

    Only tables of a few row groups are moved; a table that already has enough splits is returned
    unchanged, so large inputs never pay for this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(
    df: DataFrame,
    name: str,
    *,
    path: str | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Write ``df`` as Parquet, by default to the scratch folder, and read it back.

    Cuts the lineage with a table in shared storage, so losing an executor later costs a re-read
    and not a re-computation.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the files of shuffles that nothing refers to any more.

    They stay on the executors' disks until the driver's JVM finds that out, which in a job of many
    shuffles and little garbage may be at its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
