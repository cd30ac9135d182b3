"""A folder of text files as a table of documents."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import fixed
from textloom.sources.files import read_files


def load_documents(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """``source, text`` for every ``*.txt`` file directly in the folder, one row per file.

    Names that start with ``_`` or ``.`` and empty files are files like any other. Line ends are
    normalised to ``\\n``. Sort by ``source`` where an order is wanted. The folder is listed by the
    tasks; the driver learns whether there is any file, not which.
    """
    files = read_files(spark, folder, ".txt", tasks=tasks)
    try:
        found = files.select("name").take(1)
    except PySparkException as error:
        if "FileNotFoundError" in str(error):
            raise FileNotFoundError(fixed.FOLDER_NOT_FOUND.format(path=folder)) from error
        raise
    if not found:
        raise FileNotFoundError(fixed.NO_DOCUMENTS.format(path=folder))
    return files.select(
        F.col("name").alias("source"),
        F.regexp_replace("text", r"\r\n?", "\n").alias("text"),
    )
