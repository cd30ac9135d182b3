"""Validations made on the driver before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from textloom import fixed


def require_columns(
    df: DataFrame, columns: Iterable[str], message: str = fixed.MISSING_COLUMNS
) -> DataFrame:
    """Raise unless ``df`` has the named columns; further columns are allowed."""
    absent = sorted(set(columns).difference(df.columns))
    if absent:
        raise ValueError(message.format(columns=absent))
    return df
