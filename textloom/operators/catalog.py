"""Operation records: flatten, standardise, clean, keep the first of each key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom import fixed
from textloom.checks import require_columns
from textloom.functions.html import clean_html
from textloom.functions.text import strip
from textloom.session import materialize

ORDER_COLUMNS = ("list_pos", "pos")


def extract_operations(models: DataFrame) -> DataFrame:
    """One record per operation of a parsed service model, plus ``list_pos`` and ``pos``.

    The two give the record's place (service in the list, operation in the document), since rows
    have no order of their own. An absent or null documentation is the empty string.
    """
    exploded = models.select(
        "service", "service_name", "api_version", "list_pos", F.posexplode("operations")
    )
    return exploded.select(
        "service",
        "service_name",
        "api_version",
        F.col("col.key").alias("operation"),
        F.coalesce("col.value.documentation", F.lit("")).alias("description"),
        "list_pos",
        "pos",
    )


def operations_per_service(models: DataFrame) -> DataFrame:
    """Number of operations per model, read off the nested column without exploding it."""
    return models.select(
        "service", "service_name", "api_version", F.size("operations").alias("n_operations")
    )


def standardise(records: DataFrame) -> DataFrame:
    """Strip the identifiers, lower-case the service, clean the description."""
    require_columns(records, fixed.OPERATION_COLUMNS)
    return records.withColumns(
        {
            "service": F.lower(strip("service")),
            "service_name": strip("service_name"),
            "api_version": strip("api_version"),
            "operation": strip("operation"),
            "description": clean_html("description"),
        }
    )


def first_per_key(
    records: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Column | None = None,
) -> DataFrame:
    """Per key the first row in ``order``, and how many rows it hid.

    Returns the keys, ``first`` (struct of the other columns, null if no row qualifies),
    ``n_rejected`` (rows failing ``keep``) and ``n_duplicates``. Written as an aggregate so that
    every map task sends at most one row per key: a key holding a large part of all rows costs no
    more than any other.
    """
    keep = F.lit(True) if keep is None else keep
    others = [c for c in records.columns if c not in keys]
    place = F.struct(*order)
    return records.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.when(keep, place)).alias("first"),
        F.count_if(~keep).alias("n_rejected"),
        F.greatest(F.count_if(keep) - 1, F.lit(0)).alias("n_duplicates"),
    )


# Bits of an order column that can be packed, by type.
_PACKED_BITS = {"tinyint": 32, "smallint": 32, "int": 32, "bigint": 64}


def packed_order(records: DataFrame, order: Sequence[str]) -> Column | None:
    """One number of fixed width that sorts as ``order`` does, nulls as the least value.

    A long or a decimal can be kept in place by a hash aggregate, which a struct cannot. None if the
    columns are no integers or take more than 96 bits.
    """
    kinds = dict(records.dtypes)
    bits = [_PACKED_BITS.get(kinds[c]) for c in order]
    if None in bits or not bits or sum(bits) > 96:
        return None
    whole = sum(bits) > 64
    packed = None
    for name, n in zip(order, bits, strict=True):
        value = F.coalesce(F.col(name).cast("bigint"), F.lit(-(1 << (n - 1))))
        if packed is None:
            packed = value.cast("decimal(20,0)") if whole else value
        elif whole:
            packed = packed * F.lit(Decimal(1 << n)) + (value.cast("decimal(20,0)") + F.lit(Decimal(1 << (n - 1))))
        else:
            packed = F.shiftleft(packed, n).bitwiseOR(value + F.lit(1 << (n - 1)))
    return packed.cast("decimal(38,0)") if whole else packed


@dataclass(frozen=True)
class Resolved:
    """``records``: a written table of standardised records with ``kept`` and ``place``, their packed
    order; ``keys``: ``service, operation, place, n_rejected, n_duplicates``, the place being that of
    the record that stays, null if none does."""

    records: DataFrame
    keys: DataFrame


def resolve_operations(
    records: DataFrame, order: Sequence[str] = ORDER_COLUMNS
) -> Resolved:
    """Standardise the records and find the first of every (service, operation).

    Records whose cleaned description is empty never win their key, so an empty record cannot hide
    a later good one. Only keys and places are shuffled to find it, in a hash aggregate whose map
    tasks send one row per key: a key holding a large part of all rows costs no more than any other.
    The records are cleaned once, into a written table; ``order`` must be integers of at most 96
    bits together.
    """
    place = packed_order(records, order)
    if place is None:
        raise ValueError(f"The order columns {list(order)} do not fit one number.")
    columns = [*fixed.OPERATION_COLUMNS, *order]
    cleaned = standardise(records).select(*columns)
    cleaned = materialize(
        cleaned.withColumns({"kept": F.coalesce(F.col("description") != "", F.lit(False)), "place": place}), "standardised"
    )
    keys = cleaned.groupBy("service", "operation").agg(
        F.min(F.when(F.col("kept"), F.col("place"))).alias("place"),
        F.count_if(~F.col("kept")).alias("n_rejected"),
        F.greatest(F.count_if("kept") - 1, F.lit(0)).alias("n_duplicates"),
    )
    return Resolved(cleaned, keys)


def clean_operations(resolved: Resolved, extra: Sequence[str] = ()) -> DataFrame:
    """The surviving records in the fixed column order.

    They are fetched by key and place, which spreads a crowded key over all tasks. Of records that
    share even their place the one with the smallest hash stays.
    """
    named = {c: f"_{c}" for c in ("service", "operation", "place")}
    winners = resolved.keys.where(F.col("place").isNotNull()).select(*[F.col(c).alias(n) for c, n in named.items()])
    # A null service or operation is a key like any other.
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()])
    kept = resolved.records.where("kept").join(winners, same, "left_semi")
    ties = W.partitionBy("service", "operation", "place").orderBy(F.xxhash64("service_name", "api_version", "description"))
    first = kept.withColumn("_tie", F.row_number().over(ties)).where("_tie = 1")
    return first.select(*fixed.OPERATION_COLUMNS, *extra)


def removed_operations(resolved: Resolved) -> DataFrame:
    """``service, operation, reason, n_removed`` for everything that did not survive."""
    reasons = F.array(
        F.struct(F.lit("empty").alias("reason"), F.col("n_rejected").alias("n_removed")),
        F.struct(F.lit("duplicate").alias("reason"), F.col("n_duplicates").alias("n_removed")),
    )
    return resolved.keys.select("service", "operation", F.inline(reasons)).where("n_removed > 0")


def stage_counts(resolved: Resolved) -> DataFrame:
    """One row: records in, records out, and the two kinds of removal."""
    found = F.col("place").isNotNull()
    return resolved.keys.agg(
        F.sum(F.col("n_rejected") + F.col("n_duplicates") + found.cast("long")).alias("n_in"),
        F.count_if(found).alias("n_out"),
        F.sum("n_rejected").alias("n_empty"),
        F.sum("n_duplicates").alias("n_duplicate"),
    )
