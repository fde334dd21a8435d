"""Guards that fail a query where a join would silently drop rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def require_known(rows: DataFrame, known: DataFrame, key: str | Sequence[str], what: str) -> DataFrame:
    """The rows; one whose key (a column, or several) is not among `known` raises an error, whichever columns are read and joined later.

    The guard is a filter, and the keys come out of it too: Spark infers filters on a key from what it is joined with
    later, and would push them below the guard if the key were that of the rows alone.
    """
    keys = [key] if isinstance(key, str) else list(key)
    have = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    named = F.concat_ws(" ", F.lit(f"{what}:"), *[F.col(k).cast("string") for k in keys])
    stop = lambda kind: F.raise_error(named).cast(kind)
    kinds = dict(rows.dtypes)
    guarded = rows.join(have, keys, "left").where(F.when(F.col("_known"), True).otherwise(stop("boolean")))
    return guarded.select(*[F.when(F.col("_known"), F.col(c)).otherwise(stop(kinds[c])).alias(c) if c in keys else c for c in rows.columns])


def good_price(price: Column) -> Column:
    """Whether a price can be traded at: there, finite and above zero."""
    return F.coalesce((price > 0) & ~F.isnan(price) & (price < float("inf")), F.lit(False))
