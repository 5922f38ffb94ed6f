"""Running values over keys of any size.

Rows are dealt by ranges of key and order, so a key that holds all rows spans many tasks. A value is run within each range;
what comes from a key's earlier ranges is carried over by totals, of which a range has one that matters: that of its first
key, if the range before ends with the same. So what is broadcast is one row a range, whatever the rows or keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.storage import stage

_OVER = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
_TOTAL = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_at")))}
_BOTH = {"sum": lambda own, carry: F.when(own.isNull(), carry).otherwise(own + F.coalesce(carry, F.lit(0))), "max": lambda own, carry: F.greatest(own, carry), "last": lambda own, carry: F.coalesce(own, carry)}


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows as a staged table with _at, their place in (keys, order), and _part, their range. Ties in order cannot be split: it should end in an id."""
    at = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    return stage(at.withColumn("_part", F.shiftright("_at", 33)), "in-order")


def running(rows: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], *, before: bool = False) -> DataFrame:
    """rows (of in_order, also filtered) with a column for each of values: (sum | max | last, of what), over the key's rows up to each row.

    Nulls do not count; before: without the row's own value.
    """
    local = W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    own = rows.select("*", F.struct(*keys).alias("_key"), *[_OVER[f](c).over(local).alias(f"_own_{n}") for n, (f, c) in values.items()])
    # The first and last key of each range: one row a range, so one task can look at all.
    keyed = rows.select("*", F.struct(*keys).alias("_key"))
    ends = keyed.groupBy("_part").agg(F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"))
    goes_on = ends.withColumn("before", F.lag("last").over(W.orderBy("_part"))).filter("first = before").select(F.col("first").alias("_key")).distinct()
    totals = keyed.join(F.broadcast(goes_on), "_key").groupBy("_key", "_part").agg(*[_TOTAL[f](c).alias(n) for n, (f, c) in values.items()])
    earlier = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("_key", "_part", *[_OVER[f](F.col(n)).over(earlier).alias(f"_carry_{n}") for n, (f, _) in values.items()])
    both = own.join(F.broadcast(carried), ["_key", "_part"], "left")
    return both.select(*rows.columns, *[_BOTH[f](F.col(f"_own_{n}"), F.col(f"_carry_{n}")).alias(n) for n, (f, _) in values.items()])
