"""Joins and running totals that stay balanced when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.session import cut_lineage

MAX_HOT_KEYS = 256


def join_group_facts(members: DataFrame, per_group: DataFrame, keys: Sequence[str], size: str,
                     hot_rows: int = 100_000) -> DataFrame:
    """Inner-join every member row with the single row that describes its group.

    Groups of at least ``hot_rows`` rows, the largest ``MAX_HOT_KEYS`` of them
    by construction of the limit, are joined by broadcast, so their members
    never move.  All other groups go through an ordinary shuffle join; once the
    biggest 256 are gone none can hold more than 1/257 of the rows.  Both
    branches together are the whole join.
    """
    keys = list(keys)
    per_group = cut_lineage(per_group)
    hot = per_group.where(F.col(size) >= hot_rows).orderBy(F.col(size).desc(), *keys).limit(MAX_HOT_KEYS)
    if hot.isEmpty():
        return members.join(per_group, keys)
    hot_keys = F.broadcast(hot.select(*keys))
    heavy = members.join(F.broadcast(hot), keys)
    rest = members.join(hot_keys, keys, "left_anti").join(per_group.join(hot_keys, keys, "left_anti"), keys)
    return heavy.unionByName(rest)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                  value: Column, name: str) -> DataFrame:
    """Cumulative ``value`` per key without putting a whole key into one task.

    ``bucket`` must be non-decreasing along ``order``.  Rows are summed inside
    (key, bucket) first; only the bucket totals, one row each, are accumulated
    over the key, and the offset goes back by an equi-join on (key, bucket).
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = tagged.withColumn("_inside", F.sum("_value").over(inside))
    return (local.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_inside"))
            .drop("_bucket", "_value", "_inside", "_before"))


def overall_total(df: DataFrame, order: Sequence[str], value: Column, name: str, bucket_rows: int = 65_536) -> DataFrame:
    """Cumulative ``value`` over a whole table along the columns ``order``, which must be a key of it.

    The table is cut into ranges of about ``bucket_rows`` rows, whatever its ids
    look like, and stored, so that a row stays in its range when a task is
    repeated.  One row per range is accumulated over the table.
    """
    stored = cut_lineage(df.withColumn("_value", value))
    parts = max(1, -(-stored.count() // bucket_rows))
    ranged = cut_lineage(stored.repartitionByRange(parts, *order).withColumn("_bucket", F.spark_partition_id()))
    total = running_total(ranged.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in order], F.col("_bucket"),
                          F.col("_value"), name)
    return total.drop("_all")
