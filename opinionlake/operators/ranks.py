"""Ranks and running sums that stay bounded when one key holds much of the table.

``top_rows`` filters ``row_number() <= k`` so Spark keeps at most k rows per key and task before
the shuffle. ``block_rank``/``block_sum`` split each key into blocks of a unique integer order
column, rank inside a block, and add the totals of the blocks before it: no task ever holds more
than one block of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 262_144


def top_rows(df: DataFrame, keys, order, k: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def page_rows(df: DataFrame, keys, order, page: int, size: int) -> DataFrame:
    ranked = top_rows(df, keys, order, page * size, rank="_rank")
    return ranked.filter(F.col("_rank") > (page - 1) * size).drop("_rank")


def _with_offsets(df: DataFrame, keys, order: str, value: Column, block: int) -> DataFrame:
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    offsets = totals.select(
        *renamed, F.col("_block").alias("_kb"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block") == F.col("_kb")]
    return blocked.join(offsets, on, "left").drop("_kb", *[f"_k{i}" for i in range(len(keys))])


def block_rank(df: DataFrame, keys, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """1-based position of each row among its key, by a unique integer order column."""
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    out = _with_offsets(df, keys, order, F.lit(1).cast("bigint"), block)
    out = out.withColumn(name, F.row_number().over(inside) + F.col("_offset"))
    return out.drop("_block", "_value", "_offset")


def block_sum(df: DataFrame, keys, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Running total up to and including each row."""
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_offsets(df, keys, order, value, block)
    out = out.withColumn(name, F.sum("_value").over(inside) + F.col("_offset"))
    return out.drop("_block", "_value", "_offset")


def block_lag(df: DataFrame, keys, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``value`` of the row before each row of its key, by a unique integer order column."""
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = blocked.withColumn(name, F.lag(value).over(Window.partitionBy(*keys, "_block").orderBy(order)))
    first = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) == 1
    inside = inside.withColumn("_first", first)
    tails = blocked.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_tail"))
    carried = tails.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_kb"),
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block") == F.col("_kb")]
    joined = inside.join(carried, on, "left")
    joined = joined.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name)))
    return joined.drop("_block", "_first", "_kb", "_carry", *[f"_k{i}" for i in range(len(keys))])
