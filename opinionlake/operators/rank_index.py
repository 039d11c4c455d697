"""Pages of any depth: rows lie in ranges of their order, and counts by key and range tell which range holds a page.

A range is a share of all rows in the order (keys, order), so a key with a third of all rows has many ranges and a small key a part of
one. The summary, one row per key and range, gives the rows of the key before the range. A page reads the one or two ranges whose
places meet it and ranks only these; its cost does not grow with its number. Rows equal in key and order have no fixed places among
each other, as in any sort. Null keys are keys. The index is a snapshot: rows that come later need a new one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionlake.session import scratch


def build(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int | None = None, path: str | None = None) -> str:
    """Writes the index and gives its folder. ``ranges`` is the number of ranges, by default that of shuffle partitions."""
    spark = rows.sparkSession
    path = path or scratch(spark, "rank-index")
    by = [*[F.col(k) for k in keys], *order]
    cut = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    cut.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{path}/rows")
    spark.createDataFrame([], rows.withColumn("_range", F.lit(0)).schema).write.parquet(f"{path}/columns")
    counts = _rows(spark, path).groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(*keys)
    before = F.sum("_n").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts.select(*keys, "_range", "_n", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of_key).alias("total")).write.parquet(f"{path}/summary")
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    # A table without rows has no files in folders by range, so the columns stand beside it.
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def page(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column], number: int, size: int, only: Sequence | None = None) -> DataFrame:
    """The rows on a page (from 1) of every key, with ``position`` and the key's ``total``.

    ``only`` names values of the first key: the ranges of their pages are then the only files listed for reading.
    """
    low, high = (number - 1) * size, number * size
    hit = spark.read.parquet(f"{path}/summary").filter((F.col("_before") < high) & (F.col("_before") + F.col("_n") > low))
    rows = _rows(spark, path)
    if only is not None:
        hit = hit.filter(F.col(keys[0]).isin(list(only)))
        # As many numbers as the named keys' pages have ranges.
        rows = rows.filter(F.col("_range").isin([r[0] for r in hit.select("_range").distinct().collect()]))
    places = hit.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before", "total")
    on = [F.col("_range") == F.col("_r"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    met = rows.join(places, on)
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) + F.col("_before")
    ranked = met.withColumn("position", place).filter(F.col("position").between(low + 1, high))
    return ranked.drop("_range", "_r", "_before", *[f"_k{i}" for i in range(len(keys))])
