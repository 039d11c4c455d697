"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.session import scratch

#: Runs of ASCII white space; what lies between them is a word.
GAP = r"[\x20\x09-\x0D]+"
#: What lies between words made of digits, lower-case letters and everything beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_of(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def pieces(text: Column, gap: str) -> Column:
    """The non-empty pieces of a text between the matches of ``gap``."""
    return F.array_remove(F.split(text, gap), "")


def shingle_hashes(hashes: str, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` entries of a column of word hashes; with fewer entries, of the whole run."""
    column = F.col(hashes)
    runs = F.transform(
        F.slice(column, 1, F.greatest(F.size(column) - (n - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(column, i + k) for k in range(1, n)]),
    )
    short = F.array(F.xxhash64(F.size(column), *[F.get(column, F.lit(k)) for k in range(n - 1)]))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(column) >= n, runs).when(F.size(column) > 0, short).otherwise(none)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, of known size, there after executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

