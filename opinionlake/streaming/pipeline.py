"""Streams: ingest, windowed counts, per-thread caps, change feed, batch metrics.

File or table streams are read with ``readStream``; sinks are ``foreachBatch`` writers that put each
micro-batch under its own ``batch`` folder and overwrite it, so a batch replayed after a failure
replaces itself instead of doubling.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opinionlake import constants as C
from opinionlake.functions import dates
from opinionlake.operators import ranks
from opinionlake.streaming import keyed


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything the sink holds, with its batch number; an empty stream gives an empty frame."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(full).option("basePath", path).parquet(f"{path}/batch=*")
    except Exception as error:  # nothing was written
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], full)
        raise


def as_event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need TIMESTAMP; parquet files may hold the zone-less kind."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


# ---- ingest -------------------------------------------------------------------------------
def _fields(schema: T.StructType, names) -> tuple[T.StructField, ...]:
    return tuple(T.StructField(n, schema[n].dataType) for n in names)


def ingest(stream: DataFrame, path: str, keys=("source", "id"), time: str = "published_at", bucket_rows: int = 1 << 20) -> DataStreamWriter:
    """Append items whose identity is not stored yet, however late they come.

    Of the rows of a micro-batch with one identity the earliest stays (undated ones last). Stored identities are a
    ``KeyedTable`` under ``path/_keys``, of which a batch reads the buckets its keys fall into. A sink that has no such
    table yet has it built once from its key columns.
    """
    keys = list(keys)
    stored = keyed.KeyedTable(f"{path}/_keys", _fields(stream.schema, keys), bucket_rows=bucket_rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = stored.runs(spark, batch_id)
        if runs is None:
            runs = _adopted(spark, batch_id)
        firsts = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(F.col(time).isNull(), F.col(time))).alias("_row")).select("_row.*")
        firsts = firsts.persist()
        known = stored.lookup(runs, firsts).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        firsts.join(known, same, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        firsts.unpersist()
        landed = spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")
        stored.put(runs, landed, landed.count(), batch_id)

    def _adopted(spark: SparkSession, batch_id: int) -> list[keyed.Run]:
        earlier = read_batches(spark, path, stream.schema).filter(F.col("batch") < batch_id).select(*keys).distinct()
        count = earlier.count()
        if not count:
            return []
        stored.put([], earlier, count, -1)
        return stored.runs(spark, 0)

    return stream.writeStream.foreachBatch(write)


# ---- windows ------------------------------------------------------------------------------
# Days and weeks of the fixed local offset; weeks start on Monday. 1970-01-01 was a Thursday, so the
# Monday grid starts three days and sixteen hours into the epoch week.
_WINDOWS = {"day": ("1 day", "16 hours"), "week": ("7 days", "3 days 16 hours")}


def windowed_counts(stream: DataFrame, interval: str, time: str = "ts", lateness: str = "40 days", keys=()) -> DataFrame:
    """Counts per local day or week and sentiment. Months are re-aggregated from days, being no fixed length."""
    length, start = _WINDOWS[interval]
    timed = as_event_time(stream, time).withWatermark(time, lateness)
    out = timed.groupBy(F.window(time, length, startTime=start).alias("w"), *keys).agg(
        F.count("*").alias("count"), *[F.count_if(F.coalesce("sentiment", F.lit("unknown")) == s).alias(f"{s}_count") for s in C.SENTIMENTS]
    )
    return out.select(dates.local_day(F.col("w.start")).alias("period"), *keys, "count", *[f"{s}_count" for s in C.SENTIMENTS])


def latest_windows(written: DataFrame, keys=("period",)) -> DataFrame:
    """Update-mode output holds a window once per change; the last batch has the current figures."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("l"))
    return last.select(*keys, "l.*")


# ---- per-thread caps ----------------------------------------------------------------------
def prelimit(stream: DataFrame, thread: str, order: str, cap: int) -> DataFrame:
    """Drop rows that cannot be accepted before the shuffle: per Arrow batch, the first ``cap`` per thread.

    A thread accepts at most its first ``cap`` rows of a micro-batch, so no acceptable row is lost and
    a thread holding most of the traffic sends ``cap`` rows per Arrow batch instead of all of them.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(order, kind="stable").groupby(thread, sort=False, dropna=False).head(cap)

    return stream.mapInPandas(keep, stream.schema)


def thread_cap(stream: DataFrame, cap: int, thread: str = "thread", order: str = "seq") -> DataFrame:
    """Accept the first ``cap`` rows of every thread over all batches.

    State is one number per thread. Rows come to a key in Arrow slices; only the smallest ``cap`` are held.
    """
    rows = prelimit(stream.select(thread, order), thread, order, cap)

    def accept(key, slices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        held = pd.DataFrame(columns=[thread, order])
        for part in slices:
            held = pd.concat([held, part]) if len(held) else part
            held = held.sort_values(order, kind="stable").head(max(cap - used, 0))
        state.update((used + len(held),))
        yield held[[thread, order]]

    return rows.groupBy(thread).applyInPandasWithState(
        accept, rows.schema, T.StructType([T.StructField("used", T.LongType())]), "append", GroupStateTimeout.NoTimeout
    )


# ---- change feed --------------------------------------------------------------------------
def changes(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Batch form: rows whose value differs from the one before it under the same key."""
    before = ranks.block_lag(rows, [key], order, value, "_before")
    return before.filter(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def change_feed(stream: DataFrame, path: str, key: str, value: str, order: str, bucket_rows: int = 1 << 20) -> DataStreamWriter:
    """Stream form: emit a key's value only when it differs from the last one seen.

    A micro-batch is compared with itself in ``order`` by the batch form, which splits a busy key over
    tasks; only its first row per key is compared with the last values, a ``KeyedTable`` of which the batch reads the
    buckets it touches and to which it adds its own keys. All outputs of a batch are overwritten when it is replayed.
    """
    rows = stream.select(key, value, order)
    last = keyed.KeyedTable(f"{path}/last", _fields(rows.schema, [key]), _fields(rows.schema, [value]), bucket_rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        runs = last.runs(batch.sparkSession, batch_id) or []
        batch.persist()
        ends = batch.groupBy(key).agg(F.min(order).alias("_first"), F.max_by(value, order).alias(value)).persist()
        past = last.lookup(runs, ends).select(F.col(key).alias("_key"), F.col(value).alias("_past"))
        first = ends.select(F.col(key).alias("_key"), "_first").join(past.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
        lagged = ranks.block_lag(batch, [key], order, value, "_before").join(first, F.col(key).eqNullSafe(F.col("_key")))
        before = F.when(F.col(order) == F.col("_first"), F.col("_past")).otherwise(F.col("_before"))
        changed = lagged.filter(~before.eqNullSafe(F.col(value))).select(key, value, order)
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        last.put(runs, ends, ends.count(), batch_id)
        ends.unpersist()
        batch.unpersist()

    return rows.writeStream.foreachBatch(write)


# ---- metrics and log ----------------------------------------------------------------------
def metered_writer(path: str, metrics_path: str, *extra: Column) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch, and one row of counters for it to a table of its own; both replace themselves when replayed."""
    write_batch, write_metrics = batch_writer(path), batch_writer(metrics_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id)
        landed = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")
        write_metrics(landed.agg(F.count(F.lit(1)).alias("rows"), *extra), batch_id)

    return write


def event_rows(batches: DataFrame, job: str, payload, event_type: str, at: Column) -> DataFrame:
    """One log row per committed batch: job, type, JSON payload, time."""
    return batches.select(
        F.col(job).alias("job_id"), F.lit(event_type).alias("event_type"), F.to_json(F.struct(*payload)).alias("payload"), at.alias("created_at")
    )


def append_events(rows: DataFrame, path: str, batch_id: int) -> None:
    """The log rows of one committed batch; written again, they replace themselves."""
    batch_writer(path)(rows, batch_id)
