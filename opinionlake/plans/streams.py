"""Streaming queries, run to the end of the given events in three slices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake import constants as C
from opinionlake.plans import query
from opinionlake.plans.landing import shown
from opinionlake.plans.scoped import dates_as_text
from opinionlake.session import scratch
from opinionlake.sources import provider
from opinionlake.sources.binding import bare_items, table, with_items
from opinionlake.streaming import pipeline

_SENTIMENT = {"purchase": "positive", "view": "neutral", "error": "negative", "signup": "rating_only"}


def slices(spark, d, parts=3):
    """The events cut by id into consecutive thirds; together they are the whole table."""
    events = table(spark, d, "events")
    top = events.agg((F.max("event_id") + 1).alias("n"))
    cut = events.withColumn("_part", F.floor(F.col("event_id") * parts / top.scalar()))
    return [cut.filter(F.col("_part") == i).drop("_part") for i in range(parts)]


def replay(spark, name, parts, start):
    """Feed the slices one after another; the query stops and recovers from its checkpoint in between."""
    feed, state = scratch(spark, f"{name}-feed"), scratch(spark, f"{name}-state")
    for part in parts:
        part.write.mode("append").parquet(feed)
        running = start(spark.readStream.schema(part.schema).parquet(feed)).option("checkpointLocation", state).trigger(availableNow=True).start()
        running.awaitTermination()


def sentiment():
    out = F.lit(None).cast("string")
    for kind, label in _SENTIMENT.items():
        out = F.when(F.col("event_type") == kind, label).otherwise(out)
    return out


@query("str.ingest", """SELECT event_id, user_id, source FROM (SELECT event_id, user_id, event_type AS source FROM events)""")
def ingest(spark, d):
    """Every slice also repeats the first one, which must not be stored twice."""
    parts = slices(spark, d)
    repeated = [parts[0], parts[1].unionByName(parts[0]), parts[2].unionByName(parts[0])]
    shaped = [p.select("event_id", "user_id", F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("published_at")) for p in repeated]
    path = scratch(spark, "ingest")
    replay(spark, "ingest", shaped, lambda s: pipeline.ingest(s, path))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("source", T.StringType())])
    return pipeline.read_batches(spark, path, schema).drop("batch")


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SENTIMENT.items()) + " ELSE 'unknown' END"


@query("str.trend", f"""SELECT CAST(CAST(date_trunc('week', ts + INTERVAL 8 HOUR) AS DATE) AS VARCHAR) AS period, count(*) AS count,
 {", ".join(f"count(*) FILTER ({_CASE} = '{s}') AS {s}_count" for s in C.SENTIMENTS)} FROM events GROUP BY 1""")
def trend(spark, d):
    path = scratch(spark, "trend")
    rows = [p.withColumn("sentiment", sentiment()) for p in slices(spark, d)]
    replay(spark, "trend", rows, lambda s: pipeline.windowed_counts(s, "week").writeStream.outputMode("update").foreachBatch(pipeline.batch_writer(path)))
    schema = T.StructType([T.StructField("period", T.DateType()), *[T.StructField(c, T.LongType()) for c in ("count", *[f"{s}_count" for s in C.SENTIMENTS])]])
    return dates_as_text(pipeline.latest_windows(pipeline.read_batches(spark, path, schema)))


@query("str.thread_cap", "SELECT user_id AS thread, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 40")
def thread_cap(spark, d):
    path = scratch(spark, "cap")
    rows = [p.select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq")) for p in slices(spark, d)]
    replay(spark, "cap", rows, lambda s: pipeline.thread_cap(s, 40).writeStream.outputMode("append").foreachBatch(pipeline.batch_writer(path)))
    return pipeline.read_batches(spark, path, rows[0].schema).drop("batch")


@query("str.change_feed", """SELECT user_id, event_type, event_id FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type""")
def change_feed(spark, d):
    path = scratch(spark, "feed")
    rows = [p.select("user_id", "event_type", "event_id") for p in slices(spark, d)]
    replay(spark, "feed", rows, lambda s: pipeline.change_feed(s, path, "user_id", "event_type", "event_id"))
    return pipeline.read_batches(spark, f"{path}/changes", rows[0].schema).drop("batch")


@query("str.batch_metrics", """SELECT floor(event_id * 3 / (SELECT max(event_id) + 1 FROM events))::BIGINT AS batch, count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def batch_metrics(spark, d):
    path, counters = scratch(spark, "metrics"), scratch(spark, "counters")
    errors = F.count_if(F.col("event_type") == "error").alias("errors")
    replay(spark, "metrics", slices(spark, d), lambda s: s.writeStream.foreachBatch(pipeline.metered_writer(path, counters, errors)))
    schema = T.StructType([T.StructField("rows", T.LongType()), T.StructField("errors", T.LongType())])
    return pipeline.read_batches(spark, counters, schema).filter("rows > 0").select("batch", "rows", "errors")


@query("src.event_log", """SELECT user_id AS job_id, 'items_committed' AS event_type, '{"items":' || count(*) || ',"errors":' || count(*) FILTER (event_type = 'error') || '}' AS payload,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def event_log(spark, d):
    path = scratch(spark, "events")
    batches = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("items"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").cast("timestamp").alias("at")
    )
    rows = pipeline.event_rows(batches, "user_id", ["items", "errors"], "items_committed", F.col("at"))
    for part in range(2):
        for _ in range(2):  # a replayed batch must not double
            pipeline.append_events(rows.filter(F.col("job_id") % 2 == part), path, part)
    return pipeline.read_batches(spark, path, rows.schema).drop("batch").withColumn("created_at", shown("created_at"))


@query("udf.source_provider", with_items("""SELECT source, content_type, id AS source_item_id, md5(text) AS content_hash, text, source_url, title, board, thread_source_id, rating FROM items"""))
def source_provider(spark, d):
    path = scratch(spark, "saved")
    bare_items(spark, d).select(
        "source", "content_type", F.col("id").alias("source_item_id"), F.md5("text").alias("content_hash"), "text", "source_url", "title", "board", "thread_source_id", "rating"
    ).write.json(path)
    provider.register(spark)
    out = spark.read.format("saved_items").load(path)
    return out.select("source", "content_type", "source_item_id", "content_hash", "text", "source_url", "title", "board", "thread_source_id", "rating")


@query("lim.recent_reports", """SELECT o_orderkey AS report_id, o_custkey AS subject_id, coalesce(c_name, '未命名') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def recent_reports(spark, d):
    newest = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)
    named = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return newest.join(named, "o_custkey", "left").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("subject_id"), F.coalesce("c_name", F.lit(C.UNNAMED)).alias("name")
    )
