"""Keyed tables of streams: bounded look-ups, merges, replays, gaps, late and null keys."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.session import scratch
from opinionlake.streaming import keyed, pipeline

KEYS = (T.StructField("k", T.LongType()),)
VALUES = (T.StructField("v", T.LongType()),)


def table(spark, **sizes):
    return keyed.KeyedTable(scratch(spark, "keyed"), KEYS, VALUES, **sizes)


def put(spark, t, batch, rows):
    t.put(t.runs(spark, batch) or [], spark.createDataFrame(rows, "k bigint, v bigint"), len(rows), batch)


def test_merges_keep_the_last_value_and_look_ups_read_few_rows(spark, monkeypatch):
    monkeypatch.setattr(keyed, "FAN", 3)
    t, want = table(spark, bucket_rows=16), {}
    for batch in range(8):
        rows = [(k, batch * 1000 + k) for k in range(batch * 40, batch * 40 + 60)] + [(None, batch)]
        want |= dict(rows)
        put(spark, t, batch, rows)
    runs = t.runs(spark, 8)
    assert max(r.level for r in runs) >= 1 and len(runs) < 8
    assert sorted((r.first, r.last) for r in runs)[0][0] == 0 and runs[-1].last == 7
    everything = spark.createDataFrame([(k,) for k in [*want, 10**6]], "k bigint")
    assert {r["k"]: r["v"] for r in t.lookup(runs, everything).collect()} == want
    one = spark.createDataFrame([(45,)], "k bigint")
    seen = t.touched(runs, one)
    assert seen.count() <= 4 * 16 * len(runs) < sum(r.rows for r in runs)
    assert seen.select(F.input_file_name()).distinct().count() <= len(runs)


def test_a_replayed_batch_sees_what_came_before_it(spark):
    t = table(spark)
    put(spark, t, 0, [(1, 10)])
    put(spark, t, 4, [(1, 11), (2, 20)])  # batches in between had no rows
    put(spark, t, 4, [(1, 12)])
    assert [(r.first, r.rows) for r in t.runs(spark, 4)] == [(0, 1)]
    found = t.lookup(t.runs(spark, 5), spark.createDataFrame([(1,), (2,)], "k bigint")).collect()
    assert [tuple(r) for r in found] == [(1, 12)]
    t.put(t.runs(spark, 5), spark.createDataFrame([], "k bigint, v bigint"), 0, 5)
    assert len(t.runs(spark, 6)) == 2
    assert len(t.runs(spark, 5 * keyed.ERA)) == 2  # a gap wider than a folder of manifests


def run(spark, start, slices, schema):
    feed, state = scratch(spark, "feed"), scratch(spark, "state")
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        start(spark.readStream.schema(schema).parquet(feed)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_ingest_takes_late_rows_and_null_keys_once(spark):
    schema, path = "source string, id string, published_at string, n int", scratch(spark, "sink")
    slices = [
        [("a", "1", "2024-05-02", 1), ("a", "1", "2024-05-01", 2), ("a", None, "2024-05-01", 3), ("a", "9", None, 4), ("a", "9", "2024-05-03", 5)],
        [("a", "1", "2020-01-01", 6), ("a", "2", "2019-01-01", 7), (None, "1", None, 8)],
        [("a", None, "2024-06-01", 9), (None, "1", "2024-06-01", 10), ("b", "1", "2024-06-01", 11)],
    ]
    run(spark, lambda s: pipeline.ingest(s, path, bucket_rows=1), slices, schema)
    got = pipeline.read_batches(spark, path, spark.createDataFrame([], schema).schema)
    assert sorted(r["n"] for r in got.collect()) == [2, 3, 5, 7, 8, 11]


def test_ingest_adopts_a_sink_without_key_table(spark):
    schema, path = "source string, id string, published_at string, n int", scratch(spark, "sink")
    spark.createDataFrame([("a", "1", None, 1)], schema).write.parquet(f"{path}/batch=0")
    rows = spark.createDataFrame([("a", "1", None, 2), ("a", "2", None, 3)], schema)

    class Stream:  # the writer's function alone, called for batch 1 twice
        schema, columns = rows.schema, rows.columns

        class writeStream:
            foreachBatch = staticmethod(lambda f: f)

    write = pipeline.ingest(Stream, path)
    for _ in range(2):
        write(rows, 1)
    got = pipeline.read_batches(spark, path, rows.schema)
    assert sorted(r["n"] for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("fan", [2, 8])
def test_change_feed_over_many_batches(spark, monkeypatch, fan):
    monkeypatch.setattr(keyed, "FAN", fan)
    path, slices, want, last = scratch(spark, "feed-out"), [], [], {}
    for batch in range(5):
        rows = [((batch + i) % 4 or None, f"v{(i * (batch + 1)) // 5}", batch * 10 + i) for i in range(10)]
        slices.append(rows)
        for k, v, o in rows:
            if last.get(k, "unseen") != v:
                want.append((o, k, v))
            last[k] = v
    run(spark, lambda s: pipeline.change_feed(s, path, "k", "v", "o", bucket_rows=1), slices, "k int, v string, o int")
    got = pipeline.read_batches(spark, f"{path}/changes", spark.createDataFrame([], "k int, v string, o int").schema)
    assert sorted((r["o"], r["k"], r["v"]) for r in got.collect()) == sorted(want)
