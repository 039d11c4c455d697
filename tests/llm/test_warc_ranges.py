"""Captures that share url key, timestamp and id over many key ranges."""

from opinionlake.llm import warc
from opinionlake.llm.queries import prepare


def test_equal_rows_over_many_ranges(spark):
    prepare(spark)
    rows = [(None, "http://a.org/x", "same") if i % 3 == 0 else (i // 7, f"http://h{i % 50}.org/", f"p{i % 40}") for i in range(18_000)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(12)
        folder, runs = warc.archive(frame)
        assert runs.select("run").distinct().count() > 3
        got = sorted(warc.merge(folder, runs).collect(), key=lambda r: (r.part, r.place))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len({r.part for r in got}) > 3
    keys = [(r.url_key, r.seconds, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted((warc.url_key(u), 0, -1 if i is None else i) for i, u, _ in rows)
    assert len({(r.archive, r.offset) for r in got}) == len(rows)


def test_large_ids_and_times(spark):
    """Ids are no times; times are held within the years that a date can name."""
    prepare(spark)
    rows = [(2**62, "http://a.b/", "x", 2**62), (-5, "http://a.b/", "x", -7), (253_402_300_800, "http://a.b/c", "y", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at bigint")
    want = {(2**62, "response", None), (-5, "revisit", 2**62), (253_402_300_800, "response", None)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()} == want
    folder, runs = warc.archive(pages, seconds="at")
    assert runs.count() > 0
