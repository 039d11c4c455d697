import json
import os
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from opinionlake.functions import dates, identity, values
from opinionlake.session import shared_dir
from opinionlake.sources import pages

KEY = b"k" * 32


def page(spark, *documents, more=""):
    html = "".join(f"<script>{json.dumps(d, ensure_ascii=False)}</script>" for d in documents) + more
    return spark.createDataFrame([(1, "https://www.dcard.tw/f/food/p/1000001", html)], "page_id bigint, url string, html string")


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_no_level_of_a_document_is_stored(spark):
    before = tables(spark)
    said = [{"id": f"c{i}", "content": f"text {i}", "floor": str(i), "author": {"id": "u"}} for i in range(3)]
    records = pages.forum_records(page(spark, {"props": {"post": {"id": 1000001, "content": "an article", "comments": said}}}, [{"a": {}}]))
    got = [(r["seq"], r["kind"], r["record_id"], r["body"], r["nested"]) for r in records.orderBy("seq").collect()]
    at = lambda *places: "".join(f"{p:09d}" for p in places)
    assert got[0] == (at(0), "record", None, "", None)
    assert (at(0, 0, 0), "record", "1000001", "an article", None) in got
    for i in range(3):
        assert (at(0, 0, 0, 0, i), "comment", f"c{i}", f"text {i}", "1000001") in got
        assert (at(0, 0, 0, 0, i, 0), "record", None, "", None) in got
    assert (at(1, 0), "record", None, "", None) in got and (at(1, 0, 0), "record", None, "", None) in got
    assert len(got) == 11
    # Whole documents were written once a level, and read back by the thousand in a batch.
    made = [t for t in tables(spark) - before if t.startswith("json")]
    assert len(made) == 1 and made[0].startswith("json-records-")


def test_documents_of_any_depth_are_walked(spark):
    for depth in (pages.LEVELS - 1, pages.LEVELS, pages.LEVELS + 1, 3 * pages.LEVELS + 1):
        document = {"commentId": "deepest", "text": "at the bottom"}
        for i in range(depth):
            document = {"x": document} if i % 2 else [document]
        got = pages.forum_records(page(spark, document)).collect()
        assert len(got) == 1 + depth // 2
        assert [(r["record_id"], r["body"], len(r["seq"])) for r in got if r["kind"] == "comment"] == [("deepest", "at the bottom", 9 * (depth + 1))]


def test_scripts_leave_a_worker_in_small_batches():
    html = "".join(f"<script>{'x' * (pages.HANDED // 2)}</script>" for _ in range(9)) + '<meta name="og:title" content="T &amp; t">'
    rows = pa.RecordBatch.from_arrays([pa.array([5, None, 6], pa.int64()), pa.array(["u", None, "v"]), pa.array([html, None, "<p>no script</p>"])], ["page_id", "url", "html"])
    out = list(pages._scripts(iter([rows])))
    assert max(sum(map(len, b.column(6).to_pylist())) for b in out) <= 2 * pages.HANDED
    every = [r for b in out for r in b.to_pylist()]
    assert [r["seq"] for r in every] == [f"{i:09d}" for i in range(9)] and {(r["page_id"], r["url"], r["meta_title"], r["more"]) for r in every} == {(5, "u", "T & t", False)}


def test_comments_are_stored_once_and_keep_their_digests(spark):
    said = [
        {"id": "c1", "content": "one", "floor": "1", "createdAt": "2024-03-05T10:00:00", "author": "u"},
        {"content": "e\u200b\u0301  x", "floor": "2", "createdAt": "2024-03-05T10:00:00", "author": "u"},
        {"content": "", "floor": "3"},
    ]
    again = [{"@type": "Comment", "text": "one", "floor": "1", "dateCreated": "2024-03-05T10:00:00", "author": "u"}, {"@type": "Comment", "text": "one", "floor": "1"}]
    documents = {"post": {"id": 1000001, "content": "an article", "comments": said}}, {"post": {"id": 1000001, "comments": again}}
    records = pages.forum_records(page(spark, *documents))
    keys = identity.key_frame(spark, KEY)
    articles = pages.forum_articles(records)
    before = tables(spark)
    comments = pages.forum_comments(records, articles, keys)
    (made,) = [t for t in tables(spark) - before if t.startswith("page-comments")]
    got = {r["id"]: (r["text"], r["floor"]) for r in comments.collect()}
    # Both copies of every text were stored, to be read three times.
    assert spark.read.parquet(f"{shared_dir(spark)}/{made}").count() == len(got) == 3
    row = spark.createDataFrame([("1000001", "2", "u", "2024-03-05T10:00:00", "e\u0301 x")], "thread string, floor string, author string, created string, text string")
    digest = identity.content_hash(
        F.lit("dcard-comment"), F.col("thread"), values.counter(F.col("floor")), identity.author_hash(keys, F.lit("dcard"), F.col("author")), dates.absolute(F.col("created"), "+08:00"), F.col("text")
    )
    assert got[row.select(digest).first()[0]] == ("e\u0301 x", 2)  # the text is normalised once, its digest twice
    assert got["c1"] == ("one", 1) and sorted(v[0] for v in got.values()) == ["e\u0301 x", "one", "one"]
    assert not [c for c in map(chr, range(0x110000)) if c != "\u200b" and "\u200b" in unicodedata.normalize("NFKC", c)]
