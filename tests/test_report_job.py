"""The report job: missing labels and vectors are made, finished stages are kept, topics keep their keys."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from opinionlake.functions import text
from opinionlake.operators import labelling, report_job

MODELS = report_job.Models(labelling.encode_passages, "hashing")
ITEMS = """id string, source string, content_type string, title string, text string, board string, thread_source_id string, source_url string, rating int,
 published_at timestamp, date_precision string, signal string, metrics map<string,double>"""


def tables(spark):
    text = {"a": "slow slow staff and cold soup", "b": "slow staff and cold soup soup", "c": "broken chair near the window", "d": "lovely tea", "e": None, "f": "terrible awful noise"}
    items = spark.createDataFrame([(i, "dcard", "post", None, t, "food", None, None, None, None, "unknown", None, None) for i, t in text.items()], ITEMS)
    links = [("r1", i, n) for n, i in enumerate("abcde")] + [("r1", "a", 9), ("r1", "gone", 10), ("r2", "a", 0), ("r2", "f", 1)]
    reports = spark.createDataFrame([("r1", "One"), ("r2", "Two"), ("r3", "None")], "report_id string, subject_name string")
    labels = [("r1", i, "negative", 0.9, ["service"], ["service"], ["slow"], False, "m") for i in "abc"] + [("r2", "a", "negative", 0.9, [], [], [], False, "m")]
    known = spark.createDataFrame(labels + [("r9", "a", "positive", 0.9, [], [], [], False, "m")], report_job._LABELS)
    vectors = spark.createDataFrame([("c", [float("nan")] * 64), ("zz", [1.0] * 64)], "id string, embedding array<double>")
    return items, spark.createDataFrame(links, "report_id string, id string, ordinal bigint"), reports, known, vectors


def test_whole_job(spark, tmp_path):
    out = report_job.run(*tables(spark), MODELS, str(tmp_path / "job"))
    frozen = {(r.report_id, r.id): r for r in out["items"].collect()}
    assert set(frozen) == {("r1", i) for i in "abcde"} | {("r2", "a"), ("r2", "f")}
    assert frozen["r1", "a"].ordinal == 0 and frozen["r1", "e"].sentiment == "rating_only" and frozen["r1", "a"].local_model_id == "m"
    assert frozen["r1", "a"].topic_keys == frozen["r1", "b"].topic_keys != [] and frozen["r1", "c"].topic_keys == []
    assert frozen["r1", "a"].topic_keys != frozen["r2", "a"].topic_keys
    status = {r.report_id: r for r in out["status"].collect()}
    assert (status["r1"].complaints, status["r1"].missing_embeddings, status["r1"].status, status["r1"].topics, status["r1"].topic_items) == (3, 1, "partial", 1, 2)
    assert (status["r3"].complaints, status["r3"].topics, status["r3"].status) == (0, 0, "completed")
    overall = {r.report_id: r.sample_size for r in out["blocks"].filter("block = 'overall'").collect()}
    assert overall == {"r1": 5, "r2": 2}


def test_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path, given = str(tmp_path / "job"), tables(spark)
    monkeypatch.setattr(report_job.topics, "centroids", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        report_job.run(*given, MODELS, path)
    monkeypatch.undo()
    monkeypatch.setattr(report_job, "_all_labels", lambda *a: (_ for _ in ()).throw(AssertionError("made again")))
    out = report_job.run(*given, MODELS, path)
    assert out["topics"].count() == out["status"].agg(F.sum("topics")).first()[0] >= 2
    assert {r.stage for r in spark.read.parquet(f"{path}/stages").collect()} == {"labels", "complaints", "vectors", "clusters", "topics", "blocks", "status"}


def test_keys_of_the_report_before(spark, tmp_path):
    items, links, reports, labels, vectors = tables(spark)
    first = report_job.run(items, links, reports, labels, vectors, MODELS, str(tmp_path / "one"))
    before = first["topics"].filter("report_id = 'r1'")
    lineage = spark.createDataFrame([("r2", "r1")], "report_id string, previous string")
    second = report_job.run(items, links, reports, labels, vectors, MODELS, str(tmp_path / "two"), previous=before, lineage=lineage)
    key = before.select("topic_key").first()[0]
    assert {(r.report_id, r.topic_key) for r in second["topics"].filter(F.col("mapping") == "matched").collect()} == {("r2", key)}


def test_no_items(spark, tmp_path):
    items, links, reports, labels, vectors = tables(spark)
    out = report_job.run(items.limit(0), links.limit(0), reports, labels.limit(0), vectors.limit(0), MODELS, str(tmp_path / "none"))
    assert out["items"].count() == 0 and out["status"].count() == 3


def sql_of(columns):
    return str(columns._jdf.queryExecution().optimizedPlan())


def test_texts_are_not_searched_for_latin_words_by_patterns(spark):
    rows = spark.createDataFrame([("r", "1", "dcard", "post", "fine", 3, None)], "report_id string, id string, source string, content_type string, text string, rating int, signal string")
    plan = sql_of(labelling.label_items(rows))
    # Only a text with a letter whose case is unlike ASCII meets the pattern; the words are looked up.
    assert "CASE WHEN _odd" in plan and "Contains(_low" in plan and plan.count("Contains(") > 20


def test_texts_are_read_for_numbers_once(spark):
    plan = sql_of(text.add_masked(spark.createDataFrame([("a",)], "t string"), "t"))
    assert plan.count("_digits") >= 3


def test_labels_of_blanks_odd_letters_and_chinese(spark):
    given = {
        "never\nagain": "negative", "NEVER \t again": "negative", "neveragain": "neutral", "frİendly": "positive", "ſlow": "negative", "ba​d": "negative",
        "ｂａｄ": "negative", "不推薦": "negative", "等了\n30\n分鐘": "negative", "great bad": "positive", "​ \n": "neutral",
    }
    rows = [("r", t, "dcard", "post", t, None, None) for t in given]
    items = spark.createDataFrame(rows, "report_id string, id string, source string, content_type string, text string, rating int, signal string")
    assert {r.id: r.sentiment for r in labelling.label_items(items).collect()} == given


def test_masks_of_numbers_and_addresses(spark):
    given = {
        "call 0912-345-678\n\nnow": "call [電話已遮罩] now", "id ٠١٢٣٤٥٦٧": "id [識別碼已遮罩]", "wWw.a.b x": "[網址已遮罩] x", "HTTPS://q": "[網址已遮罩]",
        "é@d.e": "[電子郵件已遮罩]", "a\tb  @ab": "a b [帳號已遮罩]", "x@ 1234-567": "x@ 1234-567",
    }
    got = text.add_masked(spark.createDataFrame([(t, t) for t in given], "k string, t string"), "t").collect()
    assert {r.k: r.t for r in got} == given


def test_leaders_after_a_slice_are_not_multiplied(tmp_path):
    rows = pd.DataFrame({"report_id": "r", "id": [f"{i:04}" for i in range(3000)], "total": list(np.eye(3000)[:, :].astype("float64")), "dim": 3000})
    table = pa.table({"report_id": rows["report_id"], "id": rows["id"], "total": pa.array(list(rows["total"])), "dim": pa.array([3000] * 3000, pa.int32())})
    pq.write_table(table, tmp_path / "leaders.parquet")
    wide = []
    real = np.round
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(report_job.topics.np, "round", lambda a, d: wide.append(a.shape[1]) or real(a, d))
        out = pd.concat(report_job.topics._nearest(str(tmp_path), 4096)(iter([rows.sample(frac=1, random_state=1)])))
    assert (out["id"] == out["leader"]).all() and wide == [1023, 2047, 2999]


def test_slots_of_tokens():
    made = labelling.hashing_encoder(64)(["b B a1-éK 😀", ""])
    slot = lambda t: int(hashlib.md5(t).hexdigest()[:8], 16) % 64
    want = np.zeros((2, 64))
    for token in (b"b", b"b", b"a1", b"k"):
        want[0, slot(token)] += 1
    assert (made == want).all()
