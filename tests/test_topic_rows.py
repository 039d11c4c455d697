import math

from opinionlake import plans


def test_topic_rows_hold_items_and_centroids(spark, tmp_path):
    """A topic's row names all of its items and its direction; both were left out."""
    texts = ["slow slow queue", "slow queue slow", "cold soup", "broken door handle", "cold soup"]
    docs = [(6 * i, texts[i % 5], "en", "x", 10) for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 1)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    plans.load_all()
    rows = plans.QUERIES["topic.rows"](spark, str(tmp_path)).collect()
    of = {}
    for r in plans.QUERIES["topic.cluster"](spark, str(tmp_path)).collect():
        of.setdefault((r["report_id"], r["leader"]), []).append(r["id"])
    assert sum(map(len, of.values())) == 20
    assert {(r["report_id"], r["leader"]): r["item_ids"] for r in rows} == {k: sorted(v) for k, v in of.items()}
    assert all(r["count"] == len(r["item_ids"]) and len(r["centroid"]) == 64 for r in rows)
    assert all(math.isclose(sum(x * x for x in r["centroid"]), 1, abs_tol=1e-4) for r in rows)
