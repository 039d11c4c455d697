import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import sentiment as rules
from opinionlake.operators import evidence, keywords, labelling, landing, packing, planning, ranks, retrieval, stats, topics
from opinionlake.operators import scope as S
from opinionlake.session import scratch

SCHEMA = (
    "report_id string, id string, ordinal bigint, source string, content_type string, title string, text string, board string, channel_label string, "
    "thread_source_id string, source_url string, rating bigint, published_at timestamp, date_precision string, sentiment string, confidence double, "
    "aspects array<string>, negative_aspects array<string>, key_points array<string>, topic_keys array<string>, reply_count bigint, reaction_count bigint, signal string"
)


def item(key, ordinal, **over):
    base = dict(
        report_id="r", id=key, ordinal=ordinal, source="ptt", content_type="comment", title="t", text="等候太久", board="Food", channel_label="Food",
        thread_source_id="t", source_url="https://example.com/thread", rating=None, published_at=dt.datetime(2026, 8, 2, 16), date_precision="day",
        sentiment="negative", confidence=None, aspects=["speed_wait"], negative_aspects=["speed_wait"], key_points=[], topic_keys=[], reply_count=None,
        reaction_count=None, signal=None,
    )
    base.update(over)
    return tuple(base[c.split()[0]] for c in SCHEMA.split(", "))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_week_trend_counts_gaps_and_exclusions(spark):
    rows = frame(
        spark, item("a", 1), item("b", 2, published_at=dt.datetime(2026, 8, 17, 1), sentiment="positive"),
        item("c", 3, date_precision="month"), item("d", 4, published_at=None, date_precision="unknown"),
    )
    points = stats.trend(rows, "week").orderBy("period").collect()
    assert [p["period"].isoformat() for p in points] == ["2026-08-03", "2026-08-10", "2026-08-17"]
    assert [p["count"] for p in points] == [1, 0, 1]
    assert points[0]["excluded_count"] == 2
    assert points[1]["negative_ratio"] is None and points[1]["pn_reason"] == "no_classified_text"
    assert points[2]["pn_reason"] == "no_negative" and points[2]["negative_ratio"] == 0.0
    assert points[2]["period_end"] == dt.date(2026, 8, 17)


def test_week_trend_goes_on_by_mondays_when_no_week_begins_with_the_year(spark):
    rows = frame(spark, item("a", 1, published_at=dt.datetime(2024, 12, 27, 1)), item("b", 2, published_at=dt.datetime(2025, 1, 14, 1)))
    points = stats.trend(rows, "week").orderBy("period").collect()
    assert [(p["period"].isoformat(), p["count"]) for p in points] == [("2024-12-23", 1), ("2024-12-30", 0), ("2025-01-06", 0), ("2025-01-13", 1)]


def test_trend_with_bounds_keeps_empty_series_and_long_ones(spark):
    rows = frame(spark, item("a", 1))
    empty = stats.trend(rows, "month", dt.date(2025, 1, 1), dt.date(2025, 3, 31)).collect()
    assert len(empty) == 3 and sum(p["count"] for p in empty) == 0
    old = frame(spark, item("a", 1), item("b", 2, published_at=dt.datetime(1900, 1, 1, 12)))
    points = stats.trend(old, "year" if "year" in C.ACCEPTED_PRECISION else "month").collect()
    assert sum(p["count"] for p in points) == 2 and len(points) > 100


def test_summary_trend_and_items_reconcile(spark):
    rng = random.Random(3)
    rows = [
        item(str(i), i, sentiment=rng.choice(["positive", "neutral", "negative", "rating_only", None]), source=rng.choice(C.SOURCES),
             published_at=dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(3000)))
        for i in range(200)
    ]
    df = frame(spark, *rows)
    scope = S.Scope(interval="month", precision_policy="interval", source="ptt")
    chosen = S.select(df, scope)
    total = stats.statistics(chosen).first()
    series = stats.trend(chosen, "month").collect()
    assert total["count"] == sum(p["count"] for p in series) == chosen.count() == S.counts(df, scope).first()["included_count"]
    shuffled = frame(spark, *rng.sample(rows, len(rows)))
    assert stats.statistics(S.select(shuffled, scope)).first() == total


def test_dedup_keeps_last_value_at_first_position(spark):
    rows = frame(spark, item("a", 5, title="old"), item("a", 9, title="new"), item("b", 7))
    assert [(r["id"], r["title"], r["ordinal"]) for r in S.dedup(rows).orderBy("ordinal").collect()] == [("a", "new", 5), ("b", "t", 7)]


def test_scope_terms_and_validation(spark):
    rows = frame(spark, item("a", 1, text="Ｇreat coffee"), item("b", 2, text="bad tea"), item("c", 3, title="COFFEE", text="x"))
    ids = lambda s: sorted(r["id"] for r in S.select(rows, s).select("id").collect())
    assert ids(S.Scope(any_terms=("GREAT", "tea"))) == ["a", "b"]
    assert ids(S.Scope(all_terms=("coffee",), exclude_terms=("great",))) == ["c"]
    assert ids(S.Scope(q="coffee")) == ["a"]
    assert ids(S.Scope(keyword="Tea")) == ["b"]
    for bad in (dict(rating=9), dict(any_terms=(" ",)), dict(date_from=dt.date(2026, 1, 2), date_to=dt.date(2026, 1, 1)), dict(interval="year")):
        with pytest.raises(ValueError):
            S.Scope(**bad)


def test_block_helpers_equal_plain_windows_under_skew(spark):
    # One key holds most rows; tiny blocks force many block borders.
    rows = [("hot" if i % 5 else f"k{i % 7}", i * 3 + i % 2, i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n bigint, v bigint")
    pdf = pd.DataFrame(rows, columns=["k", "n", "v"]).sort_values(["k", "n"])
    pdf["rank"] = pdf.groupby("k").cumcount() + 1
    pdf["total"] = pdf.groupby("k")["v"].cumsum()
    pdf["before"] = pdf.groupby("k")["v"].shift(1)
    got = ranks.block_rank(df, ["k"], "n", "rank", block=17)
    got = ranks.block_sum(got, ["k"], "n", F.col("v"), "total", block=17)
    got = ranks.block_lag(got, ["k"], "n", "v", "before", block=17).orderBy("k", "n").toPandas()
    for c in ("rank", "total"):
        assert got[c].tolist() == pdf[c].tolist()
    assert got["before"].fillna(-1).tolist() == pdf["before"].fillna(-1).tolist()


def test_top_rows_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("k"), "id")
    plan = ranks.top_rows(df, ["k"], [F.desc("id")], 5)
    assert [r["id"] for r in plan.filter("k = 'hot'").orderBy(F.desc("id")).collect()] == [999, 998, 997, 996, 995]
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_term_and_document_frequency(spark):
    rows = frame(spark, item("a", 1, title="", text="soup soup tea"), item("b", 2, title="", text="soup"))
    got = {r["term"]: (r["term_frequency"], r["document_frequency"]) for r in keywords.tf_df(keywords.with_tokens(rows)).collect()}
    assert got == {"soup": (3, 2), "tea": (1, 1)}


def test_budget_matches_row_by_row_processing(spark):
    rng = random.Random(12)
    budget = landing.Budget(dt.date(2026, 1, 1), dt.date(2026, 12, 31), max_posts=2, max_comments=10, per_thread=3)
    rows, known = [], []
    for i in range(300):
        thread = f"t{rng.randrange(12)}" if i % 3 else "t0"  # t0 is hot
        kind = "post" if rng.random() < 0.03 else "comment"
        when = None if rng.random() < 0.1 else dt.datetime(2026 if rng.random() < 0.8 else 2020, 5, 1)
        rows.append((thread, i, kind, when))
        known.append(rng.random() < 0.05)
    data = [item(str(i), i, thread_source_id=t, content_type=k, published_at=w) for t, i, k, w in rows]
    df = frame(spark, *data).join(spark.createDataFrame([(i, not k) for i, k in enumerate(known)], "ordinal bigint, is_new boolean"), "ordinal")
    # Plain sequential reading of the rule: threads by first row, the post first, then comments.
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    posts = comments = 0
    want, reasons = set(), {}
    for thread, members in groups.items():
        post = next((m for m in members if m[2] == "post"), None)
        said = [m for m in members if m[2] == "comment"]
        if post and (post[3] is None or post[3].year != 2026):
            continue
        new_post = post is not None and not known[post[1]]
        if new_post and posts >= budget.max_posts:
            continue
        used = sum(known[m[1]] for m in said)
        if new_post:
            posts += 1
            want.add(str(post[1]))
        for m in said:
            if known[m[1]] or (post is None and (m[3] is None or m[3].year != 2026)):
                continue
            if comments >= budget.max_comments:
                reasons[str(m[1])] = "comment_limit"
            elif used >= budget.per_thread:
                reasons[str(m[1])] = "thread_comment_limit"
            else:
                reasons[str(m[1])] = "accepted"
                want.add(str(m[1]))
                comments, used = comments + 1, used + 1
    assert {r["id"] for r in landing.budgeted_select(df, budget).collect()} == want
    assert {r["id"]: r["outcome"] for r in landing.cap_reasons(df, budget).collect()} == reasons
    assert set(reasons.values()) == {"accepted", "comment_limit", "thread_comment_limit"}


def test_stop_reason_order(spark):
    df = spark.createDataFrame([(["post_limit", "unknown_date"], False), ([], False), (["comment_limit"], True)], "r array<string>, reached boolean")
    got = df.select(landing.stop_reason(F.col("reached"), F.col("r")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("unknown_date", False), ("input_exhausted", True), ("target_reached", True)]


def test_upsert_keeps_old_text_but_overwrites_dates(spark):
    schema = "item_key string, source string, id string, content_hash string, title string, board string, text string, rating bigint, published_at timestamp, date_precision string"
    at = dt.datetime(2026, 1, 1)
    stored = spark.createDataFrame([("k1", "ptt", "a", "h1", "T", "B", "old", 3, at, "day")], schema)
    incoming = spark.createDataFrame(
        [
            (1, "ptt", "a", "h9", [], "", None, "edit", None, None, "unknown"), (2, "ptt", "z", "h1", [], "N", "", "", None, None, "unknown"),
            (3, "ptt", "n", "h3", [], "x", "b", "new", 1, at, "day"), (4, "ptt", "m", "h3", [], None, None, "new2", None, at, "week"),
            (5, "ptt", "q", "h5", ["a"], None, None, "", None, None, "unknown"),
        ],
        "ordinal bigint, source string, id string, content_hash string, aliases array<string>, title string, board string, text string, rating bigint, published_at timestamp, date_precision string",
    )
    got = {r["item_key"]: r for r in landing.upsert(stored, incoming).collect()}
    assert set(got) == {"k1", "new3"}
    assert (got["k1"]["title"], got["k1"]["board"], got["k1"]["text"], got["k1"]["rating"]) == ("N", "B", "edit", 3)
    assert (got["k1"]["published_at"], got["k1"]["date_precision"]) == (None, "unknown")
    assert (got["new3"]["id"], got["new3"]["text"], got["new3"]["title"], got["new3"]["date_precision"]) == ("n", "new2", "x", "week")


def fixed_leaders(rows):
    """The rule as stated: in id order, a row far from all leaders leads; the others join the nearest leader before them."""
    led, out = [], {}
    for key, vector in sorted(rows, key=lambda r: r[0]):
        unit = np.array(vector) / np.linalg.norm(vector)
        near = [(-round(float(u @ unit), 9), k) for k, u in led]
        best = min(near, default=(0, None))
        if -best[0] < 0.8:
            led.append((key, unit))
            out[key] = key
        else:
            out[key] = best[1]
    return out


def test_clusters_equal_the_stated_rule(spark):
    """Thousands of rows around centres of which many are near each other, in two reports; unusable vectors take no part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 12))
    data = [(f"i{i:05d}", [float(x) for x in centres[rng.integers(60)] + rng.normal(scale=0.35, size=12)]) for i in range(4000)]
    bad = [("nan", [float("nan")] * 12), ("zero", [0.0] * 12), ("other", [1.0, 2.0])]
    vectors = spark.createDataFrame(data + bad, "id string, embedding array<double>")
    rows = spark.createDataFrame([("r" if i % 3 else "s", k) for i, (k, _) in enumerate(data + bad)], "report_id string, id string")
    got = {(r["report_id"], r["id"]): r["leader"] for r in topics.cluster(rows, vectors).collect()}
    want = {}
    for report in "rs":
        part = [d for i, d in enumerate(data) if ("r" if i % 3 else "s") == report]
        want |= {(report, k): v for k, v in fixed_leaders(part).items()}
    same = sum(got[k] == v for k, v in want.items())
    alone = set(got) - set(want)
    assert {i for _, i in alone} == {"other"} and all(got[k] == "other" for k in alone)
    assert same == len(want)


def test_clusters_do_not_depend_on_cells(spark, monkeypatch):
    """A large group of alike rows with copies, cut into many small cells and other partitions."""
    rng = np.random.default_rng(7)
    data = [(f"i{i:03d}", [float(x) for x in np.eye(4)[i % 4] + rng.normal(scale=0.25, size=4)]) for i in range(300)]
    data += [(f"z{i}", data[5][1]) for i in range(40)]
    rows = spark.createDataFrame([("r", k) for k, _ in data], "report_id string, id string")
    vectors = spark.createDataFrame(data, "id string, embedding array<double>").repartition(7)
    monkeypatch.setattr(topics, "CELL", 16)
    got = {r["id"]: r["leader"] for r in topics.cluster(rows, vectors).collect()}
    want = fixed_leaders(data[:300])
    assert got == want | {f"z{i}": want["i005"] for i in range(40)}
    assert topics.cluster(rows.limit(0), vectors).collect() == []


def test_clusters_take_many_rounds_and_chunks(spark, monkeypatch):
    """Leaders far more than a round or a chunk holds; the texts' vectors are read, never made again, and no pair is shuffled."""
    rng = np.random.default_rng(11)
    data = [(f"i{i:04d}", [float(x) for x in rng.normal(size=6)]) for i in range(900)]
    rows = spark.createDataFrame([("r", k) for k, _ in data], "report_id string, id string")
    vectors = spark.createDataFrame(data, "id string, embedding array<double>").repartition(5)
    monkeypatch.setattr(topics, "CELL", 7)
    monkeypatch.setattr(topics, "HEAD", 20)
    got = {r["id"]: r["leader"] for r in topics.cluster(rows, vectors).collect()}
    assert got == fixed_leaders(data) and len(set(got.values())) > 60


def test_previous_topics_are_matched_without_pairs(spark, monkeypatch):
    """Hundreds of topics against hundreds, cut into chunks: the clear single match of each, as brute force finds it."""
    rng = np.random.default_rng(13)
    old = rng.normal(size=(300, 8))
    old /= np.linalg.norm(old, axis=1)[:, None]
    mine = old[rng.integers(300, size=200)] + rng.normal(scale=0.1, size=(200, 8))
    mine /= np.linalg.norm(mine, axis=1)[:, None]
    topic = "report_id string, leader string, count bigint, centroid array<double>, embedding_model string, own_key string"
    here = spark.createDataFrame([("r2", f"l{i:03d}", 1, v.tolist(), "m", f"own{i}") for i, v in enumerate(mine)], topic)
    there = spark.createDataFrame([("r1", f"K{i:03d}", v.tolist(), "m") for i, v in enumerate(old)], "report_id string, topic_key string, centroid array<double>, embedding_model string")
    monkeypatch.setattr(topics, "CELL", 9)
    out = topics.match_previous(here, there, spark.createDataFrame([("r2", "r1")], "report_id string, previous string"))
    want, used = {}, set()
    for i, likeness in enumerate(mine @ old.T):
        first, second = np.argsort(-likeness)[:2]
        clear = likeness[first] >= C.TOPIC_MATCH and likeness[first] - likeness[second] >= C.TOPIC_MARGIN and first not in used
        want[f"l{i:03d}"] = (f"K{first:03d}", "matched") if clear else (f"own{i}", "new")
        used |= {first} if clear else set()
    assert {r["leader"]: (r["topic_key"], r["mapping"]) for r in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_recall():
    """Pairs of cosine 0.80 share a bucket."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3000, 24))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(3000, 24))
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.8 * a + 0.6 * b / np.linalg.norm(b, axis=1)[:, None]
    signs = [(v @ topics._planes(24) > 0).reshape(3000, topics.BANDS, topics.ROWS) for v in (a, b)]
    assert (signs[0] == signs[1]).all(axis=2).any(axis=1).mean() > 0.998


def test_topic_identity_needs_a_clear_single_match(spark):
    mine = spark.createDataFrame(
        [("r2", "a", 3, [1.0, 0.0], "m", "own-a"), ("r2", "b", 2, [0.999, 0.0447], "m", "own-b"), ("r2", "c", 1, [0.0, 1.0], "m", "own-c")],
        "report_id string, leader string, count bigint, centroid array<double>, embedding_model string, own_key string",
    )
    old = spark.createDataFrame(
        [("r1", "K1", [1.0, 0.0], "m"), ("r1", "K2", [0.0, 1.0], "other"), ("r1", "K3", [0.0, 1.0, 0.0], "m")],
        "report_id string, topic_key string, centroid array<double>, embedding_model string",
    )
    lineage = spark.createDataFrame([("r2", "r1")], "report_id string, previous string")
    got = {r["leader"]: (r["topic_key"], r["mapping"]) for r in topics.match_previous(mine, old, lineage).collect()}
    assert got == {"a": ("K1", "matched"), "b": ("own-b", "new"), "c": ("own-c", "new")}


def test_vector_search_chunks_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base, asked = rng.normal(size=(50, 8)), rng.normal(size=(7, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(99, [1.0])], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id bigint, embedding array<double>")
    monkeypatch.setattr(retrieval, "QUERY_CHUNK", 3)
    got = retrieval.batch_topk(vectors, queries, 5).orderBy("query_id", "position").collect()
    want = [(q, int(v)) for q in range(7) for v in np.argsort(-(base @ asked[q]))[:5]]
    assert [(r["query_id"], r["vec_id"]) for r in got] == want
    many = [pd.DataFrame({"vec_id": range(at, at + 10), "embedding": list(base[at : at + 10])}) for at in range(0, 50, 10)]
    queries.coalesce(1).write.parquet(path := scratch(spark, "asked"))
    for block, reads in ((1, 5), (25, 2), (50, 1), (1000, 1)):
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        parts = list(retrieval._scorer(path, 5)(iter(many)))
        best = pd.concat(parts).sort_values(["query_id", "score"], ascending=[True, False]).groupby("query_id").head(5)
        assert len(parts) == reads and list(zip(best["query_id"], best["vec_id"])) == want


def test_packing_closes_before_overflow(spark):
    df = spark.createDataFrame([("j", str(i), i, s) for i, s in enumerate([40, 70, 10, 10, 200, 5])], "job string, id string, n bigint, size bigint")
    got = packing.pack(df, ["job"], "n", "size", max_items=3, max_chars=100).collect()
    assert [r["batch_no"] for r in sorted(got, key=lambda r: int(r["id"]))] == [1, 2, 2, 2, 3, 4]
    many = packing.pack(df, ["job"], "n", "size", max_items=3, max_chars=100, block=3).collect()
    assert sorted((int(r["id"]), r["batch_no"]) for r in many) == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 3), (5, 4)]


@pytest.mark.parametrize("block", [5, 7, 64, 1000])
def test_packing_does_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(block)
    rows = [(j, f"{j}{i}", i, int(s)) for j, n in (("a", 301), ("b", 5), ("c", 64)) for i, s in enumerate(rng.integers(1, 60, n))]
    df = spark.createDataFrame(rows, "job string, id string, n bigint, size bigint")
    want = {}
    for job in "abc":
        number = held = chars = 0
        for j, key, _, width in rows:
            if j != job:
                continue
            if not number or held >= 5 or chars + width > 100:
                number, held, chars = number + 1, 0, 0
            held, chars = held + 1, chars + width
            want[key] = number
    got = packing.pack(df, ["job"], "n", "size", max_items=5, max_chars=100, block=block).collect()
    assert {r["id"]: r["batch_no"] for r in got} == want


ACTION = "plan_id bigint, key string, priority bigint, dependencies array<string>, hours double"


def test_dependency_order_and_schedule(spark):
    plans = [
        (1, "a", 2, ["b"], 5.0), (1, "b", 3, [], 1.0), (1, "c", 1, ["a"], 2.0), (1, "d", 3, [], 30.0),
        (2, "x", 1, ["y"], 1.0), (2, "y", 1, ["x"], 1.0), (3, "p", 1, ["nowhere"], 1.0), (4, "q", 1, [], 1.0), (4, "q", 2, [], 1.0),
        *[(5, f"k{i}", 1, [], 1.0) for i in range(16)],
    ]
    df = spark.createDataFrame(plans, ACTION)
    got = {r["plan_id"]: (r["ordered"], r["error"]) for r in planning.order_actions(df).collect()}
    assert got == {1: (["b", "a", "c", "d"], None), 2: (None, "cycle"), 3: (None, "missing_dependency"), 4: (None, "duplicate_key"), 5: (sorted(f"k{i}" for i in range(16)), None)}
    options = spark.createDataFrame([(1, 5.0, dt.date(2026, 8, 3))], "plan_id bigint, weekly_hours double, start_date date")
    rows = planning.schedule(df.filter("plan_id = 1"), options).orderBy("place").collect()
    assert [(r["key"], r["start_week"], r["due_week"]) for r in rows] == [("b", 1, 1), ("a", 1, 2), ("c", 2, 2), ("d", 2, 8)]
    assert rows[0]["start_date"] == dt.date(2026, 8, 3) and rows[0]["schedule_mode"] == "dated"


def test_a_plan_with_most_actions_leaves_in_rows(spark):
    """A long chain, its actions given backwards, beside small plans and a cycle behind a long lead."""
    n = 3000
    plans = [(1, f"k{i:04d}", 5 if i else 9, [f"k{i - 1:04d}"] if i else None, 1.0) for i in reversed(range(n))]
    plans += [(p, "a", 1, [], 2.0) for p in range(2, 200)] + [(200, "a", 1, [], 1.0), (200, "b", 1, ["a", "c"], 1.0), (200, "c", 1, ["b", "b"], 1.0)]
    df = spark.createDataFrame(plans, ACTION)
    rows = planning.ordered_rows(df, planning.faults(df), chunk=500).collect()
    assert [r["key"] for r in sorted((r for r in rows if r["plan_id"] == 1), key=lambda r: r["at"])] == [f"k{i:04d}" for i in range(n)]
    assert {(r["plan_id"], r["error"]) for r in planning.plan_errors(df).collect()} == {(200, "cycle")}
    options = spark.createDataFrame([(1, 10.0, None)], "plan_id bigint, weekly_hours double, start_date date")
    last = {r["plan_id"]: r["due_week"] for r in planning.schedule(df, options).collect() if r["place"] in (1, n)}
    assert last[1] == n // 10 and last[2] == 1 and 200 not in last
    assert planning.order_actions(df.limit(0)).collect() == []


def test_a_plan_stays_in_one_task_when_its_join_is_replanned(spark):
    """The join on plan_id becomes a broadcast at run time, after which the adaptive plan reads the shuffled actions in pieces."""
    plans = [(p, f"k{i:02d}", 1, [f"k{i - 1:02d}"] if i else [], 1.0) for i in range(40) for p in range(6)] + [(99, "a", 1, ["nowhere"], 1.0)]
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df = spark.createDataFrame(plans, ACTION).repartition(8)
        rows = planning.ordered_rows(df, planning.faults(df)).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert {(r["plan_id"], r["at"], r["key"]) for r in rows} == {(p, i, f"k{i:02d}") for p in range(6) for i in range(40)} and len(rows) == 240


def test_verdict_thresholds_are_exact(spark):
    schema = (
        "k string, metric_kind string, unit string, direction string, threshold double, minimum_sample bigint, before_count bigint, before_successes bigint, before_mean double, "
        "after_count bigint, after_successes bigint, after_mean double, after_end date, comparable boolean, confounders array<string>"
    )
    end = dt.date(2026, 1, 1)
    rows = [
        ("met", "ratio", "x", "decrease", 10.0, 10, 30, 12, None, 30, 9, None, end, True, []), ("low", "ratio", "x", "decrease", 10.0, 31, 30, 12, None, 30, 9, None, end, True, []),
        ("wait", "mean", "分", "increase", 0.1, 1, 5, None, 0.1, 5, None, 0.2, dt.date(2027, 1, 1), True, []), ("mean", "mean", "分", "increase", 0.1, 1, 5, None, 0.1, 5, None, 0.2, end, True, []),
        ("look", "mean", "分", "increase", 0.1, 1, 5, None, 0.1, 5, None, 0.2, end, True, ["promo"]), ("no", "ratio", "x", "increase", 10.0, 1, 30, 12, None, 30, 9, None, end, True, []),
    ]
    got = {r["k"]: r["verdict"] for r in planning.verdicts(spark.createDataFrame(rows, schema), dt.date(2026, 6, 1)).collect()}
    assert got == {"met": "MET", "low": "INSUFFICIENT", "wait": "OBSERVING", "mean": "MET", "look": "REVIEW", "no": "NOT_MET"}


def test_evidence_round_robin_is_order_free(spark):
    rows = [item(f"a{i:02d}", i, source="ptt" if i % 4 else "dcard", aspects=["service"]) for i in range(90)] + [item("zz", 99, aspects=["other"]), item("blank", 100, text=" ")]
    problems = spark.createDataFrame([("r", 1, "p", ["a05", "a01", "nowhere", "a05"])], "report_id string, problem_no bigint, problem_key string, evidence_ids array<string>")
    chosen = evidence.sample(frame(spark, *rows), problems).orderBy("place").collect()
    again = evidence.sample(frame(spark, *random.Random(1).sample(rows, len(rows))), problems).orderBy("place").collect()
    assert [r["id"] for r in chosen] == [r["id"] for r in again]
    assert len(chosen) == 60 and [r["id"] for r in chosen[:2]] == ["a05", "a01"] and "zz" not in {r["id"] for r in chosen}
    assert [r["source"] for r in chosen[2:6]] == ["dcard", "ptt", "dcard", "ptt"]
    cover = evidence.coverage(frame(spark, *rows), problems).first()
    assert (cover["included"], cover["excluded"], cover["snapshot_count"], cover["text_count"], cover["relevant_count"], cover["omitted"]) == (60, 31, 92, 91, 90, "nowhere")


def test_sentiment_rules(spark):
    rows = frame(
        spark, item("praise", 1, text="真的很好吃，值得再來"), item("not", 2, text="不推薦"), item("push", 3, text="推", signal="push"), item("blank", 4, text=" "),
        item("stars", 5, text="ok", rating=1, source="google_maps"), item("plain", 6, text="nothing here"),
    )
    got = {r["id"]: r for r in labelling.label_items(rows).collect()}
    assert got["praise"]["sentiment"] == "positive" and got["not"]["sentiment"] == "negative"
    assert got["push"]["sentiment"] == "positive" and got["push"]["local_model_id"] == C.VOTE_MODEL
    assert got["blank"]["sentiment"] == "rating_only" and got["blank"]["confidence"] == 1.0
    assert got["stars"]["sentiment"] == "negative" and got["stars"]["local_model_id"].endswith(C.CONTEXT_SUFFIX) and not got["stars"]["rating_text_conflict"]
    assert got["plain"]["sentiment"] == "neutral" and got["plain"]["local_model_id"] == C.LEXICON_MODEL
    assert labelling.fold_label("LABEL_2") == "positive" and labelling.fold_label("Negative") == "negative" and labelling.fold_label("1") == "neutral"


def test_thread_head_and_latest_precision(spark):
    rows = frame(
        spark, item("c1", 1, text="first comment", published_at=dt.datetime(2026, 8, 5), date_precision="week"), item("p", 2, content_type="post", text="post body", title="head", reply_count=80),
        item("c2", 3, published_at=None, date_precision="unknown", reply_count=3), item("x", 4, thread_source_id=None),
    )
    row = stats.threads(rows).first()
    assert (row["title"], row["excerpt"], row["collected_count"], row["reported_reply_count"]) == ("head", "post body", 3, 80)
    assert row["latest_date"] == dt.date(2026, 8, 5) and row["date_precision"] == "week"


def test_lexicon_counts(spark):
    df = rules.add_lexicon(spark.createDataFrame([("LOVE love bad",), ("slow",), ("",)], "text string"), F.col("text"))
    assert [(r["sentiment"], round(r["confidence"], 2)) for r in df.collect()] == [("positive", 0.63), ("negative", 0.63), ("neutral", 0.5)]
