"""Joins, ranked selections and landing jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.operators import keywords, landing, ranks, retrieval
from opinionlake.plans import query
from opinionlake.plans.reporting import _QUESTION, _SCORE
from opinionlake.plans.scoped import dates_as_text
from opinionlake.sources.binding import bare_items, items, labels_for, table, with_items

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def shown(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# ---- membership and label joins -----------------------------------------------------------
@query("join.item_label", with_items("SELECT report_id, id, label_sentiment AS sentiment FROM items"))
def item_label(spark, d):
    rows, labels = bare_items(spark, d), labels_for(spark, d)
    return rows.join(labels, rows["ordinal"] == labels["label_doc"], "left").select(
        "report_id", "id", F.col("label_sentiment").alias("sentiment")
    )


def membership(spark, d):
    """Every item belongs to its report; every twentieth is shared with a second job."""
    rows = bare_items(spark, d)
    jobs = F.when(F.col("ordinal") % 20 == 0, F.array(F.col("report_id"), F.lit("shared"))).otherwise(F.array("report_id"))
    return rows.select(F.explode(jobs).alias("job_id"), F.col("id").alias("item_id"), "ordinal")


_MEMBER = """, member AS (SELECT report_id AS job_id, id AS item_id, ordinal FROM items
 UNION ALL SELECT 'shared', id, ordinal FROM items WHERE ordinal % 20 = 0)"""


@query("join.membership", with_items(_MEMBER + " SELECT job_id, item_id, source FROM member JOIN items ON id = item_id WHERE job_id IN ('shared', 'r1')"))
def join_membership(spark, d):
    chosen = membership(spark, d).filter(F.col("job_id").isin("shared", "r1")).drop("ordinal")
    return chosen.join(bare_items(spark, d).select(F.col("id").alias("item_id"), "source"), "item_id")


@query("join.orphans", with_items(_MEMBER + """ SELECT item_id FROM member GROUP BY 1
 HAVING bool_or(job_id = 'r1') AND bool_and(job_id = 'r1')"""))
def orphans(spark, d):
    return landing.orphans(membership(spark, d), "r1")


@query("join.missing_embeddings", with_items("""SELECT report_id, id FROM items WHERE text <> '' AND ordinal NOT IN (SELECT vec_id FROM embeddings)"""))
def missing_embeddings(spark, d):
    known = table(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"))
    return bare_items(spark, d).filter("text <> ''").join(known, "ordinal", "left_anti").select("report_id", "id")


@query("join.pending_labels", with_items("SELECT report_id, id FROM items WHERE label_sentiment IS NULL"))
def pending_labels(spark, d):
    labels = labels_for(spark, d).filter("label_sentiment is not null").select(F.col("label_doc").alias("ordinal"))
    return bare_items(spark, d).join(labels, "ordinal", "left_anti").select("report_id", "id")


@query("join.missing_results", with_items("""SELECT report_id, count(*) FILTER (v.vec_id IS NULL) AS missing, count(v.vec_id) AS accepted
 FROM items LEFT JOIN (SELECT vec_id FROM embeddings WHERE label <> 3) v ON v.vec_id = ordinal GROUP BY 1"""))
def missing_results(spark, d):
    returned = table(spark, d, "embeddings").filter("label <> 3").select(F.col("vec_id").alias("ordinal"))
    return retrieval.missing_results(bare_items(spark, d).select("report_id", "ordinal"), returned, ["ordinal"], ["report_id"])


@query("join.missing_refs", with_items("""SELECT n_regionkey::BIGINT AS comparison, 'r' || n_nationkey AS report_id, e.report_id IS NULL AS missing
 FROM nation LEFT JOIN (SELECT DISTINCT report_id FROM items) e ON e.report_id = 'r' || n_nationkey"""))
def missing_refs(spark, d):
    refs = table(spark, d, "nation").select(
        F.col("n_regionkey").cast("bigint").alias("comparison"), F.concat(F.lit("r"), "n_nationkey").alias("report_id")
    )
    return retrieval.reference_check(refs, bare_items(spark, d))


@query("join.previous_report", """WITH d AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL), p AS (
 SELECT *, lag(k) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS previous FROM d)
 SELECT o_orderkey, previous FROM orders JOIN p USING (o_custkey, o_orderdate)""")
def previous_report(spark, d):
    reports = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    out = retrieval.previous_report(reports)
    return out.select(F.col("report_id").alias("o_orderkey"), "previous")


@query("join.items_by_ranked_ids", with_items(f""", s AS (SELECT report_id, id, ordinal, CAST({_SCORE} AS BIGINT) AS score FROM (SELECT *, lower(text) AS t FROM items WHERE text <> '')),
 r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, ordinal) AS position, max(score) OVER (PARTITION BY report_id) AS best FROM s)
 SELECT r.report_id, r.id, CAST(position AS INT) AS position, i.source, i.sentiment, i.board FROM r JOIN items i USING (report_id, id)
 WHERE position <= 20 AND (score > 0 OR best = 0)"""))
def items_by_ranked_ids(spark, d):
    rows = items(spark, d)
    ranked = keywords.query_rank(rows, _QUESTION).select("report_id", "id", "position")
    return retrieval.fetch_ranked(ranked, rows.select("report_id", "id", "source", "sentiment", "board"))


@query("join.evidence_tasks", """WITH ev AS (SELECT o_orderkey AS task, o_custkey AS plan, unnest([o_orderkey % 1000, (o_orderkey * 7) % 1500]) AS ref FROM orders)
 SELECT DISTINCT task, plan, CAST(ref AS VARCHAR) AS item_id FROM ev JOIN documents ON doc_id = ref""")
def evidence_tasks(spark, d):
    o = table(spark, d, "orders")
    refs = F.array((F.col("o_orderkey") % 1000).cast("string"), (F.col("o_orderkey") * 7 % 1500).cast("string"))
    tasks = o.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("plan"), refs.alias("evidence_ids"))
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"))
    return retrieval.evidence_tasks(tasks, ids)


# ---- batches ------------------------------------------------------------------------------
# Stored: every document. Incoming: every document again, one in four under a new id (found by hash
# or alias), some with new text, some fields blank; the remainder of four has both id and text new.
def stored_items(spark, d):
    rows = bare_items(spark, d)
    return rows.select(
        F.concat(F.lit("k"), "id").alias("item_key"), "source", "id", F.md5(F.concat("source", "text")).alias("content_hash"),
        "title", "board", "text", "rating", "published_at", "date_precision", "ordinal", "report_id", "thread_source_id", "content_type",
    )


def incoming_items(spark, d):
    rows, n = bare_items(spark, d), F.col("ordinal")
    body = F.when(n % 5 < 2, F.concat(F.lit("edit "), "text")).otherwise(F.col("text"))
    key = F.when(n % 4 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id"))
    aliases = F.when(n % 8 == 0, F.array(F.lit("zz"), F.col("id"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "ordinal", "report_id", "source", key.alias("id"), F.md5(F.concat("source", body)).alias("content_hash"), aliases.alias("aliases"),
        F.when(n % 7 != 0, F.concat(F.lit("new "), "title")).otherwise("").alias("title"),
        F.when(n % 6 != 0, F.col("board")).alias("board"), body.alias("text"),
        F.when(n % 2 == 0, F.col("rating")).alias("rating"),
        F.when(n % 9 != 0, F.col("published_at") + F.expr("INTERVAL 1 HOUR")).alias("published_at"),
        F.when(n % 9 != 0, "day").otherwise("unknown").alias("date_precision"), "thread_source_id", "content_type",
    )


_BATCH = """, st AS (SELECT 'k' || id AS item_key, source, id, md5(source || text) AS content_hash, title, board, text, rating, published_at,
  date_precision, ordinal, report_id, thread_source_id, content_type FROM items), inc AS (SELECT ordinal, report_id, thread_source_id, content_type, source, CASE WHEN ordinal % 4 = 0 THEN 'n' || id ELSE id END AS id,
  md5(source || body) AS content_hash, CASE WHEN ordinal % 8 = 0 THEN ['zz', id] ELSE []::VARCHAR[] END AS aliases,
  CASE WHEN ordinal % 7 <> 0 THEN 'new ' || title ELSE '' END AS title, CASE WHEN ordinal % 6 <> 0 THEN board END AS board, body AS text,
  CASE WHEN ordinal % 2 = 0 THEN rating END AS rating, CASE WHEN ordinal % 9 <> 0 THEN published_at + INTERVAL 1 HOUR END AS published_at,
  CASE WHEN ordinal % 9 <> 0 THEN 'day' ELSE 'unknown' END AS date_precision
  FROM (SELECT *, CASE WHEN ordinal % 5 < 2 THEN 'edit ' || text ELSE text END AS body FROM items)),
 bi AS (SELECT source, id AS k, min(item_key) AS m FROM st GROUP BY ALL), bh AS (SELECT source, content_hash AS k, min(item_key) AS m FROM st GROUP BY ALL),
 ba AS (SELECT ordinal, min(bi.m) AS m FROM (SELECT ordinal, source, unnest(aliases) AS k FROM inc) JOIN bi USING (source, k) GROUP BY 1),
 mt AS (SELECT inc.*, coalesce(bi.m, bh.m, ba.m) AS match_id, CASE WHEN bi.m IS NOT NULL THEN 'id' WHEN bh.m IS NOT NULL THEN 'hash'
  WHEN ba.m IS NOT NULL THEN 'alias' END AS match_by FROM inc LEFT JOIN bi ON bi.source = inc.source AND bi.k = inc.id
  LEFT JOIN bh ON bh.source = inc.source AND bh.k = inc.content_hash LEFT JOIN ba ON ba.ordinal = inc.ordinal)"""


@query("join.upsert_match", with_items(_BATCH + " SELECT ordinal, match_id, match_by FROM mt"))
def upsert_match(spark, d):
    return landing.match_stored(incoming_items(spark, d), stored_items(spark, d)).select("ordinal", "match_id", "match_by")


@query("join.known_keys", with_items(_BATCH + """, kn AS (SELECT source, unnest([id, content_hash]) AS k FROM st) SELECT ordinal, id FROM inc
 WHERE ordinal NOT IN (SELECT x.ordinal FROM (SELECT ordinal, source, unnest(list_concat([id, content_hash], aliases)) AS k FROM inc) x JOIN kn USING (source, k))"""))
def known_keys(spark, d):
    known = landing.checkpoint_keys(stored_items(spark, d), ["source"])
    return landing.only_new(incoming_items(spark, d), known).select("ordinal", "id")


@query("inc.checkpoint_keys", with_items(_BATCH + " SELECT DISTINCT report_id, source, unnest([id, content_hash]) AS key FROM st"))
def checkpoint_keys(spark, d):
    return landing.checkpoint_keys(stored_items(spark, d))


# The batch row by row: known ids and hashes grow as rows are taken.
_ROW_BY_ROW = """, ord AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ordinal) AS rn FROM inc), walk AS (
 SELECT 0 AS rn, NULL::BIGINT AS ordinal, NULL::VARCHAR AS item_key, (SELECT map(list(k), list(m)) FROM (SELECT source || '|' || k AS k, m FROM bi)) AS ids,
  (SELECT map(list(k), list(m)) FROM (SELECT source || '|' || k AS k, m FROM bh)) AS hashes
 UNION ALL SELECT rn, ordinal, key, map_concat(ids, MAP {source || '|' || id: key}), CASE WHEN old IS NULL THEN map_concat(hashes, MAP {source || '|' || content_hash: key}) ELSE hashes END
 FROM (SELECT *, coalesce(old, 'new' || ordinal) AS key FROM (SELECT o.*, ids, hashes, coalesce(ids[o.source || '|' || o.id], hashes[o.source || '|' || o.content_hash],
  list_filter(list_transform(o.aliases, lambda a: ids[o.source || '|' || a]), lambda v: v IS NOT NULL)[1]) AS old FROM walk JOIN ord o ON o.rn = walk.rn + 1)))"""


@query("inc.upsert", with_items(_BATCH + _ROW_BY_ROW + f""", g AS (SELECT item_key, arg_max(struct_pack(p := published_at, q := date_precision), ordinal) AS dt,
  arg_min(struct_pack(i := id, h := content_hash, s := source, o := ordinal, r := report_id, t := thread_source_id, c := content_type), ordinal) AS fst,
  arg_max(title, ordinal) FILTER (title <> '') AS title, arg_max(board, ordinal) FILTER (board <> '') AS board, arg_max(text, ordinal) FILTER (text <> '') AS text,
  arg_max(rating, ordinal) AS rating FROM walk JOIN inc USING (ordinal) GROUP BY 1), j AS (
 SELECT item_key, st.item_key IS NOT NULL AS old, st.* EXCLUDE (item_key), g.* EXCLUDE (item_key) RENAME (title AS nt, board AS nb, text AS nx, rating AS nr) FROM st FULL JOIN g USING (item_key))
 SELECT item_key, CASE WHEN old THEN source ELSE fst.s END AS source, CASE WHEN old THEN id ELSE fst.i END AS id, CASE WHEN old THEN content_hash ELSE fst.h END AS content_hash,
  coalesce(nt, title) AS title, coalesce(nb, board) AS board, coalesce(nx, text) AS text, coalesce(nr, rating) AS rating,
  {_TS.format('CASE WHEN dt IS NOT NULL THEN dt.p ELSE published_at END')} AS published_at, CASE WHEN dt IS NOT NULL THEN dt.q ELSE date_precision END AS date_precision,
  CASE WHEN old THEN ordinal ELSE fst.o END AS ordinal, CASE WHEN old THEN report_id ELSE fst.r END AS report_id,
  CASE WHEN old THEN thread_source_id ELSE fst.t END AS thread_source_id, CASE WHEN old THEN content_type ELSE fst.c END AS content_type FROM j""").replace("WITH ", "WITH RECURSIVE ", 1))
def upsert(spark, d):
    out = landing.upsert(stored_items(spark, d), incoming_items(spark, d))
    return out.withColumn("published_at", shown("published_at"))


@query("win.ordinal", with_items("""SELECT report_id, id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY ordinal) +
 (SELECT count(*) FILTER (x.label_sentiment IS NOT NULL AND x.report_id = n.report_id) FROM items x) AS BIGINT) AS ordinal
 FROM items n WHERE label_sentiment IS NULL"""))
def ordinal(spark, d):
    rows = items(spark, d).select("report_id", "id", "ordinal", "label_sentiment")
    existing = ranks.block_rank(rows.filter("label_sentiment is not null"), ["report_id"], "ordinal", "n")
    existing = existing.select("report_id", "id", F.col("n").alias("ordinal"))
    return landing.add_membership(existing, rows)


@query("win.occurrence", """SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS occurrence,
 sha256(user_id || '|' || event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' ||
  row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id)) AS source_id FROM events""")
def occurrence(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    out = ranks.block_rank(e, ["user_id", "event_type", "day"], "event_id", "occurrence")
    parts = F.concat_ws("|", *[F.col(c).cast("string") for c in ("user_id", "event_type", "day", "occurrence")])
    return out.select("event_id", "occurrence", F.sha2(parts, 256).alias("source_id"))


# ---- budgets ------------------------------------------------------------------------------
BUDGET = landing.Budget(dt.date(2024, 1, 8), dt.date(2024, 2, 25), max_posts=3, max_comments=20, per_thread=4)


def batch(spark, d):
    """Forum rows; those with a label are already stored."""
    rows = items(spark, d).filter("thread_source_id is not null")
    return rows.withColumn("is_new", F.col("label_sentiment").isNull())


def budget_sql(board):
    b = BUDGET
    inside = f"day BETWEEN DATE '{b.date_from}' AND DATE '{b.date_to}'"
    pin = f"p.day BETWEEN DATE '{b.date_from}' AND DATE '{b.date_to}'"
    early = (
        f"CASE WHEN p IS NULL OR p.day IS NULL THEN 'article_parse_partial' WHEN NOT {pin} THEN 'filtered' END"
        if board else f"CASE WHEN p IS NOT NULL AND p.day IS NULL THEN 'unknown_date' WHEN p IS NOT NULL AND NOT {pin} THEN 'filtered' END"
    )
    first, second = (("NOT surv", "thread_comment_limit"), (f"g >= {b.max_comments}", "comment_limit"))
    if not board:
        first, second = second, first
    return f""", bt AS (SELECT *, label_sentiment IS NULL AS is_new FROM items WHERE thread_source_id IS NOT NULL), th0 AS (
  SELECT report_id, source, thread_source_id, min(ordinal) AS fo, count(*) AS items,
   arg_min(struct_pack(day := day, n := is_new), ordinal) FILTER (content_type = 'post') AS p,
   count(*) FILTER (content_type = 'comment' AND NOT is_new) AS stored, count(*) FILTER (NOT is_new) AS dup,
   count(*) FILTER (content_type = 'comment' AND is_new AND day IS NULL) AS und FROM bt GROUP BY ALL), th1 AS (SELECT *, {early} AS early FROM th0), th2 AS (
  SELECT *, sum(CASE WHEN early IS NULL AND coalesce(p.n, false) THEN 1 ELSE 0 END) OVER (PARTITION BY report_id, source ORDER BY fo) AS np FROM th1), th AS (
  SELECT *, coalesce(early, CASE WHEN coalesce(p.n, false) AND np > {b.max_posts} THEN 'post_limit' END, 'open') AS decision FROM th2), cand AS (
  SELECT bt.*, fo, row_number() OVER (PARTITION BY bt.report_id, bt.source, bt.thread_source_id ORDER BY ordinal) <= greatest({b.per_thread} - stored, 0) AS surv
  FROM bt JOIN th USING (report_id, source, thread_source_id) WHERE decision = 'open' AND content_type = 'comment' AND is_new AND (p IS NOT NULL OR {inside})), g AS (
  SELECT *, count(*) FILTER (surv) OVER (PARTITION BY report_id, source ORDER BY fo, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM cand), oc AS (
  SELECT *, CASE WHEN {first[0]} THEN '{first[1]}' WHEN {second[0]} THEN '{second[1]}' ELSE 'accepted' END AS outcome FROM g), sel AS (
  SELECT report_id, source, thread_source_id, id FROM oc WHERE outcome = 'accepted' UNION ALL
  SELECT report_id, source, thread_source_id, arg_min(bt.id, bt.ordinal) FROM bt JOIN th USING (report_id, source, thread_source_id)
   WHERE decision = 'open' AND p.n AND content_type = 'post' AND is_new GROUP BY ALL), met AS (
  SELECT report_id, source, count(*) FILTER (decision = 'open' AND coalesce(p.n, false)) AS posts,
   count(*) FILTER (decision = 'filtered') AS filtered_threads, CAST(sum(CASE WHEN decision = 'open' THEN dup ELSE 0 END) AS BIGINT) AS duplicate_items,
   CAST(sum(CASE WHEN decision = 'unknown_date' THEN items WHEN p IS NULL THEN und ELSE 0 END) AS BIGINT) AS unknown_date_items,
   bool_or(decision = 'post_limit') AS rp, bool_or(decision = 'unknown_date' OR (p IS NULL AND und > 0)) AS ru, bool_or(decision = 'article_parse_partial') AS ra
  FROM th GROUP BY ALL), ocm AS (SELECT report_id, source, count(*) FILTER (outcome = 'accepted') AS comments, bool_or(outcome = 'thread_comment_limit') AS rt,
   bool_or(outcome = 'comment_limit') AS rc FROM oc GROUP BY ALL), ms AS (
  SELECT report_id, source, posts, coalesce(comments, 0) AS comments, duplicate_items, unknown_date_items, filtered_threads,
   posts >= {b.max_posts} AND coalesce(comments, 0) >= {b.max_comments} AS reached, list_sort(list_filter([
   CASE WHEN {'false' if board else 'rp'} OR (posts >= {b.max_posts} AND NOT (posts >= {b.max_posts} AND coalesce(comments, 0) >= {b.max_comments})) THEN 'post_limit' END,
   CASE WHEN {'false' if board else 'ru'} THEN 'unknown_date' END, CASE WHEN ra THEN 'article_parse_partial' END,
   CASE WHEN rt THEN 'thread_comment_limit' END, CASE WHEN rc THEN 'comment_limit' END], lambda x: x IS NOT NULL)) AS reasons
  FROM met LEFT JOIN ocm USING (report_id, source))"""


@query("win.post_cap", with_items(budget_sql(False) + " SELECT report_id, source, thread_source_id, decision FROM th"))
def post_cap(spark, d):
    return landing.thread_plan(batch(spark, d), BUDGET).select("report_id", "source", "thread_source_id", "decision")


@query("win.thread_cap", with_items(budget_sql(True) + " SELECT report_id, source, thread_source_id, id, outcome FROM oc"))
def thread_cap(spark, d):
    return landing.cap_reasons(batch(spark, d), BUDGET, board_rules=True)


@query("win.comment_cap", with_items(budget_sql(False) + " SELECT report_id, source, thread_source_id, id, outcome FROM oc"))
def comment_cap(spark, d):
    return landing.cap_reasons(batch(spark, d), BUDGET)


@query("inc.budgeted_select", with_items(budget_sql(False) + " SELECT * FROM sel"))
def budgeted_select(spark, d):
    return landing.budgeted_select(batch(spark, d), BUDGET).select("report_id", "source", "thread_source_id", "id")


@query("inc.budgeted_select_board", with_items(budget_sql(True) + " SELECT * FROM sel"))
def budgeted_select_board(spark, d):
    return landing.budgeted_select(batch(spark, d), BUDGET, board_rules=True).select("report_id", "source", "thread_source_id", "id")


def _case(order):
    return "CASE " + " ".join(f"WHEN list_contains(reasons, '{r}') THEN '{r}'" for r in order)


@query("inc.stop_reason", with_items(budget_sql(False) + f""" SELECT report_id, source, posts, comments, duplicate_items, unknown_date_items, filtered_threads,
 reached, array_to_string(reasons, ',') AS reasons, CASE WHEN reached THEN 'target_reached' ELSE {_case(C.FORUM_STOP_ORDER)} ELSE 'input_exhausted' END END AS stop_reason,
 reached OR len(reasons) = 0 AS complete FROM ms"""))
def stop_reason(spark, d):
    plan = landing.thread_plan(batch(spark, d), BUDGET)
    out = landing.budget_metrics(plan, BUDGET)
    out = out.withColumn("s", landing.stop_reason(F.col("reached"), F.col("reasons")))
    return out.select("report_id", "source", "posts", "comments", "duplicate_items", "unknown_date_items", "filtered_threads", "reached",
                      F.array_join("reasons", ",").alias("reasons"), "s.stop_reason", "s.complete")


# ---- subjects, deletion, imports ----------------------------------------------------------
@query("inc.subject_upsert", """WITH st AS (SELECT 's' || c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'https://maps/' || c_custkey END AS maps_url,
  md5(c_name) AS subject_key, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS address, c_acctbal AS average_rating, NULL::BIGINT AS total_review_count FROM customer),
 rq AS (SELECT o_orderkey AS request_no, CASE WHEN o_orderkey % 4 = 0 THEN 'https://maps/' || o_custkey WHEN o_orderkey % 4 = 1 THEN 'https://maps/x' || (o_orderkey % 100) END AS maps_url,
  CASE WHEN o_orderkey % 5 = 0 THEN md5('unseen ' || (o_orderkey % 40)) ELSE md5(c_name) END AS subject_key, 'name ' || o_orderpriority AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS address, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS average_rating, o_orderkey % 1000 AS total_review_count
  FROM orders JOIN customer ON c_custkey = o_custkey), f AS (
 SELECT rq.*, coalesce(u.subject_id, k.subject_id, 'new:' || coalesce(rq.maps_url, rq.subject_key)) AS subject_id FROM rq
 LEFT JOIN st u ON u.maps_url = rq.maps_url LEFT JOIN st k ON k.subject_key = rq.subject_key), l AS (
 SELECT subject_id, arg_max(maps_url, request_no) AS maps_url, arg_max(subject_key, request_no) AS subject_key, arg_max(name, request_no) AS name, arg_max(address, request_no) AS address,
  arg_max(average_rating, request_no) AS average_rating, arg_max(total_review_count, request_no) AS total_review_count FROM f GROUP BY 1)
 SELECT subject_id, coalesce(l.maps_url, st.maps_url) AS maps_url, coalesce(st.subject_key, l.subject_key) AS subject_key, coalesce(l.name, st.name) AS name,
 coalesce(l.address, st.address) AS address, coalesce(l.average_rating, st.average_rating) AS average_rating, coalesce(l.total_review_count, st.total_review_count) AS total_review_count
 FROM st FULL JOIN l USING (subject_id)""")
def subject_upsert(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    stored = c.select(
        F.concat(F.lit("s"), k.cast("string")).alias("subject_id"),
        F.when(k % 2 == 0, F.concat(F.lit("https://maps/"), k.cast("string"))).alias("maps_url"),
        F.md5("c_name").alias("subject_key"), F.col("c_name").alias("name"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("address"),
        F.col("c_acctbal").alias("average_rating"), F.lit(None).cast("bigint").alias("total_review_count"),
    )
    n = F.col("o_orderkey")
    url = F.when(n % 4 == 0, F.concat(F.lit("https://maps/"), F.col("o_custkey").cast("string"))).when(
        n % 4 == 1, F.concat(F.lit("https://maps/x"), (n % 100).cast("string"))
    )
    requests = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        n.alias("request_no"), url.alias("maps_url"),
        F.when(n % 5 == 0, F.md5(F.concat(F.lit("unseen "), (n % 40).cast("string")))).otherwise(F.md5("c_name")).alias("subject_key"),
        F.concat(F.lit("name "), "o_orderpriority").alias("name"), F.when(n % 2 == 0, F.col("o_orderpriority")).alias("address"),
        F.when(n % 3 == 0, F.col("o_totalprice")).alias("average_rating"), (n % 1000).alias("total_review_count"),
    )
    return landing.upsert_subjects(stored, requests)


@query("inc.delete_job", with_items(_MEMBER + """, orp AS (SELECT item_id FROM member GROUP BY 1 HAVING bool_or(job_id = 'r1') AND bool_and(job_id = 'r1'))
 SELECT 'membership' AS relation, job_id || ':' || item_id AS key FROM member WHERE job_id <> 'r1'
 UNION ALL SELECT 'items', id FROM items WHERE id NOT IN (FROM orp)
 UNION ALL SELECT 'embeddings', CAST(vec_id AS VARCHAR) FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (FROM orp)
 UNION ALL SELECT 'labels', report_id || ':' || id FROM items WHERE label_sentiment IS NOT NULL AND report_id <> 'r1'"""))
def delete_job(spark, d):
    rows = items(spark, d)
    tables = {
        "items": rows.select(F.col("id").alias("item_id")),
        "embeddings": table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("item_id")),
        "labels": rows.filter("label_sentiment is not null").select(F.col("report_id").alias("job_id"), F.col("id").alias("item_id")),
    }
    left = landing.delete_job(tables, membership(spark, d).drop("ordinal"), "r1")
    parts = []
    for name, df in left.items():
        key = F.concat_ws(":", *[c for c in ("job_id", "item_id") if c in df.columns])
        parts.append(df.select(F.lit(name).alias("relation"), key.alias("key")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("inc.batch_import_once", """SELECT o_orderkey, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_size % 5 = 0 THEN 'invalid'
 WHEN p_size % 3 = 0 THEN 'used' ELSE 'ok' END AS reason FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 2500""")
def batch_import_once(spark, d):
    batches = table(spark, d, "part").select(
        F.col("p_partkey").alias("import_id"), F.when(F.col("p_size") % 5 == 0, "INVALID").otherwise("VALID").alias("validation_status"),
        F.when(F.col("p_size") % 3 == 0, F.lit("job")).alias("used_by"),
    )
    wanted = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2500).alias("import_id"))
    return landing.import_use(wanted, batches).select("o_orderkey", "reason")


# ---- roll-ups -----------------------------------------------------------------------------
@query("agg.source_kind_counts", with_items("""SELECT report_id, source, count(*) AS total, count(*) FILTER (content_type = 'post') AS posts,
 count(*) FILTER (content_type = 'comment') AS comments FROM items GROUP BY ALL"""))
def source_kind_counts(spark, d):
    return landing.kind_counts(bare_items(spark, d))


@query("agg.thread_state", with_items("""SELECT report_id, source, coalesce(nullif(thread_source_id, ''), id) AS thread, count(*) FILTER (content_type = 'comment') AS comment_count,
 bool_or(content_type = 'post') AS has_post, max(source_url) FILTER (content_type = 'post') AS thread_url FROM items WHERE content_type IN ('post', 'comment') GROUP BY ALL"""))
def thread_state(spark, d):
    return landing.thread_state(bare_items(spark, d))


_CONFIG_SQL = """cfg AS (SELECT l_orderkey AS job_id, ['google_maps', 'ptt', 'dcard'][CAST(l_linenumber % 3 + 1 AS INT)] AS source,
 min(CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS BIGINT) END) AS max_reviews, min(l_partkey % 200) AS max_posts, min(l_suppkey % 2000) AS max_comments,
 bool_and(l_returnflag <> 'R') AS complete, max(l_shipdate) AS x, CAST(sum(CASE WHEN l_discount > 0.07 THEN 1 ELSE 0 END) AS BIGINT) AS collected,
 max(CASE l_linestatus WHEN 'F' THEN 'BLOCKED' ELSE 'COMPLETE' END) AS status, min(CASE WHEN l_returnflag = 'A' THEN 'page_limit' ELSE 'unknown_date' END) AS stop_reason
 FROM lineitem GROUP BY ALL), tg AS (SELECT *, CASE source WHEN 'google_maps' THEN coalesce(max_reviews, 500) ELSE max_posts + max_comments END AS target FROM cfg)"""


def source_runs(spark, d):
    li = table(spark, d, "lineitem")
    source = F.element_at(F.array(*[F.lit(s) for s in C.SOURCES]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    out = li.groupBy(F.col("l_orderkey").alias("job_id"), source.alias("source")).agg(
        F.min(F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("bigint"))).alias("max_reviews"),
        F.min(F.col("l_partkey") % 200).alias("max_posts"), F.min(F.col("l_suppkey") % 2000).alias("max_comments"),
        F.bool_and(F.col("l_returnflag") != "R").alias("complete"), F.count_if(F.col("l_discount") > 0.07).alias("collected"),
        F.max(F.when(F.col("l_linestatus") == "F", "BLOCKED").otherwise("COMPLETE")).alias("status"),
        F.min(F.when(F.col("l_returnflag") == "A", "page_limit").otherwise("unknown_date")).alias("stop_reason"),
    )
    return landing.collection_target(out)


@query("agg.collection_target", f"WITH {_CONFIG_SQL} SELECT job_id, CAST(sum(target) AS BIGINT) AS target FROM tg GROUP BY 1")
def collection_target(spark, d):
    return source_runs(spark, d).groupBy("job_id").agg(F.sum("target").alias("target"))


@query("agg.collection_rollup", f"""WITH {_CONFIG_SQL}, r AS (SELECT job_id, CAST(sum(target) AS BIGINT) AS target_count, CAST(sum(collected) AS BIGINT) AS actual_count,
 bool_and(complete) AS c, coalesce(string_agg(source || ':' || stop_reason, ';' ORDER BY source) FILTER (NOT complete), '') AS rs, bool_or(status = 'BLOCKED') AS b FROM tg GROUP BY 1)
 SELECT job_id, target_count, actual_count, c AND actual_count > 0 AS complete, CASE WHEN actual_count = 0 AND b THEN 'BLOCKED' WHEN actual_count = 0 THEN 'FAILED'
 ELSE 'READY_FOR_ANALYSIS' END AS status, CASE WHEN actual_count = 0 AND rs = '' THEN 'no_data' WHEN actual_count = 0 THEN rs
 WHEN c THEN 'all_complete' ELSE rs END AS stop_reason FROM r""")
def collection_rollup(spark, d):
    return landing.collection_rollup(source_runs(spark, d))


@query("agg.run_usage", """SELECT l_suppkey AS plan_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber) AS BIGINT) AS output_tokens,
 CAST(sum(l_partkey) AS BIGINT) AS elapsed_ms, bool_or(l_linenumber > 6) AS reused,
 (CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 2.5::DOUBLE + CAST(sum(l_linenumber) AS BIGINT) * 10.0::DOUBLE) / 1e6 AS cost FROM lineitem GROUP BY 1""")
def run_usage(spark, d):
    runs = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("plan_id"), F.col("l_quantity").cast("bigint").alias("input_tokens"),
        F.col("l_linenumber").cast("bigint").alias("output_tokens"), F.col("l_partkey").alias("elapsed_ms"),
        F.when(F.col("l_linenumber") > 6, 2).otherwise(1).alias("attempts"),
    )
    return landing.run_usage(runs, 2.5, 10.0)
