"""Snapshots, imports, exports and layout upgrades."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import identity
from opinionlake.operators import backfill, ranks, stats
from opinionlake.operators import scope as S
from opinionlake.plans import query
from opinionlake.plans.hygiene import AUTHOR_KEY, _INNER, _OUTER, norm_sql, redact_sql
from opinionlake.plans.landing import shown
from opinionlake.plans.scoped import DIGESTS, dates_as_text, key_sql, trend_sql
from opinionlake.session import scratch
from opinionlake.sources import exports, imports, snapshot
from opinionlake.sources.binding import bare_items, items, table, text_table, with_items

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# ---- snapshots ----------------------------------------------------------------------------
def snapshot_rows(spark, d, found=None):
    rows = items(spark, d, heavy=True)
    stored = rows.select(
        "id", "source", "content_type", "title", "text", "board", "thread_source_id", "source_url", "rating", "published_at", "date_precision",
        "signal", F.create_map(F.lit("reply_count"), F.col("reply_count").cast("double"), F.lit("secret"), F.lit(1.0)).alias("metrics"),
    )
    links = rows.select("report_id", "id", "ordinal")
    labels = rows.filter("label_sentiment is not null").select(
        "report_id", "id", F.col("label_sentiment").alias("sentiment"), "confidence", "aspects", "negative_aspects", "rating_text_conflict"
    )
    reports = rows.select("report_id").distinct().select("report_id", F.concat(F.lit("Brand "), "report_id").alias("subject_name"))
    return snapshot.snapshot(stored, links, labels, reports, found), reports


_SNAP = f""" SELECT report_id, id, ordinal, {redact_sql('text')} AS text, {redact_sql('title')} AS title, channel_label, source_url, label_sentiment AS sentiment,
 CASE WHEN label_sentiment IS NOT NULL THEN array_to_string(aspects, ',') ELSE '' END AS aspects,
 CASE WHEN label_sentiment IS NOT NULL THEN rating_text_conflict ELSE false END AS rating_text_conflict, reply_count::DOUBLE AS reply_count FROM items"""


def _shown(rows):
    return rows.select(
        "report_id", "id", "ordinal", "text", "title", "channel_label", "source_url", "sentiment", F.array_join("aspects", ",").alias("aspects"),
        "rating_text_conflict", F.try_element_at("metrics", F.lit("reply_count")).alias("reply_count"),
    )


@query("src.snapshot", with_items(_SNAP))
def src_snapshot(spark, d):
    return _shown(snapshot_rows(spark, d)[0])


@query("src.snapshot_topics", with_items(" SELECT report_id, id, ordinal, array_to_string(list_sort(topic_keys), ',') AS topics FROM items"))
def snapshot_topics(spark, d):
    """Topics found for a report come with the frozen items; a topic named twice for an item counts once."""
    found = items(spark, d).select("report_id", "id", F.explode("topic_keys").alias("topic_key"))
    rows = snapshot_rows(spark, d, found.unionByName(found))[0]
    return rows.select("report_id", "id", "ordinal", F.array_join("topic_keys", ",").alias("topics"))


@query("src.snapshot_once", with_items(_SNAP))
def snapshot_once(spark, d):
    """Frozen twice, the second time with changed texts: the first version must stay."""
    rows, reports = snapshot_rows(spark, d)
    path = scratch(spark, "snapshot")
    snapshot.save_once(rows, reports, path)
    changed = rows.withColumn("text", F.lit("changed later"))
    return _shown(snapshot.save_once(changed, reports, path))


@query("agg.content_digest", with_items("""SELECT report_id, sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 8))::BIGINT) || '|' || sum(('0x' || substr(h, 9, 8))::BIGINT) || '|' ||
 sum(('0x' || substr(h, 17, 8))::BIGINT) || '|' || sum(('0x' || substr(h, 25, 8))::BIGINT)) AS content_digest FROM (
 SELECT report_id, md5(id || chr(1) || source || chr(1) || coalesce(sentiment, chr(2)) || chr(1) || text) AS h FROM items) GROUP BY 1"""))
def content_digest(spark, d):
    return S.digest(items(spark, d), ["id", "source", "sentiment", "text"])


_META = ("title", "board", "thread_source_id", "source_url", "rating", "relative_date")


@query("agg.unavailable_fields", with_items("""SELECT report_id, array_to_string(list_filter([CASE WHEN count(CASE WHEN report_id <> 'r2' THEN title END) = 0 THEN 'title' END, CASE WHEN count(board) = 0 THEN 'board' END,
 CASE WHEN count(thread_source_id) = 0 THEN 'thread_source_id' END, CASE WHEN count(source_url) = 0 THEN 'source_url' END, CASE WHEN count(rating) = 0 THEN 'rating' END, 'relative_date'], lambda x: x IS NOT NULL), ',') AS unavailable_fields FROM items GROUP BY 1"""))
def unavailable_fields(spark, d):
    rows = items(spark, d).withColumns({"relative_date": F.lit(None).cast("string"), "title": F.when(F.col("report_id") != "r2", F.col("title"))})
    return S.unavailable(rows, _META).withColumn("unavailable_fields", F.array_join("unavailable_fields", ","))


SCOPE = S.Scope(date_from=dt.date(2024, 1, 10), date_to=dt.date(2024, 2, 20), interval="week", precision_policy="interval", source="dcard")
_INC = f"source = 'dcard' AND (day IS NULL OR day BETWEEN DATE '{SCOPE.date_from}' AND DATE '{SCOPE.date_to}')"


@query("sink.scope_row", with_items(f"""SELECT report_id, count(*) AS raw_count, count(DISTINCT id) AS deduplicated_count,
 count(*) FILTER ({_INC} AND day IS NOT NULL AND date_precision IN ('day', 'week')) AS included_count, count(*) FILTER ({_INC} AND day IS NULL) AS unknown_date_count,
 count(*) FILTER ({_INC} AND day IS NOT NULL AND date_precision NOT IN ('day', 'week')) AS imprecise_date_count,
 count(*) FILTER ({_INC} AND (day IS NULL OR date_precision NOT IN ('day', 'week'))) AS excluded_count, 'snapshot' AS data_basis, 4::BIGINT AS snapshot_version, 'relative_date' AS unavailable_fields,
 '{SCOPE.as_json()}' AS filters, substr(sha256(report_id || '|4|' || sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 8))::BIGINT) || '|' || sum(('0x' || substr(h, 9, 8))::BIGINT) || '|' ||
 sum(('0x' || substr(h, 17, 8))::BIGINT) || '|' || sum(('0x' || substr(h, 25, 8))::BIGINT)) || '|' || '{SCOPE.as_json()}'), 1, 24) AS scope_key
 FROM (SELECT *, md5(id || chr(1) || source || chr(1) || coalesce(sentiment, chr(2)) || chr(1) || text) AS h FROM items) GROUP BY 1"""))
def scope_row(spark, d):
    rows = items(spark, d).withColumn("relative_date", F.lit(None).cast("string"))
    out = S.scope_rows(rows, SCOPE, _META, ["id", "source", "sentiment", "text"])
    return out.withColumn("unavailable_fields", F.array_join("unavailable_fields", ","))


# ---- exports ------------------------------------------------------------------------------
_SAFE = "CASE WHEN regexp_matches({0}, '^\\s*[=+@-]') THEN '''' || {0} ELSE {0} END"
_ITEM_EXPORT = with_items(f"""SELECT report_id, id, source, content_type, {_SAFE.format('title')} AS title, board, thread_source_id, source_url, rating, {_SAFE.format('text')} AS text,
 sentiment, confidence, rating_text_conflict, array_to_string(aspects, '|') AS aspects, array_to_string(key_points, '|') AS key_points FROM items""")


@query("sink.items_csv", _ITEM_EXPORT)
def items_csv(spark, d):
    rows = exports.item_rows(items(spark, d))
    path = scratch(spark, "items-csv")
    exports.write_csv(rows, path)
    return exports.read_csv(spark, path, rows.schema).drop("relative_date")


@query("sink.items_json", _ITEM_EXPORT)
def items_json(spark, d):
    rows = exports.item_rows(items(spark, d))
    path = scratch(spark, "items-json")
    whole = items(spark, d).withColumn("relative_date", F.lit(None).cast("string"))
    exports.write_json(rows, S.scope_rows(whole, S.Scope(), _META, list(S.CONTENT)), path)
    return spark.read.schema(rows.schema).json(f"{path}/items").drop("relative_date")


_TREND_WEEK = trend_sql("week")


_WEEKLY = S.Scope(interval="week", precision_policy="interval")


@query("sink.trend_csv", with_items(f""", {DIGESTS} SELECT report_id, period, period_end, count, classified_count, positive_count, neutral_count, negative_count, rating_only_count, unknown_count, round(negative_ratio, 9) AS negative_ratio, round(pn_ratio, 9) AS pn_ratio,
 {key_sql(_WEEKLY)} AS scope_key FROM ({_TREND_WEEK}) JOIN dg USING (report_id)"""))
def trend_csv(spark, d):
    series = stats.trend(S.select(items(spark, d), _WEEKLY), "week")
    keyed = S.with_scope_key(dates_as_text(series), items(spark, d), _WEEKLY)
    rows = exports.trend_rows(keyed)
    path = scratch(spark, "trend-csv")
    exports.write_csv(rows, path)
    out = exports.read_csv(spark, path, rows.schema)
    return out.withColumns({c: F.round(c, 9) for c in ("negative_ratio", "pn_ratio")})


@query("sink.evidence_csv", with_items(f"""SELECT report_id, id, source, {_SAFE.format('title')} AS title, {_SAFE.format('text')} AS text, board,
 strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at_estimated, date_precision, sentiment FROM items WHERE sentiment = 'negative'"""))
def evidence_csv(spark, d):
    rows = exports.evidence_rows(S.select(items(spark, d), S.Scope(sentiment="negative")))
    path = scratch(spark, "evidence-csv")
    exports.write_csv(rows, path)
    return exports.read_csv(spark, path, rows.schema)


# ---- imports ------------------------------------------------------------------------------
def import_rows(spark, d):
    """One import file per language, one row per document, a different fault at each remainder of 23."""
    n, doc = F.col("doc_id") % 23, F.col("doc_id")
    thread = F.expr("doc_id div 15 + 1000000").cast("string")
    forum = F.when((n == 12), "elsewhere").otherwise(F.col("source"))
    post = doc % 5 == 0
    file = F.concat(F.lit("f"), F.expr("doc_id div 40").cast("string"))
    return text_table(spark, d).select(
        file.alias("file"), (doc + 2).alias("row_no"),
        F.when(n == 1, "thread").when(post, "Post ").otherwise("comment").alias("item_type"),
        F.when(n == 2, F.lit("9")).when(post, F.lit("")).when(n == 3, thread).otherwise(F.concat(F.lit("c"), F.expr("doc_id div 2").cast("string"))).alias("source_item_id"),
        F.when(n == 4, F.lit("")).when(n == 5, F.lit("77")).otherwise(thread).alias("thread_id"), F.lit(None).cast("string").alias("parent_id"),
        F.concat(F.lit("t "), F.expr("doc_id div 2").cast("string")).alias("title"), F.when(n == 6, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.when(n == 7, "yesterday").otherwise("2024-03-01T08:00:00").alias("published_at"),
        F.when(n == 8, "other").otherwise(F.upper(forum)).alias("forum"),
        F.when(n == 9, F.lit("https://example.com/x")).otherwise(F.concat(F.lit("https://www.dcard.tw/f/"), forum, F.lit("/p/"), thread)).alias("source_url"),
        F.concat(F.lit("user "), (doc % 50).cast("string")).alias("author"), F.when(n == 10, "-1").when(n == 11, "many").otherwise((doc % 7).cast("string")).alias("reaction_count"),
    )


_IMP = f"""imp AS (SELECT 'f' || (doc_id // 40) AS file, doc_id + 2 AS row_no, doc_id, doc_id % 23 AS n, doc_id % 5 = 0 AS post, CAST(doc_id // 15 + 1000000 AS VARCHAR) AS th,
  CASE WHEN doc_id % 23 = 12 THEN 'elsewhere' ELSE source END AS fo, {norm_sql('text')} AS body, text FROM documents), ie AS (SELECT *,
  CASE WHEN n = 1 THEN 'item_type' WHEN n = 6 OR body = '' THEN 'text' WHEN n = 9 THEN 'source_url' WHEN n = 7 THEN 'published_at' WHEN n = 4 AND NOT post THEN 'thread_missing' WHEN n = 5 THEN 'thread_mismatch'
   WHEN n = 8 THEN 'forum_mismatch' WHEN n = 2 AND post THEN 'post_id' WHEN n = 3 AND NOT post THEN 'comment_id' WHEN n = 11 THEN 'reaction_type' WHEN n = 10 THEN 'reaction_negative' END AS error,
  CASE WHEN post THEN th WHEN n = 2 THEN '9' WHEN n = 3 THEN th ELSE 'c' || (doc_id // 2) END AS sid FROM imp), ff AS (SELECT file, th, arg_min(fo, row_no) AS f0 FROM ie WHERE error IS NULL GROUP BY ALL), i2 AS (
  SELECT ie.*, CASE WHEN error IS NULL AND fo <> f0 THEN 'thread_in_two_forums' ELSE error END AS error2, md5(concat_ws('|', post, sid, th, doc_id // 2, body, fo, doc_id % 50, doc_id % 7)) AS bd FROM ie LEFT JOIN ff USING (file, th)), fb AS (
  SELECT file, sid, arg_min(bd, row_no) AS b0, min(row_no) AS r0 FROM i2 WHERE error2 IS NULL GROUP BY ALL), i3 AS (
  SELECT i2.*, CASE WHEN error2 IS NULL AND bd <> b0 THEN 'identity_conflict' ELSE error2 END AS error3 FROM i2 LEFT JOIN fb USING (file, sid) WHERE NOT coalesce(error2 IS NULL AND bd = b0 AND row_no > r0, false))"""


@query("dq.import_row", f"WITH {_IMP} SELECT file, row_no, error FROM ie")
def import_row(spark, d):
    return imports.check_rows(import_rows(spark, d)).select("file", "row_no", "error")


def checked_imports(spark, d):
    keys = identity.key_frame(spark, AUTHOR_KEY)
    rows = imports.check_rows(import_rows(spark, d))
    return imports.check_conflicts(rows.withColumn("author_hash", identity.author_hash(keys, F.lit("dcard"), F.col("author"))))


@query("dq.import_conflict", f"WITH {_IMP} SELECT file, row_no, error3 AS error FROM i3")
def import_conflict(spark, d):
    return checked_imports(spark, d).select("file", "row_no", "error")


@query("dq.import_all_or_nothing", f"""WITH {_IMP}, m AS (SELECT file, row_no || ':' || error3 AS msg, row_no FROM i3 WHERE error3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY row_no) <= 20)
 SELECT file, count(*) AS rows, count(error3) AS errors, coalesce(any_value(msgs), '') AS messages, greatest(count(error3) - 20, 0) AS more FROM i3 LEFT JOIN (SELECT file, string_agg(msg, ';' ORDER BY row_no) AS msgs FROM m GROUP BY 1) USING (file) GROUP BY 1""")
def import_all_or_nothing(spark, d):
    return imports.file_report(checked_imports(spark, d))


_ITEM_SQL = f"""SELECT id, content_type, thread_source_id, parent_source_id, sha256('dcard' || chr(0) || id || chr(0) || body) AS content_hash, aliases, board, published_at, reaction_count FROM (
 SELECT CASE WHEN post THEN th WHEN doc_id % 2 = 0 THEN h ELSE 'c' || doc_id END AS id, CASE WHEN post THEN 'post' ELSE 'comment' END AS content_type, th AS thread_source_id,
 CASE WHEN NOT post THEN th END AS parent_source_id, body, CASE WHEN post THEN h ELSE '' END AS aliases, source AS board, '2024-03-01 00:00:00' AS published_at, doc_id % 7 AS reaction_count FROM (
 SELECT *, doc_id % 5 = 0 AS post, CAST(doc_id // 15 + 1000000 AS VARCHAR) AS th, body0 AS body, sha256('dcard-import' || chr(0) || 'https://www.dcard.tw/f/' || source || '/p/' || (doc_id // 15 + 1000000) || chr(0) || CASE WHEN doc_id % 5 = 0 THEN 'post' ELSE 'comment' END
  || chr(0) || '2024-03-01T08:00:00' || chr(0) || body0) AS h FROM (SELECT *, {norm_sql('text')} AS body0 FROM documents)))"""


@query("page.import_items", _ITEM_SQL)
def import_items(spark, d):
    doc = F.col("doc_id")
    thread = F.expr("doc_id div 15 + 1000000").cast("string")
    raw = text_table(spark, d).select(
        F.lit("f").alias("file"), (doc + 2).alias("row_no"), F.when(doc % 5 == 0, "post").otherwise("comment").alias("item_type"),
        F.when((doc % 5 == 0) | (doc % 2 == 0), "").otherwise(F.concat(F.lit("c"), doc.cast("string"))).alias("source_item_id"), thread.alias("thread_id"),
        F.lit(None).cast("string").alias("parent_id"), F.lit("t").alias("title"), "text", F.lit("2024-03-01T08:00:00").alias("published_at"), F.lit("").alias("forum"),
        F.concat(F.lit("https://www.dcard.tw/f/"), "source", F.lit("/p/"), thread).alias("source_url"), F.lit("a").alias("author"), (doc % 7).cast("string").alias("reaction_count"),
    )
    out = imports.to_items(imports.check_rows(raw).withColumn("author_hash", F.lit(None).cast("string")))
    return out.select(
        "id", "content_type", "thread_source_id", "parent_source_id", "content_hash", F.array_join("aliases", ",").alias("aliases"), "board",
        shown("published_at").alias("published_at"), "reaction_count",
    )


def _written_rows(spark, d):
    """Import files hold 40 rows each, far below the file limits, at any table size."""
    return import_rows(spark, d).select("file", "row_no", *C.IMPORT_FIELDS)


_READ_SQL = f"""WITH {_IMP} SELECT 'f' || (doc_id // 40) AS file, CASE WHEN n = 1 THEN 'thread' WHEN post THEN 'Post ' ELSE 'comment' END AS item_type, 't ' || (doc_id // 2) AS title,
 md5(CASE WHEN n = 6 THEN '  ' ELSE text END) AS text, CASE n WHEN 10 THEN '-1' WHEN 11 THEN 'many' ELSE CAST(doc_id % 7 AS VARCHAR) END AS reaction_count FROM imp"""


def _read_back(spark, path, kind):
    rows = imports.read_files(spark, path, kind)
    name = F.regexp_extract("file", r"group=([^/]+)/", 1)
    return rows.select(name.alias("file"), "item_type", "title", F.md5("text").alias("text"), "reaction_count")


@query("src.import_csv", _READ_SQL)
def import_csv(spark, d):
    path = scratch(spark, "import-csv")
    rows = _written_rows(spark, d).withColumnRenamed("file", "group").drop("row_no").repartition("group")
    writer = rows.write.partitionBy("group").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    return _read_back(spark, path, ".csv")


@query("src.import_json", _READ_SQL)
def import_json(spark, d):
    path = scratch(spark, "import-json")
    rows = _written_rows(spark, d).withColumnRenamed("file", "group")
    one = F.to_json(F.struct(*C.IMPORT_FIELDS), {"ignoreNullFields": "false"})
    # Files of at most 40 rows: one JSON array each, every second one wrapped in {"items": [...]}.
    packed = rows.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", one.alias("j")))), lambda s: s["j"]), ",").alias("body"))
    wrapped = F.length("group") % 2 == 0
    value = F.when(wrapped, F.concat(F.lit('{"items":['), "body", F.lit("]}"))).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    packed.select("group", value.alias("value")).repartition("group").write.partitionBy("group").option("lineSep", "\n").format("text").save(path)
    return _read_back(spark, path, ".json")


# ---- upgrades -----------------------------------------------------------------------------
@query("bf.report_payload", """SELECT o_orderkey AS report_id, CASE WHEN v IN (2, 4) THEN v ELSE 2 END AS schema_version, CASE WHEN v IN (2, 4) THEN s ELSE coalesce(s, 0) END AS overall_size,
 CASE WHEN v IN (2, 4) THEN t ELSE coalesce(t, 0) END AS overall_texts, CASE WHEN v IN (2, 4) THEN 3 ELSE coalesce(s, 0) END AS maps_size, CASE WHEN v IN (2, 4) THEN t ELSE coalesce(t, s, 0) END AS target_count,
 CASE WHEN v IN (2, 4) THEN s ELSE coalesce(s, 0) END AS actual_count, CASE WHEN v IN (2, 4) THEN c ELSE coalesce(c, true) END AS complete, CASE WHEN v IN (2, 4) THEN 'X' WHEN coalesce(c, true) THEN 'COMPLETE' ELSE 'PARTIAL' END AS maps_status,
 CASE WHEN v IN (2, 4) THEN r ELSE coalesce(r, 'legacy_report') END AS stop_reason, CASE WHEN v IN (2, 4) THEN NULL ELSE '舊版報告未提供管理摘要。' END AS summary FROM (
 SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END::BIGINT AS v, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 50 END AS t,
 CASE WHEN o_orderkey % 3 = 0 THEN false WHEN o_orderkey % 3 = 1 THEN true END AS c, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS r FROM orders)""")
def report_payload(spark, d):
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        n.alias("report_id"), F.when(n % 4 == 0, 1).when(n % 4 == 1, 2).when(n % 4 == 2, 4).cast("bigint").alias("schema_version"),
        F.when(n % 5 != 0, F.col("o_custkey")).alias("sample_size"), F.when(n % 7 != 0, F.col("o_custkey") % 50).alias("text_count"), F.lit(3).cast("bigint").alias("maps_size"),
        F.when(n % 7 != 0, F.col("o_custkey") % 50).alias("target_count"), F.when(n % 5 != 0, F.col("o_custkey")).alias("actual_count"),
        F.when(n % 3 == 0, False).when(n % 3 == 1, True).alias("complete"), F.lit("X").alias("maps_status"), F.when(n % 2 == 0, F.col("o_orderstatus")).alias("stop_reason"),
        F.lit(None).cast("string").alias("summary"),
    )
    return backfill.report_layout(rows)


def old_links(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") - F.col("c_custkey") % 3 % 2).alias("subject_id"))
    o = table(spark, d, "orders")
    rows = o.select((F.col("o_custkey") - F.col("o_custkey") % 3 % 2).alias("subject_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("order_no"))
    reports = table(spark, d, "customer").select(
        F.col("c_custkey").alias("job_id"), F.array(F.col("c_custkey") * 3, F.col("c_custkey"), F.col("c_custkey") * 3).alias("item_ids")
    )
    return backfill.membership(jobs, rows, reports)


_LINKS = """jb AS (SELECT c_custkey AS job_id, c_custkey - c_custkey % 3 % 2 AS s FROM customer), one AS (SELECT s, min(job_id) AS job_id FROM jb GROUP BY 1 HAVING count(*) = 1), lk AS (
 SELECT job_id, o_orderkey AS item_id, 0 AS p, o_orderkey AS t FROM orders JOIN one ON s = o_custkey - o_custkey % 3 % 2
 UNION ALL SELECT c_custkey, unnest([c_custkey * 3, c_custkey]), 1, unnest([0, 1]) FROM customer), lm AS (SELECT job_id, item_id, min(struct_pack(p := p, t := t)) AS z FROM lk GROUP BY ALL), ls AS (
 SELECT job_id, item_id, row_number() OVER (PARTITION BY job_id ORDER BY z) AS ordinal FROM lm)"""


@query("bf.membership", f"WITH {_LINKS} SELECT job_id, item_id, ordinal FROM ls")
def bf_membership(spark, d):
    return old_links(spark, d)


@query("bf.labels_per_job", f"WITH {_LINKS} SELECT job_id, item_id, o_orderstatus AS label FROM ls JOIN orders ON o_orderkey = item_id")
def labels_per_job(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("label"))
    return backfill.fan_out_labels(labels, old_links(spark, d))


@query("bf.merge_vectors", """WITH v AS (SELECT vec_id AS item_id, 'm' || (label % 2) AS model_id, embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id % 3 <> 0), o AS (
 SELECT vec_id AS item_id, 'm' || (vec_id % 2) AS model_id, vec_id * 2 + n AS row_no, embedding[n + 2]::DOUBLE AS x FROM embeddings, (SELECT unnest([0, 1]) AS n))
 SELECT item_id, model_id, round(x, 6) AS first FROM v UNION ALL SELECT item_id, model_id, round(arg_min(x, row_no), 6) FROM o
 WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.item_id = o.item_id AND v.model_id = o.model_id) GROUP BY item_id, model_id""")
def merge_vectors(spark, d):
    """Old vectors come twice per item; they fill the (item, model) pairs that have none yet."""
    e = table(spark, d, "embeddings")
    name = lambda n: F.concat(F.lit("m"), (n % 2).cast("string")).alias("model_id")
    new = e.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("item_id"), name(F.col("label")), F.slice("embedding", 1, 8).alias("vector"))
    twice = e.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    old = twice.select(F.col("vec_id").alias("item_id"), name(F.col("vec_id")), (F.col("vec_id") * 2 + F.col("n")).alias("row_no"), F.slice("embedding", F.col("n") + 2, F.lit(8)).alias("vector"))
    merged = backfill.merge_vectors(new, old)
    return merged.select("item_id", "model_id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("bf.subject_keys", """WITH s AS (SELECT s_suppkey::BIGINT AS subject_id, 'Name ' || (s_suppkey % 40) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'X' END AS address, CASE WHEN s_suppkey % 3 = 0 THEN sha256('business|name ' || (s_suppkey % 40) || '|') END AS k FROM supplier
 UNION ALL SELECT 100000000 + c_custkey, c_name, c_mktsegment, NULL FROM customer), p AS (SELECT *, 'business|' || lower(name) || '|' || lower(coalesce(address, '')) AS pl FROM s), q AS (
 SELECT *, sha256(pl) AS h, sha256(pl) IN (SELECT k FROM s WHERE k IS NOT NULL) AS taken FROM p), r AS (SELECT h, min(subject_id) AS f FROM q WHERE k IS NULL GROUP BY 1)
 SELECT subject_id, name, address, coalesce(k, CASE WHEN NOT taken AND subject_id = f THEN q.h ELSE sha256(pl || '|' || subject_id) END) AS subject_key FROM q LEFT JOIN r ON r.h = q.h""")
def bf_subject_keys(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    n = F.col("s_suppkey")
    name = F.concat(F.lit("Name "), (n % 40).cast("string"))
    kept = F.sha2(F.concat(F.lit("business|name "), (n % 40).cast("string"), F.lit("|")), 256)
    old = s.select(n.alias("subject_id"), name.alias("name"), F.when(n % 2 == 0, "X").alias("address"), F.when(n % 3 == 0, kept).alias("subject_key"))
    new = c.select((F.col("c_custkey") + 100_000_000).alias("subject_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("address"), F.lit(None).cast("string").alias("subject_key"))
    return backfill.subject_keys(old.unionByName(new))


@query("bf.source_item_id", with_items("SELECT id, CASE WHEN ordinal % 3 = 0 THEN 'g' || id ELSE 'old' || id END AS source_item_id FROM items"))
def source_item_id(spark, d):
    rows = bare_items(spark, d).select(
        "id", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("g"), "id")).alias("source_item_id"), F.concat(F.lit("old"), "id").alias("source_review_id")
    )
    return backfill.source_item_ids(rows).select("id", "source_item_id")


def legacy_jobs(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    states = ("COLLECTING", "PENDING", "FAILED", "DONE", "BLOCKED", "SEARCHING", "CRAWLING")
    return o.select(
        n.alias("job_id"), F.element_at(F.array(*[F.lit(s) for s in states]), (n % 7 + 1).cast("int")).alias("status"), (n % 5 == 0).alias("collection_complete"),
        (n % 4).alias("collected_count"), (n % 500).alias("max_reviews"), F.lit(None).cast("string").alias("stop_reason"), F.lit("COLLECTION").alias("last_stage"),
    )


_JOBS = """lj AS (SELECT o_orderkey AS job_id, ['COLLECTING', 'PENDING', 'FAILED', 'DONE', 'BLOCKED', 'SEARCHING', 'CRAWLING'][CAST(o_orderkey % 7 + 1 AS INT)] AS status, o_orderkey % 5 = 0 AS c, o_orderkey % 4 AS n, o_orderkey % 500 AS m FROM orders)"""


@query("bf.job_sources", f"""WITH {_JOBS} SELECT job_id, 'google_maps' AS source, CASE WHEN status = 'COLLECTING' THEN 'PENDING' WHEN c THEN 'COMPLETE' WHEN n > 0 THEN 'PARTIAL' WHEN status = 'FAILED' THEN 'FAILED' ELSE 'PENDING' END AS source_status,
 n AS collected, m AS target_count, c AS complete FROM lj WHERE job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6)""")
def bf_job_sources(spark, d):
    have = table(spark, d, "lineitem").filter("l_linenumber = 6").select(F.col("l_orderkey").alias("job_id"), F.lit("google_maps").alias("source"))
    return backfill.job_sources(legacy_jobs(spark, d), have)


@query("bf.job_status", f"""WITH {_JOBS}, x AS (SELECT *, job_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS rep FROM lj), y AS (SELECT *, status IN ('CRAWLING', 'INTERRUPTED', 'BLOCKED', 'FAILED', 'PARTIAL') AND n > 0 AND NOT rep AS br FROM x)
 SELECT job_id, CASE WHEN status IN ('PENDING', 'SEARCHING') THEN 'PENDING_COLLECTION' WHEN br THEN 'COLLECTION_INTERRUPTED' ELSE status END AS status, CASE WHEN rep THEN true WHEN br THEN false ELSE c END AS collection_complete,
 CASE WHEN br THEN 'legacy_interrupted' END AS stop_reason, CASE WHEN rep THEN 'REPORTING' WHEN br THEN NULL ELSE 'COLLECTION' END AS last_stage FROM y""")
def bf_job_status(spark, d):
    reports = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    return backfill.job_status(legacy_jobs(spark, d), reports)
