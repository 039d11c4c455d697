"""Scope filters, statistics, trends and rankings over the snapshot items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates, text
from opinionlake.operators import rank_index, ranks, stats
from opinionlake.operators import scope as S
from opinionlake.plans import query
from opinionlake.sources.binding import items, with_items

FROM, TO = dt.date(2024, 1, 15), dt.date(2024, 2, 20)
_LIST = "SELECT report_id, id FROM items WHERE "
_RATIOS = """positive_count + neutral_count + negative_count AS classified_count,
 CASE WHEN positive_count + neutral_count + negative_count > 0 THEN negative_count::DOUBLE /
   (positive_count + neutral_count + negative_count) END AS negative_ratio,
 CASE WHEN negative_count > 0 THEN positive_count::DOUBLE / negative_count END AS pn_ratio,
 CASE WHEN negative_count > 0 THEN NULL WHEN positive_count + neutral_count + negative_count > 0
   THEN 'no_negative' ELSE 'no_classified_text' END AS pn_reason"""
_FIVE = ", ".join(f"count(*) FILTER (sent = '{s}') AS {s}_count" for s in C.SENTIMENTS)
_SRC = ", ".join(f"count(*) FILTER (source = '{s}') AS {s}_items" for s in C.SOURCES)
_THREADS = "count(DISTINCT CASE WHEN thread_source_id <> '' THEN source || '|' || thread_source_id END) AS thread_count"
_CHANNEL = f"coalesce(nullif(channel_label, ''), nullif(board, ''), '{C.NO_CHANNEL}')"


def _ids(scope):
    heavy = bool(scope.any_terms or scope.all_terms or scope.exclude_terms or scope.keyword)
    return lambda spark, d: S.select(items(spark, d, heavy), scope).select("report_id", "id")


def _filter(name, scope, where):
    query(name, with_items(_LIST + where))(_ids(scope))


_filter("flt.equals", S.Scope(source="ptt", content_type="comment", board="src7"),
        "source = 'ptt' AND content_type = 'comment' AND board = 'src7'")
_filter("flt.channel", S.Scope(channel_label=C.NO_CHANNEL), f"{_CHANNEL} = '{C.NO_CHANNEL}'")
_filter("flt.item", S.Scope(review_id="42"), "id = '42'")
_filter("flt.sentiment", S.Scope(sentiment="unknown"), "sent = 'unknown'")
_filter("flt.aspect", S.Scope(aspect="service"), "list_contains(aspects, 'service')")
_filter("flt.topic", S.Scope(topic_key="topic3"), "list_contains(topic_keys, 'topic3')")
_filter("flt.literal", S.Scope(q="The "), "contains(text, 'The ')")
_filter("flt.any_terms", S.Scope(any_terms=("THON", "chkeit")), "(contains(folded, 'thon') OR contains(folded, 'chkeit'))")
_filter("flt.all_terms", S.Scope(all_terms=("the", "ing")), "contains(folded, 'the') AND contains(folded, 'ing')")
_filter("flt.exclude_terms", S.Scope(exclude_terms=("the", "ein")),
        "NOT contains(folded, 'the') AND NOT contains(folded, 'ein')")
_filter("flt.date_range", S.Scope(date_from=FROM, date_to=TO), f"day BETWEEN DATE '{FROM}' AND DATE '{TO}'")
_filter("flt.unknown_date", S.Scope(date_from=dt.date(2000, 1, 1)), "day IS NOT NULL")
_filter("flt.precision", S.Scope(interval="week", precision_policy="interval"),
        "day IS NOT NULL AND date_precision IN ('day', 'week')")

#: Content digest of each report, and a scope's key made from it.
DIGESTS = """dg AS (SELECT report_id, sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 8))::BIGINT) || '|' || sum(('0x' || substr(h, 9, 8))::BIGINT) || '|' ||
 sum(('0x' || substr(h, 17, 8))::BIGINT) || '|' || sum(('0x' || substr(h, 25, 8))::BIGINT)) AS dg FROM (
 SELECT report_id, md5(id || chr(1) || source || chr(1) || coalesce(sentiment, chr(2)) || chr(1) || text) AS h FROM items) GROUP BY 1)"""


def key_sql(scope, member: str = "") -> str:
    return f"substr(sha256(report_id || '|4|' || dg || '|' || '{scope.as_json()}'{' || ' + repr('|') + ' || ' + member if member else ''}), 1, 24)"


TOKENS_SQL = (
    "list_filter(regexp_extract_all(folded, '((?:[^\\P{L}一-鿿]|\\p{N})+|" + text.han_words(C.DOMAIN_TERMS) + ")', 1), lambda t: length(t) >= 2 AND t NOT IN ("
    + ", ".join(f"'{w}'" for w in C.STOPWORDS) + ") AND NOT regexp_matches(t, '^[0-9]+$'))"
)
_filter("flt.keyword", S.Scope(keyword="Thon"), f"list_contains({TOKENS_SQL}, 'thon')")


@query("flt.complaint", with_items(
    "SELECT report_id, id FROM items WHERE (sentiment = 'negative' OR len(negative_aspects) > 0) AND trim(text) <> ''"))
def complaints(spark, d):
    return items(spark, d).filter(S.complaint()).select("report_id", "id")


def versions(spark, d):
    """Every item, plus a re-collected version of the comments with a shorter title."""
    base = items(spark, d)
    again = base.filter("content_type = 'comment'").withColumns(
        {"ordinal": F.col("ordinal") + 100_000_000_000, "title": F.concat(F.lit("v2 "), "title")}
    )
    return base.unionByName(again)


_VERSIONS = (
    ", ver AS (SELECT * FROM items UNION ALL SELECT * REPLACE (ordinal + 100000000000 AS ordinal, "
    "'v2 ' || title AS title) FROM items WHERE content_type = 'comment') "
)


@query("flt.dedup", with_items(_VERSIONS + """
 SELECT report_id, id, arg_max(title, ordinal) AS title, min(ordinal) AS ordinal FROM ver GROUP BY ALL"""))
def dedup(spark, d):
    rows = versions(spark, d).select("report_id", "id", "ordinal", "title")
    return S.dedup(rows).select("report_id", "id", "title", "ordinal")


@query("flt.scope_counts", with_items(_VERSIONS + f""", u AS (
 SELECT report_id, id, arg_max(day, ordinal) AS day, arg_max(date_precision, ordinal) AS p FROM ver GROUP BY ALL), f AS (
 SELECT report_id, day IS NULL AS unk, day IS NOT NULL AND p NOT IN ('day','week') AS imp FROM u
  WHERE day IS NULL OR day BETWEEN DATE '{FROM}' AND DATE '{TO}')
 SELECT r.report_id, raw_count, deduplicated_count,
  coalesce(included_count, 0) AS included_count, coalesce(unknown_date_count, 0) AS unknown_date_count,
  coalesce(imprecise_date_count, 0) AS imprecise_date_count,
  coalesce(unknown_date_count + imprecise_date_count, 0) AS excluded_count
 FROM (SELECT report_id, count(*) AS raw_count, count(DISTINCT id) AS deduplicated_count FROM ver GROUP BY 1) r
 LEFT JOIN (SELECT report_id, count(*) FILTER (NOT unk AND NOT imp) AS included_count,
  count(*) FILTER (unk) AS unknown_date_count, count(*) FILTER (imp) AS imprecise_date_count FROM f GROUP BY 1) f
 ON r.report_id = f.report_id"""))
def scope_counts(spark, d):
    scope = S.Scope(date_from=FROM, date_to=TO, interval="week", precision_policy="interval")
    rows = versions(spark, d).select("report_id", "id", "ordinal", "published_at", "date_precision")
    return S.counts(rows, scope)


@query("agg.statistics", with_items(f""" SELECT *, {_RATIOS} FROM (
 SELECT report_id, count(*) AS count, {_FIVE}, {_SRC}, {_THREADS} FROM items GROUP BY 1)"""))
def statistics(spark, d):
    return stats.statistics(items(spark, d))


@query("agg.source_counts", with_items(f"SELECT report_id, source, count(*) AS count FROM items GROUP BY ALL"))
def source_counts(spark, d):
    return items(spark, d).groupBy("report_id", "source").count()


@query("agg.thread_count", with_items(f"SELECT report_id, {_THREADS} FROM items GROUP BY ALL"))
def thread_count(spark, d):
    return items(spark, d).groupBy("report_id").agg(F.count_distinct(stats.thread_key()).alias("thread_count"))


def trend_sql(interval, where="true", low=None, high=None, keys="report_id", rel="items", pre=""):
    accepted = ", ".join(f"'{p}'" for p in C.ACCEPTED_PRECISION[interval])
    step = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH"}[interval]
    lo = f"DATE '{low}'" if low else "NULL::DATE"
    hi = f"DATE '{high}'" if high else "NULL::DATE"
    ok = f"day IS NOT NULL AND date_precision IN ({accepted})"
    return with_items(pre + f""", base AS (SELECT * FROM {rel} WHERE {where}), e AS (
  SELECT *, CAST(date_trunc('{interval}', day) AS DATE) AS period FROM base
  WHERE {ok} AND day >= coalesce({lo}, day) AND day <= coalesce({hi}, day)), b AS (
  SELECT {keys}, coalesce({lo}, f, {hi}) AS date_from, coalesce({hi}, l, {lo}, f) AS date_to, excluded_count FROM (
   SELECT {keys}, min(e_day) AS f, max(e_day) AS l, count(*) FILTER (bad) AS excluded_count FROM (
    SELECT {keys}, CASE WHEN {ok} AND day >= coalesce({lo}, day) AND day <= coalesce({hi}, day) THEN day END AS e_day,
     NOT coalesce({ok}, false) AS bad FROM base) GROUP BY {keys})), cal AS (
  SELECT {keys}, date_from, date_to, excluded_count, CAST(unnest(generate_series(
   CAST(date_trunc('{interval}', date_from) AS TIMESTAMP), CAST(date_to AS TIMESTAMP), INTERVAL {step})) AS DATE) AS period FROM b
   WHERE date_from IS NOT NULL),
  c AS (SELECT {keys}, period, count(*) AS count, {_FIVE}, {_SRC} FROM e GROUP BY {keys}, period), s AS (
  SELECT cal.*, least(date_to, CAST(period + INTERVAL {step} - INTERVAL 1 DAY AS DATE)) AS period_end,
   coalesce(count, 0) AS count, {", ".join(f"coalesce({x}_count, 0) AS {x}_count" for x in C.SENTIMENTS)},
   {", ".join(f"coalesce({x}_items, 0) AS {x}_items" for x in C.SOURCES)}
  FROM cal LEFT JOIN c USING ({keys}, period))
 SELECT {keys}, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to,
  CAST(period AS VARCHAR) AS period, CAST(period_end AS VARCHAR) AS period_end, excluded_count, count,
  {", ".join(f"{x}_count" for x in C.SENTIMENTS)}, {", ".join(f"{x}_items" for x in C.SOURCES)}, {_RATIOS} FROM s""")


def dates_as_text(df):
    """Dates as ISO strings, so both engines print them alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


@query("agg.trend", trend_sql("week"))
def trend(spark, d):
    return dates_as_text(stats.trend(items(spark, d), "week"))


@query("agg.trend_average", f"SELECT report_id, avg(count) AS average_count, count(*) AS points FROM ({trend_sql('day')}) GROUP BY 1")
def trend_average(spark, d):
    return stats.trend_average(stats.trend(items(spark, d), "day"))


@query("dt.bucket", trend_sql("month", low=FROM, high=TO))
def bucketed_months(spark, d):
    return dates_as_text(stats.trend(items(spark, d), "month", FROM, TO))


def channel_sql(label, order=None):
    return with_items(f""" SELECT *, {_RATIOS} FROM (SELECT report_id, source, {label} AS channel_label,
  count(*) AS sample_count, {_FIVE}, {_THREADS}, arg_min(struct_pack(b := board), ordinal).b AS board
  FROM items GROUP BY ALL)""")


@query("agg.channels", channel_sql(_CHANNEL))
def channels(spark, d):
    return stats.sort_channels(stats.channels(items(spark, d)), "negative_ratio")


THREAD_SQL = f""", th AS (SELECT report_id, source, thread_source_id,
  arg_min(struct_pack(t := title, b := board, u := source_url, x := substr(text, 1, 300)),
   CASE WHEN content_type = 'post' THEN ordinal ELSE ordinal + 1000000000000 END) AS h,
  count(*) AS collected_count, max(reply_count) AS reported_reply_count, max(day) AS latest_day,
  coalesce(arg_min(date_precision, struct_pack(d := -epoch(day), i := id)) FILTER (day IS NOT NULL), 'unknown') AS date_precision
  FROM items WHERE thread_source_id <> '' GROUP BY ALL), threads AS (
 SELECT report_id, source, thread_source_id, h.t AS title, collected_count, reported_reply_count,
  CAST(latest_day AS VARCHAR) AS latest_date, date_precision, h.b AS board, h.u AS source_url, h.x AS excerpt FROM th)"""


@query("agg.threads", with_items(THREAD_SQL + " SELECT * FROM threads"))
def threads(spark, d):
    return dates_as_text(stats.threads(items(spark, d)))


@query("ord.threads", with_items(THREAD_SQL + " SELECT report_id, source, thread_source_id, latest_date, reported_reply_count FROM threads"))
def ordered_threads(spark, d):
    rows = stats.threads(items(spark, d)).orderBy("report_id", *stats.thread_order("reported_reply_count"))
    return dates_as_text(rows.select("report_id", "source", "thread_source_id", "latest_date", "reported_reply_count"))


@query("lim.topk_threads", with_items(THREAD_SQL + """ SELECT report_id, source, thread_source_id, collected_count FROM threads
 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY collected_count DESC, source, thread_source_id) <= 25"""))
def top_threads(spark, d):
    rows = stats.threads(items(spark, d)).select("report_id", "source", "thread_source_id", "collected_count")
    return ranks.top_rows(rows, ["report_id"], stats.thread_order(), 25)


@query("win.precision_of_latest", with_items(THREAD_SQL + " SELECT report_id, source, thread_source_id, date_precision FROM threads"))
def precision_of_latest(spark, d):
    return stats.threads(items(spark, d)).select("report_id", "source", "thread_source_id", "date_precision")


@query("ord.items", with_items("SELECT report_id, id, CAST(day AS VARCHAR) AS day FROM items"))
def ordered_items(spark, d):
    rows = items(spark, d).orderBy("report_id", *stats.item_order("date_desc"))
    return dates_as_text(rows.select("report_id", "id", dates.local_day(F.col("published_at")).alias("day")))


@query("ord.complaints_first", with_items("""SELECT report_id, id, CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
 WHEN 'positive' THEN 2 WHEN 'rating_only' THEN 3 ELSE 4 END AS BIGINT) AS priority FROM items"""))
def complaints_first(spark, d):
    order = ["negative", "neutral", "positive", "rating_only"]
    rank = F.lit(len(order)).cast("bigint")
    for position, label in reversed(list(enumerate(order))):
        rank = F.when(F.col("sentiment") == label, F.lit(position).cast("bigint")).otherwise(rank)
    return items(spark, d).select("report_id", "id", rank.alias("priority"), "ordinal").orderBy("report_id", "priority", "ordinal").drop("ordinal")


@query("lim.page", with_items("""SELECT report_id, id, total FROM (SELECT *, count(*) OVER (PARTITION BY report_id) AS total,
 row_number() OVER (PARTITION BY report_id ORDER BY day DESC NULLS LAST, source, id) AS rn FROM items WHERE source <> 'ptt')
 WHERE rn BETWEEN 26 AND 50"""))
def page(spark, d):
    rows = items(spark, d).filter("source <> 'ptt'").select("report_id", "id", "source", "published_at")
    totals = rows.groupBy("report_id").agg(F.count("*").alias("total"))
    chosen = ranks.page_rows(rows, ["report_id"], stats.item_order("date_desc"), page=2, size=25)
    return chosen.join(totals, "report_id").select("report_id", "id", "total")


@query("lim.page_index", with_items("""SELECT report_id, id, total, rn AS position FROM (SELECT *, count(*) OVER (PARTITION BY report_id) AS total,
 row_number() OVER (PARTITION BY report_id ORDER BY day DESC NULLS LAST, source, id) AS rn FROM items WHERE source <> 'ptt')
 WHERE rn BETWEEN 76 AND 100"""))
def page_index(spark, d):
    rows = items(spark, d).filter("source <> 'ptt'").select("report_id", "id", "source", "published_at")
    order = stats.item_order("date_desc")
    path = rank_index.build(rows, ["report_id"], order)
    return rank_index.page(spark, path, ["report_id"], order, number=4, size=25).select("report_id", "id", "total", F.col("position").cast("bigint").alias("position"))


@query("agg.observed_range", with_items("""SELECT report_id, CAST(min(day) AS VARCHAR) AS observed_from,
 CAST(max(day) AS VARCHAR) AS observed_to FROM items GROUP BY 1"""))
def observed_range(spark, d):
    day = dates.local_day(F.col("published_at"))
    out = items(spark, d).groupBy("report_id").agg(F.min(day).alias("observed_from"), F.max(day).alias("observed_to"))
    return dates_as_text(out)
