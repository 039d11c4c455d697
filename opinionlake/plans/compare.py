"""Brand and topic comparisons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.operators import compare, stats
from opinionlake.operators import scope as S
from opinionlake.plans import query
from opinionlake.plans.scoped import _CHANNEL, _FIVE, _RATIOS, _SRC, _THREADS, DIGESTS, THREAD_SQL, dates_as_text, key_sql, trend_sql
from opinionlake.sources.binding import items, with_items

GROUPS = (
    compare.TopicGroup("tha", "tha", any_terms=("thon", "Erst")),
    compare.TopicGroup("ein", "ein", all_terms=("ein", "er"), exclude_terms=("that",)),
    compare.TopicGroup("que", "que", any_terms=("que",)),
)
SCOPE = S.Scope(interval="week")
FROM, TO = dt.date(2024, 1, 8), dt.date(2024, 3, 1)
_WEEK = "day IS NOT NULL AND date_precision IN ('day', 'week')"
_TESTS = {
    "tha": "(contains(folded, 'thon') OR contains(folded, 'erst'))",
    "ein": "contains(folded, 'ein') AND contains(folded, 'er') AND NOT contains(folded, 'that')",
    "que": "contains(folded, 'que')",
}
_MEM = (
    f", mother AS (SELECT * FROM items WHERE {_WEEK}), mem AS ("
    + " UNION ALL ".join(f"SELECT *, '{k}' AS member FROM mother WHERE {t}" for k, t in _TESTS.items())
    + ")"
)
_KEYS = ["report_id", "member"]


def tagged(spark, d):
    return compare.with_groups(compare.mother_set(items(spark, d, heavy=True), SCOPE), GROUPS)


def topic_members(spark, d):
    return compare.members(tagged(spark, d))


@query("cmp.topics", with_items(_MEM + f""" SELECT *, {_RATIOS} FROM (
 SELECT report_id, member, count(*) AS count, {_FIVE}, {_SRC}, {_THREADS} FROM mem GROUP BY ALL)"""))
def topics(spark, d):
    return stats.statistics(topic_members(spark, d), _KEYS)


@query("cmp.brands", with_items(f""" SELECT *, {_RATIOS} FROM (SELECT report_id AS member, count(*) AS count, {_FIVE}, {_SRC}, {_THREADS}
 FROM items WHERE {_WEEK} AND day BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY ALL)"""))
def brands(spark, d):
    scope = SCOPE.with_(date_from=FROM, date_to=TO)
    return stats.statistics(compare.brand_members(items(spark, d), ["r0", "r1", "r2", "r3"], scope), ["member"])


@query("set.scope_intersection", with_items(_MEM + " SELECT report_id, member, id FROM mem"))
def scope_intersection(spark, d):
    return topic_members(spark, d).select("report_id", "member", "id")


_MEMBERSHIPS = _MEM + ", cnt AS (SELECT report_id, id, count(*) AS n FROM mem GROUP BY ALL)"


@query("set.union_count", with_items(_MEMBERSHIPS + """ SELECT report_id, count(c.id) AS union_count FROM mother m
 LEFT JOIN cnt c USING (report_id, id) GROUP BY 1"""))
def union_count(spark, d):
    return compare.overlap_counts(tagged(spark, d)).select("report_id", "union_count")


@query("set.overlap_count", with_items(_MEMBERSHIPS + """ SELECT report_id, count(*) FILTER (c.n >= 2) AS overlap_count FROM mother m
 LEFT JOIN cnt c USING (report_id, id) GROUP BY 1"""))
def overlap_count(spark, d):
    return compare.overlap_counts(tagged(spark, d)).select("report_id", "overlap_count")


_COMPLAINTS = _MEM + """, ca AS (SELECT report_id, member, aspect, count(*) AS count FROM (
 SELECT report_id, member, unnest(list_distinct(aspects)) AS aspect FROM mem WHERE sentiment = 'negative') GROUP BY ALL)"""


@query("cmp.complaint_ratios", with_items(_COMPLAINTS + """ SELECT ca.*, count::DOUBLE / nullif(n, 0) AS ratio FROM ca JOIN (
 SELECT report_id, member, count(*) FILTER (sent IN ('positive', 'neutral', 'negative')) AS n FROM mem GROUP BY ALL) USING (report_id, member)"""))
def complaint_ratios(spark, d):
    return compare.complaint_aspects(topic_members(spark, d), _KEYS)


@query("set.common_aspects", with_items(_COMPLAINTS + " SELECT report_id, aspect FROM ca WHERE member IN ('tha', 'que') GROUP BY ALL HAVING count(DISTINCT member) = 2"))
def common_aspects(spark, d):
    pair = topic_members(spark, d).filter(F.col("member").isin("tha", "que"))
    return compare.common_aspects(compare.complaint_aspects(pair, _KEYS), 2)


@query("cmp.topic_hits", with_items(_MEM + """ SELECT report_id, member, topic_key, count(*) AS count FROM (
 SELECT report_id, member, unnest(topic_keys) AS topic_key FROM mem) GROUP BY ALL"""))
def topic_hits(spark, d):
    return compare.topic_hits(topic_members(spark, d), _KEYS)


@query("cmp.shared_bounds", with_items(_MEM + """ SELECT report_id, CAST(min(day) AS VARCHAR) AS date_from, CAST(max(day) AS VARCHAR) AS date_to
 FROM mother GROUP BY 1"""))
def shared_bounds(spark, d):
    return dates_as_text(compare.shared_bounds(compare.mother_set(items(spark, d), SCOPE), SCOPE))


def member_series(spark, d):
    """Topic trends whose buckets are shared per report."""
    rows = topic_members(spark, d)
    bounds = compare.shared_bounds(compare.mother_set(items(spark, d), SCOPE), SCOPE)
    return stats.trend(rows, "week", keys=_KEYS, bounds=bounds)


def _key(spark, d, rows, scope):
    return S.with_scope_key(rows, items(spark, d), scope, F.col("member"))


_SERIES = _MEM + f""", {DIGESTS}, bnd AS (SELECT report_id, min(day) AS f, max(day) AS t FROM mother GROUP BY 1), cal AS (
 SELECT DISTINCT report_id, member, CAST(unnest(generate_series(CAST(date_trunc('week', f) AS TIMESTAMP), CAST(t AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period
 FROM (SELECT DISTINCT report_id, member FROM mem) JOIN bnd USING (report_id)), c AS (
 SELECT report_id, member, CAST(date_trunc('week', day) AS DATE) AS period, count(*) AS count, {_FIVE}, {_SRC} FROM mem GROUP BY ALL), s0 AS (
 SELECT cal.*, coalesce(count, 0) AS count, {", ".join(f"coalesce({x}_count, 0) AS {x}_count" for x in C.SENTIMENTS)},
 {", ".join(f"coalesce({x}_items, 0) AS {x}_items" for x in C.SOURCES)} FROM cal LEFT JOIN c USING (report_id, member, period)), s AS (
 SELECT *, {_RATIOS}, CAST(period AS VARCHAR) AS p,
  {key_sql(SCOPE, "member")} AS scope_key FROM s0 JOIN dg USING (report_id))"""
_LONG = " UNION ALL ".join(
    [f"SELECT member, report_id, p AS period, scope_key, '{m}' AS metric, {m}::DOUBLE AS value FROM s" for m in compare.LONG_METRICS]
    + [f"SELECT member, report_id, p, scope_key, 'source:{x}', {x}_items::DOUBLE FROM s WHERE {x}_items > 0" for x in C.SOURCES]
    + [f"SELECT '全部選取議題', report_id, '全部期間', '', '{m}_count', n::DOUBLE FROM (SELECT m.report_id, count(c2.id) FILTER (c2.n >= {k}) AS n"
       " FROM mother m LEFT JOIN cnt c2 USING (report_id, id) GROUP BY 1)" for m, k in (("union", 1), ("overlap", 2))]
)


@query("sink.comparison_long", with_items(_SERIES + ", cnt AS (SELECT report_id, id, count(*) AS n FROM mem GROUP BY ALL) SELECT 'weekly topics' AS comparison, * FROM (" + _LONG + ")"))
def comparison_long(spark, d):
    totals = compare.overlap_counts(tagged(spark, d))
    return compare.long_table(_key(spark, d, member_series(spark, d), SCOPE), "weekly topics", totals)


@query("cmp.warnings", with_items(_MEM + f""", sm AS (SELECT report_id, member, CAST(min(day) AS VARCHAR) AS observed_from,
  CAST(max(day) AS VARCHAR) AS observed_to, {_SRC} FROM mem GROUP BY ALL), ex AS (
 SELECT report_id, count(*) FILTER (NOT coalesce({_WEEK}, false)) AS excluded_count FROM items GROUP BY 1), x AS (
 SELECT sm.*, excluded_count, report_id IN ('r0', 'r2') AS complete, CASE report_id WHEN 'r3' THEN 'legacy_live' ELSE 'snapshot' END AS data_basis
 FROM sm JOIN ex USING (report_id))
 SELECT x.*, NOT complete OR excluded_count > 0 AS incomplete, data_basis = 'legacy_live' AS live_basis, differs FROM x JOIN (
  SELECT report_id, count(DISTINCT (observed_from, observed_to, google_maps_items, ptt_items, dcard_items)) > 1 AS differs FROM x GROUP BY 1) USING (report_id)"""))
def warnings(spark, d):
    flagged = S.flag(items(spark, d), SCOPE.with_(precision_policy="interval"))
    excluded = flagged.groupBy("report_id").agg(F.count_if(~F.col("_kept")).alias("excluded_count"))
    rows = compare.summary(topic_members(spark, d), _KEYS).join(excluded, "report_id").withColumns(
        {
            "complete": F.col("report_id").isin("r0", "r2"),
            "data_basis": F.when(F.col("report_id") == "r3", "legacy_live").otherwise("snapshot"),
        }
    )
    return dates_as_text(compare.warnings(rows, ["report_id"]))


EXTRA = S.Scope(sentiment="positive", source="ptt")


@query("cmp.drilldown", with_items(_MEM + f""", {DIGESTS} SELECT report_id, member, id, {key_sql(EXTRA, "member")} AS scope_key FROM mem JOIN dg USING (report_id) WHERE sent = 'positive' AND source = 'ptt'"""))
def drilldown(spark, d):
    return _key(spark, d, S.select(topic_members(spark, d), EXTRA).select("report_id", "member", "id"), EXTRA)


# ---- whole comparisons: the tables of each member --------------------------------------------
def _topic_parts(spark, d):
    rows = topic_members(spark, d)
    bounds = compare.shared_bounds(compare.mother_set(items(spark, d), SCOPE), SCOPE)
    return compare.workspace(rows, _KEYS, "week", bounds=bounds)


def _brand_parts(spark, d):
    rows = compare.brand_members(items(spark, d), ["r0", "r1", "r2", "r3"], SCOPE.with_(date_from=FROM, date_to=TO))
    return compare.workspace(rows, ["member"], "week", FROM, TO)


_BRAND_MEM = f", mem AS (SELECT *, report_id AS member FROM items WHERE {_WEEK} AND day BETWEEN DATE '{FROM}' AND DATE '{TO}')"
_POINTS = ["period", "count", *[f"{s}_count" for s in C.SENTIMENTS], *[f"{s}_items" for s in C.SOURCES], "classified_count", "negative_ratio", "pn_ratio"]


def _channel_sql(mem, keys, label):
    return with_items(mem + f""" SELECT *, {_RATIOS} FROM (SELECT {keys}, source, {label} AS channel_label, count(*) AS sample_count, {_FIVE}, {_THREADS},
  arg_min(struct_pack(b := board), ordinal).b AS board FROM mem GROUP BY ALL)""")


def _threads_sql(mem, keys):
    tables = THREAD_SQL.replace("SELECT report_id, source", f"SELECT {keys}, source").replace("FROM items", "FROM mem")
    return with_items(mem + tables + f""" SELECT * FROM threads
 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY collected_count DESC, source, thread_source_id) <= 25""")


@query("cmp.topic_trend", with_items(_SERIES + f" SELECT report_id, member, p AS period, {', '.join(_POINTS[1:])} FROM s"))
def topic_trend(spark, d):
    return dates_as_text(_topic_parts(spark, d)["trend"].select(*_KEYS, *_POINTS))


@query("cmp.topic_channels", _channel_sql(_MEM, "report_id, member", _CHANNEL))
def topic_channels(spark, d):
    return _topic_parts(spark, d)["channels"]


@query("cmp.topic_sources", _channel_sql(_MEM, "report_id, member", "source"))
def topic_sources(spark, d):
    return _topic_parts(spark, d)["sources"]


@query("cmp.topic_threads", _threads_sql(_MEM, "report_id, member"))
def topic_threads(spark, d):
    return dates_as_text(_topic_parts(spark, d)["threads"])


@query("cmp.brand_trend", trend_sql("week", _WEEK, FROM, TO))
def brand_trend(spark, d):
    trend = _brand_parts(spark, d)["trend"]
    return dates_as_text(trend.withColumnRenamed("member", "report_id"))


@query("cmp.brand_channels", _channel_sql(_BRAND_MEM, "member", _CHANNEL))
def brand_channels(spark, d):
    return _brand_parts(spark, d)["channels"]


@query("cmp.brand_threads", _threads_sql(_BRAND_MEM, "member"))
def brand_threads(spark, d):
    return dates_as_text(_brand_parts(spark, d)["threads"])
