"""Evidence, plan rules, schedules, verdicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates
from opinionlake.operators import evidence, hygiene, packing, planning, ranks, stats
from opinionlake.plans import query
from opinionlake.plans.hygiene import redact_sql
from opinionlake.plans.scoped import _FIVE, _RATIOS, _SRC, dates_as_text
from opinionlake.sources.binding import items, table, with_items


# ---- evidence -----------------------------------------------------------------------------
def problems(spark, d):
    """One problem per aspect and report: its first four items and one id from nowhere."""
    rows = items(spark, d).select("report_id", "ordinal", "id", F.element_at("aspects", 1).alias("problem_key"))
    top = ranks.top_rows(rows, ["report_id", "problem_key"], [F.col("ordinal")], 4)
    packed = top.groupBy("report_id", "problem_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("_r"))
    number = F.array_position(F.array(*[F.lit(a) for a in C.ASPECT_LABELS]), F.col("problem_key"))
    refs = F.concat(F.transform("_r", lambda s: s["id"]), F.array(F.concat(F.lit("x"), "problem_key")))
    return packed.select("report_id", number.cast("bigint").alias("problem_no"), "problem_key", refs.alias("evidence_ids"))


_NO = "list_position([" + ",".join(f"'{a}'" for a in C.ASPECT_LABELS) + "], problem_key)"
_EV = f""", pr AS (SELECT report_id, problem_key, {_NO} AS problem_no, list_append(list(id ORDER BY ordinal), 'x' || problem_key) AS refs FROM (
 SELECT report_id, ordinal, id, aspects[1] AS problem_key FROM items QUALIFY row_number() OVER (PARTITION BY report_id, aspects[1] ORDER BY ordinal) <= 4) GROUP BY report_id, problem_key), rx AS (
 SELECT report_id, problem_key, problem_no, unnest(refs) AS id, generate_subscripts(refs, 1) AS p FROM pr), rp AS (
 SELECT report_id, id, min(problem_no * 100 + p) AS at_ FROM rx GROUP BY ALL), txt AS (SELECT * FROM items WHERE trim(text) <> ''), aa AS (
 SELECT txt.*, at_ FROM txt JOIN rp USING (report_id, id)), an AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY at_) AS position FROM aa
  QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY at_) <= 60), asp AS (SELECT DISTINCT report_id, unnest(aspects) AS a FROM aa), tps AS (
 SELECT DISTINCT report_id, unnest(topic_keys) AS t FROM aa), rel AS (SELECT * FROM txt WHERE (report_id, id) NOT IN (SELECT (report_id, id) FROM rp) AND (
  EXISTS (FROM asp WHERE asp.report_id = txt.report_id AND list_contains(txt.aspects, a)) OR EXISTS (FROM tps WHERE tps.report_id = txt.report_id AND list_contains(txt.topic_keys, t)))), str AS (
 SELECT *, CASE WHEN day IS NOT NULL AND date_precision IN ('day', 'week') THEN isoyear(day) || '-' || lpad(CAST(week(day) AS VARCHAR), 2, '0') ELSE 'unknown' END AS week FROM rel), rr AS (
 SELECT *, row_number() OVER (PARTITION BY report_id, source, week ORDER BY id) AS turn FROM str), ro AS (
 SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY turn, source, week) AS position FROM rr), sm AS (
 SELECT *, CAST(row_number() OVER (PARTITION BY report_id ORDER BY q) AS INT) AS place FROM (
  SELECT report_id, id, source, sentiment, aspects, date_precision, text, position AS q FROM an
  UNION ALL SELECT report_id, id, source, sentiment, aspects, date_precision, text, position + 60 FROM ro WHERE position <= 60)
  QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY q) <= 60)"""


@query("ev.anchors", with_items(_EV + " SELECT report_id, id, CAST(position AS INT) AS position FROM an"))
def anchors(spark, d):
    return evidence.anchors(items(spark, d), problems(spark, d)).select("report_id", "id", "position")


@query("ev.relevant", with_items(_EV + " SELECT report_id, id FROM rel"))
def relevant(spark, d):
    return evidence.relevant(items(spark, d), problems(spark, d)).select("report_id", "id")


@query("ev.strata", with_items(_EV + " SELECT report_id, source, week, count(*) AS rows FROM str GROUP BY ALL"))
def strata(spark, d):
    rows = evidence.relevant(items(spark, d), problems(spark, d)).withColumn("week", evidence.stratum_week())
    return rows.groupBy("report_id", "source", "week").agg(F.count("*").alias("rows"))


@query("win.round_robin", with_items(_EV + " SELECT report_id, id, week, CAST(turn AS INT) AS turn, CAST(position AS INT) AS position FROM ro WHERE position <= 60"))
def round_robin(spark, d):
    out = evidence.round_robin(evidence.relevant(items(spark, d), problems(spark, d)))
    return out.select("report_id", "id", "week", "turn", "position")


@query("ev.sample", with_items(_EV + """ SELECT report_id, id, source, sentiment, array_to_string(aspects, ',') AS aspects, date_precision,
 substr(text, 1, 800) AS text, place FROM sm"""))
def sample(spark, d):
    out = evidence.sample(items(spark, d), problems(spark, d))
    return out.withColumn("aspects", F.array_join("aspects", ","))


@query("ev.coverage", with_items(_EV + """, tt AS (SELECT report_id, count(*) AS snapshot_count, count(*) FILTER (trim(text) <> '') AS text_count FROM items GROUP BY 1)
 SELECT report_id, coalesce(i, 0) AS included, text_count - coalesce(i, 0) AS excluded, snapshot_count, text_count, coalesce(a, 0) + coalesce(r, 0) AS relevant_count, coalesce(o, '') AS omitted FROM tt
 LEFT JOIN (SELECT report_id, count(*) AS i FROM sm GROUP BY 1) USING (report_id) LEFT JOIN (SELECT report_id, count(*) AS a FROM aa GROUP BY 1) USING (report_id)
 LEFT JOIN (SELECT report_id, count(*) AS r FROM rel GROUP BY 1) USING (report_id)
 LEFT JOIN (SELECT report_id, string_agg(id, ',' ORDER BY at_) AS o FROM rp WHERE (report_id, id) NOT IN (SELECT (report_id, id) FROM sm) GROUP BY 1) USING (report_id)"""))
def coverage(spark, d):
    return evidence.coverage(items(spark, d), problems(spark, d))


@query("ev.problem_refs", with_items(_EV + """, x AS (SELECT rx.*, txt.id IS NOT NULL AS known, sm.id IS NOT NULL AS picked FROM rx
 LEFT JOIN txt ON txt.report_id = rx.report_id AND txt.id = rx.id LEFT JOIN sm ON sm.report_id = rx.report_id AND sm.id = rx.id)
 SELECT report_id, problem_key, bool_and(known) AS valid, string_agg(id, ',' ORDER BY p) FILTER (picked) AS evidence_ids FROM x GROUP BY ALL HAVING count(*) FILTER (picked) > 0"""))
def problem_refs(spark, d):
    rows, probs = items(spark, d), problems(spark, d)
    out = evidence.problem_refs(probs, evidence.sample(rows, probs), rows)
    return out.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("ev.complaint_sample", with_items("""SELECT report_id, id, substr(text, 1, 800) AS text FROM items
 WHERE (sentiment = 'negative' OR len(negative_aspects) > 0) AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY ordinal) <= 60"""))
def complaint_sample(spark, d):
    return evidence.complaint_sample(items(spark, d))


# ---- plans --------------------------------------------------------------------------------
# A plan is a customer, its actions are the customer's orders.
def _text(prefix, col):
    return F.concat(F.lit(prefix), col.cast("string"))


def _list(*entries):
    return F.array_compact(F.array(*entries))


def independent_actions(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("plan_id"), n.cast("string").alias("key"), n.alias("n"), F.col("o_orderdate").cast("timestamp").alias("at"),
        (1 + n % 9).cast("double").alias("hours"), (1 + n % 5).alias("priority"),
        _text("p", n % 4).alias("problem_key"), F.array(_text("e", n % 7), _text("e", n % 11)).alias("evidence_ids"),
        F.when(n % 13 == 0, "  ").otherwise("owner").alias("owner_role"), F.lit("1").alias("cost_estimate"), F.lit("m").alias("metric"),
        F.when(n % 29 == 0, "").otherwise("t").alias("target"), F.lit("v").alias("verification"),
        F.when(n % 17 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("steps"),
        F.when(n % 19 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("prerequisites"),
        F.array().cast("array<string>").alias("assumptions"),
    )


def actions(spark, d):
    """Every third action depends on the one before it."""
    before = ranks.block_lag(independent_actions(spark, d), ["plan_id"], "n", "key", "_before")
    wants = F.when(F.col("n") % 101 == 0, F.array(F.lit("nowhere"))).when((F.col("n") % 3 == 0) & F.col("_before").isNotNull(), F.array("_before"))
    return before.withColumn("dependencies", F.coalesce(wants, F.array().cast("array<string>"))).drop("_before")


_ACT = """act AS (SELECT o_custkey AS plan_id, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS n, o_orderdate AS t, (1 + o_orderkey % 9)::DOUBLE AS hours, 1 + o_orderkey % 5 AS priority,
 'p' || (o_orderkey % 4) AS problem_key, ['e' || (o_orderkey % 7), 'e' || (o_orderkey % 11)] AS evidence_ids,
 CASE WHEN o_orderkey % 101 = 0 THEN ['nowhere'] WHEN o_orderkey % 3 = 0 AND prev IS NOT NULL THEN [prev] ELSE []::VARCHAR[] END AS dependencies FROM (
 SELECT *, CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR) AS prev FROM orders))"""


def plan_problems(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    extra = F.when((F.col("plan_id") % 9 == 0) & (F.col("k") == 1), F.lit("zz"))
    key = F.when((F.col("plan_id") % 31 == 0) & (F.col("k") == 2), "p1").otherwise(_text("p", F.col("k")))
    return c.select(
        "plan_id", key.alias("problem_key"), "k",
        F.concat(F.transform(F.sequence(F.lit(0), 3 + F.col("k")), lambda i: F.concat(F.lit("e"), i.cast("string"))), _list(extra)).alias("evidence_ids"),
        F.when((F.col("plan_id") % 6 == 0) & (F.col("k") == 0), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>")).alias("unknowns"),
    )


def plan_evidence(spark, d):
    ids = F.transform(F.sequence(F.lit(0), 3 + F.col("c_custkey") % 5), lambda i: F.concat(F.lit("e"), i.cast("string")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"), ids.alias("evidence"))


_PLAN = _ACT + """, prob AS (SELECT c_custkey AS plan_id, k, CASE WHEN c_custkey % 31 = 0 AND k = 2 THEN 'p1' ELSE 'p' || k END AS problem_key,
 list_concat(list_transform(generate_series(0, 3 + k), lambda i: 'e' || i), CASE WHEN c_custkey % 9 = 0 AND k = 1 THEN ['zz'] ELSE []::VARCHAR[] END) AS refs,
 CASE WHEN c_custkey % 6 = 0 AND k = 0 THEN 1 ELSE 0 END AS unknowns FROM customer CROSS JOIN range(3) r(k)), evd AS (
 SELECT c_custkey AS plan_id, list_transform(generate_series(0, 3 + c_custkey % 5), lambda i: 'e' || i) AS evidence FROM customer),
 chk AS (SELECT act.*, p.refs IS NOT NULL AND len(list_filter(act.evidence_ids, lambda e: NOT list_contains(evidence, e))) = 0 AND
  len(list_filter(act.evidence_ids, lambda e: NOT list_contains(p.refs, e))) = 0 AS refs_ok FROM act LEFT JOIN (SELECT * FROM prob WHERE plan_id % 31 <> 0 OR k <> 2) p USING (plan_id, problem_key) LEFT JOIN evd USING (plan_id))"""


def checked_actions(spark, d):
    own = plan_problems(spark, d).filter("plan_id % 31 <> 0 or k <> 2").select("plan_id", "problem_key", F.col("evidence_ids").alias("problem_refs"))
    return planning.check_refs(independent_actions(spark, d), own, plan_evidence(spark, d))


@query("dq.evidence_refs", f"WITH {_PLAN} SELECT plan_id, key, coalesce(refs_ok, false) AS refs_ok FROM chk")
def evidence_refs(spark, d):
    return checked_actions(spark, d).select("plan_id", "key", "refs_ok")


@query("dq.published_actions", f"WITH {_PLAN} SELECT plan_id, key FROM chk WHERE refs_ok")
def published_actions(spark, d):
    return checked_actions(spark, d).filter("refs_ok").select("plan_id", "key")


@query("dq.required_fields", f"WITH {_ACT} SELECT plan_id, key, n % 13 <> 0 AND n % 29 <> 0 AND n % 17 <> 0 AS fields_ok FROM act")
def required_fields(spark, d):
    return actions(spark, d).select("plan_id", "key", planning.fields_ok().alias("fields_ok"))


_STEP = """list_sort(list_transform(list_filter(a, lambda x: NOT list_contains(ord, x.k) AND len(list_filter(x.d, lambda y: NOT list_contains(ord, y))) = 0),
  lambda x: struct_pack(p := x.p, k := x.k)))[1].k"""
_ORDER = f"""pk AS (SELECT plan_id, count(*) AS n, list(struct_pack(p := priority, k := key, d := dependencies)) AS a FROM act GROUP BY 1), st AS (
 SELECT plan_id, n, a, CASE WHEN len(list_filter(a, lambda x: len(list_filter(x.d, lambda y: NOT list_contains(list_transform(a, lambda z: z.k), y))) > 0)) > 0
  THEN 'missing_dependency' END AS e FROM pk), rec AS (SELECT plan_id, a, []::VARCHAR[] AS ord, 0 AS i FROM st WHERE e IS NULL
 UNION ALL SELECT plan_id, a, list_append(ord, {_STEP}), i + 1 FROM rec WHERE i < len(a)), fin AS (
 SELECT st.plan_id, array_to_string(r.ord, ',') AS ordered, e AS error, r.ord AS ol FROM st LEFT JOIN (SELECT * FROM rec WHERE i = len(a)) r ON r.plan_id = st.plan_id)"""


@query("plan.order", f"WITH RECURSIVE {_ACT}, {_ORDER} SELECT plan_id, ordered, error FROM fin")
def plan_order(spark, d):
    out = planning.order_actions(actions(spark, d))
    return out.select("plan_id", F.array_join("ordered", ",").alias("ordered"), "error")


def options(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        c.alias("plan_id"), F.when(c % 4 != 0, 4.0 + c % 7).alias("weekly_hours"),
        F.when(c % 5 != 0, F.date_add(F.lit(dt.date(2024, 1, 1)), (c % 60).cast("int"))).alias("start_date"),
    )


_OPT = """opt AS (SELECT c_custkey AS plan_id, CASE WHEN c_custkey % 4 <> 0 THEN 4.0::DOUBLE + c_custkey % 7 END AS weekly_hours,
 CASE WHEN c_custkey % 5 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 60 AS INT) END AS start_date FROM customer)"""


@query("plan.capacity", f"""WITH RECURSIVE {_ACT}, {_ORDER}, {_OPT}, x AS MATERIALIZED (SELECT plan_id, ol[place] AS key, place FROM (SELECT plan_id, ol, unnest(range(1, len(ol) + 1)) AS place FROM fin WHERE error IS NULL)), y AS (
 SELECT plan_id, key, place, hours, coalesce(weekly_hours, 5.0::DOUBLE) AS cap, weekly_hours IS NOT NULL AND start_date IS NOT NULL AS dated, start_date AS s,
  sum(hours) OVER (PARTITION BY plan_id ORDER BY place) AS e FROM x JOIN act USING (plan_id, key) LEFT JOIN opt USING (plan_id)), z AS (
 SELECT *, floor((e - hours) / (cap / 7)) AS fd, floor((e - hours) / cap) AS fw FROM y)
 SELECT plan_id, key, place, CAST(fw + 1 AS BIGINT) AS start_week, CAST(greatest(fw, ceil(e / cap) - 1) + 1 AS BIGINT) AS due_week,
 CASE WHEN dated THEN CAST(s + CAST(fd AS INT) AS VARCHAR) END AS start_date, CASE WHEN dated THEN CAST(s + CAST(greatest(fd, ceil(e / (cap / 7)) - 1) AS INT) AS VARCHAR) END AS due_date,
 CASE WHEN dated THEN 'dated' ELSE 'relative_draft' END AS schedule_mode FROM z""")
def capacity(spark, d):
    return dates_as_text(planning.schedule(actions(spark, d), options(spark, d)))


@query("dq.confirmations", f"""WITH RECURSIVE {_PLAN}, {_ORDER}, {_OPT}, u AS (SELECT plan_id, max(unknowns) > 0 AS u FROM prob GROUP BY 1), q AS (SELECT plan_id, bool_or(n % 19 = 0) AS q FROM act GROUP BY 1)
 SELECT opt.plan_id, concat_ws(',', error, CASE WHEN weekly_hours IS NULL OR start_date IS NULL THEN 'resources_unconfirmed' END, CASE WHEN u THEN 'unknown_causes' END, CASE WHEN q THEN 'assumptions' END) AS reasons
 FROM opt LEFT JOIN u USING (plan_id) LEFT JOIN q USING (plan_id) LEFT JOIN fin USING (plan_id)""")
def confirmations(spark, d):
    out = planning.confirmations(options(spark, d), plan_problems(spark, d), actions(spark, d))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("dq.score_gate", """WITH s AS (SELECT c_custkey AS plan_id, least(1 + c_custkey % 5, 2 + c_custkey % 4, 3, 3 + c_custkey % 2, 4) AS low, CASE WHEN c_custkey % 7 = 0 THEN 'fix' END AS rev FROM customer)
 SELECT plan_id, low >= 3 AND rev IS NULL AS passed, CASE WHEN rev IS NOT NULL THEN rev WHEN low < 3 THEN 'scores_below_three' ELSE '' END AS reasons FROM s""")
def score_gate(spark, d):
    c = F.col("c_custkey")
    reviews = table(spark, d, "customer").select(
        c.alias("plan_id"), (1 + c % 5).alias("evidence"), (2 + c % 4).alias("feasibility"), F.lit(3).cast("bigint").alias("resources"),
        (3 + c % 2).alias("measurability"), F.lit(4).cast("bigint").alias("risk"),
        F.when(c % 7 == 0, F.array(F.lit("fix"))).otherwise(F.array().cast("array<string>")).alias("revisions"),
    )
    return planning.score_gate(reviews).withColumn("reasons", F.array_join("reasons", ","))


@query("dq.diagnosis_refs", f"""WITH {_PLAN} SELECT plan_id, bool_and(len(list_filter(refs, lambda e: NOT list_contains(evidence, e))) = 0) AS refs_ok,
 count(*) = count(DISTINCT problem_key) AS keys_ok FROM prob JOIN evd USING (plan_id) GROUP BY 1""")
def diagnosis_refs(spark, d):
    return planning.check_diagnosis(plan_problems(spark, d), plan_evidence(spark, d))


@query("dq.answer_refs", """WITH a AS (SELECT conv_id, turn, list_filter(['c' || turn, 'c' || (conv_id % 9), 'c9'], lambda x: x IN ('c1', 'c3', 'c5')) AS kept FROM conversations WHERE role = 'assistant')
 SELECT conv_id, turn, array_to_string(kept, ',') AS kept, len(kept) = 0 AS unlinked FROM a""")
def answer_refs(spark, d):
    m = table(spark, d, "conversations").filter("role = 'assistant'")
    answers = m.select(
        "conv_id", "turn", F.array(_text("c", F.col("turn")), _text("c", F.col("conv_id") % 9), F.lit("c9")).alias("cited"),
        F.array(F.lit("c1"), F.lit("c3"), F.lit("c5")).alias("allowed"),
    )
    out = planning.answer_refs(answers, "cited", "allowed")
    return out.select("conv_id", "turn", F.array_join("kept", ",").alias("kept"), "unlinked")


_STAGE = C.JOURNEYS["campus"]


@query("dq.design_errors", f"""WITH {_PLAN}, x AS (SELECT plan_id, CAST(n // 2 AS VARCHAR) AS key, problem_key, evidence_ids AS sup, ['e' || (n % 5)] AS cnt,
 CASE WHEN n % 23 = 0 THEN '購買' ELSE '{_STAGE[0]}' END AS stage FROM act), j AS (SELECT x.*, p.refs, evidence FROM x
 LEFT JOIN (SELECT * FROM prob WHERE plan_id % 31 <> 0 OR k <> 2) p USING (plan_id, problem_key) LEFT JOIN evd USING (plan_id)), e AS (
 SELECT plan_id, unnest(list_filter([CASE WHEN refs IS NULL OR len(list_filter(list_concat(sup, cnt), lambda i: NOT list_contains(evidence, i))) > 0 THEN 'refs_outside_evidence'
  WHEN NOT list_has_any(sup, refs) THEN 'support_misses_problem' END, CASE WHEN list_has_any(sup, cnt) THEN 'support_is_counter' END,
  CASE WHEN stage = '購買' THEN 'unknown_stage' END], lambda v: v IS NOT NULL)) AS error FROM j)
 SELECT DISTINCT plan_id, error FROM e UNION SELECT plan_id, 'duplicate_key' FROM x GROUP BY plan_id, key HAVING count(*) > 1""")
def design_errors(spark, d):
    n = F.col("n")
    designs = actions(spark, d).select(
        "plan_id", F.expr("n div 2").cast("string").alias("key"), "problem_key", F.col("evidence_ids").alias("support_ids"),
        F.array(_text("e", n % 5)).alias("counter_ids"), F.when(n % 23 == 0, "購買").otherwise(_STAGE[0]).alias("journey_stage"),
    )
    own = plan_problems(spark, d).filter("plan_id % 31 <> 0 or k <> 2").select("plan_id", "problem_key", F.col("evidence_ids").alias("problem_refs"))
    return planning.design_errors(designs, own, plan_evidence(spark, d), "campus")


@query("dq.task_dates", f"""WITH {_ACT}, tk AS (SELECT plan_id, key, dependencies, CAST(t AS DATE) AS s, CAST(t AS DATE) + CAST(n % 40 - 2 AS INT) AS e FROM act), dp AS (
 SELECT plan_id, key, s, unnest(dependencies) AS peer FROM tk)
 SELECT plan_id, key, 'starts_after_due' AS error, NULL::VARCHAR AS peer FROM tk WHERE s > e
 UNION ALL SELECT dp.plan_id, dp.key, 'starts_before_dependency', dp.peer FROM dp JOIN tk ON tk.plan_id = dp.plan_id AND tk.key = dp.peer WHERE tk.e > dp.s""")
def task_dates(spark, d):
    tasks = actions(spark, d).select(
        "plan_id", "key", "dependencies", F.to_date("at").alias("start_date"), F.date_add(F.to_date("at"), (F.col("n") % 40 - 2).cast("int")).alias("due_date")
    )
    return planning.task_dates(tasks)


# ---- messages and results -----------------------------------------------------------------
@query("win.latest_messages", """SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8""")
def latest_messages(spark, d):
    last = ranks.top_rows(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], C.HISTORY_LIMIT)
    return last.orderBy("conv_id", "turn")


@query("win.latest_result", """SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS result, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS verdict
 FROM orders GROUP BY 1""")
def latest_result(spark, d):
    latest = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    out = table(spark, d, "orders").groupBy("o_custkey").agg(latest)
    return out.select("o_custkey", F.col("r.o_orderkey").alias("result"), F.col("r.o_orderstatus").alias("verdict"))


def payload(spark, d):
    rows = hygiene.anonymized(items(spark, d, heavy=True)).withColumn("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.withColumn("size", packing.json_size("review_key", "rating", "published", "text"))


@query("win.batch_pack", with_items(f""", pay AS (SELECT report_id, id, ordinal, {redact_sql('text')} AS m, rating, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS p FROM items WHERE text <> ''), sz AS (
 SELECT report_id, id, row_number() OVER (PARTITION BY report_id ORDER BY ordinal) AS n, length(CAST(to_json(struct_pack(review_key := id, rating := rating, published := p, text := m)) AS VARCHAR)) + 7 AS size FROM pay), rec AS (
 SELECT report_id, id, n, size, 1 AS held, size AS chars, 1 AS batch_no FROM sz WHERE n = 1 UNION ALL
 SELECT s.report_id, s.id, s.n, s.size, CASE WHEN held >= 40 OR chars + s.size > 60000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 40 OR chars + s.size > 60000 THEN s.size ELSE chars + s.size END,
  CASE WHEN held >= 40 OR chars + s.size > 60000 THEN batch_no + 1 ELSE batch_no END FROM rec JOIN sz s ON s.report_id = rec.report_id AND s.n = rec.n + 1)
 SELECT report_id, id, batch_no::BIGINT AS batch_no FROM rec""").replace("WITH ", "WITH RECURSIVE ", 1))
def batch_pack(spark, d):
    return packing.pack(payload(spark, d).withColumnRenamed("review_key", "id"), ["report_id"], "ordinal", "size")


# ---- outcomes -----------------------------------------------------------------------------
def observations(spark, d):
    """Experiment = customer segment in a nation; before = orders up to 1995, after = later ones."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey")).withColumn("e", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    early, won = F.year("o_orderdate") <= 1995, F.col("o_orderstatus") == "F"
    k, cents = F.col("c_nationkey").cast("bigint"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    out = j.groupBy(F.col("e").alias("experiment_id"), k.alias("k")).agg(
        F.count_if(early).alias("before_count"), F.count_if(~early).alias("after_count"),
        F.count_if(early & won).alias("before_good"), F.count_if(~early & won).alias("after_good"),
        F.sum(F.when(early, cents)).alias("before_cents"), F.sum(F.when(~early, cents)).alias("after_cents"),
    )
    mean = lambda s: F.expr(f"{s}_cents div nullif({s}_count, 0)") / F.lit(100.0)
    out = out.withColumns({"before_avg": mean("before"), "after_avg": mean("after")})
    ratio = F.col("k") % 2 == 0
    return out.select(
        "experiment_id", "k", F.when(ratio, "ratio").otherwise("mean").alias("metric_kind"), F.lit("元").alias("unit"),
        F.when(F.col("k") % 3 == 0, "increase").otherwise("decrease").alias("direction"), (F.col("k") % 10 + 0.5).cast("double").alias("threshold"),
        (F.col("k") * 2).alias("minimum_sample"), "before_count", "after_count",
        F.when(ratio, F.col("before_good")).alias("before_successes"), F.when(ratio, F.col("after_good")).alias("after_successes"),
        F.when(~ratio, F.col("before_avg")).alias("before_mean"), F.when(~ratio, F.col("after_avg")).alias("after_mean"),
        F.lit(dt.date(1992, 1, 1)).alias("before_start"), F.lit(dt.date(1995, 12, 31)).alias("before_end"),
        F.date_add(F.lit(dt.date(1995, 12, 27)), F.col("k").cast("int")).alias("after_start"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("k").cast("int")).alias("after_end"),
        (F.col("k") % 5 != 0).alias("comparable"), F.when(F.col("k") % 7 == 0, F.array(F.lit("season"))).otherwise(F.array().cast("array<string>")).alias("confounders"),
    )


_OBS = """ob AS (SELECT c_nationkey || '/' || c_mktsegment AS experiment_id, c_nationkey::BIGINT AS k, c_nationkey % 2 = 0 AS ratio, count(*) FILTER (year(o_orderdate) <= 1995) AS bc, count(*) FILTER (year(o_orderdate) > 1995) AS ac,
 count(*) FILTER (year(o_orderdate) <= 1995 AND o_orderstatus = 'F') AS bg, count(*) FILTER (year(o_orderdate) > 1995 AND o_orderstatus = 'F') AS ag,
 (sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (year(o_orderdate) <= 1995) // nullif(count(*) FILTER (year(o_orderdate) <= 1995), 0)) / 100.0::DOUBLE AS ba, (sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (year(o_orderdate) > 1995) // nullif(count(*) FILTER (year(o_orderdate) > 1995), 0)) / 100.0::DOUBLE AS aa FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), ov AS (
 SELECT *, CASE WHEN ratio THEN CASE WHEN bc > 0 THEN bg * 100.0::DOUBLE / bc END ELSE ba END AS bv, CASE WHEN ratio THEN CASE WHEN ac > 0 THEN ag * 100.0::DOUBLE / ac END ELSE aa END AS av FROM ob)"""


@query("out.observation_value", f"WITH {_OBS} SELECT experiment_id, round(bv, 6) AS before, round(av, 6) AS after FROM ov")
def observation_value(spark, d):
    value = lambda s: F.round(planning.observation_value(s).cast("double"), 6)
    return observations(spark, d).select("experiment_id", value("before").alias("before"), value("after").alias("after"))


@query("out.verdict", f"""WITH {_OBS}, vd AS (SELECT *, av - bv AS delta, CASE WHEN k % 3 = 0 THEN av - bv ELSE bv - av END AS gain FROM ov), vv AS (SELECT *, CASE WHEN bc < k * 2 OR ac < k * 2 OR bv IS NULL OR av IS NULL THEN 'INSUFFICIENT'
 WHEN DATE '2024-01-15' <= DATE '2024-01-01' + CAST(k AS INT) THEN 'OBSERVING' WHEN k % 7 = 0 OR k % 5 = 0 THEN 'REVIEW' WHEN gain >= k % 10 + 0.5 THEN 'MET' ELSE 'NOT_MET' END AS verdict FROM vd)
 SELECT experiment_id, verdict, CASE verdict {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.VERDICT_LABELS.items())} END AS label, round(delta, 6) AS delta,
 CASE WHEN ratio THEN '百分點' ELSE '元' END AS result_unit FROM vv""")
def verdict(spark, d):
    out = planning.verdicts(observations(spark, d), dt.date(2024, 1, 15))
    return out.select("experiment_id", "verdict", "label", F.round("delta", 6).alias("delta"), "result_unit")


@query("out.observation_check", f"""WITH {_OBS} SELECT experiment_id, concat_ws(',', CASE WHEN k <= 4 THEN 'periods' END, CASE WHEN bc < 40 AND ratio THEN 'before_successes_exceed_count' END,
 CASE WHEN ratio AND k % 4 = 0 THEN 'before_mean_in_ratio' END, CASE WHEN NOT ratio AND k % 3 = 0 THEN 'after_successes_exceed_count' END, CASE WHEN NOT ratio AND k % 3 = 0 THEN 'after_successes_in_mean' END) AS errors FROM ob""")
def observation_check(spark, d):
    k, ratio = F.col("k"), F.col("metric_kind") == "ratio"
    broken = observations(spark, d).withColumns(
        {
            "before_successes": F.when(ratio & (F.col("before_count") < 40), F.col("before_count") + 1).otherwise(F.col("before_successes")),
            "before_mean": F.when(ratio & (k % 4 == 0), F.lit(1.0)).otherwise(F.col("before_mean")),
            "after_successes": F.when(~ratio & (k % 3 == 0), F.col("after_count") + 5).otherwise(F.col("after_successes")),
        }
    )
    return planning.observation_errors(broken).select("experiment_id", F.array_join("errors", ",").alias("errors"))


@query("out.idempotent_submit", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'duplicate' END AS state FROM orders""")
def idempotent_submit(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    stored = o.select(F.col("o_custkey").alias("experiment_id"), n.cast("string").alias("submission_id"), "o_totalprice", "o_orderstatus")
    again = o.select(
        "o_orderkey", F.col("o_custkey").alias("experiment_id"), F.when(n % 3 == 0, _text("n", n)).otherwise(n.cast("string")).alias("submission_id"),
        F.when(n % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus",
    )
    return planning.submissions(stored, again, ["o_totalprice", "o_orderstatus"]).select("o_orderkey", "state")


@query("out.before_after", with_items(f""", pl AS (SELECT n_nationkey::BIGINT AS plan_id, 'r' || (n_nationkey % 4) AS a, 'r' || ((n_nationkey + 1 + n_nationkey % 2) % 4) AS b, DATE '2024-01-29' + CAST(n_nationkey AS INT) AS at_ FROM nation), ok AS (
 SELECT * FROM pl WHERE CAST(substr(a, 2) AS INT) % 2 = CAST(substr(b, 2) AS INT) % 2), ph AS (
 SELECT plan_id, 'before' AS phase, a AS report_id, at_ - 28 AS f, at_ - 1 AS t FROM ok UNION ALL SELECT plan_id, 'after', b, at_, at_ + 27 FROM ok), cal AS (
 SELECT plan_id, phase, CAST(unnest(generate_series(CAST(date_trunc('week', f) AS TIMESTAMP), CAST(t AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period FROM ph), c AS (
 SELECT plan_id, phase, CAST(date_trunc('week', day) AS DATE) AS period, count(*) AS count, {_FIVE}, {_SRC} FROM ph JOIN items USING (report_id)
 WHERE day BETWEEN f AND t AND date_precision IN ('day', 'week') GROUP BY ALL), s AS (SELECT cal.*, coalesce(count, 0) AS count, {", ".join(f"coalesce({x}_count, 0) AS {x}_count" for x in C.SENTIMENTS)} FROM cal LEFT JOIN c USING (plan_id, phase, period))
 SELECT plan_id, phase, CAST(period AS VARCHAR) AS period, count, negative_count, negative_ratio FROM (SELECT *, {_RATIOS} FROM s)"""))
def before_after(spark, d):
    n = F.col("n_nationkey").cast("bigint")
    plans = table(spark, d, "nation").select(
        n.alias("plan_id"), _text("r", n % 4).alias("before"), _text("r", (n + 1 + n % 2) % 4).alias("after"),
        F.date_add(F.lit(dt.date(2024, 1, 29)), n.cast("int")).alias("intervention"),
    )
    subject = lambda c: F.substring(c, 2, 9).cast("int") % 2
    same = plans.filter(subject("before") == subject("after"))
    return dates_as_text(stats.before_after(items(spark, d), same)).select("plan_id", "phase", "period", "count", "negative_count", "negative_ratio")
