"""Plan rules: references, required fields, gates, dependency order, capacity, task dates."""

from __future__ import annotations

import collections
import datetime as dt
import heapq
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake import constants as C
from opinionlake.functions.text import is_blank
from opinionlake.operators import ranks
from opinionlake.session import gathered

REQUIRED = ("owner_role", "cost_estimate", "metric", "target", "verification")
SCORES = ("evidence", "feasibility", "resources", "measurability", "risk")


def subset(inner: Column, outer: Column) -> Column:
    return F.coalesce(F.size(F.array_except(inner, outer)) == 0, F.lit(False))


def check_refs(actions: DataFrame, problems: DataFrame, evidence: DataFrame) -> DataFrame:
    """``refs_ok``: the problem exists and the references lie in the evidence and in the problem's own.

    ``problems``: (plan_id, problem_key, problem_refs); ``evidence``: (plan_id, evidence) - the
    sampled evidence of a plan, at most sixty ids.
    """
    # Both sides grow with the plans, and lists of ids are far larger than Spark guesses: broadcast, every task would hold all of them.
    joined = actions.join(problems.hint("merge"), ["plan_id", "problem_key"], "left").join(evidence.hint("merge"), "plan_id", "left")
    ok = F.col("problem_refs").isNotNull() & subset(F.col("evidence_ids"), F.col("evidence")) & subset(F.col("evidence_ids"), F.col("problem_refs"))
    return joined.withColumn("refs_ok", ok).drop("problem_refs", "evidence")


def fields_ok() -> Column:
    present = F.lit(True)
    for name in REQUIRED:
        present = present & ~is_blank(F.col(name))
    return present & F.forall("steps", lambda s: ~is_blank(s))


def faults(actions: DataFrame) -> DataFrame:
    """(plan_id, error): plans with a repeated key, else with a dependency that is no action of theirs."""
    keys = actions.groupBy("plan_id", "key").agg(F.count("*").alias("_n"))
    repeated = keys.filter("_n > 1").select("plan_id", F.lit("duplicate_key").alias("error"))
    asked = actions.select("plan_id", F.explode("dependencies").alias("key"))
    missing = asked.join(keys, ["plan_id", "key"], "left_anti").select("plan_id", F.lit("missing_dependency").alias("error"))
    # The first of the alphabet is also the one that counts.
    return repeated.unionByName(missing).groupBy("plan_id").agg(F.min("error").alias("error"))


def _steps(keys: list[str], needs: list) -> list[int]:
    """Places of ``keys``, which come by priority and key, in the order of doing: the first that is ready, again and again. Fewer than all if some need each other."""
    place = {k: i for i, k in enumerate(keys)}
    open_, unlocks = [len(set(own)) for own in needs], collections.defaultdict(list)
    for i, own in enumerate(needs):
        for k in set(own):
            unlocks[place[k]].append(i)
    ready, out = [i for i, n in enumerate(open_) if not n], []
    while ready:
        out.append(i := heapq.heappop(ready))
        for other in unlocks[i]:
            open_[other] -= 1
            if not open_[other]:
                heapq.heappush(ready, other)
    return out


def ordered_rows(actions: DataFrame, bad: DataFrame, chunk: int = 50_000) -> DataFrame:
    """(plan_id, at, key) of the actions of each sound plan in the order of doing, from 0; a plan with a cycle has one row, with its ``error``.

    The order of one plan is sequential: its slim sorted rows pass through one task, which holds keys and open dependencies, and leave in chunks.
    """
    slim = actions.select("plan_id", "priority", "key", F.coalesce("dependencies", F.array().cast("array<string>")).alias("needs")).join(bad, "plan_id", "left_anti")
    sorted_ = gathered(slim, ["plan_id"], "priority", "key").select("plan_id", "key", "needs")

    def done(plan, keys: list, needs: list) -> Iterator[tuple]:
        steps = _steps(keys, needs)
        if len(steps) < len(keys):
            yield plan, None, None, "cycle"
        else:
            yield from ((plan, at, keys[i], None) for at, i in enumerate(steps))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        plans, places, keys, errors = zip(*rows, strict=True)
        return pd.DataFrame({"plan_id": plans, "at": pd.array(places, "Int64"), "key": keys, "error": errors})

    def plans(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        last, keys, needs = None, [], []
        for batch in batches:
            for plan, key, own in zip(batch["plan_id"].tolist(), batch["key"].tolist(), batch["needs"].tolist(), strict=True):
                if keys and plan != last:
                    yield from done(last, keys, needs)
                    keys, needs = [], []
                keys.append(key)
                needs.append(own)
                last = plan
        if keys:
            yield from done(last, keys, needs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = plans(batches)
        while part := list(itertools.islice(rows, chunk)):
            yield frame(part)

    schema = T.StructType([T.StructField("plan_id", actions.schema["plan_id"].dataType), *T.StructType.fromDDL("at bigint, key string, error string").fields])
    return sorted_.mapInPandas(run, schema)


def order_actions(actions: DataFrame) -> DataFrame:
    """One row per plan: ``ordered`` keys, or an ``error`` (duplicate_key, missing_dependency, cycle). For plans that fit a row; ``ordered_rows`` is for any."""
    bad = faults(actions)
    packed = ordered_rows(actions, bad).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("at", "key")))).alias("_a"), F.max("error").alias("error"))
    sound = packed.select("plan_id", F.when(F.col("error").isNull(), F.transform("_a", lambda s: s["key"])).alias("ordered"), "error")
    return sound.unionByName(bad.select("plan_id", F.lit(None).cast("array<string>").alias("ordered"), "error"))


def plan_errors(actions: DataFrame) -> DataFrame:
    """(plan_id, error) of unsound plans. Only plans that are not faulty and have dependencies at all are looked through for cycles."""
    bad = faults(actions)
    linked = actions.filter(F.size("dependencies") > 0).select("plan_id").distinct()
    cycles = ordered_rows(actions.join(linked, "plan_id", "left_semi"), bad).filter(F.col("error").isNotNull())
    return bad.unionByName(cycles.select("plan_id", "error"))


def schedule(actions: DataFrame, options: DataFrame) -> DataFrame:
    """Sequential hours against weekly capacity: start/due week, and dates when hours and start are given.

    ``options``: (plan_id, weekly_hours, start_date).
    """
    ordered = ordered_rows(actions, faults(actions)).filter("key is not null").select("plan_id", F.col("at").alias("_at"), "key")
    rows = ordered.join(actions.select("plan_id", "key", "hours"), ["plan_id", "key"])
    rows = ranks.block_sum(rows, ["plan_id"], "_at", F.col("hours"), "_end").join(options, "plan_id", "left")
    capacity = F.when(F.coalesce("weekly_hours", F.lit(0.0)) > 0, F.col("weekly_hours")).otherwise(F.lit(C.DEFAULT_WEEKLY_HOURS))
    rows = rows.withColumn("_capacity", capacity)
    rows = rows.withColumn("_begin", F.col("_end") - F.col("hours"))
    dated = (F.coalesce("weekly_hours", F.lit(0.0)) > 0) & F.col("start_date").isNotNull()
    daily = F.col("_capacity") / 7
    first_day, first_week = F.floor(F.col("_begin") / daily), F.floor(F.col("_begin") / F.col("_capacity"))
    last_week = F.greatest(first_week, F.ceil(F.col("_end") / F.col("_capacity")) - 1)
    last_day = F.greatest(first_day, F.ceil(F.col("_end") / daily) - 1)
    return rows.select(
        "plan_id",
        "key",
        (F.col("_at") + 1).cast("bigint").alias("place"),
        (first_week + 1).alias("start_week"),
        (last_week + 1).alias("due_week"),
        F.when(dated, F.date_add("start_date", first_day.cast("int"))).alias("start_date"),
        F.when(dated, F.date_add("start_date", last_day.cast("int"))).alias("due_date"),
        F.when(dated, "dated").otherwise("relative_draft").alias("schedule_mode"),
    )


def confirmations(plans: DataFrame, problems: DataFrame, actions: DataFrame) -> DataFrame:
    """Reasons why a plan still needs a person: resources, unknowns, assumptions, schedule errors."""
    unknowns = problems.groupBy("plan_id").agg(F.bool_or(F.size("unknowns") > 0).alias("_unknown"))
    assumed = actions.groupBy("plan_id").agg(F.bool_or((F.size("prerequisites") > 0) | (F.size("assumptions") > 0)).alias("_assumed"))
    errors = plan_errors(actions)
    out = plans.join(unknowns, "plan_id", "left").join(assumed, "plan_id", "left").join(errors, "plan_id", "left")
    missing = (F.coalesce("weekly_hours", F.lit(0.0)) == 0) | F.col("start_date").isNull()
    reasons = F.array_compact(
        F.array(
            F.col("error"),
            F.when(missing, "resources_unconfirmed"),
            F.when(F.col("_unknown"), "unknown_causes"),
            F.when(F.col("_assumed"), "assumptions"),
        )
    )
    return out.select("plan_id", reasons.alias("reasons"))


def score_gate(reviews: DataFrame) -> DataFrame:
    """Pass when every score is at least 3 and no revision is asked; else the reasons."""
    low = F.least(*SCORES) < 3
    failed = low | (F.size("revisions") > 0)
    default = F.array(F.lit("scores_below_three"))
    reasons = F.when(failed, F.when(F.size("revisions") > 0, F.col("revisions")).otherwise(default)).otherwise(F.array().cast("array<string>"))
    return reviews.select("plan_id", (~failed).alias("passed"), reasons.alias("reasons"))


def check_diagnosis(problems: DataFrame, evidence: DataFrame) -> DataFrame:
    """A diagnosis stands when all references are evidence and its problem keys are unique."""
    joined = problems.join(evidence, "plan_id", "left")
    return joined.groupBy("plan_id").agg(
        F.bool_and(subset(F.col("evidence_ids"), F.col("evidence"))).alias("refs_ok"),
        (F.count("*") == F.count_distinct("problem_key")).alias("keys_ok"),
    )


def answer_refs(answers: DataFrame, cited: str, allowed: str) -> DataFrame:
    """Keep cited ids that are evidence; flag answers left without any although evidence exists."""
    kept = F.filter(cited, lambda c: F.array_contains(F.col(allowed), c))
    out = answers.withColumn("kept", kept)
    return out.withColumn("unlinked", (F.size("kept") == 0) & (F.size(allowed) > 0))


def design_errors(experiments: DataFrame, problems: DataFrame, evidence: DataFrame, context: str) -> DataFrame:
    """Distinct error codes of each design (five possible, so the set is bounded)."""
    repeats = experiments.groupBy("plan_id", "key").agg(F.count("*").alias("_copies"))
    joined = experiments.join(problems, ["plan_id", "problem_key"], "left").join(evidence, "plan_id", "left")
    refs = F.concat("support_ids", "counter_ids")
    outside = F.col("problem_refs").isNull() | ~subset(refs, F.col("evidence"))
    errors = F.array_compact(
        F.array(
            F.when(outside, "refs_outside_evidence").when(~F.arrays_overlap("support_ids", "problem_refs"), "support_misses_problem"),
            F.when(F.arrays_overlap("support_ids", "counter_ids"), "support_is_counter"),
            F.when(~F.col("journey_stage").isin(*C.JOURNEYS[context]), "unknown_stage"),
        )
    )
    found = joined.select("plan_id", F.explode(errors).alias("error")).distinct()
    doubled = repeats.filter("_copies > 1").select("plan_id", F.lit("duplicate_key").alias("error")).distinct()
    return found.unionByName(doubled)


def task_dates(tasks: DataFrame) -> DataFrame:
    """Tasks whose dates are out of order, alone or against a task they depend on."""
    alone = tasks.filter(F.col("start_date") > F.col("due_date")).select("plan_id", "key", F.lit("starts_after_due").alias("error"), F.lit(None).cast("string").alias("peer"))
    needs = tasks.select("plan_id", "key", "start_date", F.explode("dependencies").alias("peer"))
    peers = tasks.select("plan_id", F.col("key").alias("peer"), F.col("due_date").alias("_due"))
    early = needs.join(peers, ["plan_id", "peer"]).filter(F.col("_due") > F.col("start_date"))
    return alone.unionByName(early.select("plan_id", "key", F.lit("starts_before_dependency").alias("error"), "peer"))


# ---- outcomes -----------------------------------------------------------------------------
def observation_errors(df: DataFrame) -> DataFrame:
    """Why an observation pair or its spec is refused: error codes in a fixed order."""

    def side(s: str) -> list[Column]:
        count, good, mean = F.col(f"{s}_count"), F.col(f"{s}_successes"), F.col(f"{s}_mean")
        ratio = F.col("metric_kind") == "ratio"
        return [
            F.when(good.isNotNull() & (count.isNull() | (good > count)), f"{s}_successes_exceed_count"),
            F.when(ratio & mean.isNotNull(), f"{s}_mean_in_ratio"),
            F.when(~ratio & good.isNotNull(), f"{s}_successes_in_mean"),
        ]

    ordered = (F.col("before_start") <= F.col("before_end")) & (F.col("before_end") < F.col("after_start")) & (F.col("after_start") <= F.col("after_end"))
    checks = [F.when(~ordered, "periods"), F.when((F.col("metric_kind") == "ratio") & (F.col("threshold") > 100), "threshold"), *side("before"), *side("after")]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


_EXACT = "decimal(38,18)"


def observation_value(side: str) -> Column:
    """Percentage points for a ratio, the mean as given otherwise; exact decimal."""
    share = F.try_divide((F.col(f"{side}_successes") * 100).cast("decimal(20,0)"), F.col(f"{side}_count").cast("decimal(20,0)"))
    return F.when(F.col("metric_kind") == "ratio", share.cast(_EXACT)).otherwise(F.col(f"{side}_mean").cast(_EXACT))


def verdicts(df: DataFrame, today: dt.date) -> DataFrame:
    """Ordered rule: INSUFFICIENT, OBSERVING, REVIEW, then MET or NOT_MET by the directed change."""
    df = df.withColumns({"_b": observation_value("before"), "_a": observation_value("after")})
    enough = F.lit(True)
    for s in ("before", "after"):
        enough = enough & F.coalesce(F.col(f"{s}_count") >= F.col("minimum_sample"), F.lit(False))
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    delta = F.when(both, F.col("_a") - F.col("_b"))
    gain = F.when(F.col("direction") == "increase", delta).otherwise(-delta)
    verdict = (
        F.when(~(enough & both), "INSUFFICIENT")
        .when(F.lit(today) <= F.col("after_end"), "OBSERVING")
        .when((F.size("confounders") > 0) | ~F.col("comparable"), "REVIEW")
        .when(gain >= F.col("threshold").cast(_EXACT), "MET")
        .otherwise("NOT_MET")
    )
    labels = F.create_map(*[F.lit(x) for kv in C.VERDICT_LABELS.items() for x in kv])
    out = df.withColumns(
        {
            "verdict": verdict,
            "before": F.when(both, F.col("_b").cast("double")),
            "after": F.when(both, F.col("_a").cast("double")),
            "delta": delta.cast("double"),
            "result_unit": F.when(F.col("metric_kind") == "ratio", "百分點").otherwise(F.col("unit")),
        }
    )
    return out.withColumn("label", F.element_at(labels, F.col("verdict"))).drop("_a", "_b")


def submissions(stored: DataFrame, incoming: DataFrame, content) -> DataFrame:
    """new / duplicate / conflict for results resubmitted under the same id."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    old = stored.select("experiment_id", "submission_id", digest.alias("_old"))
    joined = incoming.withColumn("_new", digest).join(old, ["experiment_id", "submission_id"], "left")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "duplicate").otherwise("conflict")
    return joined.withColumn("state", state).drop("_old", "_new")
