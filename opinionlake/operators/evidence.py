"""Evidence selection: anchors first, then a round-robin over source/week strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates, text
from opinionlake.operators import ranks
from opinionlake.operators import scope as S


def reference_positions(problems: DataFrame) -> DataFrame:
    """First position of every referenced id: problem order, then place in the list.

    ``problems``: (report_id, problem_no, problem_key, evidence_ids).
    """
    exploded = problems.select("report_id", "problem_no", F.posexplode("evidence_ids").alias("_pos", "id"))
    return exploded.groupBy("report_id", "id").agg(F.min(F.struct("problem_no", "_pos")).alias("_at"))


def with_text(items: DataFrame) -> DataFrame:
    return items.filter(~text.is_blank(F.col("text")))


def all_anchors(items: DataFrame, problems: DataFrame) -> DataFrame:
    return with_text(items).join(reference_positions(problems), ["report_id", "id"])


def anchors(items: DataFrame, problems: DataFrame, limit: int = C.EVIDENCE_LIMIT) -> DataFrame:
    """Referenced items with text, in reference order, at most ``limit`` per report."""
    return ranks.top_rows(all_anchors(items, problems), ["report_id"], [F.col("_at")], limit, rank="position").drop("_at")


def _tagged(items: DataFrame, problems: DataFrame) -> DataFrame:
    """Items with text, their reference position ``_at`` (null when not referenced) and ``_near``.

    A diagnosis names at most ten problems with at most ten references each, so a report's anchor
    aspects and topics are short arrays that ride along on a join by report.
    """
    found = all_anchors(items, problems)
    kinds = F.explode(
        F.concat(
            F.transform("aspects", lambda a: F.struct(F.lit("a").alias("kind"), a.alias("v"))),
            F.transform("topic_keys", lambda t: F.struct(F.lit("t").alias("kind"), t.alias("v"))),
        )
    )
    near = found.select("report_id", kinds.alias("m")).groupBy("report_id").agg(
        F.collect_set(F.when(F.col("m.kind") == "a", F.col("m.v"))).alias("_aspects"),
        F.collect_set(F.when(F.col("m.kind") == "t", F.col("m.v"))).alias("_topics"),
    )
    joined = with_text(items).join(reference_positions(problems), ["report_id", "id"], "left").join(near, "report_id", "left")
    hit = F.coalesce(F.arrays_overlap("aspects", "_aspects"), F.lit(False)) | F.coalesce(F.arrays_overlap("topic_keys", "_topics"), F.lit(False))
    return joined.withColumn("_near", hit).drop("_aspects", "_topics")


def relevant(items: DataFrame, problems: DataFrame) -> DataFrame:
    """Unreferenced items with text sharing an aspect or a topic with any anchor."""
    return _tagged(items, problems).filter(F.col("_at").isNull() & F.col("_near")).drop("_at", "_near")


def stratum_week() -> Column:
    """Local ISO week for day/week precision, else 'unknown'."""
    day = dates.local_day(F.col("published_at"))
    precise = day.isNotNull() & F.col("date_precision").isin("day", "week")
    return F.when(precise, dates.iso_week(day)).otherwise("unknown")


def round_robin(rows: DataFrame, limit: int = C.EVIDENCE_LIMIT) -> DataFrame:
    """Rank inside (source, week) by id, then all first rows, all second rows, ...

    Only the first ``limit`` rows of a stratum can be chosen, so larger strata are cut before the
    shuffle.
    """
    tagged = rows.withColumn("week", stratum_week())
    inside = ranks.top_rows(tagged, ["report_id", "source", "week"], [F.col("id")], limit, rank="turn")
    return ranks.top_rows(inside, ["report_id"], [F.col("turn"), F.col("source"), F.col("week")], limit, rank="position")


def sample(items: DataFrame, problems: DataFrame, limit: int = C.EVIDENCE_LIMIT) -> DataFrame:
    """The evidence rows: anchors, then round-robin fill; whitelisted fields, text cut."""
    slim = ["report_id", "id", "source", "sentiment", "aspects", "date_precision", "text"]
    first = anchors(items, problems, limit).select(*slim, "position")
    fill = round_robin(relevant(items, problems), limit).select(*slim, (F.col("position") + limit).alias("position"))
    both = first.unionByName(fill)
    chosen = ranks.top_rows(both, ["report_id"], [F.col("position")], limit, rank="place").drop("position")
    return chosen.withColumn("text", F.substring("text", 1, C.EVIDENCE_CHARS))


def coverage(items: DataFrame, problems: DataFrame, limit: int = C.EVIDENCE_LIMIT) -> DataFrame:
    """included / excluded / snapshot / with-text / relevant counts and the omitted references.

    The sample always fills up to ``limit`` while anchors or relevant rows are left, so its size
    follows from the two counts and the sample itself need not be drawn.
    """
    totals = items.groupBy("report_id").agg(F.count("*").alias("snapshot_count"))
    tagged = _tagged(items, problems).groupBy("report_id").agg(
        F.count("*").alias("text_count"), F.count_if(F.col("_at").isNotNull() | F.col("_near")).alias("relevant_count")
    )
    # References are at most ten problems times ten ids per report.
    kept = anchors(items, problems, limit).select("report_id", "id")
    omitted = (
        reference_positions(problems)
        .join(kept, ["report_id", "id"], "left_anti")
        .groupBy("report_id")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "id"))).alias("_o"))
    )
    out = totals.join(tagged, "report_id", "left").join(omitted, "report_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    included = F.least(F.lit(limit), zero("relevant_count"))
    return out.select(
        "report_id",
        included.cast("bigint").alias("included"),
        (zero("text_count") - included).alias("excluded"),
        "snapshot_count",
        zero("text_count").alias("text_count"),
        zero("relevant_count").alias("relevant_count"),
        F.coalesce(F.array_join(F.transform("_o", lambda s: s["id"]), ","), F.lit("")).alias("omitted"),
    )


def problem_refs(problems: DataFrame, chosen: DataFrame, items: DataFrame) -> DataFrame:
    """Each problem's references inside the sample; ``valid`` is false when one is not in the report.

    Problems left without a sampled reference are dropped.
    """
    exploded = problems.select("report_id", "problem_key", F.posexplode("evidence_ids").alias("_pos", "id"))
    known = with_text(items).select("report_id", "id").withColumn("_known", F.lit(True))
    picked = chosen.select("report_id", "id").withColumn("_picked", F.lit(True))
    joined = exploded.join(known, ["report_id", "id"], "left").join(picked, ["report_id", "id"], "left")
    packed = joined.groupBy("report_id", "problem_key").agg(
        F.bool_and(F.col("_known").isNotNull()).alias("valid"),
        F.array_sort(F.collect_list(F.when(F.col("_picked"), F.struct("_pos", "id")))).alias("_kept"),
    )
    return packed.filter(F.size("_kept") > 0).select(
        "report_id", "problem_key", "valid", F.transform("_kept", lambda s: s["id"]).alias("evidence_ids")
    )


def complaint_sample(items: DataFrame, limit: int = C.EVIDENCE_LIMIT) -> DataFrame:
    """First complaint rows by position, text cut."""
    rows = items.filter(S.complaint()).select("report_id", "id", "ordinal", F.substring("text", 1, C.EVIDENCE_CHARS).alias("text"))
    return ranks.top_rows(rows, ["report_id"], [F.col("ordinal")], limit).drop("ordinal")
