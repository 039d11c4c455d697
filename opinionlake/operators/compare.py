"""Side-by-side comparison: the member (brand or topic group) becomes a column.

A row may belong to several topic groups, so membership is first an array on the row. Counts of
the union and the overlap read that array; per-member figures explode it. Nothing is joined.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates
from opinionlake.operators import ranks, stats
from opinionlake.operators import scope as S
from opinionlake.session import stored


@dataclasses.dataclass(frozen=True)
class TopicGroup:
    id: str
    name: str
    any_terms: tuple[str, ...] = ()
    all_terms: tuple[str, ...] = ()
    exclude_terms: tuple[str, ...] = ()

    def scope(self) -> S.Scope:
        return S.Scope(any_terms=self.any_terms, all_terms=self.all_terms, exclude_terms=self.exclude_terms)

    def test(self) -> Column:
        tests = S._conditions(self.scope())
        return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


def mother_set(items: DataFrame, scope: S.Scope) -> DataFrame:
    """The filtered set every topic group is cut from; comparisons always use interval precision."""
    return S.select(items, scope.with_(precision_policy="interval"))


def with_groups(mother: DataFrame, groups) -> DataFrame:
    """``groups``: the ids of the topic groups the row falls into. OR-terms of groups never merge."""
    if not 1 <= len(groups) <= 5 or len({g.id for g in groups}) != len(groups):
        raise ValueError("one to five groups with distinct ids")
    tagged = mother.withColumn("_folded", S.item_text())
    hits = F.array_compact(F.array(*[F.when(g.test(), F.lit(g.id)) for g in groups]))
    return tagged.withColumn("groups", hits).drop("_folded")


def members(tagged: DataFrame) -> DataFrame:
    return tagged.withColumn("member", F.explode("groups")).drop("groups")


def brand_members(items: DataFrame, report_ids, scope: S.Scope) -> DataFrame:
    """Two to five reports under the same filters; topic keys are report-local and not allowed."""
    if not 2 <= len(set(report_ids)) <= 5 or len(set(report_ids)) != len(report_ids):
        raise ValueError("two to five distinct reports")
    if scope.topic_key or not (scope.date_from and scope.date_to):
        raise ValueError("a brand comparison needs both dates and no topic key")
    chosen = items.filter(F.col("report_id").isin(*report_ids))
    return mother_set(chosen, scope).withColumn("member", F.col("report_id"))


def overlap_counts(tagged: DataFrame, keys=("report_id",)) -> DataFrame:
    return tagged.groupBy(*keys).agg(
        F.count_if(F.size("groups") >= 1).alias("union_count"), F.count_if(F.size("groups") >= 2).alias("overlap_count")
    )


def shared_bounds(mother: DataFrame, scope: S.Scope) -> DataFrame:
    """Missing bounds come from the mother set, so all series share their buckets."""
    day = dates.local_day(F.col("published_at"))
    seen = mother.groupBy("report_id").agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    low, high = F.lit(scope.date_from).cast("date"), F.lit(scope.date_to).cast("date")
    return seen.select(
        "report_id", F.coalesce(low, "_a", high).alias("date_from"), F.coalesce(high, "_b", low).alias("date_to")
    )


def complaint_aspects(rows: DataFrame, keys) -> DataFrame:
    """Aspects of negative rows, each once per item, over the classified count of the member."""
    classified = S.sentiment().isin("positive", "neutral", "negative")
    totals = rows.groupBy(*keys).agg(F.count_if(classified).alias("_classified"))
    exploded = rows.filter(F.col("sentiment") == "negative").select(*keys, F.explode(F.array_distinct("aspects")).alias("aspect"))
    counted = exploded.groupBy(*keys, "aspect").count()
    ratio = F.try_divide(F.col("count").cast("double"), F.col("_classified"))
    return counted.join(totals, list(keys)).withColumn("ratio", ratio).drop("_classified")


def common_aspects(counted: DataFrame, members_wanted: int, keys=("report_id",)) -> DataFrame:
    """Complaint aspects present in every member."""
    out = counted.groupBy(*keys, "aspect").agg(F.count_distinct("member").alias("_n"))
    return out.filter(F.col("_n") == members_wanted).drop("_n")


def topic_hits(rows: DataFrame, keys) -> DataFrame:
    """Items of each semantic topic inside each member."""
    return rows.select(*keys, F.explode("topic_keys").alias("topic_key")).groupBy(*keys, "topic_key").count()


def warnings(summary: DataFrame, keys=()) -> DataFrame:
    """Per member: incomplete or excluded rows, live basis; and whether period or source mix differ.

    ``summary`` carries member, complete, excluded_count, data_basis, observed_from, observed_to and
    the three source counts. One row per member, so comparing them is cheap.
    """
    mix = F.struct("observed_from", "observed_to", *[f"{s}_items" for s in C.SOURCES])
    differ = summary.groupBy(*keys).agg((F.count_distinct(mix) > 1).alias("differs"))
    flagged = summary.withColumns(
        {
            "incomplete": ~F.coalesce("complete", F.lit(False)) | (F.col("excluded_count") > 0),
            "live_basis": F.col("data_basis") == "legacy_live",
        }
    )
    if keys:
        return flagged.join(differ, list(keys))
    return flagged.withColumn("differs", differ.scalar())


def summary(rows: DataFrame, keys) -> DataFrame:
    day = dates.local_day(F.col("published_at"))
    return rows.groupBy(*keys).agg(
        F.min(day).alias("observed_from"), F.max(day).alias("observed_to"), *stats.source_counts()
    )


def top_threads(rows: DataFrame, keys, k: int = 25) -> DataFrame:
    return ranks.top_rows(stats.threads(rows, keys), list(keys), stats.thread_order(), k)


def workspace(rows: DataFrame, keys, interval: str, date_from=None, date_to=None, bounds: DataFrame | None = None, threads: int = 25) -> dict[str, DataFrame]:
    """All tables of a comparison, one group of rows per member, cut from one set of member rows.

    Those rows are written once without their long texts (an excerpt stays), since finding the members reads and folds
    all texts, and the tables would each do it again.
    """
    slim = rows.withColumn("text", F.substring("text", 1, C.EXCERPT_CHARS)).drop("_folded", "_tokens")
    held = stored(slim, "members")
    return {
        "statistics": stats.statistics(held, keys),
        "trend": stats.trend(held, interval, date_from, date_to, keys, bounds),
        "channels": stats.channels(held, keys=keys),
        "sources": stats.channels(held, "source", keys),
        "threads": top_threads(held, keys, threads),
        "complaint_aspects": complaint_aspects(held, keys),
        "topic_hits": topic_hits(held, keys),
        "observed": summary(held, keys),
    }


LONG_METRICS = (
    "count",
    "positive_count",
    "neutral_count",
    "negative_count",
    "unknown_count",
    "rating_only_count",
    "classified_count",
    "negative_ratio",
    "pn_ratio",
)


def long_table(series: DataFrame, comparison: str, totals: DataFrame | None = None) -> DataFrame:
    """comparison, member, report_id, period, metric, value, scope_key."""
    ids = ["member", "report_id", "period", "scope_key"]
    doubles = [F.col(m).cast("double").alias(m) for m in LONG_METRICS]
    main = series.select(*ids, *doubles).unpivot(ids, list(LONG_METRICS), "metric", "value")
    sources = series.select(*ids, *[F.col(f"{s}_items").cast("double").alias(f"source:{s}") for s in C.SOURCES])
    sources = sources.unpivot(ids, [f"source:{s}" for s in C.SOURCES], "metric", "value").filter("value > 0")
    out = main.unionByName(sources).withColumn("period", F.col("period").cast("string"))
    if totals is not None:
        rows = totals.select(
            F.lit("全部選取議題").alias("member"), "report_id", F.lit("全部期間").alias("period"), F.lit("").alias("scope_key"),
            F.col("union_count").cast("double").alias("union_count"), F.col("overlap_count").cast("double").alias("overlap_count"),
        ).unpivot(ids, ["union_count", "overlap_count"], "metric", "value")
        out = out.unionByName(rows)
    return out.withColumn("comparison", F.lit(comparison))
