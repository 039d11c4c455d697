"""Sentiment statistics, gap-filled trends, channel and thread tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates, identity
from opinionlake.operators import scope as S

REPORT = ("report_id",)
_COUNTS = [f"{s}_count" for s in C.SENTIMENTS]


def sentiment_counts() -> list[Column]:
    return [F.count_if(S.sentiment() == s).alias(f"{s}_count") for s in C.SENTIMENTS]


def with_ratios(df: DataFrame) -> DataFrame:
    """classified_count, negative_ratio, pn_ratio and pn_reason from the five counts."""
    classified = F.col("positive_count") + F.col("neutral_count") + F.col("negative_count")
    negative = F.col("negative_count")
    reason = F.when(negative > 0, None).when(classified > 0, "no_negative").otherwise("no_classified_text")
    return df.withColumns(
        {
            "classified_count": classified,
            "negative_ratio": F.try_divide(negative.cast("double"), classified),
            "pn_ratio": F.try_divide(F.col("positive_count").cast("double"), negative),
            "pn_reason": reason,
        }
    )


def source_counts() -> list[Column]:
    return [F.count_if(F.col("source") == s).alias(f"{s}_items") for s in C.SOURCES]


def thread_key() -> Column:
    thread = F.expr("nullif(thread_source_id, '')")
    return F.when(thread.isNotNull(), F.struct("source", thread.alias("thread")))


def statistics(items: DataFrame, keys=REPORT) -> DataFrame:
    out = items.groupBy(*keys).agg(
        F.count("*").alias("count"),
        *sentiment_counts(),
        *source_counts(),
        F.count_distinct(thread_key()).alias("thread_count"),
    )
    return with_ratios(out)


def trend(
    items: DataFrame, interval="month", date_from=None, date_to=None, keys=REPORT, bounds: DataFrame | None = None
) -> DataFrame:
    """Gap-filled series per group.

    The items are read once and pre-aggregated per (group, bucket); only those counts - at most one
    row per bucket - are folded per group, padded with the calendar and added up again.
    ``bounds`` may give each group its own ``date_from``/``date_to`` columns.
    """
    low = F.lit(date_from).cast("date") if bounds is None else F.col("date_from")
    high = F.lit(date_to).cast("date") if bounds is None else F.col("date_to")
    if bounds is not None:
        items = items.join(bounds, [k for k in keys if k in bounds.columns])
    day = dates.local_day(F.col("published_at"))
    precise = F.coalesce(F.col("date_precision").isin(*C.ACCEPTED_PRECISION[interval]), F.lit(False))
    usable = day.isNotNull() & precise
    inside = F.coalesce(day >= low, F.lit(True)) & F.coalesce(day <= high, F.lit(True))
    tagged = items.withColumns(
        {
            "_day": F.when(usable & inside, day),
            "_excluded": (~usable).cast("bigint"),
            "_low": low,
            "_high": high,
        }
    ).withColumn("period", dates.bucket(F.col("_day"), interval))
    per_bucket = tagged.groupBy(*keys, "_low", "_high", "period").agg(
        F.count("*").alias("count"),
        *sentiment_counts(),
        *source_counts(),
        F.min("_day").alias("_first"),
        F.max("_day").alias("_last"),
        F.sum("_excluded").alias("_excluded"),
    )
    return _series(per_bucket, interval, keys)


_FIGURES = ["count", *_COUNTS, *[f"{s}_items" for s in C.SOURCES]]


def _series(per_bucket: DataFrame, interval: str, keys) -> DataFrame:
    """Counts per (group, bounds, bucket) padded with the calendar of their group."""
    figures = _FIGURES
    point = F.struct("period", *figures)
    per_group = per_bucket.groupBy(*keys, "_low", "_high").agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.sum("_excluded").alias("excluded_count"),
        F.collect_list(F.when(F.col("period").isNotNull(), point)).alias("_points"),
    )
    per_group = per_group.withColumn("date_from", F.coalesce("_low", "_first", "_high")).withColumn(
        "date_to", F.coalesce("_high", "_last", "date_from")
    )
    per_group = per_group.filter(F.col("date_from").isNotNull() & F.col("date_to").isNotNull())
    # One row per group for its points and one per calendar year, so no row holds more than a year of empty buckets.
    start = dates.bucket(F.col("date_from"), interval)
    points, year = F.col("_points").alias("points"), F.lit(None).cast("int").alias("year")
    per_year = F.transform(
        F.sequence(F.year(start), F.year("date_to")), lambda y: F.struct(F.lit(None).cast(per_group.schema["_points"].dataType).alias("points"), y.alias("year"))
    )
    blocks = per_group.filter(start <= F.col("date_to")).select(
        *keys, "date_from", "date_to", "excluded_count", F.explode(F.concat(F.array(F.struct(points, year)), per_year)).alias("_b")
    )
    empty = F.transform(
        dates.calendar_of_year(F.col("date_from"), F.col("date_to"), F.col("_b.year"), interval),
        lambda c: F.struct(c.alias("period"), *[F.lit(0).cast("bigint").alias(f) for f in figures]),
    )
    padded = blocks.select(*keys, "date_from", "date_to", "excluded_count", F.explode(F.coalesce("_b.points", empty)).alias("_p"))
    series = padded.groupBy(*keys, "date_from", "date_to", "excluded_count", F.col("_p.period").alias("period")).agg(
        *[F.sum(f"_p.{f}").alias(f) for f in figures]
    )
    last = F.date_sub(dates.next_bucket(F.col("period"), interval), 1)
    return with_ratios(series.withColumn("period_end", F.least("date_to", last)))


def trend_average(series: DataFrame, keys=REPORT) -> DataFrame:
    return series.groupBy(*keys).agg(F.avg("count").alias("average_count"), F.count("*").alias("points"))


def channels(items: DataFrame, by: str = "channel", keys=REPORT) -> DataFrame:
    label = S.channel() if by == "channel" else F.col("source")
    out = items.groupBy(*keys, "source", label.alias("channel_label")).agg(
        F.count("*").alias("sample_count"),
        *sentiment_counts(),
        F.count_distinct(thread_key()).alias("thread_count"),
        F.min_by(F.struct("board"), "ordinal")["board"].alias("board"),
    )
    return with_ratios(out)


def sort_channels(rows: DataFrame, sort="sample_count", keys=REPORT) -> DataFrame:
    return rows.orderBy(*keys, F.desc_nulls_last(sort), "source", "channel_label")


def threads(items: DataFrame, keys=REPORT) -> DataFrame:
    """One row per (source, thread): head item, counts, latest day and its precision."""
    rows = items.filter(F.expr("nullif(thread_source_id, '') is not null")).withColumn(
        "_day", dates.local_day(F.col("published_at"))
    )
    head_rank = F.struct((F.col("content_type") != "post").alias("later"), F.col("ordinal"))
    head = F.struct(
        "title", "board", "source_url", F.substring(F.coalesce("text", F.lit("")), 1, C.EXCERPT_CHARS).alias("excerpt")
    )
    latest = F.when(F.col("_day").isNotNull(), F.struct((-F.unix_date("_day")).alias("d"), F.col("id")))
    out = rows.groupBy(*keys, "source", "thread_source_id").agg(
        F.min_by(head, head_rank).alias("_head"),
        F.count("*").alias("collected_count"),
        F.max("reply_count").alias("reported_reply_count"),
        F.max("_day").alias("latest_date"),
        F.coalesce(F.min_by("date_precision", latest), F.lit("unknown")).alias("date_precision"),
    )
    return out.select(
        *keys,
        "source",
        "thread_source_id",
        F.col("_head.title").alias("title"),
        "collected_count",
        "reported_reply_count",
        "latest_date",
        "date_precision",
        F.col("_head.board").alias("board"),
        identity.safe_url(F.col("_head.source_url")).alias("source_url"),
        F.col("_head.excerpt").alias("excerpt"),
    )


def thread_order(sort="collected_count"):
    return [F.desc_nulls_last(sort), F.col("source"), F.col("thread_source_id")]


def item_order(sort="original"):
    """Sort columns of an item list; dates compare by local day, undated rows last."""
    if sort == "original":
        return [F.col("ordinal")]
    day = dates.local_day(F.col("published_at"))
    first = F.desc_nulls_last(day) if sort == "date_desc" else F.asc_nulls_last(day)
    return [first, F.col("source"), F.col("id")]


def before_after(items: DataFrame, plans: DataFrame, days: int = 28) -> DataFrame:
    """Weekly series of the four weeks before and after each plan's intervention date.

    ``plans``: (plan_id, before, after, intervention), the two report ids being of one subject.
    """
    start = F.col("intervention")
    phases = F.array(
        F.struct(F.lit("before").alias("phase"), F.col("before").alias("report_id"), F.date_sub(start, days).alias("date_from"), F.date_sub(start, 1).alias("date_to")),
        F.struct(F.lit("after").alias("phase"), F.col("after").alias("report_id"), start.alias("date_from"), F.date_add(start, days - 1).alias("date_to")),
    )
    spans = plans.select("plan_id", F.explode(phases).alias("s")).select("plan_id", "s.*")
    # Items are summed by report and day first; plans meet those few rows, never the items themselves.
    day = dates.local_day(F.col("published_at"))
    usable = day.isNotNull() & F.coalesce(F.col("date_precision").isin(*C.ACCEPTED_PRECISION["week"]), F.lit(False))
    daily = items.groupBy("report_id", F.when(usable, day).alias("_at")).agg(F.count("*").alias("count"), *sentiment_counts(), *source_counts())
    inside = F.when(F.col("_at").between(F.col("date_from"), F.col("date_to")), F.col("_at"))
    met = spans.join(daily, "report_id").withColumns({"_day": inside, "_low": F.col("date_from"), "_high": F.col("date_to")})
    per_bucket = met.groupBy("plan_id", "phase", "_low", "_high", dates.bucket(F.col("_day"), "week").alias("period")).agg(
        *[F.sum(f).alias(f) for f in _FIGURES], F.min("_day").alias("_first"), F.max("_day").alias("_last"),
        F.sum(F.when(F.col("_at").isNull(), F.col("count")).otherwise(0)).alias("_excluded"),
    )
    return _series(per_bucket, "week", ("plan_id", "phase"))
