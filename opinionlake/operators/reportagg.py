"""The report aggregate: overall and per-source blocks, threads, points, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import text
from opinionlake.operators import ranks
from opinionlake.operators import scope as S

ALL = "overall"
LABELLED = ("positive", "neutral", "negative", "rating_only")


def blocks(items: DataFrame) -> DataFrame:
    """One row per report plus one per (report, source): a two-set grouping in a single pass."""
    maps = F.col("source") == "google_maps"
    out = items.groupingSets([["report_id"], ["report_id", "source"]], "report_id", "source").agg(
        F.grouping("source").alias("_all"),
        F.count("*").alias("sample_size"),
        F.count_if(F.coalesce("text", F.lit("")) != "").alias("text_count"),
        *[F.count_if(F.col("sentiment") == s).alias(f"{s}_count") for s in LABELLED],
        *[F.count_if(F.col("content_type") == t).alias(f"{t}_count") for t in C.CONTENT_TYPES],
        *[F.count_if(F.col("signal") == s).alias(f"signal_{s}") for s in C.SIGNALS],
        *[F.count_if(maps & (F.col("rating") == r)).alias(f"rating_{r}") for r in range(1, 6)],
        F.count_if(maps & F.col("rating_text_conflict")).alias("conflict_count"),
        F.count_if(F.expr("nullif(sentiment, '') is null")).alias("unlabelled_count"),
    )
    scope = F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col("source"))
    return out.withColumn("block", scope).drop("_all", "source")


def label_status(items: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """no_data / completed / partial per report, with the model ids used (a bounded set).

    ``reports`` lists reports that may hold no item at all.
    """
    out = items.groupBy("report_id").agg(
        F.count("*").alias("_n"),
        F.count_if(F.expr("nullif(sentiment, '') is null")).alias("_open"),
        F.array_join(F.array_sort(F.collect_set("local_model_id")), ",").alias("models"),
    )
    if reports is not None:
        out = reports.select("report_id").join(out, "report_id", "left")
    state = F.when(F.coalesce("_n", F.lit(0)) == 0, "no_data").when(F.col("_open") == 0, "completed").otherwise("partial")
    return out.select("report_id", state.alias("status"), F.coalesce("models", F.lit("")).alias("models"))


def aspect_sentiment(items: DataFrame) -> DataFrame:
    """Aspect x sentiment counts with the aspect label; unlabelled rows count as unknown."""
    labels = F.create_map(*[F.lit(x) for kv in C.ASPECT_LABELS.items() for x in kv])
    exploded = items.select("report_id", S.sentiment().alias("sentiment"), F.explode("aspects").alias("aspect"))
    out = exploded.groupBy("report_id", "aspect").agg(
        *[F.count_if(F.col("sentiment") == s).alias(f"{s}_count") for s in C.SENTIMENTS]
    )
    return out.withColumn("label", F.coalesce(F.try_element_at(labels, F.col("aspect")), F.col("aspect")))


def points(items: DataFrame, k: int = 8) -> DataFrame:
    """Most common stripped key points of positive (praise) and negative (complaint) rows.

    Ties go to the smaller text.
    """
    kind = F.when(F.col("sentiment") == "positive", "praise").when(F.col("sentiment") == "negative", "complaint")
    exploded = items.select("report_id", kind.alias("kind"), F.explode("key_points").alias("point")).filter("kind is not null")
    counted = (
        exploded.withColumn("point", text.strip_blank(F.col("point")))
        .filter("point <> ''")
        .groupBy("report_id", "kind", "point")
        .count()
    )
    return ranks.top_rows(counted, ["report_id", "kind"], [F.desc("count"), F.col("point")], k)


def monthly(items: DataFrame) -> DataFrame:
    """Month x sentiment by the stored (not shifted) month, for day/week/month precision only."""
    dated = items.filter(F.col("published_at").isNotNull() & F.col("date_precision").isin("day", "week", "month"))
    return dated.groupBy(
        "report_id", F.date_format("published_at", "yyyy-MM").alias("month"), S.sentiment().alias("sentiment")
    ).count()


def representatives(items: DataFrame, k: int = 5) -> DataFrame:
    """The k most confident positive and negative rows with text."""
    rows = items.filter(F.col("sentiment").isin("positive", "negative") & (F.coalesce("text", F.lit("")) != ""))
    order = [F.desc(F.coalesce("confidence", F.lit(0.0))), F.col("ordinal")]
    slim = rows.select(
        "report_id", "sentiment", "id", "source", "content_type", "title", "rating",
        F.substring("text", 1, C.EXCERPT_CHARS).alias("text"), "confidence", "ordinal",
    )
    return ranks.top_rows(slim, ["report_id", "sentiment"], order, k, rank="position").drop("ordinal")


def top_threads(items: DataFrame, k: int = 10) -> DataFrame:
    """Threads by interactions, then items; ties by the larger (source, thread, title)."""
    rows = items.filter(F.expr("nullif(thread_source_id, '') is not null"))
    title = F.coalesce(F.expr("nullif(title, '')"), F.lit(C.UNTITLED_THREAD))
    out = rows.groupBy("report_id", "source", "thread_source_id", title.alias("title")).agg(
        F.count("*").alias("item_count"),
        F.sum(F.coalesce("reaction_count", F.lit(0))).alias("interaction_count"),
        F.max_by(F.struct("source_url", "board"), "ordinal").alias("_last"),
    )
    order = [F.desc(c) for c in ("interaction_count", "item_count", "source", "thread_source_id", "title")]
    top = ranks.top_rows(out, ["report_id"], order, k)
    return top.select("*", F.col("_last.source_url").alias("source_url"), F.col("_last.board").alias("board")).drop("_last")


def headline(block_rows: DataFrame, aspects: DataFrame) -> DataFrame:
    """Positive/negative share over all labelled rows, the worst aspect, samples per source."""
    whole = block_rows.filter(F.col("block") == ALL)
    labelled = F.greatest(sum(F.col(f"{s}_count") for s in LABELLED), F.lit(1))
    worst = aspects.groupBy("report_id").agg(
        F.min_by("label", F.struct((-F.col("negative_count")).alias("n"), F.col("aspect"))).alias("top_issue")
    )
    sizes = block_rows.filter(F.col("block") != ALL).groupBy("report_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "block", F.col("sample_size").cast("string")))), ",").alias("source_sizes")
    )
    return (
        whole.join(worst, "report_id", "left").join(sizes, "report_id", "left").select(
            "report_id",
            "sample_size",
            (F.col("positive_count") / labelled).alias("positive_share"),
            (F.col("negative_count") / labelled).alias("negative_share"),
            F.coalesce("top_issue", F.lit(C.NO_ASPECT_LABEL)).alias("top_issue"),
            "source_sizes",
        )
    )
