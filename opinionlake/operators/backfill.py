"""Upgrades of older table layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake.functions.text import casefold, strip_blank
from opinionlake.operators import ranks

CURRENT_LAYOUTS = (2, 3, 4)


def report_layout(reports: DataFrame) -> DataFrame:
    """Flat version-1 reports to the current layout; newer ones pass through.

    Old rows get one map-review source block, a collection record and empty lists.
    """
    current = F.coalesce(F.col("schema_version").isin(*CURRENT_LAYOUTS), F.lit(False))
    size = F.coalesce("sample_size", F.lit(0))
    complete = F.coalesce("complete", F.lit(True))
    old = lambda new, kept: F.when(current, F.col(kept)).otherwise(new)
    return reports.select(
        "report_id",
        F.when(current, F.col("schema_version")).otherwise(2).cast("bigint").alias("schema_version"),
        old(size, "sample_size").alias("overall_size"),
        old(F.coalesce("text_count", F.lit(0)), "text_count").alias("overall_texts"),
        old(size, "maps_size").alias("maps_size"),
        old(F.coalesce("target_count", size), "target_count").alias("target_count"),
        old(F.coalesce("actual_count", size), "actual_count").alias("actual_count"),
        old(complete, "complete").alias("complete"),
        old(F.when(complete, "COMPLETE").otherwise("PARTIAL"), "maps_status").alias("maps_status"),
        old(F.coalesce("stop_reason", F.lit("legacy_report")), "stop_reason").alias("stop_reason"),
        old(F.coalesce("summary", F.lit("舊版報告未提供管理摘要。")), "summary").alias("summary"),
    )


def membership(jobs: DataFrame, items: DataFrame, reports: DataFrame, block: int = ranks.BLOCK) -> DataFrame:
    """Rebuild (job, item) links: the only job of a subject owns all its items; reports add theirs.

    ``items`` carries a unique integer ``order_no`` following (collected time, id). Items named only
    by a report come after the owned ones, in list order.
    """
    single = jobs.groupBy("subject_id").agg(F.count("*").alias("_n"), F.min("job_id").alias("job_id")).filter("_n = 1")
    owned = items.join(single, "subject_id").select("job_id", "item_id", F.lit(0).alias("_part"), F.col("order_no").alias("_at"))
    listed = reports.select("job_id", F.posexplode("item_ids").alias("_at", "item_id"))
    listed = listed.select("job_id", "item_id", F.lit(1).alias("_part"), F.col("_at").cast("bigint").alias("_at"))
    # One bigint keeps both parts in order: owned rows first, listed rows after them.
    place = F.col("_part").cast("bigint") * F.lit(1 << 62) + F.col("_at")
    links = owned.unionByName(listed).withColumn("_place", place).groupBy("job_id", "item_id").agg(F.min("_place").alias("_place"))
    return ranks.block_rank(links, ["job_id"], "_place", "ordinal", block).select("job_id", "item_id", "ordinal")


def fan_out_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Item labels copied to every job holding the item."""
    return labels.join(links.select("job_id", "item_id"), "item_id")


def merge_vectors(versions: DataFrame, old: DataFrame) -> DataFrame:
    """Old vectors fill (item, model) pairs that have none; one vector per pair remains."""
    fresh = old.join(versions.select("item_id", "model_id"), ["item_id", "model_id"], "left_anti")
    one = fresh.groupBy("item_id", "model_id").agg(F.min_by("vector", "row_no").alias("vector"))
    return versions.select("item_id", "model_id", "vector").unionByName(one.select("item_id", "model_id", "vector"))


def subject_keys(subjects: DataFrame) -> DataFrame:
    """Fill missing keys; a key already taken is re-hashed together with the subject's id."""
    folded = [casefold(strip_blank(F.coalesce(c, F.lit("")))) for c in (F.lit("business"), F.col("name"), F.col("address"))]
    plain = F.concat_ws("|", *folded)
    df = subjects.withColumn("_plain", plain).withColumn("_key", F.sha2("_plain", 256))
    taken = df.filter("subject_key is not null").select(F.col("subject_key").alias("_key")).distinct().withColumn("_taken", F.lit(True))
    firsts = df.filter("subject_key is null").groupBy("_key").agg(F.min("subject_id").alias("_first"))
    joined = df.join(taken, "_key", "left").join(firsts, "_key", "left")
    free = F.col("_taken").isNull() & (F.col("subject_id") == F.col("_first"))
    salted = F.sha2(F.concat_ws("|", "_plain", F.col("subject_id").cast("string")), 256)
    return joined.withColumn("subject_key", F.coalesce("subject_key", F.when(free, F.col("_key")).otherwise(salted))).select(*subjects.columns)


def source_item_ids(items: DataFrame) -> DataFrame:
    return items.withColumn("source_item_id", F.coalesce("source_item_id", "source_review_id"))


def job_sources(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """One map-review source row per job that has none, with the status rule of old jobs."""
    fresh = jobs.join(existing.filter("source = 'google_maps'").select("job_id"), "job_id", "left_anti")
    status = (
        F.when(F.col("status").isin("COLLECTING", "PENDING_COLLECTION", "WAITING_FOR_USER"), "PENDING")
        .when(F.col("collection_complete"), "COMPLETE")
        .when(F.col("collected_count") > 0, "PARTIAL")
        .when(F.col("status") == "FAILED", "FAILED")
        .otherwise("PENDING")
    )
    return fresh.select(
        "job_id", F.lit("google_maps").alias("source"), status.alias("source_status"), F.col("collected_count").alias("collected"),
        F.col("max_reviews").alias("target_count"), F.col("collection_complete").alias("complete"),
    )


def job_status(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Old job states in today's terms, by report existence and collected rows."""
    reported = reports.select("job_id").distinct().withColumn("_reported", F.lit(True))
    df = jobs.join(reported, "job_id", "left")
    has_report = F.col("_reported").isNotNull()
    waiting = F.col("status").isin("PENDING", "SEARCHING", "WAITING_SELECTION")
    broken = F.col("status").isin("CRAWLING", "INTERRUPTED", "BLOCKED", "FAILED", "PARTIAL") & (F.col("collected_count") > 0) & ~has_report
    status = F.when(waiting, "PENDING_COLLECTION").when(broken, "COLLECTION_INTERRUPTED").otherwise(F.col("status"))
    return df.select(
        "job_id",
        status.alias("status"),
        F.when(has_report, True).when(broken, False).otherwise(F.col("collection_complete")).alias("collection_complete"),
        F.when(broken, "legacy_interrupted").otherwise(F.col("stop_reason")).alias("stop_reason"),
        F.when(has_report, "REPORTING").when(broken, None).otherwise(F.col("last_stage")).alias("last_stage"),
    )

