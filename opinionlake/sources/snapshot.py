"""Report snapshots: the canonical item scan, written once and never changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.functions import identity, text, values

MASKED = ("title", "text", "owner_reply")


def snapshot(items: DataFrame, membership: DataFrame, labels: DataFrame, reports: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Items of every report with the labels of the same job, masked and whitelisted.

    ``membership``: (report_id, id, ordinal); ``items``: one row per id; ``labels``: (report_id, id, ...); ``reports``:
    (report_id, subject_name). Repeated links of an item keep the first place. Links are made unique and labelled as slim rows, and
    each item is masked once, however many reports hold it, before texts move to their links. ``topics``: (report_id, id, topic_key), an
    item's topics in the report; its distinct keys become ``topic_keys``.
    """
    empty = F.array().cast("array<string>")
    links = membership.groupBy("report_id", "id").agg(F.min("ordinal").alias("ordinal"))
    links = links.join(labels, ["report_id", "id"], "left").join(reports, "report_id", "left")
    if topics is not None:
        keys = topics.groupBy("report_id", "id").agg(F.array_sort(F.collect_set("topic_key")).alias("topic_keys"))
        links = links.join(keys, ["report_id", "id"], "left")
    else:
        links = links.withColumn("topic_keys", empty)
    clean = items
    for column in MASKED:
        if column in clean.columns:
            missing = F.coalesce(F.col(column), F.lit("")) == ""
            clean = text.add_masked(clean.withColumn("_none", missing), column, long=column == "text")
            # A missing title or reply stays missing; a missing text is an empty text.
            if column != "text":
                clean = clean.withColumn(column, F.when(~F.col("_none"), F.col(column)))
            clean = clean.drop("_none")
    clean = clean.withColumns(
        {"source_url": identity.safe_url(F.col("source_url")), "metrics": values.metrics(F.col("metrics")), "signal": values.signal(F.col("signal"))}
    )
    return links.join(clean, "id").withColumns(
        {
            "channel_label": F.when(F.col("source") == "google_maps", F.col("subject_name")).otherwise(F.col("board")),
            "aspects": F.coalesce("aspects", empty),
            "negative_aspects": F.coalesce("negative_aspects", empty),
            "rating_text_conflict": F.coalesce("rating_text_conflict", F.lit(False)),
            "topic_keys": F.coalesce("topic_keys", empty),
        }
    ).drop("subject_name")


def save_once(rows: DataFrame, reports: DataFrame, path: str) -> DataFrame:
    """Freeze reports that have no snapshot yet; existing ones stay untouched, empty ones included.

    Item files of a run become visible only through the manifest written after them, so a run that
    dies half-way leaves nothing behind that a reader would see. Files are range-partitioned by
    (report_id, ordinal): a report is found by file statistics and a huge one spans many files.
    """
    spark = rows.sparkSession
    wanted = reports.select("report_id").distinct()
    known = read_manifest(spark, path)
    if known is not None:
        wanted = wanted.join(known.select("report_id"), "report_id", "left_anti")
    run = uuid.uuid4().hex
    fresh = rows.join(wanted, "report_id", "left_semi")
    fresh.repartitionByRange("report_id", "ordinal").sortWithinPartitions("report_id", "ordinal").write.parquet(f"{path}/items/run={run}")
    wanted.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/manifest")
    return read(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/manifest")
    except Exception as error:  # the first run finds no table
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read(spark: SparkSession, path: str) -> DataFrame:
    """All frozen items; the run column prunes directories, the manifest hides unfinished runs."""
    items = spark.read.option("basePath", f"{path}/items").parquet(f"{path}/items")
    return items.join(read_manifest(spark, path), ["report_id", "run"]).drop("run")
