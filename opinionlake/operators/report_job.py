"""From stored items to frozen, labelled reports with topics: one job of named stages that goes on where it stopped.

Each stage writes a table in a folder of its own and then one manifest row; only what the manifest names is read. A job that is started
again with the same folder reads finished stages and runs the others, so an executor or driver that is lost costs one stage. Labels and
vectors that exist are used as they are; only missing ones are made. Reports frozen earlier stay as they are.

An item linked to a report twice counts once; links to missing items give nothing; a report without items keeps its row in ``status``. A text
without a usable vector has no topic and makes its report's status partial.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.functions import values
from opinionlake.operators import labelling, reportagg, topics
from opinionlake.operators import scope as S
from opinionlake.sources import snapshot

LABEL_COLUMNS = ("sentiment", "confidence", "aspects", "negative_aspects", "key_points", "rating_text_conflict", "local_model_id")
_LISTS = ("aspects", "negative_aspects", "key_points")
_LABELS = "report_id string, id string, " + ", ".join(
    f"{c} " + ("array<string>" if c in _LISTS else {"confidence": "double", "rating_text_conflict": "boolean"}.get(c, "string")) for c in LABEL_COLUMNS
)


@dataclass(frozen=True)
class Models:
    """What the job calls: a text encoder, its name, and a sentiment scorer (the word list without one)."""

    encode: Callable[[Column], Column]
    encoder_id: str
    score: Callable[[Column], Column] | None = None


class _Stages:
    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.done = {}
        try:
            # A handful of rows: one per finished stage.
            self.done = {r["stage"]: r["folder"] for r in spark.read.schema("stage string, folder string").parquet(f"{path}/stages").collect()}
        except Exception as error:  # the first run finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise

    def table(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        if stage not in self.done:
            rows, folder = make(), f"{stage}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            self.spark.createDataFrame([(stage, folder)], "stage string, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/stages")
            self.done[stage] = folder
        return self.spark.read.parquet(f"{self.path}/{self.done[stage]}")


def run(
    items: DataFrame, membership: DataFrame, reports: DataFrame, labels: DataFrame, vectors: DataFrame, models: Models, path: str,
    previous: DataFrame | None = None, lineage: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The job's tables: labels, vectors, topics, items (frozen), blocks and status.

    ``items``: stored items by id; ``membership``: (report_id, id, ordinal); ``reports``: (report_id, subject_name); ``labels``: known ones,
    (report_id, id) with ``LABEL_COLUMNS``; ``vectors``: known (id, embedding); ``previous`` and ``lineage`` as in ``topics.match_previous``.
    """
    stages = _Stages(items.sparkSession, path)
    links = membership.select("report_id", "id").distinct()
    labelled = stages.table("labels", lambda: _all_labels(items, links, labels, models.score))

    def of_complaints():
        slim = labelled.select("report_id", "id", "sentiment", "negative_aspects", "key_points")
        return slim.join(items.select("id", "text"), "id").filter(S.complaint()).select("report_id", "id", "key_points", "text")

    complaints = stages.table("complaints", of_complaints)

    def of_vectors():
        # A text that several reports hold is encoded once.
        missing = complaints.groupBy("id").agg(F.first("text").alias("text")).join(vectors.select("id"), "id", "left_anti")
        made = missing.select("id", models.encode("text").alias("embedding"))
        kept = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        return kept.join(complaints.select("id").distinct(), "id", "left_semi").unionByName(made)

    encoded = stages.table("vectors", of_vectors)
    assigned = stages.table("clusters", lambda: topics.cluster(complaints, encoded))

    def of_topics():
        mine = topics.centroids(assigned, encoded, models.encoder_id)
        if previous is None:
            matched = mine.withColumns({"topic_key": F.col("own_key"), "mapping": F.lit("new")})
        else:
            matched = topics.match_previous(mine, previous, lineage)
        return topics.rows(matched, assigned, complaints)

    found = stages.table("topics", of_topics)
    keys = assigned.join(found.select("report_id", "leader", "topic_key"), ["report_id", "leader"]).select("report_id", "id", "topic_key")
    frozen = snapshot.save_once(snapshot.snapshot(items, membership, labelled, reports, keys), reports, f"{path}/snapshot")
    rows = stages.table("blocks", lambda: reportagg.blocks(frozen))
    state = stages.table("status", lambda: _status(complaints, encoded, found, keys, reports))
    return {"labels": labelled, "vectors": encoded, "topics": found, "items": frozen, "blocks": rows, "status": state}


def _all_labels(items: DataFrame, links: DataFrame, labels: DataFrame, score) -> DataFrame:
    known = links.join(labels.select("report_id", "id", *LABEL_COLUMNS), ["report_id", "id"])
    open_ = links.join(labels.select("report_id", "id"), ["report_id", "id"], "left_anti")
    made = labelling.label_items(open_.join(items, "id"), score).withColumns({c: F.array().cast("array<string>") for c in _LISTS})
    typed = [F.col(c).cast(t).alias(c) for c, t in (f.strip().split(" ") for f in _LABELS.split(","))]
    return known.select(*typed).unionByName(made.select(*typed))


def _status(complaints: DataFrame, vectors: DataFrame, found: DataFrame, keys: DataFrame, reports: DataFrame) -> DataFrame:
    """Per report: complaints, those without a usable vector, topics and the rows that have one."""
    usable = vectors.filter(values.finite(F.col("embedding"))).select("id").withColumn("_has", F.lit(True))
    texts = complaints.join(usable, "id", "left").groupBy("report_id").agg(
        F.count(F.lit(1)).alias("complaints"), F.count_if(F.col("_has").isNull()).alias("missing_embeddings")
    )
    counts = found.groupBy("report_id").agg(F.count(F.lit(1)).alias("topics"), F.count_if(F.col("mapping") == "matched").alias("matched_topics"))
    held = keys.groupBy("report_id").agg(F.count(F.lit(1)).alias("topic_items"))
    out = reports.select("report_id").distinct()
    for part in (texts, counts, held):
        out = out.join(part, "report_id", "left")
    out = out.na.fill(0)
    return out.withColumn("status", F.when(F.col("missing_embeddings") > 0, "partial").otherwise("completed"))
