"""Reference checks, ranked fetches and vector search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import values
from opinionlake.operators import ranks
from opinionlake.session import scratch

QUERY_CHUNK = 512
#: Vectors that a task holds while all queries pass by; a partition of so many reads the query files once.
VECTOR_BLOCK = 1 << 16


def missing_results(expected: DataFrame, returned: DataFrame, on, keys) -> DataFrame:
    """Per group: expected keys absent from the result, and those present. Unexpected ones are ignored."""
    got = returned.select(*on).distinct().withColumn("_got", F.lit(True))
    return expected.join(got, on, "left").groupBy(*keys).agg(
        F.count_if(F.col("_got").isNull()).alias("missing"), F.count("_got").alias("accepted")
    )


def reference_check(refs: DataFrame, existing: DataFrame, key: str = "report_id") -> DataFrame:
    """Every reference with whether its target is gone."""
    present = existing.select(key).distinct().withColumn("_here", F.lit(True))
    return refs.join(present, key, "left").withColumn("missing", F.col("_here").isNull()).drop("_here")


def previous_report(reports: DataFrame) -> DataFrame:
    """Latest strictly earlier report of the same subject (ties: the larger id)."""
    moments = reports.groupBy("subject_id", "created_at").agg(F.max("report_id").alias("_report"))
    moments = moments.withColumn("_at", F.unix_micros("created_at"))
    day = 86_400_000_000  # one block per subject and day
    lagged = ranks.block_lag(moments, ["subject_id"], "_at", "_report", "previous", block=day)
    return reports.join(lagged.select("subject_id", "created_at", "previous"), ["subject_id", "created_at"])


def fetch_ranked(ranked: DataFrame, rows: DataFrame, keys=("report_id", "id")) -> DataFrame:
    """Rows of the ranked ids, in rank order."""
    return ranked.join(rows, list(keys)).orderBy("report_id", "position")


def evidence_tasks(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Tasks citing each evidence item."""
    cited = tasks.select("task", "plan", F.explode(F.array_distinct("evidence_ids")).alias("item_id"))
    return cited.join(items, "item_id", "left_semi")


# ---- vectors ------------------------------------------------------------------------------
def valid_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Finite, non-zero vectors, L2-normalised; the rest are counted as missing by callers."""
    return vectors.filter(values.finite(F.col(column))).withColumn(column, values.unit(F.col(column)))


def topk(vectors: DataFrame, query, limit: int = C.RETRIEVAL_LIMIT, keys=(), column: str = "embedding") -> DataFrame:
    """Dot-product top-k of one query vector; other dimensions are skipped."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.size(column) == len(query)).withColumn("score", values.dot(F.col(column), wanted)).drop(column)
    order = [F.desc("score"), F.col("vec_id")]
    if keys:
        return ranks.top_rows(scored, list(keys), order, limit)
    return scored.orderBy(*order).limit(limit)


def batch_topk(vectors: DataFrame, queries: DataFrame, limit: int = C.RETRIEVAL_LIMIT) -> DataFrame:
    """Top-k vectors of every query.

    ``queries`` (query_id, embedding) are written to the shared folder in files of at most ``QUERY_CHUNK``. Each task of the one pass over
    the vectors gathers blocks of ``VECTOR_BLOCK``, multiplies a block by one file's queries after the other and passes on at most ``limit``
    rows per query and block: no pair list is built, the queries are read once a block and none passes through the driver.
    """
    path = scratch(vectors.sparkSession, "queries")
    slim = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    slim.write.option("maxRecordsPerFile", QUERY_CHUNK).parquet(path)
    scored = vectors.select("vec_id", "embedding").mapInPandas(_scorer(path, limit), "query_id bigint, vec_id bigint, score double")
    return ranks.top_rows(scored, ["query_id"], [F.desc("score"), F.col("vec_id")], limit, rank="position")


def _scorer(path: str, limit: int):
    def chunks():
        store, at = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        for file in dataset.dataset(at, filesystem=store, format="parquet", exclude_invalid_files=True).get_fragments():
            table = file.to_table()
            yield table["query_id"].to_numpy(), table["embedding"].to_pylist()

    def blocks(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= VECTOR_BLOCK:
                yield pd.concat(held)
                held, rows = [], 0
        if held:
            yield pd.concat(held)

    def score(batches):
        for batch in blocks(batches):
            by_size = {n: rows.sort_values("vec_id") for n, rows in batch.groupby(batch["embedding"].map(len))}
            for ids, embeddings in chunks():
                sizes = np.array([len(e) for e in embeddings])
                for n in set(sizes.tolist()) & set(by_size):
                    asked = ids[sizes == n]
                    matrix = np.array([e for e in embeddings if len(e) == n], "float64")
                    keys = by_size[n]["vec_id"].to_numpy()
                    scores = matrix @ np.stack(by_size[n]["embedding"].to_numpy()).astype("float64").T
                    # Columns ascend by vec_id, so a stable sort breaks score ties by the smaller id.
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
                    yield pd.DataFrame(
                        {"query_id": np.repeat(asked, best.shape[1]), "vec_id": keys[best].ravel(), "score": np.take_along_axis(scores, best, axis=1).ravel()}
                    )

    return score
