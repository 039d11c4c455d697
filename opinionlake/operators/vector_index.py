"""Exact vector search through cells: vectors lie by their nearest pivot, cells that cannot hold a result are left out.

A cell knows its largest angle to the pivot and its smallest and largest norm. A query at angle t to the pivot scores at most
|q| * norm * cos(max(0, t - largest angle)) in it. Each query first searches the cells of the highest bounds that together hold
``limit`` vectors; the last of these scores is a floor, and only cells whose bound reaches it are searched after that. Results are
those of a full scan. Pivots are at most ``PIVOTS`` sampled vectors a dimension: whatever they are, only the share left out changes.

A cell with a third of all vectors is spread by ranges of its ids' hashes. Null and empty vectors are not indexed; a query without
a vector of its dimension has no results; cells with values that are not finite are never left out; equal scores go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import values
from opinionlake.operators import ranks
from opinionlake.operators.retrieval import QUERY_CHUNK, VECTOR_BLOCK
from opinionlake.session import scratch, stored

PIVOTS = 256
#: Slack of angles and bounds, far above the rounding of doubles.
SLACK = 1e-6


# ---- build --------------------------------------------------------------------------------
def build(vectors: DataFrame, path: str | None = None, pivots: int = PIVOTS) -> str:
    """Writes the index of (vec_id, embedding) and gives its folder, which any number of searches may use."""
    path = path or scratch(vectors.sparkSession, "vector-index")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("dim", F.size("embedding")).filter("dim > 0")
    sample = ranks.top_rows(rows.filter(values.finite(F.col("embedding"))), ["dim"], [F.xxhash64("vec_id"), F.col("vec_id")], 4 * pivots)
    # Copies give one pivot.
    few = ranks.top_rows(sample.groupBy("dim", "embedding").agg(F.min("vec_id").alias("vec_id")), ["dim"], [F.xxhash64("vec_id"), F.col("vec_id")], pivots, rank="_cell")
    few.select("dim", (F.col("_cell") - 1).alias("cell"), "embedding").coalesce(1).write.parquet(f"{path}/pivots")

    def assign(batches):
        pivot = _Pivots(path)
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                matrix = np.stack(part["embedding"].to_numpy())
                with np.errstate(invalid="ignore"):
                    norm = np.sqrt((matrix * matrix).sum(axis=1))
                    cell, angle = pivot.nearest(matrix, norm, dim)
                yield part.assign(cell=cell, angle=angle, norm=np.where(np.isnan(norm), np.inf, norm))

    placed = rows.mapInPandas(assign, "vec_id bigint, embedding array<double>, dim int, cell int, angle double, norm double")
    spread = placed.repartitionByRange(F.col("dim"), F.col("cell"), F.xxhash64("vec_id")).sortWithinPartitions("dim", "cell")
    spread.write.partitionBy("dim", "cell").parquet(f"{path}/cells")
    cells = _cells(vectors.sparkSession, path)
    stats = cells.groupBy("dim", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("norm").alias("low"), F.max("norm").alias("high")
    )
    stats.coalesce(1).write.parquet(f"{path}/stats")
    return path


def _cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id bigint, embedding array<double>, angle double, norm double, dim int, cell int").parquet(f"{path}/cells")


def _files(path: str):
    store, at = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    for file in dataset.dataset(at, filesystem=store, format="parquet", exclude_invalid_files=True).get_fragments():
        yield file.to_table().to_pandas()


class _Pivots:
    """Unit pivots of each dimension; the first axis where none was sampled."""

    def __init__(self, path: str):
        self.by_dim = {}
        for table in _files(f"{path}/pivots"):
            for dim, part in table.groupby("dim"):
                matrix = np.stack(part.sort_values("cell")["embedding"].to_numpy())
                norm = np.sqrt((matrix * matrix).sum(axis=1))
                if (norm > 0).any():
                    self.by_dim[dim] = matrix[norm > 0] / norm[norm > 0, None]

    def of(self, dim: int) -> np.ndarray:
        return self.by_dim.get(dim, np.eye(1, dim))

    def angles(self, matrix: np.ndarray, norm: np.ndarray, dim: int) -> np.ndarray:
        """Angle of each row to each pivot; zero vectors have angle zero, which their norm makes right."""
        cosine = (matrix / np.where(norm > 0, norm, 1)[:, None]) @ self.of(dim).T
        return np.where((norm > 0)[:, None], np.arccos(np.clip(cosine, -1, 1)), 0.0)

    def nearest(self, matrix: np.ndarray, norm: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        angles = self.angles(matrix, norm, dim)
        angles = np.where(np.isnan(angles) | ~np.isfinite(norm)[:, None], np.pi, angles)
        cell = angles.argmin(axis=1)
        return cell.astype("int32"), angles[np.arange(len(cell)), cell]


class _Cells:
    """Cells of each dimension, with bounds of what a query can score in them."""

    def __init__(self, path: str):
        self.pivots = _Pivots(path)
        tables = list(_files(f"{path}/stats"))
        stats = pd.concat(tables) if tables else pd.DataFrame({"dim": [], "cell": []})
        self.by_dim = {dim: part.sort_values("cell").reset_index(drop=True) for dim, part in stats.groupby("dim")}

    def bounds(self, matrix: np.ndarray, dim: int) -> np.ndarray:
        stats = self.by_dim[dim]
        norm = np.sqrt((matrix * matrix).sum(axis=1))
        angles = self.pivots.angles(matrix, norm, dim)[:, stats["cell"].to_numpy()]
        cosine = np.cos(np.clip(angles - stats["angle"].to_numpy() - SLACK, 0, np.pi))
        low, high = stats["low"].to_numpy(), stats["high"].to_numpy()
        with np.errstate(invalid="ignore"):
            bound = norm[:, None] * np.where(cosine > 0, cosine * high, cosine * low)
            return np.where(np.isfinite(bound), bound + SLACK * norm[:, None] * high, np.inf)

    def homes(self, bounds: np.ndarray, dim: int, limit: int) -> np.ndarray:
        """The cells of highest bounds up to the one that makes ``limit`` vectors full."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        count = self.by_dim[dim]["n"].to_numpy()[order]
        chosen = (np.cumsum(count, axis=1) - count) < limit
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, chosen, axis=1)
        return out

    def wanted(self, matrix: np.ndarray, floors: np.ndarray | None, dim: int, limit: int) -> np.ndarray:
        """Which cells each query searches: its homes without a floor, else the others that can reach it."""
        bounds = self.bounds(matrix, dim)
        homes = self.homes(bounds, dim, limit)
        return homes if floors is None else ~homes & ~(bounds < floors[:, None])


def _by_dim(table: pd.DataFrame):
    """(dimension, ids, matrix, floors or None) of queries."""
    table = table[table["embedding"].notna()]
    for dim, part in table.groupby(table["embedding"].map(len)):
        if dim > 0:
            yield dim, part["query_id"].to_numpy(), np.stack(part["embedding"].to_numpy()), part["floor"].to_numpy() if "floor" in part else None


# ---- search -------------------------------------------------------------------------------
def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = C.RETRIEVAL_LIMIT) -> DataFrame:
    """(query_id, vec_id, score, position): the ``limit`` highest dot products of every query (query_id, embedding)."""
    firsts, asked = _first_pass(spark, path, queries, limit)
    rest = _pass(spark, path, asked, limit)
    return ranks.top_rows(firsts.unionByName(rest), ["query_id"], [F.desc("score"), F.col("vec_id")], limit, rank="position")


def searched(spark: SparkSession, path: str, queries: DataFrame, limit: int = C.RETRIEVAL_LIMIT) -> DataFrame:
    """(query_id, n_vectors, n_scored): vectors of the query's dimension, and those in the cells that its search reads."""
    _, asked = _first_pass(spark, path, queries, limit)

    def count(batches):
        cells = _Cells(path)
        for batch in batches:
            for dim, ids, matrix, floors in _by_dim(batch):
                if dim in cells.by_dim:
                    n = cells.by_dim[dim]["n"].to_numpy()
                    read = cells.wanted(matrix, None, dim, limit) | cells.wanted(matrix, floors, dim, limit)
                    yield pd.DataFrame({"query_id": ids, "n_vectors": n.sum(), "n_scored": read @ n})

    return spark.read.parquet(asked).mapInPandas(count, "query_id bigint, n_vectors bigint, n_scored bigint")


def _first_pass(spark: SparkSession, path: str, queries: DataFrame, limit: int) -> tuple[DataFrame, str]:
    """Results of the home cells, and the folder of the queries with their floors."""
    slim = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = scratch(spark, "queries")
    slim.write.option("maxRecordsPerFile", QUERY_CHUNK).parquet(asked)
    found = _pass(spark, path, asked, limit)
    firsts = stored(ranks.top_rows(found, ["query_id"], [F.desc("score"), F.col("vec_id")], limit), "first-results")
    floors = firsts.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= limit, F.min("score")).alias("floor"))
    again = scratch(spark, "queries")
    with_floor = spark.read.schema(slim.schema).parquet(asked).join(floors, "query_id", "left")
    with_floor.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).write.option("maxRecordsPerFile", QUERY_CHUNK).parquet(again)
    return firsts, again


def _pass(spark: SparkSession, path: str, asked: str, limit: int) -> DataFrame:
    """One pass over the cells that some query wants; at most ``limit`` rows a query leave each block."""

    def named(batches):
        cells = _Cells(path)
        for batch in batches:
            for dim, _, matrix, floors in _by_dim(batch):
                if dim in cells.by_dim:
                    some = cells.wanted(matrix, floors, dim, limit).any(axis=0)
                    yield pd.DataFrame({"dim": dim, "cell": cells.by_dim[dim]["cell"].to_numpy()[some]})

    # At most PIVOTS numbers a dimension, whatever the number of queries and vectors.
    wanted = spark.read.parquet(asked).mapInPandas(named, "dim int, cell int").groupBy("dim").agg(F.collect_set("cell").alias("cells")).collect()
    rows, keep = _cells(spark, path), F.lit(False)
    for w in wanted:
        keep = keep | ((F.col("dim") == w["dim"]) & F.col("cell").isin(w["cells"]))
    return rows.filter(keep).select("vec_id", "embedding", "dim", "cell").mapInPandas(_scorer(path, asked, limit), "query_id bigint, vec_id bigint, score double")


def _scorer(path: str, asked: str, limit: int):
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
        cells = _Cells(path)
        for block in blocks(batches):
            groups = {key: (part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy())) for key, part in block.sort_values("vec_id").groupby(["dim", "cell"])}
            for table in _files(asked):
                for dim, ids, matrix, floors in _by_dim(table):
                    if dim in cells.by_dim:
                        mask = dict(zip(cells.by_dim[dim]["cell"], cells.wanted(matrix, floors, dim, limit).T))
                        parts = [_best(ids, matrix, mask[cell], *group, limit) for (d, cell), group in groups.items() if d == dim and mask[cell].any()]
                        if parts:
                            both = pd.concat(parts).sort_values(["score", "vec_id"], ascending=[False, True])
                            yield both.groupby("query_id").head(limit)

    return score


def _best(ids, matrix, mask, keys, vectors, limit: int) -> pd.DataFrame:
    """The highest scores of the queries in ``mask`` in one cell; vectors ascend by id, so equal scores go to the smaller."""
    scores = matrix[mask] @ vectors.T
    best = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
    return pd.DataFrame({"query_id": np.repeat(ids[mask], best.shape[1]), "vec_id": keys[best].ravel(), "score": np.take_along_axis(scores, best, axis=1).ravel()})
