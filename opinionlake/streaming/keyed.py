"""A keyed last-value table for streams, of which a micro-batch touches only what its keys may hit.

The table is a set of runs. Each micro-batch adds one run with the keys it changed; ``FAN`` runs of one level are
merged to a run of the next, so a key is rewritten once a level and never by a batch that merely comes later. A run is
cut into hash buckets of about ``bucket_rows`` keys, hence large runs have many buckets and a small batch reads few of
them. Which runs count after batch n stands in the manifest of batch n, written last: a batch that is replayed sees the
runs of the manifest before its own and overwrites what it wrote itself.

Null keys are keys like any other and equal each other. A batch without rows leaves the table as it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 8
#: Buckets of one run at most: as many numbers as a look-up may bring to the driver. Larger runs have larger buckets.
MAX_BUCKETS = 1 << 14
#: Manifests of so many batches share a folder, so that finding the newest lists one folder, not all.
ERA = 1000

_MANIFEST = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "last", "level", "buckets", "rows")])


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    level: int
    buckets: int
    rows: int


@dataclass(frozen=True)
class KeyedTable:
    path: str
    keys: tuple[T.StructField, ...]
    values: tuple[T.StructField, ...] = ()
    bucket_rows: int = 1 << 20

    # ---- runs ---------------------------------------------------------------------------
    def runs(self, spark: SparkSession, batch_id: int) -> list[Run] | None:
        """The runs that count for batch ``batch_id``: those of the newest manifest before it. None: there is no manifest."""
        era = batch_id // ERA
        for place in (f"era={era}", f"era={era - 1}", "era=*"):
            try:
                found = spark.read.schema(_MANIFEST).option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest/{place}/batch=*")
            except Exception as error:
                if "PATH_NOT_FOUND" in str(error):
                    continue
                raise
            found = found.filter(F.col("batch") < batch_id)
            newest = found.agg(F.max("batch")).first()[0]  # of a partition column; batches may be missing in between
            if newest is not None:
                rows = found.filter(F.col("batch") == newest).filter("first is not null").collect()  # FAN runs a level
                return sorted((Run(r["first"], r["last"], r["level"], r["buckets"], r["rows"]) for r in rows), key=lambda r: r.first)
        return None

    def _publish(self, spark: SparkSession, runs: list[Run], batch_id: int) -> None:
        rows = [(r.first, r.last, r.level, r.buckets, r.rows) for r in runs] or [(None,) * len(_MANIFEST)]
        listed = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.path}/manifest/era={batch_id // ERA}/batch={batch_id}")

    def _place(self, run: Run) -> str:
        return f"{self.path}/runs/{run.first}-{run.last}"

    def _names(self, fields) -> list[str]:
        return [f.name for f in fields]

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self._names(self.keys)]), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, run: Run) -> None:
        cut = rows.select(*self._names(self.keys), *self._names(self.values)).withColumn("_bucket", self._bucket(run.buckets))
        ordered = cut.repartition(min(run.buckets, 2000), "_bucket").sortWithinPartitions("_bucket", *self._names(self.keys))
        ordered.write.mode("overwrite").partitionBy("_bucket").parquet(self._place(run))

    def _read(self, spark: SparkSession, run: Run) -> DataFrame:
        schema = T.StructType([*self.keys, *self.values, T.StructField("_bucket", T.IntegerType())])
        return spark.read.schema(schema).parquet(self._place(run)).withColumn("_last", F.lit(run.last))

    def _sized(self, run: Run) -> Run:
        return replace(run, buckets=min(MAX_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, run.rows / self.bucket_rows))))))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, of the latest run; a key stands once in a run, so in a group at most once per run."""
        keys, values = self._names(self.keys), self._names(self.values)
        if not values:
            return rows.select(*keys).distinct()
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_last").alias("_v")).select(*keys, "_v.*")

    # ---- look-up ------------------------------------------------------------------------
    def touched(self, runs: list[Run], wanted: DataFrame) -> DataFrame | None:
        """All rows of the buckets that may hold a wanted key. The bucket numbers are collected: at most ``MAX_BUCKETS`` a run."""
        if not runs:
            return None
        spark, parts = wanted.sparkSession, []
        sizes = sorted({r.buckets for r in runs})
        marks = F.array(*[F.struct(F.lit(n).alias("buckets"), self._bucket(n).alias("bucket")) for n in sizes])
        hit = wanted.select(F.explode(marks).alias("m")).select("m.*").distinct().collect()
        for run in runs:
            numbers = [h["bucket"] for h in hit if h["buckets"] == run.buckets]
            parts.append(self._read(spark, run).filter(F.col("_bucket").isin(numbers)))
        return reduce(DataFrame.unionByName, parts)

    def lookup(self, runs: list[Run], wanted: DataFrame) -> DataFrame:
        """The last value of each wanted key that the table knows."""
        keys = self._names(self.keys)
        rows = self.touched(runs, wanted)
        if rows is None:
            return wanted.sparkSession.createDataFrame([], T.StructType([*self.keys, *self.values]))
        asked = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys])
        return self._newest(rows.join(asked, same, "left_semi"))

    # ---- changes ------------------------------------------------------------------------
    def put(self, runs: list[Run], rows: DataFrame, count: int, batch_id: int) -> None:
        """Add ``count`` rows, one per key, as the run of the batch; merge levels that are full, among earlier runs only."""
        spark = rows.sparkSession
        kept = self._merged(spark, runs)
        if count:
            run = self._sized(Run(batch_id, batch_id, 0, 1, count))
            self._write(rows, run)
            kept = [*kept, run]
        self._publish(spark, kept, batch_id)

    def _merged(self, spark: SparkSession, runs: list[Run]) -> list[Run]:
        level = 0
        while any(r.level >= level for r in runs):
            full = [r for r in runs if r.level == level]
            if len(full) >= FAN:
                rows = self._newest(reduce(DataFrame.unionByName, [self._read(spark, r) for r in full]))
                run = self._sized(Run(full[0].first, full[-1].last, level + 1, 1, sum(r.rows for r in full)))
                self._write(rows, run)
                count = self._read(spark, run).count()  # from the files' footers
                runs = sorted([r for r in runs if r.level != level] + [replace(run, rows=count)], key=lambda r: r.first)
            level += 1
        return runs
