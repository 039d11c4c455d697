"""Near copies by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Texts with equal shingle sets share a key and are one member. Two members are compared when they share one of ``BANDS`` buckets, each keyed by
``ROWS`` minima of the set's hashes: at similarity s they do with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8 and more above. Inside a bucket
the bit-sliced search over five-word SimHash fingerprints names the pairs within ``RADIUS`` bits (0.8 means about 10 on average), and a pair is linked
only if the exact similarity of the two sets of 64-bit shingle hashes reaches the threshold.

Large groups are settled in proportion to their size first: each member is checked against one leader of a bucket slot of about ``SLOT``
members, and slot leaders against the bucket's. Buckets whose members are all in one component are done. In the others the members outside the largest component are compared with
all, in cells of no more than ``CELL`` of each, so a large group with one stray in its bucket is passed once. A component is linked through chains. Shingle sets are made only for members of shared buckets.

Null and wordless texts have the empty set and are one group. Repeated rows and null ids are treated as by ``simhash.dedup``; all columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.llm import simhash
from opinionlake.llm.common import written
from opinionlake.llm.components import components

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 26
BANDS, ROWS = 20, 5
SLOT, CELL = 64, 512
_PART = 4096
_random = np.random.default_rng(simhash.SEED)
_TIMES = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    chunks = list(simhash.hashes(text, n))
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, "<u8")


def bands(found: np.ndarray) -> list[int]:
    """A bucket of each band; of an empty set none."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _PART):
        # The low bits of a product depend on low bits only; the minimum is decided by the high ones.
        least = np.minimum(least, (_TIMES[:, None] * found[None, at : at + _PART] + _PLUS[:, None]).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


@F.pandas_udf(T.StructType().add("key", T.LongType()).add("fp", T.LongType()).add("buckets", T.ArrayType(T.LongType())))
def _described(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        keys, prints, buckets = [], [], []
        for t in batch:
            found = shingle_set(t if isinstance(t, str) else None)
            keys.append(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED))
            prints.append(simhash.majority([found]))
            buckets.append(_signed(bands(found)))
        yield pd.DataFrame({"key": _signed(keys), "fp": _signed(prints), "buckets": buckets})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingle_set(t if isinstance(t, str) else None).view(np.int64) for t in batch])


def _scaled(similarity: float) -> int:
    return round(similarity * 1_000_000)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets are as similar as that; in whole numbers."""
    scaled = _scaled(similarity)
    if min(len(a), len(b)) * 1_000_000 < scaled * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared * 1_000_000 >= scaled * (len(both) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that reach the similarity."""
    one = sets.select(F.col("key").alias("_u"), F.col("found").alias("_a"))
    two = sets.select(F.col("key").alias("_v"), F.col("found").alias("_b"))
    met = pairs.join(one, F.col("u") == F.col("_u")).join(two, F.col("v") == F.col("_v"))
    shared = F.size(F.array_intersect("_a", "_b")).cast("bigint")
    counted = met.select("u", "v", shared.alias("_m"), (F.size("_a") + F.size("_b")).cast("bigint").alias("_n"))
    return counted.filter(F.col("_m") * 1_000_000 >= (F.col("_n") - F.col("_m")) * _scaled(similarity)).select("u", "v")


def _compare(similarity: float, radius: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        prints, keys, found = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["key"].tolist(), rows["found"].tolist()
        stray = rows["stray"].to_numpy(bool)
        _, label = np.unique(rows["root"].to_numpy(np.int64), return_inverse=True)
        out = []
        for i, j in simhash.near(np.zeros(len(rows), np.int64), prints, radius):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if stray[a] != stray[b] and label[a] != label[b] and alike(found[a], found[b], similarity):
                    out.append((keys[a], keys[b]))
                    label[label == label[a]] = label[b]
            if (label == label[0]).all():
                break
        return pd.DataFrame(out, columns=["u", "v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            for cell, rows in batch.groupby(["bucket", "lo", "hi"], sort=False):
                if held and cell != last:
                    yield links(pd.concat(held))
                    held = []
                held.append(rows)
                last = cell
        if held:
            yield links(pd.concat(held))

    return run


def rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(_id, _hash, root) of every row: rows of one group of near copies share ``root``."""
    text_column, ident = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    slim = docs.select(ident.alias("_id"), F.xxhash64(text_column).alias("_hash"), _described(text_column).alias("_d"))
    slim = written(slim.select("_id", "_hash", "_d.*"), "described")
    distinct = slim.groupBy("key").agg(F.first("buckets").alias("buckets"))
    banded = distinct.select("key", F.explode("buckets").alias("bucket"))
    # Of buckets with the same members one is enough.
    sizes = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.bit_xor(F.xxhash64("key")).alias("_x"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("_s")
    )
    shared = sizes.filter(F.col("n") > 1).groupBy("n", "least", "_x", "_s").agg(F.min("bucket").alias("_b")).select("_b", "n", "least")
    members = written(banded.join(shared, F.col("bucket") == F.col("_b")).select("bucket", "key", "n", "least"), "members")

    wanted = members.select(F.col("key").alias("_k")).distinct()
    one = slim.groupBy("key").agg(F.min(F.struct("_id", "_hash")).alias("_one")).join(wanted, F.col("key") == F.col("_k"))
    one = written(one.select("key", "_one.*"), "wanted")
    rows = docs.select(ident.alias("_i"), F.xxhash64(text_column).alias("_h"), text_column.alias("_t"))
    met = rows.join(one, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    sets = written(met.groupBy("key").agg(F.first("_t").alias("_t")).select("key", _sets("_t").alias("found")), "sets")

    slot = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / SLOT))
    leaders = members.groupBy("bucket", slot.alias("slot")).agg(F.min("key").alias("leader"), F.first("n").alias("n"), F.first("least").alias("least"))
    slots = leaders.select(F.col("bucket").alias("_b"), F.col("slot").alias("_s"), "leader")
    led = members.withColumn("slot", slot).join(slots, (F.col("bucket") == F.col("_b")) & (F.col("slot") == F.col("_s"))).filter(F.col("key") != F.col("leader"))
    pairs = led.groupBy("key").agg(F.max(F.struct("n", "leader")).alias("_m")).select(F.col("key").alias("u"), F.col("_m.leader").alias("v"))
    pairs = pairs.unionAll(leaders.filter(F.col("leader") != F.col("least")).select(F.col("leader").alias("u"), F.col("least").alias("v")))
    first = written(_confirmed(pairs.distinct(), sets, similarity), "links")
    known = components(first)

    def with_root(rows: DataFrame, key: str = "key") -> DataFrame:
        named = known.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        return rows.join(named, F.col(key) == F.col("_u"), "left").withColumn("root", F.coalesce("_v", key)).drop("_u", "_v")

    # Of a bucket with several components all but its largest one's members are strays; only pairs with a stray are left to compare.
    parts = with_root(members).groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.groupBy(F.col("bucket").alias("_b")).agg(F.max(F.struct("_c", "root")).alias("_m"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_r")).filter(F.col("_r") > 1)
    open_ = parts.select("_b", F.col("_m.root").alias("_main"), F.ceil(F.col("_n") / cell).alias("_rows"), F.ceil((F.col("_n") - F.col("_m._c")) / cell).alias("_columns"))
    left = written(with_root(members).join(open_, F.col("bucket") == F.col("_b")).select("bucket", "key", "root", "_main", "_rows", "_columns"), "open")
    prints = slim.groupBy(F.col("key").alias("_k")).agg(F.first("fp").alias("fp"))
    facts = left.select("key").distinct().join(prints, F.col("key") == F.col("_k")).drop("_k").join(sets.withColumnRenamed("key", "_f"), F.col("key") == F.col("_f")).select(F.col("key").alias("_g"), "fp", "found")
    # Each block of members meets each block of strays in one cell.
    row, column = F.pmod(F.xxhash64("key"), F.col("_rows")), F.pmod(F.xxhash64("key"), F.col("_columns"))
    count = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    whole = left.select("bucket", "key", "root", row.alias("lo"), F.explode(count("_columns")).alias("hi"), F.lit(False).alias("stray"))
    strays = left.filter(F.col("root") != F.col("_main")).select("bucket", "key", "root", F.explode(count("_rows")).alias("lo"), column.alias("hi"), F.lit(True).alias("stray"))
    full = whole.unionAll(strays).join(facts, F.col("key") == F.col("_g")).drop("_g")
    ordered = full.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "key")
    second = ordered.mapInPandas(_compare(similarity, radius), "u bigint, v bigint")
    known = components(first.unionAll(second))
    return with_root(slim.select("_id", "_hash", "key"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One document of each group of near copies, with all its columns, chosen as by ``simhash.dedup``."""
    return simhash.first_of(docs, rooted(docs, doc_id, text, similarity, radius, cell), doc_id, text)
