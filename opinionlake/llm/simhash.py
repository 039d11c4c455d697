"""SimHash near-dedup with bit-sliced comparison.

A text's fingerprint has a bit set when over half of its shingle hashes have it. Fingerprints within the radius r are linked. Copies share a
fingerprint, so only distinct ones are compared. The 64 bits are cut into r + 2 blocks: two fingerprints within r agree in two blocks at least,
so each fingerprint goes into a bucket for every pair of blocks, about 25 bits for r = 3. Inside a bucket the bits of all members lie in vertical planes, 64 members to a
word. Member i is compared with member i + d for 64 members at once: XOR of each plane with itself moved by d, added up in carry-save
counters that start such that they overflow just beyond the radius. Words whose lanes have all overflowed are abandoned.

A bucket emits a spanning forest of its links, never all pairs; the forests are joined by connected components in Spark. A bucket beyond
``CELL`` members is cut into sub-blocks, and each pair of sub-blocks is a cell of its own, so no task holds more than two sub-blocks of one bucket and no link is lost.

Null and wordless texts have fingerprint zero and are linked like any others. Repeated rows and null ids are kept; a component's id is its
smallest non-null id (null if it has none). An empty table gives an empty result. Only the named columns are read by ``assign``; ``dedup`` carries all columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.llm.common import written
from opinionlake.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 3
CELL = 4096
CHUNK = 1 << 16
ROWS = 200_000


def hashes(text: str | None, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the runs of ``n`` words in chunks, so a long text needs little beyond its words; of fewer words, one hash of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(n, len(words))
    starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")


def majority(chunks: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingle hashes: bits that over half of them have; zero of none."""
    total, count = np.zeros(64, np.int64), 0
    for chunk in chunks:
        total += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(chunk)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """As an unsigned integer."""
    return majority(hashes(text, n))


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t if isinstance(t, str) else None) for t in batch], np.uint64).view(np.int64))


def near(keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS, every: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + d) of equal keys and at most ``radius`` differing bits, for one distance d after another. Keys are sorted."""
    n = len(keys)
    words = -(-n // 64)
    lanes = np.zeros((64, words * 64), np.uint8)
    lanes[:, :n] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.zeros((64, words + 2), np.uint64)
    planes[:, :words] = np.packbits(lanes, axis=1, bitorder="little").view("<u8")
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for d in range(1, n):
        same = keys[d:] == keys[:-d]
        if not same.any():
            return  # sorted keys: no longer distance has a pair either
        open_lanes = np.zeros(words * 64, np.uint8)
        open_lanes[: n - d] = same
        mask = np.packbits(open_lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(mask)
        over, (skip, shift) = ~mask[at], divmod(d, 64)
        counters = [np.full(len(at), ones if start >> k & 1 else 0, np.uint64) for k in range(width)]
        for b in range(64):
            plane, moved = planes[b], np.minimum(at + skip, words)
            other = plane[moved]
            if shift:
                other = (other >> np.uint64(shift)) | (plane[np.minimum(moved + 1, words)] << np.uint64(64 - shift))
            carry = plane[at] ^ other
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % every == every - 1:
                live = over != ones
                if not live.all():
                    at, over, counters = at[live], over[live], [c[live] for c in counters]
                    if not len(at):
                        break
        if len(at):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(hit)
            i = at[word] * 64 + lane
            yield i, i + d


def forest(keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its component within its key."""
    label = np.arange(len(keys))
    for i, j in near(keys, prints, radius):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(label, up := label[label]):
                label = up
    return label


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(rows: pd.DataFrame) -> pd.DataFrame:
            prints = rows["fp"].to_numpy(np.int64)
            cell = rows[["bucket", "lo", "hi"]].to_numpy(np.int64)
            first = np.ones(len(cell), bool)
            first[1:] = (cell[1:] != cell[:-1]).any(axis=1)
            root = forest(np.cumsum(first), prints.view(np.uint64), radius)
            moved = root != np.arange(len(root))
            return pd.DataFrame({"u": prints[moved], "v": prints[root[moved]]})

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                rows = pd.concat(held, ignore_index=True)
                cell = rows[["bucket", "lo", "hi"]].to_numpy(np.int64)
                cut = int(np.flatnonzero((cell == cell[-1]).all(axis=1))[0])  # the last cell may go on
                if cut:
                    yield links(rows.iloc[:cut])
                held = [rows.iloc[cut:]]
        if held and sum(map(len, held)):
            yield links(pd.concat(held, ignore_index=True))

    return run


def in_cells(banded: DataFrame, cell: int = CELL, member: str = "fp") -> DataFrame:
    """(``member``, bucket, lo, hi): members of buckets beyond ``cell`` dealt to sub-blocks, and each pair of sub-blocks a cell."""
    large = banded.groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell)
    cut = F.coalesce(F.ceil(F.col("_n") / (cell // 2)), F.lit(1)).cast("bigint")
    split = banded.join(large, F.col("bucket") == F.col("_b"), "left").select(member, "bucket", cut.alias("_cut"))
    own = F.pmod(F.xxhash64(member), F.col("_cut"))
    split = split.select(member, "bucket", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cut") - 1)).alias("_other"))
    # A sub-block meets itself in every cell it is in; its cell with itself is needed only when it is the only one.
    return split.select(member, "bucket", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"))


def linked(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(u, v): each fingerprint that is not the least of its component, with the least. ``prints`` has a column ``fp`` of distinct ones."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1).cast("bigint")) for k in range(blocks)]
    buckets = [
        F.xxhash64(F.lit(t), part[a], part[b]) if edges[1] > 14 else F.shiftleft(part[a], 14).bitwiseOR(part[b]) * 16 * blocks + t
        for t, (a, b) in enumerate(combinations(range(blocks), 2))
    ]
    banded = prints.select("fp", F.explode(F.array(*buckets)).alias("bucket"))
    cells = in_cells(banded, cell)
    ordered = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "fp")
    return components(ordered.mapInPandas(_compare(radius), "u bigint, v bigint"))


def roots(rows: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """``rows`` (with a column ``fp``) and the least fingerprint of the component, ``root``."""
    moved = linked(rows.select("fp").distinct(), radius, cell)
    return rows.join(moved, F.col("fp") == F.col("u"), "left").withColumn("root", F.coalesce("v", "fp")).drop("u", "v")


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    slim = written(docs.select(F.col(f"`{doc_id}`").alias("id"), fingerprints(F.col(f"`{text}`").cast("string")).alias("fp")), "fingerprints")
    classes = roots(slim.groupBy("fp").agg(F.min("id").alias("least")), radius, cell)
    first = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(first, "root").select(F.col("fp").alias("_f"), "component_id")
    joined = slim.join(known, F.col("fp") == F.col("_f"))
    return joined.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id, of equal ids that of the smallest text hash.

    The choice is made on slim rows; ``row_number() = 1`` is cut down inside each task before rows move, so a component with a third of all
    rows stays small. Texts move once, to meet the chosen (id, text hash); of rows equal in both one is kept.
    """
    text_column, key = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    slim = written(docs.select(key.alias("_id"), F.xxhash64(text_column).alias("_hash"), fingerprints(text_column).alias("fp")), "fingerprints")
    return first_of(docs, roots(slim, radius, cell), doc_id, text)


def first_of(docs: DataFrame, rooted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of each ``root`` in ``rooted`` (_id, _hash, root) the row of ``docs`` with the smallest id, then text hash."""
    text_column, key = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    order = Window.partitionBy("root").orderBy(F.col("_id").asc_nulls_last(), "_hash")
    chosen = rooted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).select("_id", "_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_i"), F.xxhash64(text_column).alias("_h"))
    met = rows.join(written(chosen, "chosen"), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    one = Window.partitionBy("_i", "_h").orderBy(F.xxhash64("_row"))
    return met.withColumn("_n", F.row_number().over(one)).filter(F.col("_n") == 1).select("_row.*")
