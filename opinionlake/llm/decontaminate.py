"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document when at least ``threshold`` of its distinct word shingles occur there. Items are partitioned by size
(powers of two of their number of shingles). Each partition has a sketch size that follows from its largest item: the sketch is the items'
k smallest shingle hashes (bottom-k MinHash). With q shingles at most q - ceil(t q) may be missing, so of any q - ceil(t q) + m sketched
ones at least m are in a document that contains the item. That bound makes the search complete: every document is met through the sketch,
whatever its length, and only documents with m or more sketch hits are verified. Verification intersects the shingle *strings*.

Documents' shingle hashes are exploded and joined to the sketches by equality; Spark broadcasts the sketches when their written size allows it
and shuffles both sides otherwise. Hits are summed partially before they move. No Python is used.

Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case. A text of fewer words than a shingle has is one
shingle by itself, and so only meets an equally short text. Null and wordless items match nothing; null texts contain nothing. Rows that
share an id and text give one pair; rows with null ids are kept under the null id. Only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.llm.common import NOT_ALNUM, pieces, shingle_hashes, text_of, written


def _words(text: Column) -> Column:
    return pieces(F.lower(text), NOT_ALNUM)


def shingles(words: str, n: int) -> Column:
    """The word runs as text, so that equal hashes cannot pass for equal words."""
    w = F.col(words)
    runs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))
    whole = F.array(F.concat_ws(" ", w))
    return F.when(F.size(w) >= n, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, item_id: str, text: str, n: int, threshold: float, extra: float) -> DataFrame:
    """(item, hash, size, need): the bottom-k hashes of each item and the hits that a containing document must have."""
    words = items.select(F.col(f"`{item_id}`").alias("_item"), _words(text_of(f"`{text}`")).alias("_w"))
    hashed = words.select("_item", F.transform("_w", lambda w: F.xxhash64(w)).alias("_hw"))
    sorted_ = hashed.select("_item", F.sort_array(F.array_distinct(shingle_hashes("_hw", n))).alias("_s"))
    q = F.size("_s")
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(q)))  # upper end of the size partition
    # Exact decimals: 0.2 * 50 must not come out as 9.999...
    may_miss = q - F.ceil((q * F.lit(threshold).cast("decimal(10,6)"))).cast("int")
    k = F.least(q, may_miss + F.greatest(F.lit(1), F.ceil(largest * extra)).cast("int"))
    sized = sorted_.filter(q > 0).select("_item", "_s", q.alias("_q"), (k - may_miss).alias("_need"), k.alias("_k"))
    return sized.select("_item", "_q", "_need", F.explode(F.slice("_s", F.lit(1), F.col("_k"))).alias("_hash"))


def contained(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", n: int = 5,
    threshold: float = 0.8, extra: float = 0.1,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): all pairs at or above the threshold. ``extra`` is the share of an item sketched beyond the bound."""
    sketch = written(sketches(items, item_id, item_text, n, threshold, extra), "sketches")
    base = docs.select(F.col(f"`{doc_id}`").alias("_doc"), text_of(f"`{text}`").alias("_t"))
    hashed = base.select("_doc", _words(F.col("_t")).alias("_w")).select("_doc", F.transform("_w", lambda w: F.xxhash64(w)).alias("_hw"))
    seen = hashed.select("_doc", F.explode(F.array_distinct(shingle_hashes("_hw", n))).alias("_hash"))
    # A document has each hash once; repeated rows of one id only add to the hits, and so to what is verified.
    hits = seen.join(sketch, "_hash").groupBy("_doc", "_item", "_need").agg(F.count(F.lit(1)).alias("_hits"))
    candidates = written(hits.filter(F.col("_hits") >= F.col("_need")).select("_doc", "_item"), "candidates")
    item_runs = items.select(F.col(f"`{item_id}`").alias("_i"), _words(text_of(f"`{item_text}`")).alias("_iw"))
    item_runs = item_runs.select("_i", F.array_distinct(shingles("_iw", n)).alias("_is"))
    pairs = candidates.join(item_runs, F.col("_item").eqNullSafe(F.col("_i")))
    meet = base.withColumnRenamed("_doc", "_d").join(pairs, F.col("_d").eqNullSafe(F.col("_doc")))
    texts = meet.select("_doc", "_item", "_is", _words(F.col("_t")).alias("_w")).select("_doc", "_item", "_is", shingles("_w", n).alias("_ds"))
    shared = texts.select("_doc", "_item", F.size("_is").cast("bigint").alias("_n"), F.size(F.array_intersect("_is", "_ds")).cast("bigint").alias("_m"))
    # The filter stands behind the aggregate: before it, it would be pushed below the projections and compute the shingles anew.
    best = shared.groupBy("_doc", "_item").agg(F.max(F.struct("_m", "_n")).alias("_b"))
    return best.filter(F.col("_b._m") >= F.col("_b._n") * F.lit(threshold).cast("decimal(10,6)")).select(
        F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), F.col("_b._n").alias("n_item"), F.col("_b._m").alias("n_shared"),
        F.round(F.col("_b._m") / F.col("_b._n"), 6).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that contain no item; all their columns. A row goes by its own text, whatever other rows share its id."""
    t = F.col(f"`{text}`").cast("string")
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(t).alias("hash"))
    bad = contained(docs.select(key.alias("_key"), t.alias("_text")), items, doc_id="_key", text="_text", **options).select(F.col("_key").alias("_bad")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    return rows.join(bad, F.col("_key").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")
