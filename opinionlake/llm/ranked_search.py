"""Ranked lexical search: the best documents of every item, by a dual-tree search that skips whole batches of both.

A document's coordinate for a term is its saturated, length-normed count; an item's coordinate is the term's weight times its occurrences in the item. A score
is their inner product. Documents of a task are kept in a tree (leaves of ``LEAF`` documents, nodes of ``FAN`` leaves, and so on), items in another, and each
node holds the maximum of every coordinate below it. The product of two nodes' maxima is no less than any score between them, so a pair of nodes whose product
stays below the weakest k-th score among the node's items is skipped whole: the result is exact. Pairs that remain are opened, the most promising first, down
to leaves, whose scores are one small matrix product.

Spark partitions the work. One pass counts each whole text's terms and keeps those whose hash is among the items' (a fixed bitmap of 2**``BITS`` bits, so false
friends may stay; they meet no item). Documents are ranged by their commonest kept term and length, so that neighbours are alike and the maxima tight. Items are
cut into blocks of about ``ITEMS``, written to the shared folder; every task streams the blocks past the documents it holds. One document in ``SEED`` is searched
first, only to give every item a k-th score to start from; the others follow with it, and both results are merged.

Products are taken in doubles as long as no score can reach 2**53 and in 64-bit integers beyond, so all sums are exact.

Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased. Null and wordless texts have no terms, are in no statistics and
are never found; an item without terms finds nothing. Every row is a document, so repeated rows are found each; equal scores go by ascending id, null ids last.
Rows equal in item id and text are one item, rows with equal ids and other texts are items of their own. Empty tables give an empty result. Only ids and
texts are read, whatever else the tables hold.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.llm import files
from opinionlake.llm.common import pieces, text_of, written
from opinionlake.session import scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAK = re.compile(NO_TERM)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
BITS, SEED, ITEMS, LEAF, FAN = 20, 16, 48, 16, 8
ITEM_LEAF, ITEM_FAN = 8, 4
#: Postings that a task holds at once, and cells of a dense document matrix.
HELD, CELLS = 1_500_000, 4_000_000
_KNOWN = 500_000
_PART = 1 << 22


def terms(text: Column) -> Column:
    return pieces(F.translate(text, _UPPER, _LOWER), NO_TERM)


def term_counts(text: str) -> Counter:
    """Occurrences of each term as written; long texts are taken in parts that end between terms."""
    if len(text) <= _PART:
        return Counter(TERM.findall(text))
    counts, at = Counter(), 0
    while at < len(text):
        cut = _BREAK.search(text, at + _PART) if len(text) - at > _PART else None
        end = cut.start() if cut else len(text)
        counts.update(TERM.findall(text, at, end))
        at = end
    return counts


def _counter(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        rows = 0
        for batch in batches:
            sizes, names, counts, signs, ends = [], [], [], [], [0]
            salts = pa.array(range(rows, rows + batch.num_rows), pa.int64())
            rows += batch.num_rows
            for text in batch.column("text").to_pylist():
                kept: dict[str, int] = {}
                found = term_counts(text)
                for raw, c in found.items():
                    if raw in known:
                        term = known[raw]
                    else:
                        term = raw.translate(_FOLD)
                        h = xxhash.xxh64_intdigest(term.encode(), 42) & ((1 << BITS) - 1)
                        term = term if bits[h >> 3] >> (h & 7) & 1 else None
                        if len(known) >= _KNOWN:
                            known.clear()
                        known[raw] = term
                    if term is not None:
                        kept[term] = kept.get(term, 0) + c
                sizes.append(found.total())
                names += kept
                counts += kept.values()
                ends.append(len(names))
                signs.append(min(kept, key=lambda t: (-kept[t], t)) if kept else None)  # noqa: B023
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), salts, pa.array(sizes, pa.int64()), pa.array(signs, pa.string()), lists(names, pa.string()), lists(counts, pa.int64())],
                ["doc", "salt", "n", "sign", "terms", "tf"],
            )

    return run


class _Node:
    """Items with their coordinates: ``weights`` (terms x items) in a leaf, ``top`` their maxima in every node."""

    def __init__(self, items, columns, top, children=(), weights=None):
        self.items, self.columns, self.top, self.children, self.weights = items, columns, top, children, weights


def item_tree(rows: list[tuple[np.ndarray, np.ndarray]], kind) -> _Node | None:
    """The tree over ``rows`` (columns, weights of each item), which come in an order that puts like beside like."""
    level = []
    for at in range(0, len(rows), ITEM_LEAF):
        part = rows[at : at + ITEM_LEAF]
        columns = np.unique(np.concatenate([c for c, _ in part]))
        weights = np.zeros((len(columns), len(part)), kind)
        for i, (c, w) in enumerate(part):
            weights[np.searchsorted(columns, c), i] = w
        level.append(_Node(np.arange(at, at + len(part)), columns, weights.max(axis=1, initial=0), weights=weights))
    while len(level) > 1:
        above = []
        for at in range(0, len(level), ITEM_FAN):
            part = level[at : at + ITEM_FAN]
            columns = np.unique(np.concatenate([n.columns for n in part]))
            top = np.zeros(len(columns), kind)
            for n in part:
                where = np.searchsorted(columns, n.columns)
                top[where] = np.maximum(top[where], n.top)
            above.append(_Node(np.concatenate([n.items for n in part]), columns, top, part))
        level = above
    return level[0] if level else None


class Search:
    """Best documents of the items of one block; ``floor`` holds scores that the k-th of each item is known to reach."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray, k: int, most: int):
        # No coordinate of a document exceeds 10**6.
        self.kind = np.float64 if most * 10**6 < 1 << 53 else np.int64
        self.k, self.tree = k, item_tree(rows, self.kind)
        self.limit = np.maximum(floor, 1).astype(self.kind)
        self.best: list[list] = [[] for _ in rows]
        self.opened = self.skipped = 0

    def add(self, matrix: np.ndarray, ids: list) -> None:
        """Searches documents (rows of coordinates), which come in an order that puts like beside like."""
        if self.tree is None or not len(matrix):
            return
        levels, self.ids = [matrix], ids
        for step in (LEAF, FAN, FAN):
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), step), axis=0))
        self.levels = levels
        self._visit(self.tree, len(levels) - 1, 0, len(levels[-1]))

    def _visit(self, node: _Node, level: int, lo: int, hi: int) -> None:
        if level == 0:
            return self._score(node, lo, hi)
        bounds = self.levels[level][lo:hi][:, node.columns] @ node.top
        order = np.argsort(-bounds, kind="stable").tolist()
        for seen, j in enumerate(order):
            if bounds[j] < self.limit[node.items].min():
                self.skipped += len(order) - seen
                break
            self.opened += 1
            if level == 1 and node.children:
                for child in node.children:
                    self._visit(child, 1, lo + j, lo + j + 1)
                continue
            step = LEAF if level == 1 else FAN
            a, b = (lo + j) * step, min((lo + j + 1) * step, len(self.levels[level - 1]))
            for child in node.children or (node,):
                self._visit(child, level - 1, a, b)

    def _score(self, node: _Node, lo: int, hi: int) -> None:
        scores = self.levels[0][lo:hi][:, node.columns] @ node.weights
        rows, places = np.nonzero(scores >= self.limit[node.items])
        for r, p in zip(rows.tolist(), places.tolist(), strict=True):
            item, ident = int(node.items[p]), self.ids[lo + r]
            best, entry = self.best[item], (-int(scores[r, p]), ident is None, 0 if ident is None else ident)
            if len(best) == self.k and entry >= best[-1]:
                continue
            insort(best, entry)
            del best[self.k :]
            if len(best) == self.k:
                self.limit[item] = max(self.limit[item], -best[-1][0])


def _searcher(path: str, k: int):
    """Each task holds documents up to ``HELD`` postings and lets all item blocks pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = files._at(path)
        blocks = ds.dataset(at, filesystem=store, format="parquet")
        code: dict[str, int] = {}
        ids, norms, lengths, codes, counts, kind, full = [], [], [], [], [], None, 0

        def found():
            m, n = np.concatenate(norms), np.concatenate(lengths)
            tf, all_codes = np.concatenate(counts), np.concatenate(codes)
            owner = np.repeat(np.arange(len(n)), n)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
            for part in blocks.to_batches(batch_size=1):
                for block in part.to_pylist():
                    yield from hits(block, impact, owner, all_codes, len(n))

        def hits(block, impact, owner, all_codes, n_docs):
            local = np.full(len(code), -1, np.int64)
            column, rows, places, most = {}, {}, [], 0
            totals: dict[int, int] = {}
            for e in block["entries"]:
                totals[e["place"]] = totals.get(e["place"], 0) + e["weight"]
                if e["term"] in code:
                    c = column.setdefault(e["term"], len(column))
                    local[code[e["term"]]] = c
                    rows.setdefault(e["place"], []).append((c, e["weight"]))
            if not rows:
                return
            most = max(totals.values())
            # Items whose commonest terms agree stand together.
            places = sorted(rows, key=lambda p: sorted((w, c) for c, w in rows[p])[:3])
            floor = {f["place"]: f["score"] for f in block["floors"] or []}
            pairs = [(np.array([c for c, _ in sorted(rows[p])]), np.array([w for _, w in sorted(rows[p])])) for p in places]
            search = Search(pairs, np.array([floor.get(p, 0) for p in places]), k, most)
            where = local[all_codes]
            seen = where >= 0
            where, who, what = where[seen], owner[seen], impact[seen]
            size = max(LEAF, min(LEAF * FAN * FAN, CELLS // len(column)))
            for at in range(0, n_docs, size):
                a, b = np.searchsorted(who, (at, at + size))
                if a == b:
                    continue
                matrix = np.zeros((min(size, n_docs - at), len(column)), search.kind)
                matrix[who[a:b] - at, where[a:b]] = what[a:b]
                search.add(matrix, ids[at : at + size])
            out = [(block["block"], p, ident if not missing else None, -score) for p, best in zip(places, search.best, strict=True) for score, missing, ident in best]
            if out:
                b, p, i, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int32()), pa.array(i, kind), pa.array(s, pa.int64())], ["block", "place", "doc", "score"])

        for batch in batches:
            names = batch.column("terms")
            flat = names.flatten().dictionary_encode()
            mapped = np.array([code.setdefault(t, len(code)) for t in flat.dictionary.to_pylist()], np.int64)
            codes.append(mapped[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64))
            counts.append(batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            lengths.append(np.diff(names.offsets.to_numpy()))
            norms.append(batch.column("m").to_numpy(zero_copy_only=False))
            ids += batch.column("doc").to_pylist()
            kind, full = batch.schema.field("doc").type, full + len(flat)
            if full >= HELD:
                yield from found()
                code.clear()
                ids, norms, lengths, codes, counts, full = [], [], [], [], [], 0
        if ids:
            yield from found()

    return run


def _item_blocks(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(block, place, item) of every item and (block, place, term, times) of its terms."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), text_of(f"`{text}`").alias("text")).distinct()
    n_blocks = max(1, -(-rows.count() // ITEMS))
    hashed = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("item", F.xxhash64("text"), "text"))
    placed = written(hashed.withColumn("place", place), "items")
    times = placed.select("block", "place", F.explode(terms(F.col("text"))).alias("term")).groupBy("block", "place", "term").agg(F.count(F.lit(1)).alias("times"))
    return placed.select("block", "place", "item"), written(times, "item_terms")


def counted(docs: DataFrame, vocabulary: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, salt, n, sign, terms, tf) of every row: its number in the task (which parts repeated rows), length, commonest kept term, kept terms and their occurrences."""
    bits = bytearray(1 << (BITS - 3))
    for (h,) in vocabulary.select(F.pmod(F.xxhash64("term"), F.lit(1 << BITS))).distinct().toLocalIterator():  # no more than the bitmap has bits
        bits[h >> 3] |= 1 << (h & 7)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), text_of(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("doc", docs.schema[doc_id].dataType), *T.StructType.fromDDL("salt bigint, n bigint, sign string, terms array<string>, tf array<bigint>").fields])
    return written(rows.mapInArrow(_counter(bytes(bits)), schema), "counted")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 of each item."""
    placed, item_terms = _item_blocks(items, item_id, item_text)
    known = counted(docs, item_terms.select("term"), doc_id, text)
    n_docs, n_terms = known.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = known.select(F.explode("terms").alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = item_terms.join(frequency, F.col("term") == F.col("_term")).select("block", "place", "term", (weight * F.col("times")).cast("bigint").alias("weight"))
    blocks = written(weighted.groupBy("block").agg(F.collect_list(F.struct("place", "term", "weight")).alias("entries")), "blocks")

    m = F.expr(f"75 + (25BD * cast(n as decimal(16,0)) * {n_docs}BD) div {max(n_terms, 1)}BD").cast("bigint")
    some = known.filter(F.size("terms") > 0).withColumn("m", m)
    seeded = F.pmod(F.xxhash64("doc", "n", "sign"), F.lit(SEED)) == 0
    schema = T.StructType([*T.StructType.fromDDL("block bigint, place int").fields, T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    best = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())

    def found(rows: DataFrame, floors: DataFrame) -> DataFrame:
        path = scratch(docs.sparkSession, "search")
        blocks.join(floors, "block", "left").write.parquet(path)
        hits = rows.sortWithinPartitions("sign", "m").select("doc", "m", "terms", "tf").mapInArrow(_searcher(path, k), schema)
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    none = "array<struct<place:int,score:bigint>>"
    # Few tasks, for each of them brings its own best.
    tasks = -(-known.rdd.getNumPartitions() // SEED)
    first = written(found(some.filter(seeded).coalesce(tasks), blocks.select("block", F.lit(None).cast(none).alias("floors"))), "seed")
    floors = first.filter(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("floors"))
    rest = found(some.filter(~seeded).repartitionByRange("sign", "m", "salt"), floors)
    merged = first.drop("rank").unionByName(rest.drop("rank")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = placed.select(F.col("block").alias("_b"), F.col("place").alias("_p"), "item")
    joined = merged.join(named, (F.col("block") == F.col("_b")) & (F.col("place") == F.col("_p")))
    return joined.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score")
