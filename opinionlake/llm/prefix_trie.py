"""Conversation prefix trie: every shared beginning of conversations once, with totals of all that follows it.

A node is a distinct sequence of first turns (role, text). Its key is a 128-bit hash, the exclusive or of position-salted turn hashes, so a conversation's
prefix keys are running sums, made by blocks of ``BLOCK`` turns; a parent's key is the node's without its last turn. A node is named by its smallest member and its
depth, and a conversation's path is the list of the names of its prefixes.

Totals over subtrees come from a centroid decomposition of the parent edges. A component's centroid is the deepest node that holds at least half of the
component's members' turns, so what is left after its removal are components of at most half of that. What the component has below the centroid is summed once and added to the
nodes on the way from the centroid to the component's top; then the parts below each of its children, and the part above it, are components of their own.
After the last split each node has the whole of its subtree, whatever the tree's shape: a chain of a million turns takes as many rounds as a bush.
Components of more than ``LIMIT`` nodes are split in Spark, all at once in each round: who lies below a centroid, and which nodes lie above it, are equalities on
(conversation, depth) in the path table. Smaller ones are finished inside tasks.

Null roles and texts are empty. Turns go by turn number (null first), then role and text. Rows without a conversation id belong to no conversation. Repeated
rows are turns of their own; conversations without turns are members of the root. A very long text only counts by its hash and bytes. An empty table has no
node. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.llm.common import text_of, written

BLOCK, LIMIT = 4096, 4096


def _counted_on(rows: DataFrame, key: str, block: str, value, name: str, order: list, total) -> DataFrame:
    """``rows`` with ``name``: the running ``value`` of a key's rows, blocks one after the other; ``total`` joins two values."""
    sums = rows.groupBy(key, block).agg(value.alias("_v"))
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(key).alias("_k"), F.col(block).alias("_b"), F.coalesce(total(F.col("_v")).over(before), F.lit(0)).alias("_carried"))
    joined = rows.join(carried, (F.col(key) == F.col("_k")) & (F.col(block) == F.col("_b"))).drop("_k", "_b")
    inside = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("_inside", value.over(inside)).withColumn(name, F.col("_inside") + F.col("_carried") if total is F.sum else F.col("_inside").bitwiseXOR(F.col("_carried"))).drop("_inside", "_carried")


def ordered(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, role, text): each conversation's turns, numbered from 1."""
    slim = rows.select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), text_of(f"`{role}`").alias("role"), text_of(f"`{text}`").alias("text")
    ).filter(F.col("conv").isNotNull())
    blocked = slim.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 63))) / BLOCK))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return _counted_on(blocked, "conv", "block", F.count(F.lit(1)), "depth", order, F.sum).select("conv", "depth", "role", "text")


def members(turns: DataFrame) -> DataFrame:
    """(conv, depth, h1, h2, p1, p2, bytes): the key of each prefix, of its parent, and the bytes of its last text."""
    own = [F.xxhash64("depth", "role", "text"), F.xxhash64(F.lit("other"), "text", "depth", "role")]
    rows = turns.select("conv", "depth", own[0].alias("o1"), own[1].alias("o2"), F.octet_length("text").cast("bigint").alias("bytes"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    for k in ("1", "2"):
        rows = _counted_on(rows, "conv", "block", F.bit_xor(f"o{k}"), f"h{k}", ["depth"], F.bit_xor)
    parents = [F.col(f"h{k}").bitwiseXOR(F.col(f"o{k}")).alias(f"p{k}") for k in ("1", "2")]
    return rows.select("conv", "depth", "h1", "h2", *parents, "bytes")


def centroid_sums(parent: list[int], weights: list[tuple[int, ...]]) -> list[list[int]]:
    """Sums over the subtrees of one component, whose nodes come parents first; the top's parent is -1."""
    sums = [[0] * len(weights[0]) for _ in parent]
    side, size = [0] * len(parent), [0] * len(parent)
    work = [list(range(len(parent)))]
    while work:
        part = work.pop()
        top = part[0]
        for v in part:
            size[v] = 1
        for v in reversed(part[1:]):
            size[parent[v]] += size[v]
        half = (len(part) + 1) // 2
        # Parents come first, so the last node of at least half is the deepest: such nodes are one path.
        centroid = max(v for v in part if size[v] >= half)
        above, below = [], {}
        total = [0] * len(weights[0])
        for v in part:
            p = parent[v]
            if v != centroid and (v == top or p != centroid and side[p] == -1):
                side[v] = -1
                above.append(v)
                continue
            if v != centroid:
                side[v] = v if p == centroid else side[p]
                below.setdefault(side[v], []).append(v)
            for i, w in enumerate(weights[v]):
                total[i] += w
        v = centroid
        while True:
            for i, t in enumerate(total):
                sums[v][i] += t
            if v == top:
                break
            v = parent[v]
        work += [p for p in (above, *below.values()) if p]
    return sums


def _small(columns: list[str]):
    def finish(rows: list) -> pd.DataFrame:
        place = {(r.owner, r.depth): i for i, r in enumerate(rows)}
        parent = [-1] + [place[(r.parent, r.depth - 1)] for r in rows[1:]]
        sums = centroid_sums(parent, [tuple(int(getattr(r, c)) for c in columns) for r in rows])
        out = {"owner": [r.owner for r in rows], "depth": [r.depth for r in rows]}
        return pd.DataFrame(out | {c: [int(getattr(r, f"a_{c}")) + s[i] for r, s in zip(rows, sums, strict=True)] for i, c in enumerate(columns)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                name = (row.top, row.top_depth)
                if held and name != last:
                    done.append(finish(held))
                    held = []
                held.append(row)
                last = name
            if done:
                yield pd.concat(done)
        if held:
            yield finish(held)

    return run


def rollup(nodes: DataFrame, paths: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """(owner, depth, columns): sums over subtrees.

    ``nodes`` (owner, depth, parent, measure, columns): a node is named by (owner, depth), its parent by (parent, depth - 1); ``measure`` is the members' turns from it on.
    ``paths`` (conv, depth, owner) names the nodes on the way of each conversation; a node's own way is that of its owner.
    """
    tops = nodes.filter(F.col("parent").isNull()).select("owner", "depth")
    top, top_depth = tops.first() or (None, None)
    names = ["owner", "depth", "parent", "top", "top_depth", "m", *columns, *[f"a_{c}" for c in columns]]
    zeros = [F.lit(0).cast("bigint").alias(f"a_{c}") for c in columns]
    state = nodes.select("owner", "depth", "parent", F.lit(top).cast("bigint").alias("top"), F.lit(top_depth).cast("bigint").alias("top_depth"), F.col("measure").alias("m"), *columns, *zeros)
    finished, small = [], []
    while True:
        sizes = state.groupBy(F.col("top").alias("_t"), F.col("top_depth").alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.max("m").alias("_w")).filter(F.col("_n") > limit)
        sizes = written(sizes, "components")
        in_large = (F.col("top") == F.col("_t")) & (F.col("top_depth") == F.col("_d"))
        small.append(state.join(sizes, in_large, "left_anti").select(*names))
        if sizes.isEmpty():
            break
        active = state.join(sizes, in_large).drop("_t", "_d", "_n")
        heavy = active.filter(2 * F.col("m") >= F.col("_w")).groupBy(F.col("top").alias("_t"), F.col("top_depth").alias("_d"))
        centroids = written(heavy.agg(F.max(F.struct("depth", "owner", "m")).alias("_c")).select("_t", "_d", F.col("_c.owner").alias("_co"), F.col("_c.depth").alias("_cd"), F.col("_c.m").alias("_cm")), "centroids")
        met = active.join(centroids, in_large).drop("_t", "_d", "_w")
        # Which node the owner's way passes at the centroid's depth, and at that of its children.
        asked = met.select("owner", "_cd").distinct().select("owner", F.col("_cd").alias("_asked"), F.explode(F.array(F.col("_cd"), F.col("_cd") + 1)).alias("_at"))
        way = paths.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), F.col("owner").alias("_passed"))
        passed = asked.join(way, (F.col("owner") == F.col("_conv")) & (F.col("_at") == F.col("_depth"))).groupBy(F.col("owner").alias("_o"), F.col("_asked").alias("_a")).agg(
            F.max(F.when(F.col("_at") == F.col("_asked"), F.col("_passed"))).alias("_here"), F.max(F.when(F.col("_at") > F.col("_asked"), F.col("_passed"))).alias("_child")
        )
        known = met.join(passed, (F.col("owner") == F.col("_o")) & (F.col("_cd") == F.col("_a")), "left").drop("_o", "_a")
        below = (F.col("depth") >= F.col("_cd")) & F.coalesce(F.col("_here") == F.col("_co"), F.lit(False))
        known = written(known.withColumn("_below", below), "sides")
        totals = known.filter("_below").groupBy(F.col("top").alias("_t"), F.col("top_depth").alias("_d")).agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
        # The way from the centroid to the component's top.
        line = centroids.join(way, (F.col("_co") == F.col("_conv")) & (F.col("_depth") <= F.col("_cd")) & (F.col("_depth") >= F.col("_d")))
        line = line.join(totals.withColumnsRenamed({"_t": "_tt", "_d": "_dd"}), (F.col("_t") == F.col("_tt")) & (F.col("_d") == F.col("_dd")))
        line = line.select(F.col("_passed").alias("_lo"), F.col("_depth").alias("_ld"), F.lit(True).alias("_on"), *[f"_s_{c}" for c in columns])
        added = known.join(line, (F.col("owner") == F.col("_lo")) & (F.col("depth") == F.col("_ld")), "left")
        central = (F.col("owner") == F.col("_co")) & (F.col("depth") == F.col("_cd"))
        moved = F.col("_below") & ~central
        after = written(added.select(
            "owner", "depth", "parent", F.when(moved, F.col("_child")).otherwise(F.col("top")).alias("top"), F.when(moved, F.col("_cd") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            (F.col("m") - F.when(F.coalesce("_on", F.lit(False)) & ~central, F.col("_cm")).otherwise(0)).alias("m"), *columns,
            *[(F.col(f"a_{c}") + F.coalesce(f"_s_{c}", F.lit(0))).alias(f"a_{c}") for c in columns], central.alias("_central"),
        ), "split")
        finished.append(after.filter("_central").select("owner", "depth", *[F.col(f"a_{c}").alias(c) for c in columns]))
        state = after.filter(~F.col("_central")).select(*names)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    # Whole numbers without nulls for the tasks: only a component's top may have no parent, and its parent is not asked for.
    rest = rest.withColumn("parent", F.coalesce("parent", F.lit(0))).drop("m").repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "owner")
    out = rest.mapInPandas(_small(columns), "owner bigint, depth bigint, " + ", ".join(f"{c} bigint" for c in columns))
    for more in finished:
        out = out.unionByName(more)
    return out


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids pass by; only the digest of the node at hand is held."""
    name, digest = None, None
    for batch in batches:
        out = []
        for owner, depth, conv in zip(batch["owner"].tolist(), batch["depth"].tolist(), batch["conv"].tolist(), strict=True):
            if name != (owner, depth):
                if digest:
                    out.append((*name, digest.hexdigest()))
                name, digest = (owner, depth), hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if out:
            yield pd.DataFrame(out, columns=["_o", "_d", "ends"])
    if digest:
        yield pd.DataFrame([(*name, digest.hexdigest())], columns=["_o", "_d", "ends"])


def trie(turns: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv, depth, role, text) are numbered from 1 without gaps, as by ``ordered``; ``convs`` (conv) are all conversations, with or without turns.
    """
    rows = written(members(turns), "members")
    lengths = convs.select(F.col("conv").alias("_c")).distinct().join(rows.groupBy("conv").agg(F.max("depth").alias("_n")), F.col("_c") == F.col("conv"), "left")
    lengths = written(lengths.select("_c", F.coalesce("_n", F.lit(0)).cast("bigint").alias("_n")), "lengths")
    with_length = rows.join(lengths, F.col("conv") == F.col("_c")).drop("_c")
    kept = [F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("_n") - F.col("depth") + 1).alias("measure")]
    inner = with_length.groupBy("depth", "h1", "h2").agg(*kept, F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    zero = F.lit(0).cast("bigint")
    base = lengths.select(F.col("_c").alias("conv"), zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "_n").groupBy("depth", "h1", "h2").agg(*kept)
    keyed = written(inner.unionByName(base.withColumns({"bytes": zero, "p1": zero, "p2": zero})), "nodes")
    above = keyed.select((F.col("depth") + 1).alias("_d"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("owner").alias("parent"))
    named = keyed.join(above, (F.col("depth") == F.col("_d")) & (F.col("p1") == F.col("_1")) & (F.col("p2") == F.col("_2")), "left").select("owner", "depth", "parent", "n_convs", "measure", "bytes")
    named = written(named, "named")
    children = named.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_p"), (F.col("depth") - 1).alias("_d")).agg(F.count(F.lit(1)).alias("n_children"))
    facts = named.join(children, (F.col("owner") == F.col("_p")) & (F.col("depth") == F.col("_d")), "left").withColumn("n_children", F.coalesce("n_children", zero))
    facts = facts.select("owner", "depth", "parent", "n_convs", "measure", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    facts = written(facts, "facts")
    known = keyed.select(F.col("depth").alias("_d"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "owner")
    paths = rows.join(known, (F.col("depth") == F.col("_d")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))).select("conv", "depth", "owner")
    root = (named.filter(F.col("depth") == 0).select("owner").first() or (None,))[0]
    paths = written(paths.unionByName(lengths.select(F.col("_c").alias("conv"), zero.alias("depth"), F.lit(root).cast("bigint").alias("owner"))), "paths")
    sums = rollup(facts, paths, ["n_leaves", "saved_tokens"], limit)
    ends = paths.join(lengths, (F.col("conv") == F.col("_c")) & (F.col("depth") == F.col("_n"))).select("owner", "depth", "conv")
    ends = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv").mapInPandas(_digests, "_o bigint, _d bigint, ends string")
    out = facts.drop("n_leaves", "saved_tokens", "measure").join(sums, ["owner", "depth"]).join(ends, (F.col("owner") == F.col("_o")) & (F.col("depth") == F.col("_d")), "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
