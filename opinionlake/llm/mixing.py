"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (how often it is taken). Of all rates that give each source its target of words and exceed no cap, those nearest
to 1 in relative entropy are r = min(cap, exp(lambda_s * size)): an exponential tilt with one multiplier for each source, found by Newton
steps on the convex dual. A rate depends on the source and the size only, so documents are first summed to a histogram (source, size, n);
the text is read once and the Newton sums are small partial aggregates over the histogram, for all sources at once. A step that would leave
its bracket is replaced by halving the bracket.

Rates become copies in three steps. Over the sizes of a source in order, running sums of rates are rounded, so errors of neighbouring sizes
cancel. What is still missing of (or above) the target by more than a thousandth is then made up: copies of the one size that leaves the least, or else one copy in and another out,
as long as that lessens the difference. At last the copies of a (source, size) group are dealt evenly to its documents in hash order; the order is made in hash ranges of about ``BLOCK`` documents.

All sums are of whole numbers (rates in units of 2**-24, Newton sums as decimals), so reruns give the same copies whatever the order.

Null texts have size 0; size-0 documents take part with no words and keep rate 1 where their source has a target. A null source is a source of its own, last in order. Repeated
rows and null ids are dealt like others. An empty table gives an empty result. ``mix`` carries all columns, ``plan`` only the named ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.llm.common import GAP, text_of, written

WEIGHTS = (5, 2, 1)
CAP = 3
UNIT = 1 << 24
BLOCK = 20_000
ROUNDS = 400


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, GAP), "")).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size, least) with ``target``: the total by weight, none above ``cap`` times its source, the excess reshared.

    Sharing stops at the level at which no open source is above its cap; the level is a single row, found round by round.
    """
    ranked = sources.withColumn("_order", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_order") % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * cap).cast("double")
    open_ = ranked.withColumn("_w", weight).withColumn("_limit", limit)
    level, n_capped = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("_w") * level >= F.col("_limit")
        total, given, open_weight, now = open_.agg(
            F.sum("source_size"), F.sum(F.when(capped, F.col("source_size") * cap)), F.sum(F.when(~capped, F.col("_w"))), F.count(F.when(capped, 1))
        ).first()
        if now == n_capped or not open_weight:
            break
        level, n_capped = ((total or 0) - (given or 0)) / open_weight, now
    level = level or 0.0
    return open_.select("source", "source_size", "least", F.least(F.col("_limit"), F.col("_w") * level).alias("target"))


def _rate(multiplier: Column, size: Column, cap: int) -> Column:
    return F.exp(F.least(multiplier * size, F.lit(math.log(cap)))).cast("double")


def multipliers(histogram: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, lambda): one Newton step for all unsettled sources at a time, until every source has its words to one in 10**9.

    The state is a small written table with one row a source. Each step has the same short plan, so the driver keeps no more of a hundredth step than of the first.
    """
    some = histogram.filter(F.col("size") > 0)
    ratio = F.col("target") / F.col("source_size")
    # At the low end all documents together are below the target, at the high end all are at the cap.
    low, high = F.log(ratio) / F.col("least"), F.log(F.lit(float(cap))) / F.col("least")
    state = goals.filter((F.col("source_size") > 0) & (F.col("target") > 0)).select(
        "source", "target", F.when(ratio < 1, low).otherwise(0.0).alias("_lo"), F.when(ratio < 1, 0.0).otherwise(high).alias("_hi"),
        F.lit(0.0).alias("lambda"), (ratio >= cap * (1 - 1e-12)).alias("_full"),
    )
    state = written(state.withColumn("_settled", F.col("_full")), "state")
    rows = some.select(F.col("source").alias("_s"), "size", "n")
    for _ in range(ROUNDS):
        if state.filter(~F.col("_settled")).isEmpty():
            break
        rate = _rate(F.col("lambda"), F.col("size"), cap)
        tokens = F.col("n") * F.col("size")
        inner = F.col("lambda") * F.col("size") < math.log(cap)
        sums = rows.join(state.filter(~F.col("_settled")), F.col("_s").eqNullSafe(F.col("source"))).groupBy("source", "target", "_lo", "_hi", "lambda", "_full").agg(
            F.sum((tokens * rate).cast("decimal(38,9)")).cast("double").alias("_f"),
            F.sum(F.when(inner, (tokens * F.col("size") * rate)).otherwise(0.0).cast("decimal(38,9)")).cast("double").alias("_g"),
        )
        below = F.col("_f") < F.col("target")
        lo, hi = F.when(below, F.col("lambda")).otherwise(F.col("_lo")), F.when(below, F.col("_hi")).otherwise(F.col("lambda"))
        # Newton on log(sum) = log(target), which is nearer to a line than the sum itself.
        step = F.col("lambda") + F.when(F.col("_g") > 0, F.log(F.col("target") / F.col("_f")) * F.col("_f") / F.col("_g"))
        inside = (step > lo) & (step < hi)
        # A bracket that doubles cannot halve any more is as near as one can come.
        settled = (F.abs(F.col("_f") / F.col("target") - 1) < 1e-9) | (lo + (hi - lo) / 2 <= lo) | (lo + (hi - lo) / 2 >= hi)
        moved = sums.select(
            "source", "target", lo.alias("_lo"), hi.alias("_hi"), F.when(settled, F.col("lambda")).when(inside, step).otherwise((lo + hi) / 2).alias("lambda"), "_full", settled.alias("_settled")
        )
        state = written(moved.unionByName(state.filter("_settled")), "state")
    else:
        raise RuntimeError(f"sources unsettled after {ROUNDS} Newton steps")
    # A source whose target is its cap has no finite multiplier: one that caps its shortest document does as well.
    return state.select("source", F.when(F.col("_full"), F.col("_hi")).otherwise(F.col("lambda")).alias("lambda"))


def _moves(groups: DataFrame, missing: DataFrame, cap: int) -> DataFrame:
    """(source, size, by): for each source the copies of one size whose change leaves the smallest difference, if that is smaller than now."""
    size, miss = F.col("size"), F.col("_miss")
    room = F.when(miss > 0, F.col("n") * cap - F.col("k")).otherwise(F.col("k"))
    copies = F.least(room, F.expr("(abs(_miss) * 2 + size) div (2 * size)"))
    left = F.abs(F.abs(miss) - copies * size)
    tried = groups.filter(size > 0).join(missing, F.col("source").eqNullSafe(F.col("_s"))).select("_s", size, miss, copies.alias("_by"), left.alias("_left"))
    best = tried.filter((F.col("_by") > 0) & (F.col("_left") < F.abs(miss))).groupBy("_s").agg(F.min(F.struct("_left", "size", (F.col("_by") * F.signum("_miss")).cast("bigint").alias("by"))).alias("_b"))
    return best.select(F.col("_s").alias("source"), "_b.size", "_b.by")


def _swaps(groups: DataFrame, missing: DataFrame, cap: int) -> DataFrame:
    """(source, size, by): for each source one copy in and one out whose sizes differ by nearly what is missing, if that leaves less than now."""
    here = groups.filter(F.col("size") > 0).join(missing, F.col("source").eqNullSafe(F.col("_s")))
    none = F.lit(None).cast("bigint")
    out = here.filter(F.col("k") > 0).select("_s", "_miss", F.col("size").alias("_at"), F.col("size").alias("_out"), none.alias("_in"))
    into = here.filter(F.col("k") < F.col("n") * cap).select("_s", "_miss", (F.col("size") - F.col("_miss")).alias("_at"), none.alias("_out"), F.col("size").alias("_in"))
    line = Window.partitionBy("_s").orderBy("_at", "_out", "_in")
    near = out.unionByName(into).select(
        "_s", "_miss", "_in", F.last("_out", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("_under"),
        F.first("_out", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing)).alias("_over"),
    ).select("_s", "_miss", "_in", F.explode(F.array("_under", "_over")).alias("_out"))
    left = F.abs(F.col("_miss") - F.col("_in") + F.col("_out"))
    best = near.filter(F.col("_in").isNotNull() & F.col("_out").isNotNull() & (left < F.abs("_miss"))).groupBy("_s").agg(F.min(F.struct(left.alias("_left"), "_in", "_out")).alias("_b"))
    pair = F.array(F.struct(F.col("_b._in").alias("size"), F.lit(1).cast("bigint").alias("by")), F.struct(F.col("_b._out").alias("size"), F.lit(-1).cast("bigint").alias("by")))
    return best.select(F.col("_s").alias("source"), F.explode(pair).alias("_p")).select("source", "_p.*")


def _adjusted(groups: DataFrame, cap: int) -> DataFrame:
    """``groups`` (source, size, n, target, taken copies ``k``) with the differences to the targets made up as far as any move or swap lessens them.

    Sources within a thousandth of their target are left alone. Every change lessens a whole number, so the rounds come to an end.
    """
    while True:
        sums = groups.groupBy(F.col("source").alias("_s")).agg(F.max("target").alias("_t"), (F.round(F.first("target")).cast("bigint") - F.sum(F.col("k") * F.col("size"))).alias("_miss"))
        missing = sums.filter((F.col("_miss") != 0) & (F.abs("_miss") * 1000 > F.col("_t"))).select("_s", "_miss")
        moves = written(_moves(groups, missing, cap), "moves")
        if moves.isEmpty():
            moves = written(_swaps(groups, missing, cap), "moves")
            if moves.isEmpty():
                return groups
        named = moves.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "by")
        joined = groups.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
        groups = written(joined.select("source", "size", "n", "target", "source_size", (F.col("k") + F.coalesce("by", F.lit(0))).cast("bigint").alias("k")), "groups")


def group_copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size, n, target, source_size, k): the copies that each group of documents of one source and size gets in all."""
    histogram = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    least = F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    sources = written(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), least), "sources")
    goals = written(targets(sources, weights, cap), "goals")
    tilt = multipliers(histogram, goals, cap).withColumnRenamed("source", "_t")
    known = histogram.join(goals.drop("least").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.join(tilt, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    rate = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("lambda").isNull(), F.lit(1.0)).otherwise(_rate(F.col("lambda"), F.col("size"), cap))
    units = F.least(F.round(rate * UNIT), F.lit(cap * UNIT)).cast("bigint") * F.col("n")
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sums = known.withColumn("_units", units).withColumn("_upto", F.sum("_units").over(upto))
    copies = F.expr(f"(_upto + {UNIT // 2}) div {UNIT} - (_upto - _units + {UNIT // 2}) div {UNIT}")
    rounded = sums.select("source", "size", "n", "target", "source_size", copies.cast("bigint").alias("k"))
    return _adjusted(written(rounded, "groups"), cap)


def _dealt(rows: DataFrame, groups: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (source, size, ...) with target, source_size and ``copies``."""
    named = groups.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "k", "target", "source_size")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    # Places are those in hash order whatever the number of blocks, for blocks are ranges of the hash.
    share = F.xxhash64(*order).cast("double") / F.lit(2.0**64) + 0.5
    joined = joined.withColumn("_block", F.floor(share * F.ceil(F.col("n") / BLOCK)))
    blocks = joined.groupBy(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy("_s", "_z").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    joined = joined.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_block") == F.col("_b"))).drop("_s", "_z", "_b")
    place = F.row_number().over(Window.partitionBy("source", "size", "_block").orderBy(F.xxhash64(*order), *order)).cast("bigint") + F.col("_before")
    # Place i of n gets floor(i k / n) - floor((i - 1) k / n) copies: k in all, and no more than k / n rounded up each.
    copies = F.expr("(_place * k) div n - ((_place - 1) * k) div n")
    return joined.withColumn("_place", place).withColumn("copies", copies.cast("bigint")).drop("_place", "_before", "_block", "n", "k")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document."""
    t = text_of(f"`{text}`")
    sized = written(docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("source"), words(t).alias("size"), F.xxhash64(t).alias("_hash")), "sizes")
    dealt = _dealt(sized, group_copies(sized, weights, cap), [F.col("_id"), F.col("_hash")])
    return dealt.select(F.col("_id").alias(doc_id), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixture itself: each document as often as its copies, with all its columns.

    Copies are dealt on slim rows; texts move once, to meet them by id and text hash. Rows equal in both share their copies evenly.
    """
    t = text_of(f"`{text}`")
    key, digest = F.col(f"`{doc_id}`"), F.xxhash64(t)
    sized = written(docs.select(key.alias("_id"), F.col(f"`{source}`").alias("source"), words(t).alias("size"), digest.alias("_hash")), "sizes")
    dealt = _dealt(sized, group_copies(sized, weights, cap), [F.col("_id"), F.col("_hash")])
    shares = dealt.groupBy("_id", "_hash").agg(F.sum("copies").alias("_k"), F.count(F.lit(1)).alias("_m")).filter(F.col("_k") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_i"), digest.alias("_h"))
    met = rows.join(shares, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    met = met.withColumn("_r", F.row_number().over(Window.partitionBy("_i", "_h").orderBy(F.xxhash64("_row"))))
    times = F.expr("(_r * _k) div _m - ((_r - 1) * _k) div _m").cast("int")
    return met.select("_row", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")
