"""Quality rules: per-document failures, summed by host, shrunk with an empirical beta prior, joined back.

Each document is measured by array expressions (no Python). A failure of a *base* rule rejects the document by itself. The *soft* rules
are summed by host: a host's failure rate of a rule is drawn to the mean of all hosts by a beta prior whose strength is fitted to the hosts
by the method of moments, so a host with few documents is not condemned by chance. A document is rejected when its host is condemned by
some rule and the document itself fails a soft rule: clean documents of a bad host stay.

Nulls and odd rows: a null text counts as empty (it fails the word minimum); a null host is a host of its own; repeated rows are judged and
counted one by one; an empty table gives an empty result. Columns that are not asked for are not looked at, so clashing names do no harm;
a kept column with the name of a result column is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.llm.common import GAP, pieces, text_of, written


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    min_mean_chars: int = 3
    max_mean_chars: int = 12
    host_rate: float = 0.5
    #: The prior counts for this many documents at least, so that one document cannot condemn a host.
    min_strength: float = 10.0


SOFT = ("symbols", "lines", "chars")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_soft", "host_bad")


def _covered(positions: str, window: int) -> Column:
    """Number of words that windows starting at the (sorted) positions cover."""
    p = F.col(positions)
    reach = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))).cast("bigint"))
    return F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, b: a + b)


def measure(docs: DataFrame, text: str, rules: Rules, carry: list[Column]) -> DataFrame:
    """The carried columns and the measures of each text. One pass over the text; arrays are projected once, then read by name."""
    n, no_long = rules.window, F.array().cast("array<bigint>")
    df = docs.select(*carry, text_of(text).alias("_t"))
    carried = df.columns[:-1]
    df = df.select(
        *carried,
        pieces(F.col("_t"), GAP).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    df = df.select(
        *carried, "n_symbols",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_hw"),
    )
    measures = ["n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    hw = F.col("_hw")
    runs = F.transform(F.slice(hw, 1, F.greatest(F.size(hw) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(hw, i + k) for k in range(1, n)]))
    df = df.select(*carried, *measures, F.when(F.size(hw) >= n, runs).otherwise(no_long).alias("_h"))
    # Only texts that hold some window twice pay for the sort by (hash, position).
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.select(*carried, *measures, F.when(repeats, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"))
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    df = df.select(*carried, *measures, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_p"))
    df = df.select(*carried, *measures, F.when(F.col("_p").isNull(), F.lit(0)).otherwise(_covered("_p", n)).cast("bigint").alias("n_repeat_words"))
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    some = F.col("n_words") > 0
    return df.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (some & (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("n_words"))).alias("_f_symbols"),
        (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines")).alias("_f_lines"),
        (some & ~F.col("word_chars").between(rules.min_mean_chars * F.col("n_words"), rules.max_mean_chars * F.col("n_words"))).alias("_f_chars"),
    )


def host_verdicts(measured: DataFrame, host: str, rules: Rules) -> DataFrame:
    """(host, _bad) from failures by host: partial sums, then one row of moments over the hosts, then the shrunk rates."""
    sums = measured.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"_f_{r}").cast("bigint")).alias(f"_k_{r}") for r in SOFT]
    )
    sums = written(sums, "hosts")  # one row a host; the moments and the rates both read it
    n = F.col("_n")
    moments = sums.agg(
        F.sum("_n").alias("_all"),
        *[F.sum(f"_k_{r}").alias(f"_s_{r}") for r in SOFT],
        *[F.sum(F.col(f"_k_{r}") * F.col(f"_k_{r}") / n).alias(f"_q_{r}") for r in SOFT],
        F.count(F.lit(1)).alias("_hosts"),
    )
    joined = sums.withColumn("_m", moments.select(F.struct("*")).scalar())
    joined = joined.select(*sums.columns, "_m.*")
    bad = F.lit(False)
    for r in SOFT:
        mean = F.col(f"_s_{r}") / F.col("_all")
        spread = mean * (1 - mean)
        # Variance of the hosts' rates, weighted by size, without the part that sampling alone would give.
        between = (F.col(f"_q_{r}") / F.col("_all") - mean * mean) - spread * F.col("_hosts") / F.col("_all")
        strength = F.when((spread > 0) & (between > spread * 1e-6), F.greatest(spread / between - 1, F.lit(rules.min_strength))).otherwise(F.lit(1e6))
        rate = F.round((F.col(f"_k_{r}") + strength * mean) / (n + strength), 9)
        bad = bad | (rate > rules.host_rate)
    return joined.select("_host", bad.alias("_bad"))


def _judged(docs: DataFrame, names: list[str], text: str, host: str, rules: Rules) -> DataFrame:
    """The named columns as ``_row``, with all results.

    Texts are measured twice, once for the sums by host and once beside the rows: that costs less than writing the rows in between.
    """
    place = F.col(f"`{host}`").alias("_h0")
    verdicts = host_verdicts(measure(docs, text, rules, [place]), "_h0", rules)
    measured = measure(docs, text, rules, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), place])
    joined = measured.join(verdicts, F.col("_h0").eqNullSafe(F.col("_host")), "left")
    soft = sum((F.col(f"_f_{r}").cast("bigint") for r in SOFT), F.lit(0).cast("bigint"))
    bad = F.coalesce("_bad", F.lit(False))
    return joined.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~(bad & (soft > 0))).alias("kept"), soft.alias("n_soft"), bad.alias("host_bad"),
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of the documents (all by default) with the measures, ``n_soft``, ``host_bad`` and ``kept``."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    return _judged(docs, names, text, host, rules).select("_row.*", *RESULT)


def clean(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep; their own columns, whatever their names."""
    judged = _judged(docs, docs.columns, text, host, rules)
    # One sum over both sides of the join, of terms that are never null. A condition on the texts alone, also an inferred "is not null", would
    # be pushed below the projections of the measures, and each of these would be computed anew wherever it is named.
    reasons = F.coalesce(F.col("base_failed").cast("int"), F.lit(1)) + F.coalesce((F.col("host_bad") & (F.col("n_soft") > 0)).cast("int"), F.lit(0))
    return judged.filter(reasons == 0).select("_row.*")
