"""Term counts, keyword rankings, cluster labels and lexical retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import segment, text
from opinionlake.operators import ranks
from opinionlake.operators import scope as S


def with_tokens(items: DataFrame, tokenizer: segment.Tokenizer = segment.DEFAULT) -> DataFrame:
    """``tokens`` of each item, by the same tokenizer as the keyword filter; rows with ``brand_terms`` use them as words."""
    folded = items.withColumn("_body", S.item_text())  # a column of its own, so that a text is folded once
    return folded.withColumn("tokens", tokenizer.tokens(F.col("_body"), S.brand_terms(items))).drop("_body")


def with_brands(items: DataFrame, brands: DataFrame) -> DataFrame:
    """Items with their report's own brand names. ``brands`` holds (report_id, brand_terms), one small row per report."""
    folded = F.transform(text.normalize_all(F.col("brand_terms")), F.lower)
    return items.join(brands.select("report_id", folded.alias("brand_terms")), "report_id", "left")


def with_brand_tokens(items: DataFrame, brands: DataFrame, tokenizer: segment.Tokenizer = segment.DEFAULT) -> DataFrame:
    return with_tokens(with_brands(items, brands), tokenizer).drop("brand_terms")


def tf_df(tokenised: DataFrame, keys=("report_id",)) -> DataFrame:
    """Term and document frequency in one shuffle.

    Every token counts once for TF and every distinct token of an item once for DF, so both are
    plain sums that combine before the shuffle - no per-document grouping and no distinct count.
    """
    hit = lambda tf, df: lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
    marks = F.concat(F.transform("tokens", hit(1, 0)), F.transform(F.array_distinct("tokens"), hit(0, 1)))
    # An outer explode spares the optimiser's extra "array is not empty" test, which would tokenise twice.
    exploded = tokenised.select(*keys, F.explode_outer(marks).alias("m")).filter("m is not null")
    return exploded.groupBy(*keys, F.col("m.term").alias("term")).agg(
        F.sum("m.tf").alias("term_frequency"), F.sum("m.df").alias("document_frequency")
    )


def rank(counts: DataFrame, metric="term_frequency", limit=30, hidden: DataFrame | None = None, keys=("report_id",)) -> DataFrame:
    """Top terms by a metric, then by term; ``hidden`` (report_id, term) are left out."""
    if hidden is not None:
        counts = counts.join(hidden, [*keys, "term"], "left_anti")
    return ranks.top_rows(counts, list(keys), [F.desc(metric), F.col("term")], limit)


def cluster_labels(members: DataFrame, keys, k: int = 5) -> DataFrame:
    """Top label words of each cluster: counted once per item, ties by word."""
    words = members.select(*keys, F.explode_outer(text.cluster_words(F.col("key_points"), F.col("text"))).alias("word")).filter("word is not null")
    counted = words.groupBy(*keys, "word").count()
    return ranks.top_rows(counted, list(keys), [F.desc("count"), F.col("word")], k, rank="position")


def question_terms(question: str) -> list[str]:
    return sorted(set(re.findall(r"[\w㐀-鿿]{2,}", question.lower())))


def score(body: Column, terms) -> Column:
    lowered = F.lower(body)
    total = F.lit(0).cast("bigint")
    for term in terms:
        total = total + text.occurrences(lowered, F.lit(term))
    return total


def query_rank(items: DataFrame, question: str, limit: int = C.RETRIEVAL_LIMIT) -> DataFrame:
    """Lexical fallback per report: most occurrences first, then position.

    All texts of a report are scored. Zero scores are dropped unless every text scores zero.
    """
    rows = items.filter(F.coalesce("text", F.lit("")) != "")
    scored = rows.select("report_id", "id", "ordinal", score(F.col("text"), question_terms(question)).alias("score"))
    top = ranks.top_rows(scored, ["report_id"], [F.desc("score"), F.col("ordinal")], limit, rank="position")
    best = top.filter("position = 1").select(F.col("report_id").alias("_r"), F.col("score").alias("_best"))
    kept = top.join(best, F.col("report_id") == F.col("_r")).filter((F.col("score") > 0) | (F.col("_best") == 0))
    return kept.select("report_id", "id", "position", "score")
