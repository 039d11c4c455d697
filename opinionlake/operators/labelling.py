"""The labelling job and its pluggable scorer and encoder."""

from __future__ import annotations

import collections
import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake import constants as C
from opinionlake.functions import sentiment as rules
from opinionlake.functions import text

CLASSES = rules.CLASSES
_SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in CLASSES])


def scorer_udf(load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]], batch: int = 32):
    """Arrow UDF around a text classifier.

    ``load`` runs once per worker task and returns a function from texts to (label, score) rows;
    labels are folded into the three classes.
    """

    @F.pandas_udf(_SCORES)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            folded = []
            for start in range(0, len(texts), batch):
                chunk = texts.iloc[start : start + batch].fillna("").tolist()
                for labelled in model(chunk):
                    totals = dict.fromkeys(CLASSES, 0.0)
                    for label, value in labelled:
                        totals[fold_label(label)] += float(value)
                    folded.append(totals)
            yield pd.DataFrame(folded, columns=list(CLASSES), index=texts.index)

    return score


def fold_label(label: str) -> str:
    """Class of a classifier label: by name, else by the usual 0/2 numbering."""
    name = str(label).lower()
    for cls, marks in (("positive", ("label_2", "2")), ("negative", ("label_0", "0"))):
        if cls[:3] in name or name in marks:
            return cls
    return "neutral"


def picked(scores: Column) -> Column:
    """sentiment and confidence of a score struct, first class winning ties."""
    by_class = {c: scores[c] for c in CLASSES}
    return F.struct(
        rules.argmax(by_class).alias("sentiment"),
        F.greatest(*by_class.values()).alias("confidence"),
        *[v.alias(c) for c, v in by_class.items()],
    )


def chunked_scores(df: DataFrame, key: str, tokens: Column, score, size: int = C.CHUNK_TOKENS, stride: int = C.CHUNK_STRIDE) -> DataFrame:
    """Length-weighted mean score over overlapping token windows; one row per key."""
    n = F.size("_tokens")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(stride)))
    windows = df.select(key, tokens.alias("_tokens")).select(key, F.explode(starts).alias("_start"), "_tokens")
    chunk = F.array_join(F.slice("_tokens", F.col("_start") + 1, F.lit(size)), " ")
    scored = windows.select(key, chunk.alias("_chunk")).select(
        key, F.greatest(F.length("_chunk"), F.lit(1)).alias("_w"), score(F.col("_chunk")).alias("_s")
    )
    weight = F.sum("_w")
    return scored.groupBy(key).agg(
        F.count("*").alias("chunks"), *[(F.sum(F.col(f"_s.{c}") * F.col("_w")) / weight).alias(c) for c in CLASSES]
    )


def label_items(items: DataFrame, score=None, model_id: str = C.LEXICON_MODEL) -> DataFrame:
    """item_labels: scored text, vote rule, calibration, star sentiment, conflict.

    ``score`` is a scorer UDF; without one the word-list scorer labels the rows.
    """
    body = F.coalesce("text", F.lit(""))
    keep = items.select("report_id", "id", "source", "content_type", "text", "rating", "signal")
    if score is None:
        df = rules.add_lexicon(keep, body)
    else:
        df = keep.withColumn("_p", score(body)).withColumn("_p", picked(F.col("_p"))).select("*", "_p.*").drop("_p")
    df = df.withColumn("_vote", rules.vote_rule(F.col("source"), F.col("content_type"), body, F.col("signal")))
    vote, voted, blank = F.col("_vote"), F.col("_vote").isNotNull(), text.is_blank(F.col("text"))
    nothing = F.lit(None).cast("double")
    by_vote = {
        "positive": F.when(vote == "positive", 0.95).otherwise(0.0),
        "neutral": F.lit(0.05),
        "negative": F.when(vote == "negative", 0.95).otherwise(0.0),
    }
    df = df.withColumns(
        {
            "sentiment": F.when(voted, vote).when(blank, "rating_only").otherwise(F.col("sentiment")),
            "confidence": F.when(voted, 0.95).when(blank, 1.0).otherwise(F.col("confidence")),
            **{c: F.when(voted, by_vote[c]).when(blank, nothing).otherwise(F.col(c)) for c in CLASSES},
            "local_model_id": F.when(voted, C.VOTE_MODEL).otherwise(F.lit(model_id)),
        }
    )
    rated = rules.star_sentiment(F.col("rating"))
    label = F.col("sentiment")
    return rules.calibrate(df).select(
        "report_id",
        "id",
        "sentiment",
        "confidence",
        *CLASSES,
        rated.alias("rating_sentiment"),
        F.coalesce((label != "rating_only") & (label != rated), F.lit(False)).alias("rating_text_conflict"),
        "local_model_id",
    )


def fallback_count(labels: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with text that the word-list scorer had to label."""
    texted = items.filter(F.coalesce("text", F.lit("")) != "").select("report_id", "id")
    # Counted, not filtered: a condition on the model is pushed below the labelling and repeats its text work once per phrase.
    used = labels.select("report_id", "id", F.col("local_model_id").startswith(C.LEXICON_MODEL).alias("_used"))
    counted = used.join(texted, ["report_id", "id"], "left_semi").groupBy("report_id").agg(F.count_if("_used").alias("fallback"))
    return counted.filter("fallback > 0")


# ---- encoder hook -------------------------------------------------------------------------
def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str):
    """Arrow UDF around a text encoder; outputs are L2-normalised. Passages and queries differ by prefix."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            raw = np.asarray(model([prefix + t for t in texts.fillna("")]), dtype="float64")
            norms = np.linalg.norm(raw, axis=1, keepdims=True)
            yield pd.Series(list(raw / np.where(norms == 0, 1.0, norms)), index=texts.index)

    return encode


class _Slots(dict):
    """A token's bucket, found once."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        self[token] = int(hashlib.md5(token).hexdigest()[:8], 16) % self.dim
        return self[token]


#: UTF-8 bytes of a lower-cased text with a blank for all but a-z and 0-9.
_TOKEN_BYTES = bytes(b if chr(b) in string.ascii_lowercase + string.digits else 32 for b in range(256))


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for a trained encoder: token counts in hashed buckets."""
    slots = _Slots(dim)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, value in enumerate(texts):
            counts = collections.Counter(value.lower().encode("utf-8", "surrogatepass").translate(_TOKEN_BYTES).split())
            if counts:
                out[row] = np.bincount([slots[token] for token in counts], weights=list(counts.values()), minlength=dim)
        return out

    return encode


encode_passages = encoder_udf(hashing_encoder, "passage: ")
encode_queries = encoder_udf(hashing_encoder, "query: ")
