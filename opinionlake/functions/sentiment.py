"""Sentiment rules as columns: lexicon, stars, votes, calibration."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions.text import HAN, collapsed, composed, is_blank, occurrences

CLASSES = ("positive", "neutral", "negative")
#: Letters beyond ASCII that a pattern without regard to case takes for ASCII ones, though ``lower`` may not.
_ODD = "\u0130\u0131\u017f\u212a"


def _total(text: Column, words, chinese: Column) -> Column:
    """Occurrences of all words; null for a null text. Counting costs several times what the test before it does."""
    none = F.lit(0).cast("bigint")
    counts = [F.when(F.contains(text, F.lit(w)), occurrences(text, F.lit(w))).when(text.isNotNull(), none) for w in words]
    han = [c for w, c in zip(words, counts, strict=True) if _is_han(w)]
    rest = [c for w, c in zip(words, counts, strict=True) if not _is_han(w)]
    if han:
        rest.append(F.when(chinese, functools.reduce(Column.__add__, han)).when(text.isNotNull(), none))
    return functools.reduce(Column.__add__, rest)


def _is_han(word: str) -> bool:
    return re.search(f"[{HAN}]", word) is not None


def _holds(text: Column, pattern: str) -> Column:
    """Whether a class of characters beyond ASCII occurs; texts in ASCII are not searched."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(pattern)


def add_lexicon(df: DataFrame, body: Column) -> DataFrame:
    """Add sentiment, confidence and the three scores from word counts.

    Stages are separate projections on purpose: each value is computed once per row.
    """
    df = df.withColumn("_low", F.lower(body))
    lowered, chinese = F.col("_low"), F.col("_chinese")
    df = df.withColumn("_chinese", _holds(lowered, f"[{HAN}]"))
    df = df.withColumns({"_good": _total(lowered, C.POSITIVE_WORDS, chinese), "_bad": _total(lowered, C.NEGATIVE_WORDS, chinese)}).drop("_low", "_chinese")
    good, bad = F.col("_good"), F.col("_bad")
    label = F.when((good == 0) & (bad == 0), "neutral").when(good >= bad, "positive").otherwise("negative")
    strength = F.least(F.lit(0.55) + F.lit(0.08) * F.abs(good - bad), F.lit(0.85))
    df = df.withColumns(
        {"sentiment": label, "confidence": F.when((good == 0) & (bad == 0), F.lit(0.5)).otherwise(strength)}
    )
    rest = (F.lit(1.0) - F.col("confidence")) / 2
    scores = {c: F.when(F.col("sentiment") == c, F.col("confidence")).otherwise(rest) for c in CLASSES}
    return df.withColumns(scores).drop("_good", "_bad")


def star_sentiment(rating: Column) -> Column:
    return F.when(rating <= 2, "negative").when(rating == 3, "neutral").when(rating > 3, "positive")


def canonical_label(label: Column) -> Column:
    """Classifier label -> one of the three classes."""
    low = F.lower(label)
    return (
        F.when(F.contains(low, F.lit("pos")) | low.isin("label_2", "2"), "positive")
        .when(F.contains(low, F.lit("neg")) | low.isin("label_0", "0"), "negative")
        .otherwise("neutral")
    )


def vote_rule(source: Column, content_type: Column, text: Column, signal: Column) -> Column:
    """Sentiment of a very short board comment, taken from its vote; null when not applicable."""
    short = (source == "ptt") & (content_type == "comment") & (F.length(text) <= 4)
    return F.when(short & (signal == "push"), "positive").when(short & (signal == "boo"), "negative")


def _plain_words(pattern: str) -> list[str]:
    """The words of a pattern that only lists small ASCII words, else none."""
    return pattern.split("|") if re.fullmatch("[a-z |]+", pattern) else []


def _spaced(lowered: Column, patterns) -> Column:
    """Whether a pattern in ASCII may depend on how blanks are written: it lists a word group whose parts all occur, or is more than a list."""
    tests = [F.lit(not all(_plain_words(p) for p in patterns if p.isascii()))]
    groups = [w.split(" ") for p in patterns for w in _plain_words(p) if " " in w]
    tests += [functools.reduce(Column.__and__, [F.contains(lowered, F.lit(part)) for part in group]) for group in groups]
    return functools.reduce(Column.__or__, tests)


def phrase_hits(text: Column, patterns, chinese: Column, lowered: Column, odd: Column) -> Column:
    """How many phrase groups match. ``chinese`` says whether the text holds a Chinese character:

    all groups but the Latin ones need one, and letter case only matters to the Latin ones. Lists of Latin words are looked up in the
    ``lowered`` text, which costs a third of the pattern, unless the text holds an ``odd`` letter.
    """
    hits = []
    for pattern in patterns:
        words = _plain_words(pattern)
        if words:
            listed = functools.reduce(Column.__or__, [F.contains(lowered, F.lit(w)) for w in words])
            hits.append(F.when(odd, text.rlike("(?iu)" + pattern)).otherwise(listed).cast("int"))
        elif pattern.isascii():
            hits.append(text.rlike("(?iu)" + pattern).cast("int"))
        else:
            hits.append(F.when(chinese, text.rlike(pattern).cast("int")).otherwise(0))
    return functools.reduce(lambda a, b: a + b, hits)


def argmax(scores: dict[str, Column]) -> Column:
    """Label of the highest score; ties go to the earlier class."""
    ranked = [F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(scores.items())]
    return F.array_max(F.array(*ranked))["k"]


def calibrate(df: DataFrame, body: str = "text", rating: str = "rating") -> DataFrame:
    """Blend sentiment, confidence and scores with phrase groups and a star prior.

    Reads and replaces sentiment, confidence, positive, neutral, negative and local_model_id. Blank
    texts and rating-only rows pass through unchanged.
    """
    clean, lowered, chinese, odd = F.col("_clean"), F.col("_low"), F.col("_chinese"), F.col("_odd")
    df = df.withColumn("_clean", composed(F.col(body)))
    df = df.withColumn("_low", F.lower(clean))
    df = df.withColumns({"_rare": _holds(clean, f"[{_ODD}{HAN}]"), "_blank": is_blank(clean)})
    df = df.withColumns({"_chinese": F.col("_rare") & clean.rlike(f"[{HAN}]"), "_odd": F.col("_rare") & clean.rlike(f"[{_ODD}]")})
    # Blanks are only written alike where a phrase may see them; most texts are read but not copied.
    df = df.withColumn("_seen", F.col("_rare") | _spaced(lowered, (*C.POSITIVE_PHRASES, *C.NEGATIVE_PHRASES)))
    df = df.withColumn("_clean", F.when(F.col("_seen"), collapsed(clean)).otherwise(clean))
    df = df.withColumn("_low", F.when(F.col("_seen"), F.lower(clean)).otherwise(lowered))
    df = df.withColumns(
        {
            "_praise": phrase_hits(clean, C.POSITIVE_PHRASES, chinese, lowered, odd),
            "_blame": phrase_hits(clean, C.NEGATIVE_PHRASES, chinese, lowered, odd),
        }
    )
    df = df.withColumns({f"_{c}": F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in CLASSES})
    silent = (F.col("_positive") == 0) & (F.col("_neutral") == 0) & (F.col("_negative") == 0)
    floor = F.greatest(F.col("confidence"), F.lit(0.5))
    bonus = {"positive": F.col("_praise") * C.PHRASE_WEIGHT, "negative": F.col("_blame") * C.PHRASE_WEIGHT, "neutral": F.lit(0.0)}
    for star, (label, weight) in C.STAR_PRIOR.items():
        bonus[label] = bonus[label] + F.when(F.col(rating) == star, F.lit(weight)).otherwise(F.lit(0.0))
    df = df.withColumns(
        {f"_{c}": F.when(silent & (F.col("sentiment") == c), floor).otherwise(F.col(f"_{c}")) + bonus[c] for c in CLASSES}
    )
    df = df.withColumn("_total", F.greatest(F.col("_positive") + F.col("_neutral") + F.col("_negative"), F.lit(1.0)))
    df = df.withColumns({f"_{c}": F.col(f"_{c}") / F.col("_total") for c in CLASSES})
    final = {c: F.col(f"_{c}") for c in CLASSES}
    kept = F.col("_blank") | (F.col("sentiment") == "rating_only")
    touched = ~kept & ((F.col("_praise") > 0) | (F.col("_blame") > 0) | F.col(rating).isNotNull())
    model = F.col("local_model_id")
    df = df.withColumns(
        {
            "local_model_id": F.when(touched & ~model.endswith(C.CONTEXT_SUFFIX), F.concat(model, F.lit(C.CONTEXT_SUFFIX))).otherwise(model),
            "sentiment": F.when(kept, F.col("sentiment")).otherwise(argmax(final)),
            "confidence": F.when(kept, F.col("confidence")).otherwise(F.greatest(*final.values())),
            **{c: F.when(kept, F.col(c)).otherwise(final[c]) for c in CLASSES},
        }
    )
    return df.drop("_clean", "_low", "_chinese", "_odd", "_rare", "_blank", "_seen", "_praise", "_blame", "_total", *[f"_{c}" for c in CLASSES])
