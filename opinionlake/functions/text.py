"""Cleaning, folding, masking and tokenising as column expressions."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake import constants as C

#: White space and the separators 1C to 1F, as one set of bits and one category: every further range costs time on every character.
_BLANK = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\p{Z}"
#: Runs of blanks but the single plain space, which a replacement would only copy.
_SPACES = rf"[{_BLANK}](?:[{_BLANK}]+|(?<! ))"

#: Blanks of ASCII but space and line feed; without them a text in ASCII needs no pattern for its lines.
_RARE_BLANK = r"[\t\x0b\f\r\x1c\x1d\x1e\x1f]"


# Blocks in which most letters are left alone by NFKC; anything outside them goes the long way.
_COMMON_BLOCKS = ((0x00, 0x17F), (0x3001, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF))


def _outside(stable) -> str:
    """Regex for "some character that is not known to be stable".

    Long runs come first and are passed over as wholes; a class tries all its ranges on every character.
    """
    runs: list[list[int]] = []
    for first, last in _COMMON_BLOCKS:
        for point in range(first, last + 1):
            if not stable(chr(point)):
                continue
            if runs and runs[-1][1] == point - 1:
                runs[-1][1] = point
            else:
                runs.append([point, point])
    named = [(f"\\x{{{a:x}}}-\\x{{{b:x}}}", b - a >= 64) for a, b in runs]
    long = "".join(f"[{r}]++|" for r, wide in named if wide)
    return rf"(?s)\A(?:{long}[{''.join(r for r, _ in named)}])*+."


def _nfkc_stable(ch: str) -> bool:
    return unicodedata.normalize("NFKC", ch) == ch and not unicodedata.combining(ch)


@functools.lru_cache(maxsize=1)
def _compat_class() -> str:
    return _outside(_nfkc_stable)


@functools.lru_cache(maxsize=1)
def _casefold_class() -> str:
    return _outside(lambda ch: ch.casefold() == ch.lower())


@functools.lru_cache(maxsize=1)
def _fold_class() -> str:
    return _outside(lambda ch: _nfkc_stable(ch) and ch.casefold() == ch.lower())


def _needs(col: Column, pattern: str) -> Column:
    return (F.octet_length(col) != F.length(col)) & col.rlike(pattern)


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def nfkc(col: Column) -> Column:
    """NFKC. Only texts holding an affected character cross to Python; the rest stay in the JVM."""
    return F.coalesce(_nfkc(F.when(_needs(col, _compat_class()), col)), col)


def composed(col: Column) -> Column:
    """NFKC, no zero-width space; null becomes ''. The first half of ``normalize``."""
    text, zero = nfkc(F.coalesce(col, F.lit(""))), F.lit("\u200b")
    # A replacement compares at every byte; the test before it only looks for the first one.
    return F.when(F.contains(text, zero), F.replace(text, zero, F.lit(""))).otherwise(text)


def collapsed(col: Column) -> Column:
    """Single blanks, trimmed. The second half of ``normalize``, for a column that stands in a projection of its own."""
    in_ascii = F.octet_length(col) == F.length(col)
    lines = F.when(F.contains(col, F.lit("\n")), F.replace(col, F.lit("\n"), F.lit(" "))).otherwise(col)
    single = F.when(F.contains(lines, F.lit("  ")), F.regexp_replace(lines, "  +", " ")).otherwise(lines)
    return F.trim(F.when(in_ascii & ~col.rlike(_RARE_BLANK), single).otherwise(F.regexp_replace(col, _SPACES, " ")))


def normalize(col: Column) -> Column:
    """NFKC, no zero-width space, single blanks, trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(composed(col), _SPACES, " "))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda strings: [s if s is None else unicodedata.normalize("NFKC", s) for s in strings], na_action="ignore")


def normalize_all(strings: Column) -> Column:
    """``normalize`` for each string of an array; only strings holding an affected character cross to Python."""
    sent = F.transform(strings, lambda s: F.when(_needs(s, _compat_class()), s))
    composed = F.zip_with(_nfkc_each(F.when(F.exists(sent, lambda s: s.isNotNull()), sent)), strings, lambda a, b: F.coalesce(a, b))
    return F.transform(F.coalesce(composed, strings), lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit("\u200b"), F.lit("")), _SPACES, " ")))


def fold(col: Column) -> Column:
    """NFKC + casefold matching key; null becomes ''."""
    text = F.coalesce(col, F.lit(""))
    return F.coalesce(_nfkc_casefold(F.when(_needs(text, _fold_class()), text)), F.lower(text))


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def casefold(col: Column) -> Column:
    """Full casefold, without NFKC. Only texts holding a letter whose casefold is not its lower case cross to Python."""
    return F.coalesce(_casefold(F.when(_needs(col, _casefold_class()), col)), F.lower(col))


# What a text must hold for a mask to be able to hit; a cheap test that spares most texts the pattern. Each begins with a sign or digit of the match and
# looks back from there, since a pattern that begins with a look-behind or a wide class tries it at every character.
_HINT = {
    "url": lambda t: functools.reduce(Column.__or__, [F.contains(t, F.lit(part)) for part in ("://", "ww.", "WW.", "wW.", "Ww.")]),
    "email": lambda t: F.contains(t, F.lit("@")) & t.rlike(rf"@(?<=[{C.W}.+-]@)[{C.W}-]+\.[{C.W}-]"),
    "handle": lambda t: F.contains(t, F.lit("@")) & t.rlike(rf"@(?<![{C.W}]@)[A-Za-z0-9_.-]{{2}}"),
    "phone": lambda t: t.rlike(r"[09]\p{Nd}{1,3}[- ]?\p{Nd}{3,4}[- ]?\p{Nd}{3}"),
    "long_id": lambda t: t.rlike(r"\p{Nd}{8}"),
}
#: What both numbers hold. Masks leave no new digits, so one test before them serves both.
_NUMBERS = ("phone", "long_id")


def _five_digits(t: Column) -> Column:
    in_ascii = F.octet_length(t) == F.length(t)
    return F.when(in_ascii, t.rlike("[0-9]{2}[- ]?[0-9]{3}")).otherwise(t.rlike(r"\p{Nd}{2}[- ]?\p{Nd}{3}"))


def mask(col: Column, kind: str) -> Column:
    label, pattern = C.MASKS[kind]
    return F.regexp_replace(col, pattern, label)


def _mask_where_it_may_hit(value: Column, kind: str) -> Column:
    return F.when(_HINT[kind](value), mask(value, kind)).otherwise(value)


def mask_all(strings: Column) -> Column:
    """The five masks for each string of an array, one pass each, so that no mask runs twice on a string."""
    return functools.reduce(lambda a, kind: F.transform(a, lambda s: _mask_where_it_may_hit(s, kind)), C.MASKS, strings)


def add_masked(df: DataFrame, column: str, counts: str | None = None, long: bool = True) -> DataFrame:
    """Replace ``column`` by its masked form, one projection per mask so each runs once per row.

    ``counts`` names a struct column of how often each mask fired. ``long`` texts get the cheap tests.
    """
    df = df.withColumn("_t", composed(F.col(column))).withColumn("_t", collapsed(F.col("_t")))
    if counts or long:
        df = df.withColumn("_digits", _five_digits(F.col("_t")))
    for kind, (_, pattern) in C.MASKS.items():
        may_hit = F.col("_digits") & _HINT[kind](F.col("_t")) if kind in _NUMBERS else _HINT[kind](F.col("_t"))
        if counts:
            fired = F.when(may_hit, F.regexp_count("_t", F.lit(pattern))).otherwise(0).cast("bigint")
            df = df.withColumn(f"_n_{kind}", fired)
        masked = mask(F.col("_t"), kind)
        if long:
            masked = F.when(may_hit, masked).otherwise(F.col("_t"))
        df = df.withColumn("_t", masked)
    if counts:
        df = df.withColumn(counts, F.struct(*[F.col(f"_n_{k}").alias(k) for k in C.MASKS]))
    return df.withColumn(column, F.col("_t")).drop("_t", "_digits", *[f"_n_{k}" for k in C.MASKS])


def redact(col: Column) -> Column:
    """Normalise, then the five masks in their fixed order."""
    return functools.reduce(mask, C.MASKS, normalize(col))


def strip_blank(col: Column) -> Column:
    """Python-like strip()."""
    return F.regexp_replace(col, rf"^[{_BLANK}]+|[{_BLANK}]+$", "")


def is_blank(col: Column) -> Column:
    return ~F.coalesce(col, F.lit("")).rlike(f"[^{_BLANK}]")


def formula_safe(col: Column) -> Column:
    """Prefix a quote when a spreadsheet would read the value as a formula."""
    return F.when(col.rlike(r"(?U)^[\s\x1c-\x1f]*[=+@-]"), F.concat(F.lit("'"), col)).otherwise(col)


def alternation(words) -> str:
    """Longest-first alternation, so a left-to-right scan is a longest match."""
    quoted = [w for w in sorted(set(words), key=lambda w: (-len(w), w)) if w]
    return "|".join("".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in w) for w in quoted)


HAN = "一-鿿"
#: Runs of letters and digits of all other scripts.
RUN = rf"[\p{{L}}\p{{N}}&&[^{HAN}]]+"
#: Brand names of several words begin and end where a word does; the edge itself may be a sign, as in "c++".
_BOUND = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def han_words(words) -> str:
    """The dictionary's words as an alternation; words without Han letters are runs anyway."""
    return alternation(w for w in words if w.isalnum() and any("一" <= c <= "鿿" for c in w))


def run_pattern(brands: Column | None = None) -> Column:
    """Letter runs of texts without Han letters, and before them the brand names of several words."""
    if brands is None:
        return F.lit(f"({RUN})")
    lower = F.array_distinct(F.transform(brands, lambda b: F.lower(F.trim(b))))
    several = F.filter(lower, lambda w: ~w.rlike(r"^[\p{L}\p{N}]*$"))
    longest = F.transform(F.array_sort(F.transform(several, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
    quoted = F.transform(longest, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}\s])", r"\\$1"))
    first = F.concat(F.lit(f"{_BOUND[0]}(?:"), F.array_join(quoted, "|"), F.lit(f"){_BOUND[1]}|"))
    return F.concat(F.lit("("), F.when(F.size(quoted) > 0, first).otherwise(""), F.lit(f"{RUN})"))


def worth_keeping(found: Column) -> Column:
    """Tokens of two characters or more, no stop words, no numbers."""
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*C.STOPWORDS) & ~t.rlike(r"^\p{N}+$"))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a literal word."""
    cut = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return (cut / F.length(word)).cast("bigint")


def cluster_words(key_points: Column, text: Column) -> Column:
    """Label candidates of one item: key points if any, else word runs; each once."""
    runs = F.regexp_extract_all(text, F.lit("([a-zA-Z]{3,}|[一-鿿]{2,})"), F.lit(1))
    runs = F.transform(
        F.filter(runs, lambda w: ~w.isin(*C.CLUSTER_STOPWORDS)), lambda w: F.substring(w, 1, 16)
    )
    points = F.coalesce(key_points, F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(points) > 0, points).otherwise(runs))
