"""Numbers and maps: counters, first integers, whitelisted metrics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionlake import constants as C


def first_int(label: Column) -> Column:
    compact = F.regexp_replace(F.coalesce(label, F.lit("")), "[,，]", "")
    return F.regexp_extract(compact, r"(\d+)", 1).try_cast("bigint")


def first_decimal(label: Column) -> Column:
    compact = F.replace(F.coalesce(label, F.lit("")), F.lit(","), F.lit(""))
    return F.regexp_extract(compact, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def counter(value: Column) -> Column:
    """A 1-12 digit counter (thousands commas allowed), else null."""
    text = F.replace(F.trim(value.cast("string")), F.lit(","), F.lit(""))
    return F.when(text.rlike(r"^\d{1,12}$"), text).try_cast("bigint")


def metrics(raw: Column) -> Column:
    """Whitelisted non-negative metrics."""
    return F.map_filter(raw, lambda k, v: k.isin(*C.METRIC_KEYS) & v.isNotNull() & (v >= 0))


def signal(value: Column) -> Column:
    return F.when(value.isin(*C.SIGNALS), value)


def diagnostics(counters: Column) -> Column:
    return F.map_filter(counters, lambda k, v: k.isin(*C.DIAGNOSTIC_COUNTERS) & v.isNotNull() & (v >= 0))


def known_reasons(reasons: Column) -> Column:
    """Known partial reasons, first occurrence kept, in order."""
    return F.array_distinct(F.filter(reasons, lambda r: r.isin(*C.PARTIAL_REASONS)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def finite(v: Column) -> Column:
    """Present, every entry finite, and not the zero vector."""
    entries = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )
    return F.coalesce(v.isNotNull() & entries & (norm(v) > 0), F.lit(False))


def unit(v: Column) -> Column:
    # Repeated, the length is computed once; inside the lambda it would be for every entry.
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, length: x.cast("double") / length)
