"""The clean/mask/identity job: landed rows to masked, folded, identified items plus its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake import constants as C
from opinionlake.functions import dates, identity, text


def estimate_date(df: DataFrame, now: Column) -> DataFrame:
    """An explicit time wins over a parsed relative date; precision follows the winner."""
    parsed = dates.relative(F.col("relative_date"), now)
    explicit = F.col("published_at").isNotNull()
    return df.withColumn("_parsed", parsed).withColumns(
        {
            "date_precision": F.when(explicit, F.col("date_precision")).otherwise(F.col("_parsed.precision")),
            "published_at": F.coalesce("published_at", "_parsed.at"),
        }
    ).drop("_parsed")


def clean(raw: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Mask text and title, hash the author and drop the name, estimate the date, add identities."""
    blank = F.lit("")
    masked = raw.withColumns(
        {
            "folded": text.fold(F.concat_ws(" ", F.coalesce("title", blank), F.coalesce("text", blank))),
            "author_hash": identity.author_hash(keys, F.col("source"), F.col("author")),
            "content_hash": identity.content_hash(F.col("source"), F.col("id"), F.col("text")),
            "source_url": identity.safe_url(F.col("source_url")),
        }
    ).drop("author")
    masked = text.add_masked(text.add_masked(masked, "text", counts="mask_counts"), "title", long=False)
    return estimate_date(masked, now)


def clean_metrics(cleaned: DataFrame) -> DataFrame:
    """One row per source: rows, masks by kind, undated rows, refused URLs."""
    return cleaned.groupBy("source").agg(
        F.count("*").alias("rows"),
        *[F.sum(f"mask_counts.{k}").alias(f"masked_{k}") for k in C.MASKS],
        F.count_if(F.col("published_at").isNull()).alias("undated"),
        F.count_if(F.col("source_url").isNull()).alias("invalid_url"),
    )


def _kept(dtype: T.StructType):
    return [f for f in dtype.fields if f.name not in C.MODEL_FORBIDDEN_KEYS]


def _scrub(col: Column, dtype: T.DataType, strings) -> Column:
    """Rebuild a value by its schema: forbidden fields and map keys go, strings pass through ``strings``, at any depth."""
    if isinstance(dtype, T.StringType):
        return strings(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _scrub(x, dtype.elementType, strings))
    if isinstance(dtype, T.MapType):
        allowed = F.map_filter(col, lambda k, v: ~k.isin(*C.MODEL_FORBIDDEN_KEYS)) if isinstance(dtype.keyType, T.StringType) else col
        return F.transform_values(allowed, lambda k, v: _scrub(v, dtype.valueType, strings))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_scrub(col[f.name], f.dataType, strings).alias(f.name) for f in _kept(dtype)]))
    return col


def _nested_strings(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _nested_strings(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _nested_strings(dtype.valueType)
    return isinstance(dtype, T.StructType) and any(_nested_strings(f.dataType) for f in _kept(dtype))


def _touched(dtype: T.DataType) -> bool:
    """Whether values of the type can hold anything that must go or be masked."""
    if isinstance(dtype, T.ArrayType):
        return _touched(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) or _touched(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return len(_kept(dtype)) < len(dtype.fields) or any(_touched(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.StringType)


def _all_strings(col: Column, dtype: T.DataType) -> Column:
    """All strings of a value that may pass, as one flat array."""
    none = F.array().cast("array<string>")
    if isinstance(dtype, T.StringType):
        return F.array(col)
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(col, lambda x: _all_strings(x, dtype.elementType))), none) if _nested_strings(dtype.elementType) else none
    if isinstance(dtype, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(col), lambda x: _all_strings(x, dtype.valueType))), none) if _nested_strings(dtype.valueType) else none
    if isinstance(dtype, T.StructType):
        parts = [_all_strings(col[f.name], f.dataType) for f in _kept(dtype) if _nested_strings(f.dataType)]
        return F.coalesce(F.concat(*parts), none) if parts else none
    return none


def model_boundary(df: DataFrame) -> DataFrame:
    """Projection for an outside model: identity and locator fields dropped, strings masked, in structs, arrays and maps too.

    Normalising may need Python, which lambdas over nested values cannot call. So the distinct strings of a nested value go through the same
    mask once, as one array, and the value is rebuilt by looking its strings up.
    """
    kept = [f for f in df.schema.fields if f.name not in C.MODEL_FORBIDDEN_KEYS]
    nested = [f for f in kept if not isinstance(f.dataType, T.StringType) and _touched(f.dataType)]
    plain_text = lambda c: F.when(c.isNotNull(), text.redact(c))
    out = df.select(*[plain_text(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in kept])
    if not nested:
        return out
    strings = F.array_distinct(F.array_compact(F.concat(*[_all_strings(F.col(f"`{f.name}`"), f.dataType) for f in nested])))
    plain = out.withColumn("_strings", strings).withColumn("_clean", text.normalize_all(F.col("_strings")))
    masked = plain.withColumn("_known", F.map_from_arrays("_strings", text.mask_all(F.col("_clean"))))
    look = lambda c: F.when(c.isNotNull(), F.element_at(F.col("_known"), c))
    return masked.select(*[(_scrub(F.col(f"`{f.name}`"), f.dataType, look) if f in nested else F.col(f"`{f.name}`")).alias(f.name) for f in kept])


def anonymized(items: DataFrame) -> DataFrame:
    """Payload rows: key, rating, time, masked text; forum rows add source, type and masked title."""
    forum = F.coalesce("source", F.lit("google_maps")) != "google_maps"
    rows = items.filter(F.coalesce("text", F.lit("")) != "").select(
        "report_id",
        F.col("id").alias("review_key"),
        "rating",
        "published_at",
        "text",
        F.when(forum, F.col("source")).alias("source"),
        F.when(forum, F.coalesce("content_type", F.lit("review"))).alias("content_type"),
        F.when(forum, F.coalesce("title", F.lit(""))).alias("thread_title"),
        "ordinal",
    )
    masked = text.add_masked(text.add_masked(rows, "text"), "thread_title", long=False)
    return masked.withColumn("thread_title", F.when(F.col("source").isNotNull(), F.col("thread_title")))
