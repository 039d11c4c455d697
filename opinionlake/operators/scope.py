"""The shared scope: one spec, one set of flag columns, one selection used by every analytic."""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates, segment, text

_EQUALS = ("source", "content_type", "board", "thread_source_id", "rating")
_TERM_GROUPS = ("any_terms", "all_terms", "exclude_terms")


@dataclasses.dataclass(frozen=True)
class Scope:
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    interval: str = "month"
    precision_policy: str = "all"
    source: str | None = None
    content_type: str | None = None
    sentiment: str | None = None
    aspect: str | None = None
    topic_key: str | None = None
    board: str | None = None
    channel_label: str | None = None
    thread_source_id: str | None = None
    review_id: str | None = None
    rating: int | None = None
    q: str | None = None
    any_terms: tuple[str, ...] = ()
    all_terms: tuple[str, ...] = ()
    exclude_terms: tuple[str, ...] = ()
    keyword: str | None = None

    def __post_init__(self):
        if self.interval not in C.ACCEPTED_PRECISION:
            raise ValueError(f"unknown interval {self.interval}")
        if self.date_from and self.date_to:
            days = (self.date_to - self.date_from).days
            if days < 0 or days > C.MAX_TREND_DAYS:
                raise ValueError("dates must be in order and at most 30 years apart")
        if self.rating is not None and not 1 <= self.rating <= 5:
            raise ValueError("rating is 1..5")
        for group in _TERM_GROUPS:
            terms = tuple(sorted({_fold(t.strip()) for t in getattr(self, group)}))
            if any(not t or len(t) > 100 for t in terms) or len(terms) > 20:
                raise ValueError(f"{group}: at most 20 terms of 1 to 100 characters")
            object.__setattr__(self, group, terms)

    def with_(self, **changes) -> Scope:
        return dataclasses.replace(self, **changes)

    def as_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True, ensure_ascii=False, default=str)


def _fold(value: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", value).casefold()


def item_text() -> Column:
    """Folded title and text, the string every term test looks at."""
    blank = F.lit("")
    return text.fold(F.concat_ws(" ", F.coalesce("title", blank), F.coalesce("text", blank)))


def channel() -> Column:
    """Channel label, else board, else the fixed 'no channel' label ('' counts as missing)."""
    return F.coalesce(F.expr("nullif(channel_label, '')"), F.expr("nullif(board, '')"), F.lit(C.NO_CHANNEL))


def sentiment() -> Column:
    return F.coalesce("sentiment", F.lit("unknown"))


def complaint() -> Column:
    """Negative, or with a negative aspect, and with text."""
    hit = (F.col("sentiment") == "negative") | (F.size("negative_aspects") > 0)
    return F.coalesce(hit, F.lit(False)) & ~text.is_blank(F.col("text"))


def _conditions(scope: Scope) -> list[Column]:
    tests = []
    if scope.channel_label:
        tests.append(channel() == scope.channel_label)
    for field in _EQUALS:
        if getattr(scope, field) is not None:
            tests.append(F.col(field) == getattr(scope, field))
    if scope.review_id:
        tests.append(F.col("id") == scope.review_id)
    if scope.sentiment:
        tests.append(sentiment() == scope.sentiment)
    if scope.aspect:
        tests.append(F.array_contains("aspects", scope.aspect))
    if scope.topic_key:
        tests.append(F.array_contains("topic_keys", scope.topic_key))
    if scope.q:
        tests.append(F.contains(F.coalesce("text", F.lit("")), F.lit(scope.q)))
    if _reads_text(scope):
        # All tests on the folded text hang on one lambda variable, so it is built once a row, not once a term.
        tests.append(F.exists(F.array("_folded"), lambda folded: _text_tests(scope, folded)))
    if scope.keyword:
        tests.append(F.array_contains("_tokens", _fold(scope.keyword)))
    return tests


def _reads_text(scope: Scope) -> bool:
    return any(getattr(scope, g) for g in _TERM_GROUPS)


def _text_tests(scope: Scope, folded: Column) -> Column:
    has = lambda t: F.contains(folded, F.lit(t))
    tests = [has(t) for t in scope.all_terms] + [~has(t) for t in scope.exclude_terms]
    if scope.any_terms:
        tests.append(functools.reduce(lambda a, b: a | b, [has(t) for t in scope.any_terms]))
    return functools.reduce(lambda a, b: a & b, tests)


def brand_terms(items: DataFrame) -> Column | None:
    """The report's brand names, where the rows carry them."""
    return F.col("brand_terms") if "brand_terms" in items.columns else None


def _folded(items: DataFrame, scope: Scope, tokenizer: segment.Tokenizer) -> DataFrame:
    df = items.withColumn("_folded", item_text()) if _reads_text(scope) or scope.keyword else items
    return df.withColumn("_tokens", tokenizer.tokens(F.col("_folded"), brand_terms(items))) if scope.keyword else df


def _date_flags(scope: Scope) -> dict[str, Column]:
    """Range, unknown-date and precision tests over ``_day``; precision is judged after the range."""
    inside = F.lit(True)
    if scope.date_from:
        inside = inside & (F.col("_day").isNull() | (F.col("_day") >= F.lit(scope.date_from)))
    if scope.date_to:
        inside = inside & (F.col("_day").isNull() | (F.col("_day") <= F.lit(scope.date_to)))
    strict = scope.precision_policy == "interval"
    undated = F.col("_day").isNull() if (scope.date_from or scope.date_to or strict) else F.lit(False)
    accepted = F.coalesce(F.col("date_precision").isin(*C.ACCEPTED_PRECISION[scope.interval]), F.lit(False))
    return {"inside": inside, "undated": undated, "imprecise": ~undated & ~accepted if strict else F.lit(False)}


def flag(items: DataFrame, scope: Scope, tokenizer: segment.Tokenizer = segment.DEFAULT) -> DataFrame:
    """Rows passing every non-date test, with ``_day``, ``_unknown_date``, ``_imprecise``, ``_kept``.

    Known dates outside the range drop without being counted.
    """
    df = _folded(items, scope, tokenizer)
    for test in _conditions(scope):
        df = df.filter(F.coalesce(test, F.lit(False)))
    df = df.drop("_folded", "_tokens").withColumn("_day", dates.local_day(F.col("published_at")))
    flags = _date_flags(scope)
    return df.filter(flags["inside"]).withColumns(
        {"_unknown_date": flags["undated"], "_imprecise": flags["imprecise"], "_kept": ~flags["undated"] & ~flags["imprecise"]}
    )


def select(items: DataFrame, scope: Scope, tokenizer: segment.Tokenizer = segment.DEFAULT) -> DataFrame:
    """The rows of the scope. Snapshot items are already unique per (report_id, id)."""
    flagged = flag(items, scope, tokenizer).filter("_kept")
    return flagged.drop("_day", "_unknown_date", "_imprecise", "_kept")


def dedup(versions: DataFrame, keys=("report_id", "id"), order: str = "ordinal") -> DataFrame:
    """Last version per id, kept at the position of the first.

    Aggregated, not windowed: every task folds its own versions before the shuffle, so an id with
    very many versions costs one row per task.
    """
    rest = [c for c in versions.columns if c not in (*keys, order)]
    last = F.max_by(F.struct(*rest), order).alias("_last")
    return (
        versions.groupBy(*keys)
        .agg(last, F.min(order).alias(order))
        .select(*[f"_last.{c}" if c in rest else c for c in versions.columns])
    )


def counts(versions: DataFrame, scope: Scope, keys=("report_id",), tokenizer: segment.Tokenizer = segment.DEFAULT) -> DataFrame:
    """Raw, deduplicated, included and excluded counts per report in one pass over the versions.

    Whether a version is in scope depends on that version alone, so it shrinks to one small outcome
    number before anything moves; the last version's outcome per id is a partial aggregate.
    """
    df = _folded(versions, scope, tokenizer).withColumn("_day", dates.local_day(F.col("published_at")))
    flags = _date_flags(scope)
    passes = functools.reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), _conditions(scope), flags["inside"])
    outcome = F.when(~passes, 0).when(flags["undated"], 1).when(flags["imprecise"], 2).otherwise(3)
    per_id = df.groupBy(*keys, "id").agg(F.max_by(outcome, "ordinal").alias("_outcome"), F.count("*").alias("_copies"))
    return per_id.groupBy(*keys).agg(
        F.sum("_copies").alias("raw_count"),
        F.count("*").alias("deduplicated_count"),
        F.count_if(F.col("_outcome") == 3).alias("included_count"),
        F.count_if(F.col("_outcome") == 1).alias("unknown_date_count"),
        F.count_if(F.col("_outcome") == 2).alias("imprecise_date_count"),
        F.count_if(F.col("_outcome").isin(1, 2)).alias("excluded_count"),
    )


def digest(items: DataFrame, columns, keys=("report_id",)) -> DataFrame:
    """Order-free content fingerprint per report: sums of digest words, mergeable in any order."""
    words = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]))
    parts = [F.conv(F.substring("_md5", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    sums = items.withColumn("_md5", words).groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)]
    )
    key = F.sha2(F.concat_ws("|", "_n", *[f"_s{i}" for i in range(4)]), 256)
    return sums.select(*keys, key.alias("content_digest"))


def scope_key(report: Column, digest_col: Column, scope_json: str, version: int = 4) -> Column:
    return F.substring(
        F.sha2(F.concat_ws("|", report, F.lit(str(version)), digest_col, F.lit(scope_json)), 256), 1, 24
    )


#: Fields that make up an item's content in a digest.
CONTENT = ("id", "source", "sentiment", "text")


def with_scope_key(rows: DataFrame, items: DataFrame, scope: Scope, member: Column | None = None, version: int = 4) -> DataFrame:
    """``rows`` of a report with the key of their scope, equal to that of the report's ``scope_rows``.

    ``member`` (a topic or brand name) narrows the scope; it is put behind the scope's filters.
    """
    filters = F.lit(scope.as_json()) if member is None else F.concat_ws("|", F.lit(scope.as_json()), member)
    digests = digest(items, list(CONTENT)).select(F.col("report_id").alias("_report"), "content_digest")
    keyed = rows.join(digests, F.col("report_id") == F.col("_report"), "left")
    text_key = F.concat_ws("|", "report_id", F.lit(str(version)), "content_digest", filters)
    return keyed.withColumn("scope_key", F.substring(F.sha2(text_key, 256), 1, 24)).drop("_report", "content_digest")


def unavailable(items: DataFrame, columns, keys=("report_id",)) -> DataFrame:
    """Metadata columns no row of the report provides."""
    missing = F.array_compact(F.array(*[F.when(F.count(c) == 0, c) for c in columns]))
    return items.groupBy(*keys).agg(missing.alias("unavailable_fields"))


def scope_rows(items: DataFrame, scope: Scope, metadata, content, basis: str = "snapshot", version: int = 4) -> DataFrame:
    """The reconciliation record of each report: filters, counts, basis, missing fields, scope key."""
    rows = counts(items, scope).join(unavailable(items, metadata), "report_id").join(digest(items, content), "report_id")
    text_filters = scope.as_json()
    return rows.withColumns(
        {
            "filters": F.lit(text_filters),
            "data_basis": F.lit(basis),
            "snapshot_version": F.lit(version).cast("bigint"),
            "scope_key": scope_key(F.col("report_id"), F.col("content_digest"), text_filters, version),
        }
    ).drop("content_digest")
