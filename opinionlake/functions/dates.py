"""Local days, buckets, and parsing of relative and absolute times."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionlake import constants as C

_STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def local_day(ts: Column) -> Column:
    """Calendar day at the fixed UTC+8 offset (session zone is UTC)."""
    return F.to_date(ts + F.expr(f"INTERVAL {C.LOCAL_OFFSET_HOURS} HOURS"))


def bucket(day: Column, interval: str) -> Column:
    """The day itself, the Monday of its week, or the first of its month."""
    return day if interval == "day" else F.trunc(day, interval)


def next_bucket(day: Column, interval: str) -> Column:
    """The start of the bucket after the one that holds the day."""
    if interval == "month":
        return F.add_months(F.trunc(day, "month"), 1)
    return F.date_add(bucket(day, interval), 1 if interval == "day" else 7)


def calendar_of_year(start: Column, end: Column, year: Column, interval: str) -> Column:
    """Array of the bucket starts of [start, end] that fall into a year."""
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    first = F.when(bucket(new_year, interval) == new_year, new_year).otherwise(next_bucket(new_year, interval))
    low, high = F.greatest(bucket(start, interval), first), F.least(end, F.make_date(year, F.lit(12), F.lit(31)))
    return F.when(low <= high, F.sequence(low, F.greatest(low, high), F.expr(_STEP[interval]))).otherwise(F.array().cast("array<date>"))


def iso_week(day: Column) -> Column:
    """ISO year-week such as 2024-01."""
    year = F.extract(F.lit("YEAROFWEEK"), day)
    return F.concat_ws("-", year.cast("string"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.when(key != "", key))


def relative(value: Column, now: Column) -> Column:
    """'2 週前' / 'a month ago' / '剛剛' -> struct(at, precision) relative to ``now``."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    text = F.regexp_replace(text, "edited|已編輯", "")

    def group(index: int) -> Column:
        english = F.regexp_extract(text, C.RELATIVE_EN, index)
        chinese = F.regexp_extract(text, C.RELATIVE_ZH, index)
        return F.when(english != "", english).otherwise(chinese)

    word, unit = group(1), group(2)
    amount = (
        F.when(word.isin("a", "an", "一"), 1)
        .when(word == "幾", 2)
        .otherwise(F.coalesce(word.try_cast("bigint"), F.lit(1)))
    )
    instant = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in C.RELATIVE_NOW])
    matched = unit != ""
    minutes = (
        F.when(instant, F.when(matched, amount).otherwise(0))
        .when(matched, amount * _lookup(unit, C.UNIT_MINUTES))
    )
    precision = (
        F.when(instant, F.lit("day"))
        .when(matched, _lookup(unit, C.UNIT_PRECISION))
        .otherwise(F.lit("unknown"))
    )
    at = F.timestamp_micros(F.unix_micros(now) - minutes * 60_000_000)
    return F.struct(at.alias("at"), precision.alias("precision"))


_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(Z|[+-]\d{2}:?\d{2})?$"
_RFC = (
    r"^(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2}(?::\d{2})?)"
    r"(?:\s+([+-]\d{4}|GMT|UTC|UT|Z))?$"
)
_CTIME = r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})$"


def _zone(raw: Column, default: str) -> Column:
    plain = F.regexp_replace(raw, r"^([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(raw.isin("Z", "GMT", "UTC", "UT"), F.lit("+00:00")).when(raw == "", F.lit(default)).otherwise(plain)


def absolute(value: Column, naive_offset: str = "+00:00") -> Column:
    """ISO-8601 or RFC-2822 (also the weekday-month-day form) to a UTC instant; else null."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    clock = F.regexp_extract(text, _ISO, 2)
    clock = F.when(clock == "", F.lit("00:00:00")).when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    iso = F.concat(
        F.regexp_extract(text, _ISO, 1), F.lit("T"), clock, _zone(F.regexp_extract(text, _ISO, 3), naive_offset)
    )

    months = {m: f"{i:02d}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

    def compose(pattern: str, day: int, month: int, year: int, at: int, zone: Column) -> Column:
        clock = F.regexp_extract(text, pattern, at)
        clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
        return F.concat(
            F.regexp_extract(text, pattern, year),
            F.lit("-"),
            _lookup(F.lower(F.regexp_extract(text, pattern, month)), months),
            F.lit("-"),
            F.lpad(F.regexp_extract(text, pattern, day), 2, "0"),
            F.lit("T"),
            clock,
            zone,
        )

    rfc = compose(_RFC, 1, 2, 3, 4, _zone(F.regexp_extract(text, _RFC, 5), naive_offset))
    ctime = compose(_CTIME, 2, 1, 4, 3, F.lit(naive_offset))
    chosen = F.when(text.rlike(_ISO), iso).when(text.rlike(_RFC), rfc).when(text.rlike(_CTIME), ctime)
    return F.try_to_timestamp(chosen)
