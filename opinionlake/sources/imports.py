"""Bulk import files: reading, row checks, conflicts, all-or-nothing, projection to items."""

from __future__ import annotations

import csv
import itertools
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates, identity, text, values
from opinionlake.operators import ranks
from opinionlake.session import cut_lineage, stored
from opinionlake.sources import splitcsv, splitjson

_ROW = ", ".join(f"{f} string" for f in C.IMPORT_FIELDS)
#: Rows of a file that are handed on at once.
ROWS = 10_000
#: Bytes of a CSV file that one task reads at a time.
RANGE_BYTES = 64 << 20
#: What opening a file costs, in bytes that could be read instead.
OPEN_BYTES = 1 << 20
#: Bytes in which a header of the fixed field names, quoted or not, must end.
HEADER_BYTES = 4096
#: Half of a character pair, which only an escape in JSON can give; no table holds it.
_LONE = re.compile("[\ud800-\udfff]")
#: Faults of a JSON file, the gravest first: a file gets the first that any of its ranges has.
JSON_FAULTS = ("not_utf8", "bad_json", "not_a_list", "bad_fields")
_SCHEMA = f"file string, row_no bigint, file_error string, {_ROW}"


def _cell(value, field: str):
    """String as is; other JSON values are marked, so the row check can refuse them."""
    if value is None or isinstance(value, str) and not _LONE.search(value):
        return value
    if field == "reaction_count" and type(value) is int:
        return str(value)
    return "\u0000" + json.dumps(value)


_COLUMNS = ["file", "row_no", "file_error", *C.IMPORT_FIELDS]


def _bad(name: str, error: str) -> pd.DataFrame:
    return pd.DataFrame([[name, 0, error, *[None] * len(C.IMPORT_FIELDS)]], columns=_COLUMNS)


def _tables(name: str, rows: Iterator[list], first: int) -> Iterator[pd.DataFrame]:
    for at, part in enumerate(iter(lambda: list(itertools.islice(rows, ROWS)), [])):
        yield pd.DataFrame([[name, i, None, *row] for i, row in enumerate(part, first + at * ROWS)], columns=_COLUMNS)


def read_files(spark: SparkSession, path: str, kind: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of all CSV/JSON import files below ``path``, or one row with ``file_error`` per bad file.

    The type follows the file name unless ``kind`` names it (".csv", ".json"). No file, row or text is refused for its size;
    files are read in ranges of ``range_bytes``. Spark does not list files of no bytes; they give nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.lit(kind) if kind else F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kinds = files.withColumn("_kind", ending)
    unknown = kinds.filter(~F.col("_kind").isin(".csv", ".json")).select(
        F.col("path").alias("file"), F.lit(0).cast("bigint").alias("row_no"), F.lit("unknown_type").alias("file_error"),
        *[F.lit(None).cast("string").alias(f) for f in C.IMPORT_FIELDS],
    )
    return _read_json(kinds.filter("_kind = '.json'"), range_bytes).unionByName(_read_csv(kinds.filter("_kind = '.csv'"), range_bytes)).unionByName(unknown)


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    return stored(files.select(F.col("path").alias("file"), "length", F.explode(starts).alias("start")), "ranges")


def _tasks(ranges: DataFrame) -> int:
    """How many tasks read the ranges. Told by bytes in the files: the adaptive plan only sees names and would give all of them to one task."""
    spark = ranges.sparkSession
    size = F.least(F.col("length") - F.col("start"), F.lit(RANGE_BYTES).cast("bigint")) + OPEN_BYTES
    total = ranges.agg(F.sum(size)).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES)) if total else 1


def _per_file(ranges: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the ranges of each file in order; a range is a few numbers."""
    packed = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in ranges.columns if c not in ("file", "start")]))).alias("ranges"))
    return packed.select("file", F.inline(F.udf(work, f"array<struct<{schema}>>", useArrow=False)("ranges")))


def _read_json(files: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges are judged and composed per file, the list is located, then each range parses the elements that begin in it.

    The list is the file itself or the last member "items" of an outer object. A file with any fault gives one error row and no others.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                whole = _bytes(row.file, row.start, range_bytes + 3)
                data, ahead = whole[:range_bytes], whole[range_bytes:]
                sound = splitcsv.valid_utf8(data, ahead, row.start == 0)
                skip = len(splitcsv.BOM) if row.start == 0 and data.startswith(splitcsv.BOM) else 0
                place, root = splitjson.lead(data[skip:])
                maps = [v for m in splitjson.outcomes(data[skip:]) for v in m]
                at = row.start + skip + place if place >= 0 else -1
                out.append([row.file, row.length, row.start, sound, at, root, maps])
            yield pd.DataFrame(out, columns=["file", "length", "start", "sound", "at", "root", "maps"])

    ranges = _ranges(files, range_bytes)
    tasks = _tasks(ranges)
    spread_out = lambda df: df.repartition(tasks, "file", "start")
    judged = stored(spread_out(ranges).mapInPandas(judge, "file string, length bigint, start bigint, sound boolean, at bigint, root string, maps array<bigint>"), "json-ranges")

    def settle(part: list) -> list[tuple]:
        placed = splitjson.compose([[tuple(r.maps[i : i + 3]) for i in range(0, len(r.maps), 3)] for r in part])
        sound = all(r.sound for r in part)
        root, at = next(((r.root, r.at) for r in part if r.at >= 0), ("", -1))
        return [(r.length, r.start, *p, sound, root, at) for r, p in zip(part, placed, strict=True)]

    placed = "length bigint, start bigint, state bigint, depth bigint, low bigint, sound boolean, root string, at bigint"
    settled = spread_out(_per_file(judged, settle, placed))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = []
            for row in batch.itertuples():
                place, shut = -1, False
                if row.root == "{":
                    data = _bytes(row.file, row.start, range_bytes + splitjson.NAME_BYTES)
                    size = min(range_bytes, len(data))
                    place, shut = splitjson.member(data, size, row.state, row.depth, "items", lambda n, r=row: _bytes(r.file, r.start, n))
                elif row.root == "[" and row.start <= row.at < row.start + range_bytes:
                    place, shut = row.at - row.start, row.low <= 0
                marks.append((row.start + place if place >= 0 else place, shut))
            yield batch.assign(mark=[m for m, _ in marks], shut=[s for _, s in marks])

    marked = stored(settled.mapInPandas(mark, "file string, " + placed + ", mark bigint, shut boolean"), "json-marks")

    def locate(part: list) -> list[tuple]:
        level = 1 if part[0].root == "[" else 2
        named = [i for i, r in enumerate(part) if r.mark != -1]
        # The bracket may stand in a later range than the member's name.
        bracket = part[named[-1]].mark if named else -1
        holder = max(i for i, r in enumerate(part) if r.start <= bracket) if bracket >= 0 else -1
        ends = [i for i in range(holder + 1, len(part)) if part[i].low < level] if holder >= 0 else []
        # No bracket stands between a name and its list, so a holder behind the name's range holds no other before it.
        shut = holder >= 0 and (part[holder].shut if holder == named[-1] else part[holder].low < level)
        last = holder if shut else ends[0] if ends else -1
        never = last == -1 and holder >= 0
        return [(r.length, r.start, r.state, r.depth, r.sound, level, bracket, 0 <= holder <= i <= last, never, i == holder) for i, r in enumerate(part)]

    located = _per_file(
        marked, locate, "length bigint, start bigint, state bigint, depth bigint, sound boolean, level bigint, bracket bigint, within boolean, open boolean, first boolean"
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                for rows in _json_rows(row, range_bytes):
                    yield rows.assign(start=row.start)

    parsed = stored(spread_out(located).mapInPandas(parse, _SCHEMA + ", start bigint"), "json-rows")
    grave = F.array_position(F.array(*[F.lit(f) for f in JSON_FAULTS]), F.col("file_error"))
    faults = parsed.filter("file_error is not null").groupBy("file").agg(F.min_by("file_error", grave).alias("file_error"))
    good = parsed.filter("file_error is null")
    counts = good.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    held = counts.select("file").distinct().withColumn("_held", F.lit(1))
    named = files.select(F.col("path").alias("file")).join(faults, "file", "left").join(held, "file", "left").filter("file_error is not null or _held is null").select(
        "file", F.lit(0).cast("bigint").alias("row_no"), F.coalesce("file_error", F.lit("empty")).alias("file_error"),
        *[F.lit(None).cast("string").alias(f) for f in C.IMPORT_FIELDS],
    )
    numbered = good.join(offsets, ["file", "start"]).withColumn("row_no", F.col("row_no") + F.col("_before"))
    return numbered.join(faults.select("file"), "file", "left_anti").select(*_COLUMNS).unionByName(named)


def _around(data: bytes) -> str | None:
    """Fault of a file without the elements of its list."""
    try:
        value = json.loads(data.decode("utf-8-sig"))
    except (ValueError, RecursionError):
        return "bad_json"
    return None if isinstance(value.get("items") if isinstance(value, dict) else value, list) else "not_a_list"


def _json_rows(row, range_bytes: int) -> Iterator[pd.DataFrame]:
    """Rows of the elements that begin in a range, numbered from 1, then the gravest fault found in it."""
    if not row.sound:
        if row.start == 0:
            yield _bad(row.file, "not_utf8")
        return
    if row.bracket < 0 or row.open:  # no list, or one that never ends
        if row.start == 0:
            yield _bad(row.file, "bad_json" if row.open else _around(_bytes(row.file, 0, row.length)) or "bad_json")
        return
    if not row.within:
        return
    data = _bytes(row.file, row.start, range_bytes)
    found, begin, close = splitjson.elements(data, row.state, row.depth, row.level, row.bracket - row.start if row.first else -1)
    faults = set()
    if close >= 0:
        faults.add(_around(_bytes(row.file, 0, row.bracket + 1) + _bytes(row.file, row.start + close, row.length - row.start - close)))
    texts = (data[a:b] for a, b in found)
    ended = close
    if begin >= 0:
        rest, reach = data[begin:], 1 << 16
        while True:
            more = _bytes(row.file, row.start + begin + len(rest), reach)
            rest, reach = rest + more, reach * 2
            parts, _, shut = splitjson.elements(b"[" + rest, splitjson.OUTSIDE, 0, 1, 0)
            if parts or not more:
                break
        if not parts:
            yield _bad(row.file, "bad_json")
            return
        ended = row.start + begin + shut - 1 if len(parts) == 1 and shut >= 0 else -1
        texts = itertools.chain(texts, [rest[: parts[0][1] - 1]])
    # White space alone between the two brackets is an empty list, elsewhere a fault.
    sole = row.first and len(found) + (begin >= 0) == 1 and ended >= 0

    def rows():
        for text_ in texts:
            if sole and not text_.strip(b" \t\n\r"):
                continue
            try:
                value = json.loads(text_.decode("utf-8"))
            except (ValueError, RecursionError):
                faults.add("bad_json")
                return
            if not isinstance(value, dict):
                faults.add("not_a_list")
            elif set(value) != set(C.IMPORT_FIELDS):
                faults.add("bad_fields")
            elif not faults - {None}:
                yield [_cell(value[f], f) for f in C.IMPORT_FIELDS]

    yield from _tables(row.file, rows(), 1)
    faults.discard(None)
    if faults:
        yield _bad(row.file, min(faults, key=JSON_FAULTS.index))


def _bytes(name: str, start: int, size: int) -> bytes:
    from pyarrow import fs

    # Spark names files by plain paths, a URI holds blanks and signs escaped.
    system, place = fs.FileSystem.from_uri(quote(name, safe="/:@"))
    with system.open_input_file(place) as file:
        file.seek(start)
        return file.read(size)


def _read_csv(files: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges are judged, their maps composed per file (a few bytes a range), then parsed; a file with any fault gives no rows."""
    ranges = _ranges(files, range_bytes)
    tasks = _tasks(ranges)
    spread_out = lambda df: df.repartition(tasks, "file", "start")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                whole = _bytes(row.file, row.start, range_bytes + 3)
                data, ahead = whole[:range_bytes], whole[range_bytes:]
                if row.start == 0 and data.startswith(splitcsv.BOM):
                    data = data[len(splitcsv.BOM) :]
                maps = splitcsv.outcomes(data, ahead[:1])
                out.append([row.file, row.start, splitcsv.valid_utf8(data, ahead, row.start == 0), [int(v) for o in maps for v in o]])
            yield pd.DataFrame(out, columns=["file", "start", "sound", "maps"])

    judged = stored(spread_out(ranges).mapInPandas(judge, "file string, start bigint, sound boolean, maps array<bigint>"), "csv-ranges")

    def settle(part: list) -> list[tuple]:
        placed = splitcsv.compose([[tuple(r.maps[i : i + 3]) for i in range(0, len(r.maps), 3)] for r in part])
        sound = all(r.sound for r in part)
        return [(r.start, *p, sound) for r, p in zip(part, placed, strict=True)]

    settled = _per_file(judged, settle, "start bigint, first bigint, before bigint, sound boolean")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if not row.sound:
                    if row.start == 0:
                        yield _bad(row.file, "not_utf8")
                    continue
                yield from _range_rows(row.file, row.start, row.first, row.before, range_bytes)

    parsed = stored(spread_out(settled).mapInPandas(parse, _SCHEMA), "csv-rows")
    faults = parsed.filter("file_error is not null").groupBy("file").agg(F.min("file_error").alias("file_error"))
    held = parsed.filter("file_error is null").groupBy("file").agg(F.lit(1).alias("_held"))
    all_faults = files.select(F.col("path").alias("file")).join(faults, "file", "left").join(held, "file", "left")
    named = all_faults.filter("file_error is not null or _held is null").select(
        "file", F.lit(0).cast("bigint").alias("row_no"), F.coalesce("file_error", F.lit("empty")).alias("file_error"),
        *[F.lit(None).cast("string").alias(f) for f in C.IMPORT_FIELDS],
    )
    return parsed.filter("file_error is null").join(faults.select("file"), "file", "left_anti").unionByName(named)


def _head(name: str) -> list[str] | None:
    """The first record; of a file whose first record is no header only as much is read as a header could take."""
    data = _bytes(name, 0, HEADER_BYTES).removeprefix(splitcsv.BOM)
    _, end = splitcsv.record_end(data, splitcsv.RECORD)
    try:
        return next(splitcsv.records(data[:end]), None)
    except (UnicodeDecodeError, csv.Error):
        return None


def _range_rows(name: str, start: int, first: int, before: int, range_bytes: int) -> Iterator[pd.DataFrame]:
    """Rows of the records that begin in a range. The header is record 0 of the file and counts among those before."""
    header = _head(name)
    if sorted(header or []) != sorted(C.IMPORT_FIELDS):
        if start == 0:
            yield _bad(name, "bad_header")
        return
    if first < 0:
        return
    data = _bytes(name, start, range_bytes)
    if start == 0:
        data = data.removeprefix(splitcsv.BOM)
    data = data[first:]
    end, reach = start + range_bytes, 1 << 16
    state = splitcsv.end_state(data)
    while state != splitcsv.RECORD and (more := _bytes(name, end, reach)):
        state, used = splitcsv.record_end(more, state)
        data, end, reach = data + more[:used], end + len(more), reach * 2
    places = [header.index(f) for f in C.IMPORT_FIELDS]
    try:
        rows = list(splitcsv.records(data))
    except csv.Error:
        yield _bad(name, "bad_csv")
        return
    if before == 0:
        rows = rows[1:]
    if any(len(row) > len(header) for row in rows):
        yield _bad(name, "bad_fields")
        return
    # Short rows are filled with nulls; data rows are numbered from 2.
    filled = (row + [None] * (len(header) - len(row)) for row in rows)
    yield from _tables(name, ([row[p] for p in places] for row in filled), max(before, 1) + 1)


_INTEGER = r"^-?[0-9]+$"


def check_rows(rows: DataFrame) -> DataFrame:
    """Normalised fields plus ``error``: the first rule a row breaks, or null."""
    clean = {
        "item_type": F.lower(text.normalize(F.col("item_type"))),
        "text": text.normalize(F.col("text")),
        "_url": identity.canonical_article(F.col("source_url")),
        "published_at": F.trim(F.coalesce("published_at", F.lit(""))),
        "thread_id": text.normalize(F.col("thread_id")),
        "forum": F.lower(text.normalize(F.col("forum"))),
        "source_item_id": text.normalize(F.col("source_item_id")),
        "parent_id": F.nullif(text.normalize(F.col("parent_id")), F.lit("")),
        "title": F.nullif(text.normalize(F.col("title")), F.lit("")),
        "_reaction": F.trim(F.coalesce("reaction_count", F.lit(""))),
    }
    marked = [F.coalesce(F.col(f).startswith("\u0000"), F.lit(False)) for f in C.IMPORT_FIELDS]
    flagged = rows.withColumn("_marked", F.array_contains(F.array(*marked), True))
    df = flagged.withColumns(clean)
    url = F.col("_url.url")
    df = df.withColumns(
        {"_forum": F.regexp_extract(url, r"/f/([^/]+)/p/", 1), "_thread": F.regexp_extract(url, r"/p/([0-9]+)$", 1)}
    )
    post, own = F.col("item_type") == "post", F.col("source_item_id")
    instant = dates.absolute(F.col("published_at"))
    iso = F.col("published_at").rlike(r"^\d{4}-\d{2}-\d{2}")
    checks = [
        (F.col("_marked"), "wrong_type"),
        (~F.col("item_type").isin("post", "comment"), "item_type"),
        (F.col("text") == "", "text"),
        (F.col("_url.reason").isNotNull(), "source_url"),
        (~iso | instant.isNull(), "published_at"),
        (~post & (F.col("thread_id") == ""), "thread_missing"),
        ((F.col("thread_id") != "") & (F.col("thread_id") != F.col("_thread")), "thread_mismatch"),
        ((F.col("forum") != "") & (F.col("forum") != F.col("_forum")), "forum_mismatch"),
        (post & (own != "") & (own != F.col("_thread")), "post_id"),
        (~post & (own == F.col("_thread")), "comment_id"),
        ((F.col("_reaction") != "") & ~F.col("_reaction").rlike(_INTEGER), "reaction_type"),
        (F.col("_reaction").startswith("-") & ~F.col("_reaction").rlike("^-0+$"), "reaction_negative"),
    ]
    error = F.coalesce(*[F.when(bad, code) for bad, code in checks])
    return df.withColumns(
        {
            "error": error,
            "source_url": url,
            "forum": F.col("_forum"),
            "thread_id": F.col("_thread"),
            "source_item_id": F.when(post, F.col("_thread")).otherwise(F.nullif(own, F.lit(""))),
            "reaction_count": F.when(F.col("_reaction") == "", F.lit(0)).otherwise(F.col("_reaction").try_cast("bigint")).cast("bigint"),
        }
    ).drop("_url", "_forum", "_thread", "_reaction", "_marked")


_CONTENT = ("item_type", "source_item_id", "thread_id", "parent_id", "title", "text", "published_at", "forum", "source_url", "author_hash", "reaction_count")


def check_conflicts(rows: DataFrame) -> DataFrame:
    """Mark forum and identity conflicts and drop exact repeats.

    ``rows`` passed through ``check_rows`` and carries ``author_hash``. Every row is compared with the
    first accepted row of its thread and of its identity; both firsts are grouped minima.
    """
    rows = cut_lineage(rows)  # read three times below; the text checks run once
    good = rows.filter("error is null")
    forums = good.groupBy("file", "thread_id").agg(F.min_by("forum", "row_no").alias("_first_forum"))
    fallback = F.concat_ws("\u0001", "source_url", "item_type", "published_at", "text")
    key = F.when(F.col("source_item_id").isNotNull(), F.concat(F.lit("i"), "source_item_id")).otherwise(F.concat(F.lit("f"), F.md5(fallback)))
    body = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in _CONTENT]))
    tagged = rows.withColumns({"_key": key, "_body": body}).join(forums, ["file", "thread_id"], "left")
    split = F.col("error").isNull() & (F.col("forum") != F.col("_first_forum"))
    tagged = tagged.withColumn("error", F.when(split, "thread_in_two_forums").otherwise(F.col("error")))
    firsts = tagged.filter("error is null").groupBy("file", "_key").agg(
        F.min_by("_body", "row_no").alias("_first_body"), F.min("row_no").alias("_first_row")
    )
    joined = tagged.join(firsts, ["file", "_key"], "left")
    ok, same = F.col("error").isNull(), F.col("_body") == F.col("_first_body")
    repeat = ok & same & (F.col("row_no") > F.col("_first_row"))
    out = joined.withColumn("error", F.when(ok & ~same, "identity_conflict").otherwise(F.col("error")))
    return out.filter(~F.coalesce(repeat, F.lit(False))).drop("_key", "_body", "_first_forum", "_first_body", "_first_row")


def file_report(checked: DataFrame, shown: int = 20) -> DataFrame:
    """Per file: rows, errors, the first messages and how many more there are."""
    totals = checked.groupBy("file").agg(F.count("*").alias("rows"), F.count("error").alias("errors"))
    first = ranks.top_rows(checked.filter("error is not null").select("file", "row_no", "error"), ["file"], [F.col("row_no")], shown)
    packed = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row_no", "error"))).alias("_m"))
    message = F.array_join(F.transform("_m", lambda m: F.concat(m["row_no"].cast("string"), F.lit(":"), m["error"])), ";")
    return totals.join(packed, "file", "left").select(
        "file", "rows", "errors", F.coalesce(message, F.lit("")).alias("messages"), F.greatest(F.col("errors") - shown, F.lit(0)).alias("more")
    )


def accepted(checked: DataFrame) -> DataFrame:
    """Rows of files without any error."""
    bad = checked.filter("error is not null").select("file").distinct()
    return checked.join(bad, "file", "left_anti").drop("error")


def to_items(rows: DataFrame) -> DataFrame:
    """Accepted import rows as collected items."""
    post = F.col("item_type") == "post"
    own_hash = identity.content_hash(F.lit("dcard-import"), F.col("source_url"), F.col("item_type"), F.col("published_at"), F.col("text"))
    at = dates.absolute(F.col("published_at"), "+08:00")
    df = rows.withColumns({"_hash": own_hash, "_at": at})
    item_id = F.when(post, F.col("thread_id")).otherwise(F.coalesce("source_item_id", "_hash"))
    df = df.withColumn("id", item_id)
    return df.select(
        F.lit("dcard").alias("source"),
        F.col("item_type").alias("content_type"),
        "id",
        F.when(post, F.array("_hash")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.col("thread_id").alias("thread_source_id"),
        F.when(~post, F.coalesce("parent_id", "thread_id")).alias("parent_source_id"),
        identity.content_hash(F.lit("dcard"), F.col("id"), F.col("text")).alias("content_hash"),
        "author_hash",
        "title",
        F.col("forum").alias("board"),
        "text",
        F.col("_at").alias("published_at"),
        F.when(F.col("_at").isNotNull(), "day").otherwise("unknown").alias("date_precision"),
        "source_url",
        F.coalesce(values.counter(F.col("reaction_count")), F.lit(0)).alias("reaction_count"),
    )
