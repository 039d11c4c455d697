"""WARC archives with an externally merged capture index.

Each task writes records of its rows to gzip-per-record archives and, beside each archive, a run: the captures of that archive as lines sorted by (url key,
timestamp, id), with the byte offset of every ``EVERY``-th line; captures equal in these are ordered by the rest of the line. The runs are merged into one global order. Sampled keys of all runs are range partitioned
by Spark, which gives bounded key ranges; each range is one task that reads only its stretch of each run and merges the stretches with a loser tree: the root holds
the least line, and taking it replays one path of log2(k) comparisons. More than ``FAN`` runs are first merged in groups, level by level, so no
task opens more than that. The merged parts, in order, are the capture histories: by url key, then by time.

Of captures with the same payload the one with the largest id is the response; the others are revisit records that refer to it and carry its
digest and the payload's length but no payload. Digests are grouped as slim rows; a payload that a third of all pages share costs one partial aggregate.

Files get new names from each attempt and count through the tables that Spark writes, so lost executors do no harm.

A null payload is empty, a null url an empty one; a null timestamp is the epoch; null ids sort lowest, and among copies that all have no id every one is the response, as are repeated
rows of the largest id; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.llm import files
from opinionlake.llm.common import written
from opinionlake.session import scratch

FAN, EVERY = 64, 256
ARCHIVE = 32 << 20
#: The last second of the year 9999, the latest that a record's date can name; captures without a time are of the epoch.
LATEST = 253_402_300_799
_UUID = "urn:page:"
_END = b"\r\n"


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, in lower case; blanks and control characters as %XX."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, mark, query = host.partition("?")
    key = ",".join(reversed(host.lower().split("."))) + ")" + (slash + path if slash else "/" + mark + query if mark else "/").lower()
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in key)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _when(seconds: int) -> str:
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, page: str | None, url: str, seconds: int, payload: bytes, refers_to: str | None, payload_digest: str) -> bytes:
    """One gzip member."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = _END.join(http) + (payload if kind == "response" else b"")
    # A line end in a url would begin a new header line.
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {target}", f"WARC-Date: {_when(seconds)}", f"WARC-Record-ID: <{_UUID}{'' if page is None else page}>",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_UUID}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + _END + _END + block + _END + _END) + pack.flush()


def parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    page = lambda s: s.removeprefix("<" + _UUID).removesuffix(">") or None
    if fields["WARC-Type"] == "response" and (len(payload) != length or "sha1:" + digest(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload,
    }


def line_key(line: bytes) -> bytes:
    """The line itself. It begins with key, timestamp and id, the two last padded to one width, and no key holds a byte up to the blank, so lines
    sort by these; offset, length and archive set equal ones apart. Ranges, runs and merges must use this one order, or lines fall between ranges."""
    return line


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, the top the winner."""

    def __init__(self, runs: Iterable[Iterator[bytes]]):
        self._runs = list(runs)
        self._k = max(1, len(self._runs))
        self._heads: list = [None] * self._k
        for i in range(len(self._runs)):
            self._pull(i)
        self._tree = [-1] * self._k
        for i in range(self._k):
            self._replay(i, build=True)

    def _pull(self, i: int) -> None:
        line = next(self._runs[i], None)
        self._heads[i] = None if line is None else (line_key(line), i, line)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _replay(self, i: int, build: bool = False) -> None:
        winner, node = i, (i + self._k) // 2
        while node > 0:
            other = self._tree[node]
            if build and other < 0:
                self._tree[node] = winner  # the match waits for its second player
                return
            if self._beats(other, winner):
                self._tree[node], winner = winner, other
            node //= 2
        self._tree[0] = winner

    def __iter__(self) -> Iterator[bytes]:
        while (head := self._heads[top := self._tree[0]] if self._runs else None) is not None:
            yield head[2]
            self._pull(top)
            self._replay(top)


def run_bytes(lines: list[bytes]) -> tuple[bytes, list[tuple[bytes, int]]]:
    """The sorted lines as a file, and (line, offset) of every ``EVERY``-th."""
    marks, at = [], 0
    for i, line in enumerate(lines):
        if i % EVERY == 0:
            marks.append((line, at))
        at += len(line) + 1
    return b"".join(x + b"\n" for x in lines), marks


def stretch(path: str, start: int, end: int, low: bytes | None, high: bytes | None, buffer: int = 1 << 16) -> Iterator[bytes]:
    """Lines of bytes start..end of a run whose keys are in low..high (high not included)."""
    lo, hi = low is not None and line_key(low), high is not None and line_key(high)
    with files.open_random(path) as source:
        source.seek(start)
        rest, left = b"", end - start
        while left > 0 or rest:
            more = source.read(min(buffer, left)) if left > 0 else b""
            left -= len(more)
            *lines, rest = (rest + more).split(b"\n")
            for line in lines:
                key = line_key(line)
                if high is not None and key >= hi:
                    return
                if low is None or key >= lo:
                    yield line
            if not more:
                return


def _payload(html: str | None) -> bytes:
    return (html if isinstance(html, str) else "").encode("utf-8", "surrogatepass")


def _archive(folder: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        body, lines, at = [], [], 0

        def close():
            nonlocal body, lines, at
            archive = files.save(folder, "capture.warc.gz", b"".join(body))
            data, marks = run_bytes(sorted((x + b" " + archive.rsplit("/", 1)[1].encode() for x in lines), key=line_key))
            run_path = files.save(folder, "capture.run", data)
            out = pd.DataFrame({"run": run_path, "bytes": len(data), "mark": [k for k, _ in marks], "offset": [o for _, o in marks]})
            body, lines, at = [], [], 0
            return out

        for batch in batches:
            for page, url, html, seconds, keeps, refers, sha in zip(
                batch["page"], batch["url"], batch["html"], batch["seconds"], batch["keeps"], batch["refers"], batch["sha"], strict=True
            ):
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                member = record("response" if keeps else "revisit", page, url, int(seconds), _payload(html), refers, sha)
                # Ids are moved up so that they sort as text; no id at all is 0.
                stamp = f"{int(seconds):020d} {int(page) + (1 << 63) if page is not None else 0:020d}"
                lines.append(f"{url_key(url)} {stamp} {at} {len(member)}".encode("utf-8", "surrogatepass"))
                body.append(member)
                at += len(member)
                if at >= size:
                    yield close()
        if lines:
            yield close()

    return run


def decided(pages: DataFrame, page_id: str, url: str, html: str, seconds: str | None) -> DataFrame:
    """Rows for the archives: whether each keeps its payload, the page that it refers to, and the digest as hex."""
    page = F.col(f"`{page_id}`").cast("bigint")
    stamp = F.coalesce(F.col(f"`{seconds}`").cast("bigint") if seconds else F.lit(0), F.lit(0))
    rows = pages.select(
        page.alias("id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
        F.least(F.greatest(stamp, F.lit(0)), F.lit(LATEST)).alias("seconds"),
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Only digests that occur twice or more matter for the join; the others keep their payload.
    first = rows.groupBy(F.col("sha").alias("_sha")).agg(F.max("id").alias("_top"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    met = rows.join(first, F.col("sha") == F.col("_sha"), "left")
    keeps = F.col("_top").isNull() | F.coalesce(F.col("id") == F.col("_top"), F.lit(False))
    return met.select(
        F.col("id").cast("string").alias("page"), "url", "html", "seconds", keeps.alias("keeps"), F.when(~keeps, F.col("_top")).cast("string").alias("refers"), "sha"
    )


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", seconds: str | None = None, size: int = ARCHIVE) -> tuple[str, DataFrame]:
    """Writes archives and runs; the folder, and the table of runs (run, bytes, mark, offset): one row for each sampled line."""
    folder = scratch(pages.sparkSession, "warc")
    files.make_folder(folder)
    rows = decided(pages, page_id, url, html, seconds)
    made = rows.mapInPandas(_archive(folder, size), "run string, bytes bigint, mark binary, offset bigint")
    return folder, written(made, "runs")


def _groups(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """The few rows of each group of a partition sorted by ``column``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for value, rows in batch.groupby(column, sort=True):
            if held and held[0][column].iloc[0] != value:
                yield int(held[0][column].iloc[0]), pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield int(held[0][column].iloc[0]), pd.concat(held)


def _lines(rows: pd.DataFrame) -> Iterator[bytes]:
    return iter(LoserTree(stretch(r.run, int(r.start), int(r.end), r.low, r.high) for r in rows.itertuples(index=False)))


def _to_runs(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _groups(batches, "part"):
            marks, at = [], 0
            with files.Writer(f"{folder}/merged-{uuid.uuid4().hex}.run") as out:
                for i, line in enumerate(_lines(rows)):
                    if i % EVERY == 0:
                        marks.append((line, at))
                    out.write(line + b"\n")
                    at += len(line) + 1
            yield pd.DataFrame({"run": out.path, "bytes": at, "mark": [k for k, _ in marks], "offset": [o for _, o in marks]})

    return run


def _to_captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("url_key", "seconds", "page_id", "offset", "length", "archive")
    for part, rows in _groups(batches, "part"):
        place, held = 0, []

        def frame(held, place, part=part):
            out = pd.DataFrame([x.decode("utf-8", "surrogatepass").split(" ") for x in held], columns=list(names))
            return out.assign(part=part, place=range(place, place + len(out)))

        for line in _lines(rows):
            held.append(line)
            if len(held) == 20_000:
                yield frame(held, place)
                place, held = place + len(held), []
        if held:
            yield frame(held, place)


_STRETCHES = ("part", "run", "start", "end", "low", "high")


def merge(folder: str, runs: DataFrame, fan: int = FAN) -> DataFrame:
    """(part, place, url_key, seconds, page_id, archive, offset, length) of all captures; (part, place) is their global order."""
    none = F.lit(None).cast("binary")
    while (k := runs.select("run").distinct().count()) > fan:
        whole = runs.groupBy("run").agg(F.max("bytes").alias("end")).withColumn("part", F.pmod(F.xxhash64("run"), F.lit(-(-2 * k // fan))))
        rows = whole.select("part", "run", F.lit(0).cast("bigint").alias("start"), "end", none.alias("low"), none.alias("high"))
        ordered = rows.repartition("part").sortWithinPartitions("part", "run")
        runs = written(ordered.mapInPandas(_to_runs(folder), "run string, bytes bigint, mark binary, offset bigint"), "runs")
    # Each sampled line gets the key range it falls into; a run's lines up to its next sampled line may belong to all ranges up to that one's.
    placed = written(runs.repartitionByRange("mark").withColumn("part", F.spark_partition_id()), "ranges")
    by_part = Window.orderBy("part")  # one row for each range
    lows = placed.groupBy("part").agg(F.min("mark").alias("_min"))
    lows = lows.select("part", F.when(F.row_number().over(by_part) > 1, F.col("_min")).alias("low"), F.lead("_min").over(by_part).alias("high"))
    following = Window.partitionBy("run").orderBy("offset")
    steps = placed.select("run", "offset", "part", F.lead("offset", 1).over(following).alias("_next"), F.lead("part", 1).over(following).alias("_to"), "bytes")
    steps = steps.withColumn("_end", placed.agg(F.max("part")).scalar())
    spread = steps.select("run", "offset", F.coalesce("_next", "bytes").alias("_next"), F.explode(F.sequence("part", F.coalesce("_to", "_end"))).alias("part"))
    cut = spread.groupBy("run", "part").agg(F.min("offset").alias("start"), F.max("_next").alias("end"))
    rows = cut.join(lows.select("part", "low", "high"), "part").select(*_STRETCHES)
    ordered = rows.repartition("part").sortWithinPartitions("part", "run")
    out = ordered.mapInPandas(_to_captures, "part int, place bigint, url_key string, seconds string, page_id string, archive string, offset string, length string")
    shown = F.col("page_id").cast("decimal(20,0)")
    return out.select(
        "part", "place", "url_key", F.col("seconds").cast("bigint").alias("seconds"), F.when(shown > 0, (shown - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")).alias("page_id"), "archive",
        F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"),
    )


def _records(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("archive", sort=False):
                with files.open_random(f"{folder}/{name}") as source:
                    found = []
                    for offset, length in zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True):
                        source.seek(offset)
                        fields = parse(source.read(length))
                        found.append([fields[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")])
                yield pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read(folder: str, captures: DataFrame) -> DataFrame:
    """The records that the index names, archive by archive in file order."""
    ordered = captures.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")
    out = ordered.mapInPandas(_records(folder), "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Archives the pages, merges the index and reads every record through it."""
    folder, runs = archive(pages, **columns)
    return read(folder, merge(folder, runs))
