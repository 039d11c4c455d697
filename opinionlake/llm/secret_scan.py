"""Secret scans: sliding-window entropy over candidate strings of each character class, beside fixed patterns.

All in column expressions. A pattern's matches come from ``regexp_extract_all``; their places from the lengths of the gaps that ``split`` by
the same pattern leaves between them. Candidates of a character class are its maximal runs. A window slides over a candidate; the counts of
its characters, and with them the sum of c log c, are updated for the character that enters and the one that leaves, so a step costs the
same for any window. All sums are whole micro-bits, so results do not depend on the order of additions. A candidate is a secret if some
window reaches the class's entropy that overlaps no piece between slashes with a word of the allow list, so a sample's name in a path does
not hide the key behind it; matches of the fixed patterns are never suppressed.

A null text counts as empty and gives zero counts and empty span lists; repeated rows give repeated rows; an empty table an empty result.
Spans with one start are ordered by kind as listed. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.llm.common import text_of


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns: kind, pattern, the group whose length counts, its least length. A shorter match is passed over and dropped.
#: Runs of hex digits are maximal, so asking for 16 in the pattern drops the same ones.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))


@dataclass(frozen=True)
class CharClass:
    """A candidate is a match of ``pattern`` that also holds a match of each of ``needs``."""

    kind: str
    pattern: str
    min_bits: float
    needs: tuple[str, ...]


CLASSES = (
    CharClass("entropy_hex", "[0-9A-Fa-f]{20,}", 3.0, ("[0-9]", "[A-Fa-f]")),
    CharClass("entropy_base64", "[A-Za-z0-9+/_-]{20,}", 3.9, ("[0-9]", "[A-Za-z]")),
)
WINDOW = 20
#: A piece between slashes that holds one of these, in any case, is a known sample and does not count for a candidate's entropy.
ALLOW = ("example", "sample", "placeholder", "changeme", "0123456789", "abcdefghij", "xxxxxxxx", "00000000")
#: Code points that the classes use: + to z.
FIRST, LAST = 43, 122
BLOCK = 256


def clog(window: int = WINDOW) -> list[int]:
    """c log2 c in micro-bits for c = 0..window."""
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def _sums_before(values: Column) -> Column:
    """For each entry the sum of those before it. Appends to an array, so only for short ones."""
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    walk = F.aggregate(
        values, zero,
        lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")),
    )
    return walk["out"]


def _starts(found: Column, gaps: Column) -> Column:
    """Start of each match, by blocks: sums inside a block, and the totals of the blocks before it."""
    steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("bigint"))

    def in_blocks(s):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK))
        )
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, v: a + v))

        both = F.arrays_zip(blocks.alias("b"), _sums_before(totals).alias("o"))
        inside = lambda p: F.arrays_zip(p["b"].alias("v"), _sums_before(p["b"]).alias("s"))
        return F.flatten(F.transform(both, lambda p: F.transform(inside(p), lambda q: q["v"] + q["s"] + p["o"])))

    return _bind(steps, in_blocks)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _spans(text: str, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, order, end, kind) of the pattern's matches whose group is long enough."""
    t, p = F.col(text), F.lit(pattern)

    def of(found):
        starts = _starts(found, F.split(t, pattern, -1))
        counted = F.regexp_extract_all(t, p, F.lit(group)) if group else found
        rows = F.arrays_zip(starts.alias("at"), found.alias("m"), counted.alias("g"))
        long = F.filter(rows, lambda r: F.length(r["g"]) >= least)
        return F.transform(long, lambda r: _span(r["at"], order, r["at"] + F.length(r["m"]), kind))

    return _bind(F.regexp_extract_all(t, p, F.lit(0)), lambda found: F.when(F.size(found) > 0, of(found)).otherwise(_no_spans()))


def _span(start: Column, order: int, end: Column, kind: str) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(order).alias("order"), end.cast("bigint").alias("end"), F.lit(kind).alias("kind"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")


def best_window(candidate: Column, window: int = WINDOW) -> Column:
    """Largest entropy of a window of the candidate, times the window's length, in micro-bits."""
    table = F.array(*[F.lit(v).cast("bigint") for v in clog(window)])
    full = clog(window)[window]

    def walk(codes):
        zero = F.struct(
            F.array_repeat(F.lit(0), LAST - FIRST + 1).alias("counts"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("best"), F.lit(0).alias("i"),
        )

        def step(a, enters):
            leaves = F.when(a["i"] >= window, F.get(codes, a["i"] - window)).otherwise(F.lit(-1))
            out = F.when(leaves >= 0, F.get(a["counts"], leaves)).otherwise(F.lit(0))
            into = F.get(a["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
            s = a["s"] - F.get(table, out) + F.get(table, F.greatest(out - 1, F.lit(0))) - F.get(table, into) + F.get(table, into + 1)
            counts = F.transform(a["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
            best = F.when(a["i"] >= window - 1, F.greatest(a["best"], F.lit(full).cast("bigint") - s)).otherwise(a["best"])
            return F.struct(counts.alias("counts"), s.alias("s"), best.alias("best"), (a["i"] + 1).alias("i"))

        return F.aggregate(codes, zero, step)["best"]

    return _bind(F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST), walk)


def _listed(value: Column, allow: tuple[str, ...]) -> Column:
    """Whether the value holds a word of the allow list, in any case."""
    out = F.lit(False)
    for word in allow:
        out = out | F.lower(value).contains(word)
    return out


def _unlisted(candidate: Column, allow: tuple[str, ...]) -> Column:
    """What is left of a candidate without the pieces between slashes that are on the allow list; blanks occur in no class."""
    pieces = F.transform(F.split(candidate, "/", -1), lambda p: F.when(_listed(p, allow), F.lit(" ")).otherwise(p))
    return F.split(F.array_join(pieces, "/"), " ", -1)


def _random_spans(text: str, order: int, char_class: CharClass, window: int, allow: tuple[str, ...]) -> Column:
    t, p = F.col(text), F.lit(char_class.pattern)

    def secret(m):
        fits = F.lit(True)
        for need in char_class.needs:
            fits = fits & m.rlike(need)
        least = round(window * char_class.min_bits * 1e6)
        high = lambda part: F.when(F.length(part) >= window, best_window(part, window) >= least).otherwise(F.lit(False))
        # The walk comes last: candidates that fail the cheap tests are not scored.
        return F.when(fits & _listed(m, allow), F.exists(_unlisted(m, allow), high)).when(fits, high(m)).otherwise(F.lit(False))

    def of(found):
        rows = F.arrays_zip(_starts(found, F.split(t, char_class.pattern, -1)).alias("at"), found.alias("m"))
        return F.transform(F.filter(rows, lambda r: secret(r["m"])), lambda r: _span(r["at"], order, r["at"] + F.length(r["m"]), char_class.kind))

    return _bind(F.regexp_extract_all(t, p, F.lit(0)), lambda found: F.when(F.size(found) > 0, of(found)).otherwise(_no_spans()))


def scan(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", classes: tuple[CharClass, ...] = CLASSES, window: int = WINDOW, allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """(id, spans): all spans of each text, by start and kind, as structs (start, order, end, kind); order < 3 marks the fixed patterns."""
    df = docs.select(F.col(f"`{id_column}`").alias(id_column), text_of(f"`{text}`").alias("_t"))
    kinds = [_spans("_t", i, *base) for i, base in enumerate(BASE)]
    kinds += [_random_spans("_t", len(BASE) + i, c, window, allow) for i, c in enumerate(classes)]
    return df.select(id_column, F.sort_array(F.concat(*kinds)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
