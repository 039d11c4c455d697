"""License scans: fuzzy search for short notices, with the spans and edits of each.

A notice with up to k edits is cut into k + 1 pieces of nearly equal length: wherever the notice stands with at most k edits, one piece stands
there unchanged. One automaton finds all pieces of all notices in one walk over the text. A piece's place gives a window, as wide as the notice
and k more to either side; overlapping windows are joined. In each window the ``regex`` library looks for the notice with at most k edits and reports the
span and the number of edits. Notices with k = 0 are the base phrases; they must also begin and end at word ends.

Texts are compared in a plain form: A-Z in lower case, words (runs of digits, letters and anything beyond ASCII) joined by one space. Spans are reported in words
and in characters of the original text. Rows are independent, so the work follows the scan's splits; a task holds one text at a time.

A null text is empty: no words, no labels, score 0. Ties between matches of one notice go to the fewer edits, then the earlier. Repeated rows and null ids give
rows of their own; an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int


#: Fixed phrases and labels of the base search.
BASE = (
    Notice("gnu general public license", "gpl", 0),
    Notice("apache license", "apache", 0),
    Notice("cc by", "cc-by", 0),
    Notice("mit license", "mit", 0),
)
#: Notices that the fuzzy search adds; about one edit for ten characters.
NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("you can redistribute it and or modify it under the terms of the gnu", "gpl", 6),
    Notice("licensed under the apache license version 2 0", "apache", 4),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    Notice("released under the mit license", "mit", 3),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("licensed under cc by nc", "cc-by-nc", 2),
    Notice("licensed under cc by sa", "cc-by-sa", 2),
    Notice("licensed under cc by nd", "cc-by-nd", 2),
    Notice("dedicated to the public domain", "public-domain", 3),
    Notice("all rights reserved", "all-rights-reserved", 1),
)
#: Every ASCII byte that is no digit or letter becomes a space, A-Z become a-z.
_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_words(text: str) -> list[str]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).decode("utf-8", "surrogatepass").split(" ")


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces that cover the notice."""
    n, parts = len(notice.text), notice.edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((k, offset))
        self._seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self._seeds.add_word(piece, (len(piece), places))
        self._seeds.make_automaton()
        # Best match first, then the earliest; edits may not eat into the neighbouring words of a base phrase as it allows none.
        self._patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") if n.edits else None for n in notices]

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By notice, the joined stretches of the text in which it may stand."""
        found: dict[int, list[list[int]]] = {}
        for last, (length, places) in self._seeds.iter(text):
            start = last + 1 - length
            for k, offset in places:
                notice = self.notices[k]
                lo, hi = max(0, start - offset - notice.edits), start - offset + len(notice.text) + notice.edits
                own = found.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                    own[-1][0] = min(own[-1][0], lo)
                else:
                    own.append([lo, hi])
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in the plain text, without overlaps within a notice of the fuzzy kind."""
        out = []
        for k, stretches in self.windows(text).items():
            notice, pattern = self.notices[k], self._patterns[k]
            for lo, hi in stretches:
                if pattern is None:  # the seed is the whole phrase; a joined stretch may hold it several times
                    at = text.find(notice.text, lo, hi)
                    while at >= 0:
                        end = at + len(notice.text)
                        if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
                            out.append((at, end, k, 0))
                        at = text.find(notice.text, at + 1, hi)
                else:
                    out += self._fuzzy(pattern, text, lo, min(hi, len(text)), k)
        return self._best(set(out))

    def _best(self, found: set) -> list[tuple[int, int, int, int]]:
        """All base places, and the fuzzy ones that no match with fewer edits overlaps: "by sa" with two edits is no match where "by nc" stands."""
        kept = sorted(m for m in found if not self.notices[m[2]].edits)
        fuzzy = sorted(found.difference(kept), key=lambda m: m[3])
        taken: list[tuple[int, int]] = []
        for _, level in groupby(fuzzy, key=lambda m: m[3]):
            starts, level = [a for a, _ in taken], list(level)
            fresh = []
            for m in level:
                i = bisect_left(starts, m[1]) - 1
                if i < 0 or taken[i][1] <= m[0]:
                    fresh.append(m)
            kept += fresh
            joined: list[tuple[int, int]] = []
            for a, b in sorted(taken + [m[:2] for m in fresh]):
                if joined and a < joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            taken = joined
        return sorted(kept)

    def _fuzzy(self, pattern, text, lo, hi, k):
        found, todo = [], [(lo, hi)]
        while todo:
            a, b = todo.pop()
            m = pattern.search(text, a, b)
            if m is None:
                continue
            start, end = m.span()
            found.append((start, end, k, sum(m.fuzzy_counts)))
            if end > start:
                todo += [(a, start), (end, b)]
        return found


@lru_cache(maxsize=2)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan_text(text: str | None, notices: tuple[Notice, ...] = BASE + NOTICES) -> dict:
    """Word count, spans and score of one text."""
    text = text or ""
    words = list(filter(None, plain_words(text)))
    form = " ".join(words)
    found = scanner(notices).matches(form)
    spans, score = [], 0.0
    if found:
        places = [m.span() for m in _WORD.finditer(text)]
        for start, end, k, edits in found:
            first = form.count(" ", 0, start + (form[start : start + 1] == " "))
            last = form.count(" ", 0, end - (form[end - 1 : end] == " "))
            notice = notices[k]
            spans.append((notice.label, notice.edits == 0, first, places[first][0], places[min(last, len(places) - 1)][1], edits))
            score = max(score, 1.0 - edits / len(notice.text))
    return {"n_words": len(words), "spans": spans, "score": score}


SPAN = "array<struct<label:string,base:boolean,word:bigint,start:bigint,end:bigint,edits:int>>"


def _scan(notices):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("label", "base", "word", "start", "end", "edits")
        for batch in batches:
            rows = [scan_text(t if isinstance(t, str) else None, notices) for t in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"].array, "n_words": [r["n_words"] for r in rows], "score": [r["score"] for r in rows],
                "spans": [[dict(zip(names, s, strict=True)) for s in r["spans"]] for r in rows],
            })

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = BASE + NOTICES) -> DataFrame:
    """(doc_id, n_words, score, spans): spans are structs (label, base, word, start, end, edits)."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))  # ids as text, for pandas has no whole numbers beside nulls
    out = slim.mapInPandas(_scan(notices), f"id string, n_words bigint, score double, spans {SPAN}")
    return out.select(F.col("id").cast("bigint").alias(doc_id), "n_words", "score", "spans")
