"""The tokenizer: letter runs in the JVM, Han runs cut by the most probable path through a word graph.

The dictionary is data: a table (word, freq) that each worker reads once into a prefix table, which holds every word with
its weight and every beginning of a word. Domain terms and the report's brand names are added to it, each just
frequent enough to win over its own parts. Texts without Han letters never leave the JVM.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake import constants as C
from opinionlake.functions import text

#: Words of a dictionary at most; each worker holds them in memory. Larger ones are refused.
MAX_WORDS = 2_000_000

_ATOM = re.compile(f"[{text.HAN}]|[^{text.HAN}]+")
_PIECE = re.compile(r"[^\W_]+")
_HAN = re.compile(f"[{text.HAN}]")


def fold_word(word: str) -> str:
    return unicodedata.normalize("NFKC", word).casefold().strip()


class Words:
    """Weights (log of the share) of words, and their beginnings; ``base`` is looked up where a word is not held here."""

    def __init__(self, counted: Iterable[tuple[str, int]] = (), base: Words | None = None, least_total: int = 2):
        counted = list(counted)
        self.base = base
        self.total = base.total if base else max(least_total, sum(n for _, n in counted))
        self.entries: dict[str, float | None] = {}
        for word, n in counted:
            self._hold(word, math.log(n / self.total))

    def _hold(self, word: str, weight: float) -> None:
        self.entries[word] = weight
        end = 0
        for atom in _ATOM.findall(word)[:-1]:
            end += len(atom)
            self.entries.setdefault(word[:end], None)

    def find(self, begin: str) -> tuple[bool, float | None]:
        """(some word begins so, weight if it is one)."""
        held = begin in self.entries
        weight = self.entries.get(begin)
        if self.base:
            below, low = self.base.find(begin)
            return held or below, low if weight is None else weight
        return held, weight

    def add(self, words: Iterable[str]) -> Words:
        """Words without a count, shorter ones first: at least as frequent as their parts are together, and once more."""
        for word in sorted(set(words), key=lambda w: (len(w), w)):
            _, known = self.find(word)
            least = math.log((math.floor(math.exp(self.path(word)[0]) * self.total + 1e-9) + 1) / self.total)
            self._hold(word, least if known is None else max(least, known))
        return self

    def path(self, piece: str) -> tuple[float, list[tuple[str, bool]]]:
        """Weight and (part, is a word) of the heaviest path; of equal ones that whose first part is the longest."""
        atoms = _ATOM.findall(piece)
        n, unknown = len(atoms), -math.log(self.total)
        starts = [0]
        for atom in atoms:
            starts.append(starts[-1] + len(atom))
        best: list[tuple[float, int, bool]] = [(0.0, 0, False)] * (n + 1)
        for i in range(n - 1, -1, -1):
            choice = (unknown + best[i + 1][0], i + 1, False)
            for j in range(i + 1, n + 1):
                more, weight = self.find(piece[starts[i] : starts[j]])
                if weight is not None and (weight + best[j][0], j) >= choice[:2]:
                    choice = (weight + best[j][0], j, True)
                if not more:
                    break
            best[i] = choice
        parts, i = [], 0
        while i < n:
            _, j, is_word = best[i]
            parts.append((piece[starts[i] : starts[j]], is_word))
            i = j
        return best[0][0], parts


def _whole(word: str) -> bool:
    return word.isalnum() and bool(_HAN.search(word))


@functools.lru_cache(maxsize=2)
def _dictionary(path: str | None) -> Words:
    """Once a worker: the table at ``path`` and the domain terms."""
    if path is None:
        return Words(least_total=len(C.DOMAIN_TERMS)).add(C.DOMAIN_TERMS)
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    table = ds.dataset(root, filesystem=system, format="parquet").to_table(["word", "freq"])
    return Words(zip(table["word"].to_pylist(), table["freq"].to_pylist()), least_total=len(C.DOMAIN_TERMS)).add(C.DOMAIN_TERMS)


def _phrases(brands) -> str:
    """Brand names that are no single run, longest first; an edge that is no Han letter must be a word's edge."""
    edge = lambda c, look: "" if _HAN.match(c) else look
    found = sorted({b for b in brands if b and not b.isalnum()}, key=lambda w: (-len(w), w))
    return "|".join(edge(b[0], r"(?<![^\W_])") + re.escape(b) + edge(b[-1], r"(?![^\W_])") for b in found)


@functools.lru_cache(maxsize=1024)
def _scanner(path: str | None, brands: tuple[str, ...], loose: bool) -> Callable[[str], list[str]]:
    folded = [fold_word(b) for b in brands]
    base = _dictionary(path)
    words = Words(base=base).add(b for b in folded if _whole(b)) if any(_whole(b) for b in folded) else base
    phrases = re.compile(_phrases(folded)) if _phrases(folded) else None

    def piece(run: str) -> list[str]:
        if not _HAN.search(run):
            return [run]
        out: list[str] = []
        open_run = False
        for part, is_word in words.path(run)[1]:
            single = not is_word and _HAN.match(part) is not None
            if single and not loose:
                continue
            if single and open_run:
                out[-1] += part
            else:
                out.append(part)
            open_run = single
        return out

    def cut(body: str) -> list[str]:
        out, at = [], 0
        for hit in phrases.finditer(body) if phrases else ():
            out += [t for p in _PIECE.findall(body[at : hit.start()]) for t in piece(p)] + [hit.group()]
            at = hit.end()
        out += [t for p in _PIECE.findall(body[at:]) for t in piece(p)]
        return [t for t in out if not t.isnumeric()]

    return cut


@dataclass(frozen=True)
class Tokenizer:
    """``dictionary``: folder of a table (word, freq), see ``write_dictionary``; none: the domain terms alone.

    ``loose`` keeps Han letters that no word covers as one token; with a full dictionary they are better dropped.
    ``cut`` replaces the whole method: it gets folded texts and lists of brand names and returns lists of tokens.
    """

    dictionary: str | None = None
    loose: bool = True
    version: str = C.TOKENIZER_VERSION
    cut: Callable[[pd.Series, pd.Series], pd.Series] | None = None

    def tokens(self, folded: Column, brands: Column | None = None) -> Column:
        """Tokens of a folded text: two characters or more, no stop word, not a number."""
        names = F.lit(None).cast("array<string>") if brands is None else brands
        if self.cut is not None:
            found = F.pandas_udf(self.cut, T.ArrayType(T.StringType()))(folded, names)
            return text.worth_keeping(found)
        path, loose = self.dictionary, self.loose

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def han_tokens(bodies: pd.Series, named: pd.Series) -> pd.Series:
            return pd.Series(
                [None if b is None else _scanner(path, tuple(n) if n is not None else (), loose)(b) for b, n in zip(bodies, named)], dtype=object
            )

        han = folded.rlike(f"[{text.HAN}]")
        runs = F.regexp_extract_all(folded, text.run_pattern(brands), F.lit(1))
        return text.worth_keeping(F.coalesce(han_tokens(F.when(han, folded), F.when(han, names)), runs))


DEFAULT = Tokenizer()


def dictionary_rows(words: DataFrame) -> DataFrame:
    """(word, freq) of a dictionary: folded, counts added up; what is not one run with a Han letter or counts below one is left out."""
    folded = words.select(F.trim(text.fold(F.col("word"))).alias("word"), F.col("freq").cast("bigint").alias("freq"))
    good = folded.filter(F.col("word").rlike(r"^[\p{L}\p{N}]+$") & F.col("word").rlike(f"[{text.HAN}]") & (F.col("freq") >= 1))
    return good.groupBy("word").agg(F.sum("freq").alias("freq"))


def write_dictionary(words: DataFrame, path: str, loose: bool = False) -> Tokenizer:
    """Write a dictionary to a folder that all workers can read; the tokenizer's version names its content."""
    dictionary_rows(words).write.parquet(path)
    spark = words.sparkSession
    held = spark.read.parquet(path).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("word", "freq")).alias("h")).first()
    if held["n"] > MAX_WORDS:
        raise ValueError(f"a dictionary holds at most {MAX_WORDS} words, not {held['n']}")
    return Tokenizer(path, loose, f"{C.TOKENIZER_VERSION}:{(held['h'] or 0) & (2**64 - 1):016x}")
