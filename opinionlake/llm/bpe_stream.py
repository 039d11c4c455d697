"""Byte-pair encoding as a streaming transducer of bounded lookahead, and decoding as an incremental state machine.

Whether a merge happens can depend on what follows, but not without bound: a merge (x, z) is only prevented from the right when z, or a piece that z ends with on its
way, is taken by an *earlier* merge, which in turn needs its own right part undisturbed, and so on with ever earlier merges. The longest such chain, found
for all merges in their order, is the merge list's sufficient lookahead (``Merges.lookahead`` symbols). A boundary that a window leaves open that far from its end
is a boundary whatever follows, and both sides are encoded independently of each other. So the transducer holds a window, emits the tokens up to its last
sure boundary and goes on from there: a word of any length needs constant memory. It works for merge lists whose merges only use what earlier ones make;
another list is refused.

Texts are taken in stretches that end at a space. A stretch of common characters in normal form is lower-cased and cut into words at once, each word seen before
costs one lookup in a bounded cache. What letters, numbers and white space are is asked of the tokenizer once for each worker. Other stretches are cut at ASCII
spaces and line ends, which no word crosses; a piece seen before costs one lookup, the words of a new one are cached by themselves. Pieces longer than ``PIECE`` are normalised, cut into words and encoded in parts, the last word being left open between parts. Special
tokens' strings in a text are those tokens, as in the tokenizer. Normalising and cutting into words is the tokenizer's own for pieces in one part.

``Detokenizer`` takes ids one after the other and gives text as soon as it is sure. Its ``letters`` form is that of a tokenizer without decoder (tokens' letters with spaces
between); its ``text`` form undoes the byte letters, holds back unfinished UTF-8 sequences and puts a space behind each word.

Null texts are empty: no ids and an empty decoded text. Repeated rows and null ids are rows like others, all columns but the text are left out except the id; empty
tables give empty results.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.llm import characters
from opinionlake.llm.common import text_of
from opinionlake.llm.token_output import byte_letters

PIECE, PART, STRETCH = 4096, 1 << 16, 1 << 18
PIECES, WORDS, LONG_WORD = 250_000, 800_000, 256
#: One sign of each kind of run that may go on from part to part.
_MARK = {"letters": "a", "others": "!"}


class Merges:
    """The merge table by symbol ids, and the lookahead that is sufficient for it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        made = set(vocab.values()) - {vocab[a + b] for a, b in merges}
        length = {i: 1 for i in made}
        rules: dict[int, list[tuple[int, int]]] = {}
        # Of each left symbol: ranks of its merges, and the farthest reach of those up to each rank.
        ranks: dict[int, list[int]] = {}
        reaches: dict[int, list[int]] = {}
        self.lookahead = 1
        for rank, (a, b) in enumerate(merges):
            x, z, new = vocab[a], vocab[b], vocab[a + b]
            if x not in length or z not in length:
                raise ValueError(f"merge {rank} uses what no earlier merge makes")
            self.rank.setdefault((x, z), rank)
            self.made.append(new)
            reach, open_ = 0, [(z, rank)]
            while open_:
                s, deadline = open_.pop()
                if s in ranks:
                    at = bisect_left(ranks[s], deadline)
                    reach = max(reach, reaches[s][at - 1] if at else 0)
                open_ += [(right, min(deadline, r)) for r, right in rules.get(s, ())]
            reach += length[z]
            ranks.setdefault(x, []).append(rank)
            reaches.setdefault(x, []).append(max(reach, reaches[x][-1] if reaches.get(x) else 0))
            self.lookahead = max(self.lookahead, reach)
            length[new] = max(length.get(new, 0), length[x] + length[z])
            rules.setdefault(new, []).append((rank, z))
        self.longest = max(length.values(), default=1)
        self.symbols = {t: i for t, i in vocab.items() if i in made}
        self.suffix = suffix

    def apply(self, ids: list[int]) -> list[int]:
        """All merges of one window, the earliest in the list first, equal ones from the left."""
        if len(ids) > 64:
            return self._apply_long(ids)
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def _apply_long(self, ids: list[int]) -> list[int]:
        rank, ids, n = self.rank.get, list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or rank((ids[i], ids[j])) != best:
                continue
            ids[i], ids[j] = self.made[best], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := rank((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (found, a))
        return [i for i in ids if i >= 0]


class Transducer:
    """Tokens of one word whose letters come in parts."""

    def __init__(self, merges: Merges, lengths: dict[int, int], window: int | None = None):
        self.merges, self.lengths = merges, lengths
        # A token is no longer than ``longest``, so a window of this size has a sure boundary.
        self.window = max(window or 4 * merges.lookahead, merges.lookahead + 2 * merges.longest)
        self.held: list[int] = []
        self.last = ""

    def feed(self, letters: str) -> list[int]:
        """Ids that are sure by now."""
        if not letters:
            return []
        symbols, out = self.merges.symbols, []
        letters, self.last = self.last + letters[:-1], letters[-1]
        for at in range(0, len(letters), self.window):
            self.held += [symbols[c] for c in letters[at : at + self.window]]
            if len(self.held) >= self.window:
                out += self._sure()
        return out

    def _sure(self) -> list[int]:
        tokens, out, at = self.merges.apply(list(self.held)), [], 0
        for t in tokens:
            if at + self.lengths[t] + self.merges.lookahead > len(self.held):
                break
            at += self.lengths[t]
            out.append(t)
        del self.held[:at]
        return out

    def end(self) -> list[int]:
        """The rest; the transducer is then ready for another word."""
        if not self.last:
            return []
        out = self.merges.apply([*self.held, self.merges.symbols[self.last + self.merges.suffix]])
        self.held, self.last = [], ""
        return out


@lru_cache(maxsize=1)
def _joiners() -> frozenset[str]:
    """Characters that normalising may join to one before them."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


def _parts(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` that normalise independently of each other."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and (unicodedata.combining(text[end]) or text[end] in _joiners()):
            end += 1
        yield text[at:end]
        at = end


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], merges, self.suffix)
        self.lengths = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in model["vocab"].items()}
        tokenizer = Tokenizer.from_file(path)
        self._normal, self._cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self._split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self._letters = byte_letters()
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._strange, self._find = self._classes()
        encoder_ = self

        class Known(dict):
            """Ids by word. A full cache starts anew."""

            def __missing__(self, word):
                found = encoder_._encoded(word.encode().decode("latin-1").translate(encoder_._letters))
                if len(word) <= LONG_WORD:
                    if len(self) >= WORDS:
                        self.clear()
                    self[word] = found
                return found

        self._known = Known()

    def _classes(self):
        """A search for characters that need the tokenizer's own way, and the words of a text without such."""
        plain = lambda c: ("σ" if c == "Σ" else c).lower()
        # Characters that normalising changes by itself are not strange: a text is asked whether it is in normal form.
        strange = [c for c in characters.KNOWN if unicodedata.is_normalized("NFC", c) and not c.isspace() and plain(c) != self._normal(c)]
        letters, numbers, others = characters.kinds(self._cut)
        return characters.strangers(strange), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{numbers}|{others}+").findall

    def ids(self, text: str) -> bytes:
        """The ids as native 32-bit integers."""
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        if self._split and any(s in text for s in self.special):
            for i, part in enumerate(self._split(text)):
                if i % 2:
                    yield array("i", [self.special[part]]).tobytes()
                else:
                    yield from self._plain(part)
        else:
            yield from self._plain(text)

    def _plain(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + STRETCH) if len(text) - at > STRETCH else -1
            stretch = text[at:] if end < 0 else text[at:end]
            at = len(text) if end < 0 else end
            if len(stretch) <= 2 * STRETCH and (stretch.isascii() or not self._strange(stretch) and unicodedata.is_normalized("NFC", stretch)):
                yield b"".join(map(self._known.__getitem__, self._find(stretch.replace("Σ", "σ").lower())))
            else:
                yield from self._by_piece(stretch)

    def _by_piece(self, text: str) -> Iterator[bytes]:
        known = self._pieces
        for piece in text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" "):
            found = known.get(piece)
            if found is None:
                if len(piece) > PIECE:
                    yield from self._long(piece)
                    continue
                if len(known) >= PIECES:
                    known.clear()
                found = known[piece] = b"".join(self._word(w) for w, _ in self._cut(self._normal(piece))) if piece else b""
            yield found

    def _encoded(self, letters: str) -> bytes:
        if len(letters) > LONG_WORD:
            run = Transducer(self.merges, self.lengths)
            return array("i", run.feed(letters) + run.end()).tobytes()
        symbols = self.merges.symbols
        return array("i", self.merges.apply([*map(symbols.__getitem__, letters[:-1]), symbols[letters[-1] + self.suffix]])).tobytes()

    def _word(self, letters: str) -> bytes:
        """``letters`` are byte letters."""
        found = self._words.get(letters)
        if found is None:
            found = self._encoded(letters)
            if len(letters) <= LONG_WORD:
                if len(self._words) >= PIECES:
                    self._words.clear()
                self._words[letters] = found
        return found

    def _kind(self, char: str) -> str | None:
        """The kind of run that the character is in; numbers are words of one character each."""
        if len(self._cut("a" + char)) == 1:
            return "letters"
        return "others" if len(self._cut("!" + char)) == 1 else None

    def _long(self, piece: str, size: int = PART) -> Iterator[bytes]:
        """A piece in parts: a run of letters or of other signs that reaches a part's end stays open."""
        run, kind, held = Transducer(self.merges, self.lengths), None, ""
        for raw in _parts(piece, size):
            # A sign in front of the part goes on with the open run, if the part does.
            part, held = _MARK.get(kind, "") + held + self._normal(raw), ""
            words = self._cut(part)
            if kind:
                (letters, (_, end)), words = words[0], words[1:]
                yield array("i", run.feed(letters[1:])).tobytes()
                if end == len(part):
                    continue
                yield array("i", run.end()).tobytes()
                kind = None
            for letters, (start, end) in words:
                # What begins with an apostrophe so near the end may become one of the short endings.
                if letters[0] == "'" and start >= len(part) - 3:
                    held = part[start:]
                    break
                kind = self._kind(part[start]) if end == len(part) else None
                if kind:
                    yield array("i", run.feed(letters)).tobytes()
                else:
                    yield self._word(letters)
        if kind:
            yield array("i", run.end()).tobytes()
        for letters, _ in self._cut(held):
            yield self._word(letters)


class Detokenizer:
    """Text from ids that come one after the other."""

    def __init__(self, tokens: dict[int, str], suffix: str, special: Iterable[int] = (), form: str = "letters"):
        self.tokens, self.suffix, self.special, self.form = tokens, suffix, frozenset(special), form
        self._bytes = {c: b for b, c in byte_letters().items()}
        self.reset()

    def reset(self) -> None:
        self._begun = False
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """What is sure after these ids."""
        if self.form == "letters":
            text = " ".join(map(self.tokens.__getitem__, ids))
            out = " " + text if self._begun and text else text
            self._begun = self._begun or bool(text)
            return out
        out = []
        for i in ids:
            token = self.tokens[i]
            if i in self.special:
                out += [self._utf8.decode(b"", True), token]
                self._utf8.reset()
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            letters = token.removesuffix(self.suffix) if ends else token
            out.append(self._utf8.decode(bytes(self._bytes[c] for c in letters), ends))
            if ends:
                self._utf8.reset()
                out.append(" ")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished sequence at the end stands for."""
        out = self._utf8.decode(b"", True) if self.form == "text" else ""
        self.reset()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


@lru_cache(maxsize=4)
def detokenizer(path: str, form: str) -> Detokenizer:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["id"]: t["content"] for t in spec["added_tokens"]}
    return Detokenizer({i: t for t, i in spec["model"]["vocab"].items()} | special, spec["model"].get("end_of_word_suffix") or "", special, form)


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = encoder(tokenizer).ids
        for batch in batches:
            parts = [encode_(t) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [doc_id, "ids"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), text_of(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", form: str = "letters", step: int = 1 << 16) -> DataFrame:
    """``encoded`` with ``decoded``, the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = detokenizer(tokenizer, form)
        for batch in batches:
            out = []
            for row in batch.column(ids):
                values = np.asarray(row.values) if row.is_valid else np.zeros(0, np.int32)
                out.append("".join([machine.feed(values[at : at + step].tolist()) for at in range(0, len(values), step)]) + machine.end())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
