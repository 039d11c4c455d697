"""Token-id output: documents in id order as wavelet matrix shards, one compressed file each, and the way back.

Documents are range partitioned and sorted by id (then by text hash and text). Each task encodes its part, ends every document with the end id and
writes a shard whenever about ``SHARD`` ids are full; documents are never cut. A shard's header lists its documents' ids and lengths.
Files are written under new names and only the manifest that Spark writes makes them count, so repeated tasks do no harm. Reading starts
from the manifest: shards are spread over all tasks, and starts come from sums over shards and parts.

Encoding uses the tokenizer's own BPE model through a bounded cache of pre-tokens. What letters, numbers and white space are is asked of the tokenizer once for each
worker, so a text is cut into pre-tokens at once, in stretches that end at a space between two visible characters, where no pre-token is. Texts
with the tokenizer's special tokens, and stretches with rare characters or without such a space, take the library's plain way. The results are those of ``encode(text, add_special_tokens=False)``.

A null text is empty: it has the end id alone. Null ids come first. Repeated rows are encoded each. An empty table gives an empty result. Only
the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.llm import characters, files, wavelet
from opinionlake.llm.common import text_of, written
from opinionlake.session import scratch

SHARD = 1 << 21
END = 2
TOKENS, LONG, STRETCH = 1_000_000, 256, 1 << 18
#: Between two visible characters; Python's visible characters are visible for the tokenizer too.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where visible, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters_of, tokenize = byte_letters(), self.tokenizer.model.tokenize
        letters, numbers, others = characters.kinds(self.tokenizer.pre_tokenizer.pre_tokenize_str)
        visible = letters[1:-1] + numbers[1:-1] + others[1:-1]
        # Byte-level pre-tokens: the fixed pattern of this family of tokenizers.
        self._pre = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{others}+|[^{visible}]+(?![{visible}])|[^{visible}]+").findall
        self._strange = characters.strangers()

        class Known(dict):
            """Ids by pre-token. A full cache starts anew; what is frequent comes back at once."""

            def __missing__(self, word):
                ids = array("I", [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters_of))]).tobytes()
                if len(self) >= TOKENS:
                    self.clear()
                if len(word) <= LONG:
                    self[word] = ids
                return ids

        self._known = Known()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self._special):
            return self._plain(text)
        return b"".join(map(self._stretch, self._parts(text, STRETCH)))

    def _stretch(self, text: str) -> bytes:
        if len(text) > 2 * STRETCH or not text.isascii() and self._strange(text):
            return self._plain(text)
        return b"".join(map(self._known.__getitem__, self._pre(text)))

    def _parts(self, text: str, size: int) -> Iterator[str]:
        """Parts of about ``size``, cut where no pre-token is."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + size) if len(text) - at > size else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def _plain(self, text: str, size: int = 1 << 20) -> bytes:
        """By the library alone, in bounded pieces."""
        return b"".join(np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes() for part in self._parts(text, size))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def _planes(path: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def _writer(tokenizer: str, folder: str, planes: int, end: int, shard: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(tokenizer).ids, TaskContext.get().partitionId()
        parts, names, lengths, full, number = [], [], [], 0, 0

        def close():
            nonlocal parts, names, lengths, full, number
            ids = np.frombuffer(b"".join(parts), "<u4")
            header = {"documents": names, "lengths": lengths}
            path = files.save(folder, f"part-{part:06d}-{number:06d}", wavelet.build(ids, planes, header))
            row = pd.DataFrame({"part": [part], "number": [number], "path": [path], "n": [len(ids)], "documents": [len(names)]})
            parts, names, lengths, full, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for name, text in zip(batch["id"], batch["text"], strict=True):
                ids = encode(text) + tail
                parts.append(ids)
                names.append(None if name is None else int(name))
                lengths.append(len(ids) // 4)
                full += len(ids) // 4
                if full >= shard:
                    yield close()
        if names:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, shard: int = SHARD) -> DataFrame:
    """The manifest (part, number, path, n, documents), one row a shard; part and number are in document order."""
    folder = scratch(docs.sparkSession, "tokens")
    files.make_folder(folder)
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), text_of(f"`{text}`").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select(F.col("id").cast("string"), "text")  # as text, for pandas has no whole numbers beside nulls
    made = ordered.mapInPandas(_writer(tokenizer, folder, _planes(tokenizer), end, shard), "part int, number int, path string, n bigint, documents bigint")
    return written(made, "manifest")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start, path in zip(batch["start"], batch["path"], strict=True):
            matrix = wavelet.WaveletMatrix(files.load(path))
            ids, lengths = matrix.decode().astype("<u4"), np.array(matrix.header["lengths"], np.int64)
            ends = np.cumsum(lengths)
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pd.DataFrame(
                {"doc_id": pd.array(matrix.header["documents"], "Int64"), "start": ends - lengths + start, "n_tokens": lengths, "ids_crc32": np.array(sums, np.int64)}
            )


def read(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = manifest.groupBy(F.col("part").alias("_p")).agg(F.sum("n").alias("_n"))
    parts = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("_within", within).join(parts, F.col("part") == F.col("_p"))
    shards = placed.select((F.col("_before") + F.col("_within")).alias("start"), "path")
    tasks = tasks or max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return shards.repartition(tasks, "path").mapInPandas(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
