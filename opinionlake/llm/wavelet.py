"""A wavelet matrix over token ids: one file of compressed bit planes with access, rank, select and bulk decoding.

Plane k holds bit (planes - 1 - k) of each id, in an order that is stably parted by the bits of the planes before. Planes are stored in blocks of
65,536 bits, each compressed by itself, with the number of ones before each block: a lookup unpacks one block a plane.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WMTX1\n"
BITS = 1 << 16


def build(ids: np.ndarray, planes: int, header: dict) -> bytes:
    """The file's bytes. ``header`` is kept with it."""
    order = np.ascontiguousarray(ids, np.uint16 if planes <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1)
    blobs, directory, zeros = [], [], []
    for k in range(planes - 1, -1, -1):
        bits = (order & order.dtype.type(1 << k)) != 0
        packed = np.packbits(bits, bitorder="little")
        blocks = [pack.compress(packed[at : at + BITS // 8].tobytes()) for at in range(0, len(packed), BITS // 8)]
        ones = np.add.reduceat(bits, np.arange(0, len(bits), BITS), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        directory.append([[len(b) for b in blocks], (np.cumsum(ones) - ones).tolist()])
        zeros.append(int(len(bits) - ones.sum()))
        blobs += blocks
        order = np.concatenate([order[~bits], order[bits]])
    head = zstandard.ZstdCompressor(level=3).compress(json.dumps({**header, "n": len(ids), "planes": planes, "zeros": zeros, "directory": directory}).encode())
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *blobs])


class WaveletMatrix:
    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = len(MAGIC) + 8
        (size,) = struct.unpack("<Q", data[len(MAGIC) : at])
        self.header = json.loads(zstandard.ZstdDecompressor().decompress(data[at : at + size]))
        self._data, at = data, at + size
        self.n, self.planes, self.zeros = self.header["n"], self.header["planes"], self.header["zeros"]
        self._ends = []
        for lengths, _ in self.header["directory"]:
            ends = at + np.cumsum([0, *lengths])
            self._ends.append(ends)
            at = int(ends[-1])
        self._block = lru_cache(maxsize=64)(self._unpacked)

    def _unpacked(self, plane: int, block: int) -> np.ndarray:
        ends = self._ends[plane]
        raw = zstandard.ZstdDecompressor().decompress(self._data[ends[block] : ends[block + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of the plane."""
        block, rest = divmod(i, BITS)
        before = self.header["directory"][plane][1]
        if block == len(before):
            return self.n - self.zeros[plane]
        return before[block] + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for k in range(self.planes):
            bit, ones = int(self._block(k, i // BITS)[i % BITS]), self._ones(k, i)
            value, i = value << 1 | bit, self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.planes):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.planes - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of the id among the first i."""
        return self.count(value, 0, i)

    def count(self, value: int, lo: int, hi: int) -> int:
        """Occurrences of the id in places lo..hi-1."""
        if value >> self.planes or lo >= hi:
            return 0
        a, b = self._range(value, lo, hi)
        return b - a

    def _place(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of the plane: the block by its directory, then inside it."""
        before = np.array(self.header["directory"][plane][1], np.int64)
        start = before if bit else np.arange(len(before)) * BITS - before
        block = int(np.searchsorted(start, j, "right")) - 1
        return block * BITS + int(np.flatnonzero(self._block(plane, block)[: self.n - block * BITS] == bit)[j - int(start[block])])

    def select(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of the id; -1 if there are not so many."""
        lo, hi = self._range(value, 0, self.n) if not value >> self.planes else (0, 0)
        if not 0 <= j < hi - lo:
            return -1
        at = lo + j
        for k in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - k) & 1
            at = self._place(k, bit, at - self.zeros[k] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each parting is undone."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        unpack = zstandard.ZstdDecompressor()
        for k in range(self.planes - 1, -1, -1):
            ends = self._ends[k]
            raw = b"".join(unpack.decompress(self._data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).view(bool)
            order = np.empty(self.n, kind)
            order[~bits] = values[: self.zeros[k]]
            order[bits] = values[self.zeros[k] :] | kind(1 << (self.planes - 1 - k))
            values = order
        return values
