"""Greedy request batches in item order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.operators import ranks

BLOCK = 8192


def json_size(*columns):
    """Characters of the row as JSON with a blank after every comma and colon, nulls included."""
    packed = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.length(packed) + 2 * len(columns) - 1


def _next_starts(sizes: np.ndarray, max_items: int, max_chars: int) -> np.ndarray:
    """For a batch that starts at each row, the row at which the next one starts."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    by_chars = np.searchsorted(total, total[:-1] + max_chars, "right") - 1
    return np.maximum(at + 1, np.minimum(at + max_items, by_chars))


def pack(rows: DataFrame, keys, order: str, size: str, max_items=C.PACK_ITEMS, max_chars=C.PACK_CHARS, block=BLOCK) -> DataFrame:
    """``batch_no`` per row: a batch closes before the row that would exceed either limit.

    The plain sequential packing of a whole job, made in blocks of ``block`` rows. A batch that reaches over a block's edge ends within
    ``max_items`` rows of it, so a block is a map of few entries: where its first new batch starts -> where the next block's does, and how many
    start here. The maps of a job are walked in order, which gives each block its entry; then the blocks are numbered independently.
    """
    keys = list(keys)
    block = max(block, max_items)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    named = ", ".join(f"{k} {fields[k]}" for k in keys)
    placed = ranks.block_rank(rows.select(*keys, "id", order, F.col(size).cast("bigint").alias("_size")), keys, order, "_n")
    placed = placed.withColumns({"_part": F.floor((F.col("_n") - 1) / block), "_off": (F.col("_n") - 1) % block})
    # The rows that a batch may reach into belong to the block before as well.
    ahead = placed.filter((F.col("_off") < max_items) & (F.col("_part") > 0)).select(*keys, (F.col("_part") - 1).alias("_part"), (F.col("_off") + block).alias("_off"), "_size")
    seen = placed.select(*keys, "_part", "_off", "_size").unionAll(ahead)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_off")
        own = int((pdf["_off"] < block).sum())
        following = _next_starts(pdf["_size"].to_numpy(), max_items, max_chars)
        exits, starts = [], []
        # Entries from the back: what lies behind an entry's next start is known already.
        leave, count = {}, {}
        for at in range(own - 1, -1, -1):
            to = int(following[at])
            leave[at], count[at] = (to - own, 1) if to >= own else (leave[to], count[to] + 1)
        for entry in range(max_items):
            exits.append(leave[entry] if entry < own else 0)
            starts.append(count[entry] if entry < own else 0)
        return pdf[[*keys, "_part"]].head(1).assign(exits=[exits], starts=[starts])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        entry, before, out = 0, 0, []
        for exits, starts in zip(pdf["exits"], pdf["starts"], strict=True):
            out.append((entry, before))
            entry, before = int(exits[entry]), before + int(starts[entry])
        return pdf[[*keys, "_part"]].assign(entry=[e for e, _ in out], before=[b for _, b in out])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_off")
        following = _next_starts(pdf["_size"].to_numpy(), max_items, max_chars)
        opens, at = np.zeros(len(pdf), np.int64), int(pdf["entry"].iloc[0])
        while at < len(pdf):
            opens[at] = 1
            at = int(following[at])
        return pdf[[*keys, "id"]].assign(batch_no=np.cumsum(opens) + int(pdf["before"].iloc[0]))

    mapped = seen.groupBy(*keys, "_part").applyInPandas(maps, f"{named}, _part bigint, exits array<bigint>, starts array<bigint>")
    entries = mapped.groupBy(*keys).applyInPandas(walk, f"{named}, _part bigint, entry bigint, before bigint")
    met = placed.join(entries, [*keys, "_part"])
    return met.groupBy(*keys, "_part").applyInPandas(number, f"{named}, id string, batch_no bigint")
