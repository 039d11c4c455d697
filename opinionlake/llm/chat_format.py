"""Chat formatting: conversations as windows of bounded length, with masks over what is to be learnt.

Each turn has a number of tokens, and a prefix sum gives its start in the conversation. Starts are cut into cells of the length that the budget
leaves beside the system turn and the history; turns belong to the cell in which they start. A cell's last turn, if it does not fit, gets a window of its own. So
windows consist of whole turns, and only a turn longer than all that is left exceeds the budget. A window begins with the system turn, then repeats those turns before it whose start lies
within ``history`` tokens of its own, then has its own turns. Only assistant texts among its own turns are under the mask: repeated ones are not learnt twice.

Prefix sums are made in blocks (sums inside a block of turns, totals of the blocks before), and cells, repeats and windows by equality on (conversation, cell), so a
conversation with a third of all turns is spread over many tasks.

The template marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings in texts get a backslash behind their first character, those that have
backslashes there already one more; reading takes one away again. In roles, backslashes and line ends are written as two characters.

Null texts and roles are empty; null turn numbers come first; equal turn numbers are ordered by role and text; rows without a conversation id are one
conversation; repeated rows are turns of their own; an empty table gives an empty result. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.llm.common import written

BUDGET, HISTORY, LEAST = 2048, 512, 256
#: Tokens that the marks of a turn count for.
MARKS = 5
BLOCK = 4096
#: Control strings of common chat templates, which texts must not bring in.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and the spans (code points) under the mask; turns are (role, text, learnt)."""
    parts, spans, at = [], [], 0
    for role, text, learnt in turns:
        head, body = f"<|im_start|>{escape_role(role)}\n", escape(text)
        if learnt:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}<|im_end|>\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns with ``tokens`` before them in the conversation (``start``), their place there (``place``) and the whole's first turn."""
    # Blocks of the conversation's order: the turn number where it is dense; a turn number's rows stay together.
    blocked = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 63))) / BLOCK))
    totals = blocked.groupBy("conv", "block").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("conv").alias("_conv"), F.col("block").alias("_block"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_tokens"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_count"),
    )
    placed = blocked.join(offsets, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sums = F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return placed.select(
        "conv", "role", "text", "tokens", (F.col("_tokens") + sums).alias("start"), (F.col("_count") + F.row_number().over(inside) - 1).cast("bigint").alias("place")
    )


def count_tokens(tokenizer: str | None):
    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        if tokenizer is None:
            return texts.str.count(r"\w+|[^\w\s]").astype("int64")
        from opinionlake.llm.token_output import encoder

        return pd.Series([len(encoder(tokenizer).ids(t)) // 4 for t in texts], dtype="int64")

    return count


def windows(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None,
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """(conv_id, cell, part, turns): the turns of each window as structs (kind, place, role, text); kind is 0 system, 1 repeated, 2 own."""
    slim = rows.select(
        F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    turns = written(_ordered(slim.withColumn("tokens", count_tokens(tokenizer)(F.col("text")) + MARKS)), "turns")
    system = turns.filter((F.col("place") == 0) & (F.col("role") == "system")).select(F.col("conv").alias("_conv"), F.col("text").alias("_system"), F.col("tokens").alias("_long"))
    room = F.greatest(F.lit(budget - history) - F.coalesce("_long", F.lit(0)), F.lit(LEAST))
    body = turns.join(system.select("_conv", "_long"), F.col("conv").eqNullSafe(F.col("_conv")), "left").withColumn("_room", room)
    # The system turn itself opens the conversation and is its first window's own turn.
    body = body.withColumn("cell", F.floor(F.col("start") / F.col("_room"))).select("conv", "role", "text", "tokens", "start", "place", "cell", "_room")
    group = Window.partitionBy("conv", "cell")
    last = F.col("place") == F.max("place").over(group)
    too_long = F.col("start") + F.col("tokens") - F.min("start").over(group) > F.col("_room")
    alone = last & too_long & (F.col("place") > F.min("place").over(group))
    own = written(body.withColumn("part", alone.cast("int")), "own")
    heads = own.groupBy("conv", "cell", "part").agg(F.min("start").alias("_from"), F.min("place").alias("_first"))
    # A turn can be repeated by windows that begin at most ``history`` tokens after it, so in its own cell or the next cells up to there.
    reach = F.sequence(F.col("cell"), F.floor((F.col("start") + history) / F.col("_room")))
    offered = own.filter(F.col("tokens") <= history).select("conv", "role", "text", "start", "place", F.explode(reach).alias("cell"))
    named = heads.select(F.col("conv").alias("_conv"), F.col("cell").alias("_cell"), "part", "_from", "_first")
    met = offered.join(named, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("cell") == F.col("_cell")))
    system_first = (F.col("place") == 0) & (F.col("role") == "system")
    met = met.filter((F.col("place") < F.col("_first")) & (F.col("start") >= F.col("_from") - history) & ~system_first)
    kept = heads.filter(F.col("_first") > 0).join(system, F.col("conv").eqNullSafe(F.col("_conv")))
    struct = lambda kind, place, role, text: F.struct(F.lit(kind).alias("kind"), place.cast("bigint").alias("place"), role.alias("role"), text.alias("text"))
    c = F.col
    parts = (
        own.select("conv", "cell", "part", struct(2, c("place"), c("role"), c("text")).alias("t"))
        .unionAll(met.select("conv", "cell", "part", struct(1, c("place"), c("role"), c("text")).alias("t")))
        .unionAll(kept.select("conv", "cell", "part", struct(0, F.lit(0), F.lit("system"), c("_system")).alias("t")))
    )
    # A window's turns are bounded by the budget, so they may be gathered.
    return parts.groupBy("conv", "cell", "part").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumnRenamed("conv", conv_id)


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [render([(t["role"], t["text"], t["kind"] == 2 and t["role"] == "assistant") for t in turns]) for turns in batch["turns"]]
        yield pd.DataFrame({
            "conv": batch["conv"].array, "cell": batch["cell"], "part": batch["part"], "repeated": [sum(t["kind"] < 2 for t in turns) for turns in batch["turns"]],
            "formatted": [f for f, _ in made], "loss": [[{"start": a, "end": b} for a, b in spans] for _, spans in made],
        })


def format_chats(rows: DataFrame, conv_id: str = "conv_id", **options) -> DataFrame:
    """(conv_id, cell, part, repeated, formatted, loss): windows in the order (cell, part); ``repeated`` turns open each, ``loss`` are spans to learn."""
    made = windows(rows, conv_id, **options).select(F.col(f"`{conv_id}`").cast("string").alias("conv"), "cell", "part", "turns")  # as text, for pandas has no whole numbers beside nulls
    schema = "conv string, cell bigint, part int, repeated int, formatted string, loss array<struct<start:int,end:int>>"
    out = made.mapInPandas(_rendered, schema)
    return out.select(F.col("conv").cast("bigint").alias(conv_id), "cell", "part", "repeated", "formatted", "loss")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams windows in order; holds the running digests of one conversation, never its turns."""
    here, state = object(), None

    def row(conv, s):
        return pd.DataFrame({
            "conv": [conv], "n_turns": [s[0]], "turns_sha256": [s[1].hexdigest()], "loss_chars": [s[2]], "loss_sha256": [s[3].hexdigest()],
            "formatted_chars": [s[4]],
        })

    for batch in batches:
        out = []
        for conv, repeated, formatted, loss in zip(batch["conv"], batch["repeated"], batch["formatted"], batch["loss"], strict=True):
            if state is None or conv != here:
                if state is not None:
                    out.append(row(here, state))
                here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                learnt = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        if out:
            yield pd.concat(out)
    if state is not None:
        yield row(here, state)


def digests(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation, read from the formatted windows: turns and learnt texts as counts and digests.

    A digest needs its windows in order, so one task streams a conversation's windows; it keeps the digest's state only.
    """
    slim = formatted.select(F.col(f"`{conv_id}`").cast("string").alias("conv"), "cell", "part", "repeated", "formatted", "loss")
    ordered = slim.repartition("conv").sortWithinPartitions("conv", "cell", "part")
    out = ordered.mapInPandas(_digests, "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return out.withColumn("conv", F.col("conv").cast("bigint")).withColumnRenamed("conv", conv_id)
