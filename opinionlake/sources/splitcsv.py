"""Large quoted CSV files cut into byte ranges that tasks read on their own.

Whether a line end closes a record depends on all quotes before it. So each range is first read under every state it
might begin in, which gives a map "state at its start -> state at its end"; the maps of a file are composed in order, a
few bytes a range, and each range is then parsed from the first record that begins in it to the end of the last one.
A task holds one range and the record that leaves it. The records are those of a sequential reader.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator

#: States between bytes: a record begins, a field begins, in an unquoted field, in quotes, behind a quote in quotes.
RECORD, FIELD, PLAIN, QUOTED, CLOSED = STATES = range(5)

_PLAIN_END = re.compile(rb"[,\n]")
_FIELD = rb'(?:"(?>[^"]+|"")*+"[^,\n"]*+|[^",\n][^,\n]*+|)'
_WHOLE = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+\n")
BOM = codecs.BOM_UTF8


def _step(state: int, data: bytes, at: int) -> tuple[int, int]:
    """The state after the byte at ``at``, or after the run of bytes that leave it as it is, and where that is."""
    byte = data[at : at + 1]
    if state in (RECORD, FIELD):
        return {b'"': QUOTED, b",": FIELD, b"\n": RECORD}.get(byte, PLAIN), at + 1
    if state == PLAIN:
        end = _PLAIN_END.search(data, at)
        return (PLAIN, len(data)) if end is None else ((FIELD if end.group() == b"," else RECORD), end.end())
    if state == QUOTED:
        end = data.find(b'"', at)
        return (QUOTED, len(data)) if end < 0 else (CLOSED, end + 1)
    return {b'"': QUOTED, b",": FIELD, b"\n": RECORD}.get(byte, PLAIN), at + 1


def record_end(data: bytes, state: int, at: int = 0) -> tuple[int, int]:
    """(state, place) where the record that is open ends, or where the bytes do."""
    while at < len(data):
        state, at = _step(state, data, at)
        if state == RECORD:
            break
    return state, at


def _rest(data: bytes, at: int, ahead: bytes) -> tuple[int, int]:
    """(state at the end, records with content) of bytes in which a record begins at ``at``."""
    count, size = 0, len(data)
    while at < size:
        blank = data[at : at + 1] == b"\n" or (data[at : at + 2] or b"") == b"\r\n" or (data[at:] == b"\r" and ahead == b"\n")
        count += not blank
        whole = _WHOLE.match(data, at)
        if whole is None:
            state, at = record_end(data, RECORD, at)
            if state != RECORD:
                return state, count
        else:
            at = whole.end()
    return RECORD, count


def outcomes(data: bytes, ahead: bytes = b"") -> list[tuple[int, int, int]]:
    """For each state at the start: state at the end, offset of the first record that begins here (-1: none), records with content.

    Hypotheses that meet at the same record go on together.
    """
    seen: dict[int, tuple[int, int]] = {}
    out = []
    for entry in STATES:
        state, first = (RECORD, 0) if entry == RECORD else record_end(data, entry)
        if first >= len(data) or state != RECORD:
            out.append((state, -1, 0))
            continue
        if first not in seen:
            seen[first] = _rest(data, first, ahead)
        out.append((seen[first][0], first, seen[first][1]))
    return out


def end_state(data: bytes) -> int:
    """State at the end of bytes at whose start a record begins."""
    return _rest(data, 0, b"")[0]


def compose(ranges: list[list[tuple[int, int, int]]]) -> list[tuple[int, int]]:
    """(offset of the first record, number of records before) of each range of a file, in order."""
    state, before, out = RECORD, 0, []
    for maps in ranges:
        end, first, count = maps[state]
        out.append((first, before))
        state, before = end, before + count
    return out


def valid_utf8(data: bytes, ahead: bytes, begins_file: bool = False) -> bool:
    """Whether the characters that begin in ``data`` are whole; ``ahead`` are the three bytes after it."""
    skip = 0
    while not begins_file and skip < min(3, len(data)) and 0x80 <= data[skip] < 0xC0:
        skip += 1  # the end of a character of the range before, which that range judges
    if skip == len(data):
        return True
    more = 0
    while more < len(ahead) and 0x80 <= ahead[more] < 0xC0:
        more += 1
    try:
        (data[skip:] + ahead[:more]).decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def records(data: bytes) -> Iterator[list[str]]:
    """The records of whole lines, blank ones left out."""
    csv.field_size_limit(2**31 - 1)
    return (row for row in csv.reader(io.StringIO(data.decode("utf-8"), newline="")) if row)
