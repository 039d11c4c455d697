"""Large JSON files that hold one list, cut into byte ranges that tasks read on their own.

Where an element of the list ends depends on the strings and brackets before it. So each range gives, for every string state
it might begin in, the state at its end, the change of depth and the lowest depth; these are composed per file in order, a few
numbers a range. Each range then parses the elements that begin in it, reading on for the last one. The list is the whole file
or the value of a member of an outer object. A task holds one range and the element that leaves it; what stands around the list
is read by one task.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: String states between bytes: in no string, in a string, behind a backslash in a string.
OUTSIDE, STRING, ESCAPED = STATES = range(3)

_INSIDE = rb'(?>[^"\\]+|\\.)*+'
_OPEN_PART = re.compile(_INSIDE, re.S)
_CLOSE = re.compile(_INSIDE + rb'"', re.S)
_STRING = re.compile(rb'"' + _INSIDE + rb'"', re.S)
#: Strings (also one that does not end), brackets and commas; below a certain depth also objects that hold no brackets as one token.
_TOKEN = re.compile(rb'"' + _INSIDE + rb'(?:"|\\?\Z)|[\[\]{},]', re.S)
_FLAT = re.compile(rb'\{(?>[^"{}\[\]]+|"' + _INSIDE + rb'")*+\}|' + _TOKEN.pattern, re.S)
_VALUE = re.compile(rb"[ \t\n\r]*+(?::[ \t\n\r]*+(.)?)?", re.S)
_NOT_BRACKETS = bytes(b for b in range(256) if b not in b"[]{}")
_LEAD = re.compile(rb"[^ \t\n\r]")
#: Bytes that hold a member's name of up to eight characters, each escaped, and its quotes.
NAME_BYTES = 64


def _string_end(data: bytes, state: int) -> int:
    """Place behind the string that is open at the start (0: none is); -1 if it does not end here."""
    if state == OUTSIDE:
        return 0
    end = _CLOSE.match(data, int(state == ESCAPED))
    return end.end() if end else -1


def _rest(data: bytes, at: int) -> tuple[int, int, int]:
    body = data[at:]
    odd = (len(body) - len(body.rstrip(b"\\"))) % 2
    # A quote set behind the bytes closes a string that is open there, and stays alone otherwise.
    bare = _STRING.sub(b"", body[: len(body) - odd] + b'"')
    state = OUTSIDE if bare.endswith(b'"') else ESCAPED if odd else STRING
    brackets = np.frombuffer(bare.translate(None, _NOT_BRACKETS), "uint8")
    depth = np.cumsum(np.where(brackets & 4, -1, 1))
    return (state, int(depth[-1]), int(depth.min())) if len(depth) else (state, 0, 1)


def outcomes(data: bytes) -> list[tuple[int, int, int]]:
    """For each state at the start: state at the end, change of depth, lowest change on the way (1: no bracket closes or opens)."""
    seen: dict[int, tuple[int, int, int]] = {}
    out = []
    for entry in STATES:
        at = _string_end(data, entry)
        if at < 0:
            whole = _OPEN_PART.match(data, min(int(entry == ESCAPED), len(data))).end() == len(data)
            out.append((STRING if whole else ESCAPED, 0, 1))
            continue
        if at not in seen:
            seen[at] = _rest(data, at)
        out.append(seen[at])
    return out


def lead(data: bytes) -> tuple[int, str]:
    """Place and character of the first byte that is no white space; (-1, "") without one."""
    found = _LEAD.search(data)
    return (found.start(), found.group().decode("latin-1")) if found else (-1, "")


def compose(ranges: list[list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """(string state at the start, depth at the start, lowest depth in it) of each range of a file; the lowest is large where no bracket is."""
    state, depth, out = OUTSIDE, 0, []
    for maps in ranges:
        end, change, low = maps[state]
        out.append((state, depth, depth + low))
        state, depth = end, depth + change
    return out


def member(data: bytes, size: int, state: int, depth: int, name: str, more) -> tuple[int, bool]:
    """The last member ``name`` of the outer object whose name begins in the first ``size`` bytes and whose value is a list.

    Gives the place of the list's bracket and whether the list ends in these bytes; (-1, False) without such a member, (-2, False) where
    the last such member is no list. ``data`` holds ``NAME_BYTES`` more than the range and ``more(n)`` the ``n`` bytes from the range's
    start.
    """
    at, found, shut, full = _string_end(data, state), -1, False, data
    while 0 <= at < size:
        token = (_FLAT if depth >= 1 else _TOKEN).search(data, at)
        if token is None or token.start() >= size:
            break
        at, first = token.end(), data[token.start()]
        if first == 0x22:
            if depth == 1 and len(token.group()) <= NAME_BYTES and _named(token.group(), name):
                reach, value = len(full), _VALUE.match(full, at)
                while value.end() == len(full) and value.group(1) is None:
                    reach *= 2
                    longer = more(reach)
                    if len(longer) == len(full):
                        break
                    full, value = longer, _VALUE.match(longer, at)
                if b":" in value.group():
                    found, shut = (value.end() - 1, False) if value.group(1) == b"[" else (-2, False)
        elif len(token.group()) == 1 and first != 0x2C:
            depth += -1 if first & 4 else 1
            if found >= 0 and depth == 1 and token.start() > found:
                shut = True
    return found, shut


def _named(token: bytes, name: str) -> bool:
    try:
        return json.loads(token) == name
    except ValueError:
        return False


def elements(data: bytes, state: int, depth: int, level: int, bracket: int = -1) -> tuple[list[tuple[int, int]], int, int]:
    """Elements that begin here as (begin, end), the beginning of one that does not end here, and the place of the list's end (-1: none).

    ``bracket`` is where the list begins, -1 if before these bytes; ``level`` is the depth in the list.
    """
    at, begin, out = (bracket + 1, bracket + 1, []) if bracket >= 0 else (_string_end(data, state), -1, [])
    if bracket >= 0:
        depth = level
    while 0 <= at < len(data):
        token = (_FLAT if depth >= level else _TOKEN).search(data, at)
        if token is None:
            break
        at, first = token.end(), data[token.start()]
        if first == 0x2C:
            if depth == level:
                if begin >= 0:
                    out.append((begin, token.start()))
                begin = at
        elif first != 0x22 and len(token.group()) == 1:
            depth += -1 if first & 4 else 1
            if depth < level:
                if begin >= 0:
                    out.append((begin, token.start()))
                return out, -1, token.start()
    return out, begin, -1
