"""What a tokenizer takes for letters, numbers and other signs, found by asking it; its tables may be of another age than Python's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: The basic plane, which patterns hold as one table; other characters are rare enough to go the tokenizer's own way.
KNOWN = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000))]


def group(characters: Iterable[str]) -> str:
    """A pattern's class of characters."""
    return "[" + "".join(f"\\U{ord(c):08x}" for c in sorted(characters)) + "]"


def strangers(more: Iterable[str] = ()) -> Callable:
    """A search for characters beyond the known ones, or among ``more``."""
    return re.compile(f"[^{group(set(KNOWN) - set(more))[1:]}").search


def kinds(cut: Callable[[str], list]) -> tuple[str, str, str]:
    """Classes of letters, numbers and other visible signs, as patterns; ``cut`` gives words with their places."""

    def joined(sign: str) -> set[str]:
        """Characters that stay in one word with the sign."""
        return {KNOWN[start // 3] for _, (start, end) in cut("\n".join(sign + c for c in KNOWN)) if start % 3 == 0 and end - start == 2}

    letters, others = joined("a"), joined("!")
    numbers = joined("1") - letters - others
    if not numbers:  # words of one number each; white space is no word there
        numbers = {KNOWN[start // 2] for _, (start, _) in cut("\n".join(KNOWN)) if start % 2 == 0} - letters - others
    return group(letters), group(numbers), group(others)
