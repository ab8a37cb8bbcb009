"""Walking over whole texts of any length in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes that are cut into words at a time.
PIECE = 1 << 20


def word_lists(text: bytes | None, piece: int | None = None) -> Iterator[list[bytes]]:
    """All words of a text, in order, in lists; ASCII white space separates words."""
    piece = piece or PIECE
    at, end = 0, len(text or b"")
    while at < end:
        stop = at + piece
        if stop < end:
            gap = _SPACE.search(text, stop)
            stop = gap.start() if gap else end
        yield text[at:stop].split()
        at = stop
