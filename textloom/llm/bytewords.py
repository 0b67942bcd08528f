"""Words of a text as bytes: runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case.

In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so a table of 256 bytes gives the words.
"""

from __future__ import annotations

import re

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """The words in order; none of None."""
    return raw.translate(_TABLE).split() if raw else []


def word_places(raw: bytes) -> list[tuple[int, int]]:
    """The first byte and the end of each word."""
    return [m.span() for m in _WORD.finditer(raw)]
