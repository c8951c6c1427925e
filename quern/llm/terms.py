"""Terms of whole texts: maximal runs of letters (and digits) and of all characters beyond ASCII, only A-Z lower-cased.

All separators are ASCII, so a text's UTF-8 bytes are split as they are: one table maps A-Z to a-z and every separator to a
blank, other bytes stay.
"""

from __future__ import annotations

import pyarrow as pa

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(digits: bool) -> bytes:
    """The table for ``bytes.translate``; ``digits``: 0-9 belong to terms."""
    kept = LOWER + "0123456789" * digits
    return bytes(ord(chr(b).lower()) if chr(b) in UPPER else b if b > 127 or chr(b) in kept else 32 for b in range(256))


def split(data: bytes | None, by: bytes) -> list[bytes]:
    return data.translate(by).split() if data else []


def texts(terms: list[bytes]) -> pa.Array:
    """Terms as an Arrow string column: they end at ASCII characters, so they hold whole characters."""
    return pa.array(terms, pa.binary()).view(pa.string())
