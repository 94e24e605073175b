"""Rank files of byte-level tokenizers: one line per piece, base64 bytes and rank."""
from __future__ import annotations

import base64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
