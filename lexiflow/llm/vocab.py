"""Reading byte-level BPE vocabulary files of the tokenizers library."""

from __future__ import annotations

import json


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
