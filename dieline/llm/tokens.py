"""Public byte-level BPE vocabularies: encoders built from bytes that the driver read."""

from __future__ import annotations

import base64
import json

import tiktoken


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the characters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level BPE file of the tokenizers library.

    The ids of such a file are in merge order, so an id is the token's rank.
    """
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = {x["content"]: x["id"] for x in found["added_tokens"] if x["special"]}
    back = {c: b for b, c in byte_chars().items()}
    ranks = {bytes(back[c] for c in k): v for k, v in found["model"]["vocab"].items() if k not in special}
    return ranks, special


def encoder(ranks: dict[bytes, int], special: dict[str, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("dieline", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
