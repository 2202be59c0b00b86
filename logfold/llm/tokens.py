"""Tokenizing whole texts with public byte-level vocabularies."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

#: Without white space of two characters or more the pattern's look-ahead can't matter, and its faster form is used.
_RUN = re.compile(r"\s\s")
_AHEAD = r"|\s+(?!\S)"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def coders(path: str):
    """The coder by the public split pattern, and one by the pattern without its look-ahead. Both know <|endoftext|> by the first free id."""
    import public_tokenizers
    import tiktoken

    known = ranks(path)
    return tuple(tiktoken.Encoding(f"ranks{k}", pat_str=p, mergeable_ranks=known, special_tokens={"<|endoftext|>": len(known)}) for k, p in enumerate((public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(_AHEAD, ""))))


def encode(text: str, path: str, end: bool = True) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit words. end: <|endoftext|> in the text is its one id, as the
    tokenizers library reads it by default; else it is ordinary text."""
    whole, fast = coders(path)
    if end and "<|endoftext|>" in text:
        return array("I", whole.encode(text, allowed_special="all")).tobytes()
    return array("I", (whole if _RUN.search(text) else fast).encode_ordinary(text)).tobytes()
