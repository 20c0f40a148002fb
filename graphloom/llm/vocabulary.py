"""Byte-level BPE vocabularies as ranks, read from a file that the caller names."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Where the tables of ranks of public tokenizers are installed; every operator takes another path.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of byte_bpe_50k: contractions, words, numbers, marks, each with one blank before it, and white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, which is its id and its priority as a merge."""
    out = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                out[base64.b64decode(token)] = int(rank)
    return out


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    """The vocabulary in the compiled encoder."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
