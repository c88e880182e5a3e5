"""Public byte-level BPE vocabularies: files of ``base64(token) rank`` lines, given by path and sent with the job."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

#: How this family of vocabularies cuts a text into pieces before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, read once on the driver (under 1 MB); closures carry them, so executors need no such path."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(4)
def ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(4)
def encoder(raw: bytes) -> tiktoken.Encoding:
    """Kept by each Python worker, for all its tasks."""
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(raw), special_tokens={})


@lru_cache(4)
def token_bytes(raw: bytes) -> np.ndarray:
    """The number of bytes of each token."""
    known = ranks(raw)
    out = np.zeros(max(known.values()) + 1, np.int64)
    for token, k in known.items():
        out[k] = len(token)
    return out
