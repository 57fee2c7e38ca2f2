"""Hashes of word shingles of one text."""

from __future__ import annotations

import numpy as np


def shingle_hashes(value: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of `words` words (ASCII lower case, cut at ASCII white space); repeats included.

    A shorter text is one shingle, a text without words none.
    """
    import xxhash

    parts = value.encode("utf-8", "surrogatepass").lower().split() if value else []
    if not parts:
        return np.zeros(0, "uint64")
    n, hashed = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, parts), "int64", len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    joined = b" ".join(parts)
    return np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), "uint64", n)
