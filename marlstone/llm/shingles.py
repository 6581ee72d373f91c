"""Words, shingles and SimHash fingerprints of one text, as Python workers compute them."""

from __future__ import annotations

import numpy as np

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles in order, repeats included: ``shingle`` words, joined by one space; of
    fewer words one shingle, of none no shingle.  A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    spans = zip((ends - sizes)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def fingerprint_of(h: np.ndarray) -> np.uint64:
    """A bit is 1 if it is set in over half the hashes; of no hash 0."""
    counts, part = np.zeros(64, np.int64), 65_536
    for at in range(0, len(h), part):
        counts += np.unpackbits(h[at : at + part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
