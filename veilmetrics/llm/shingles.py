"""Word shingles and their XXH64 hashes, for the Python stages."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from xxhash import xxh64_digest

SEED = 42


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() splits on just these, and bytes.lower() changes A-Z alone."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each k consecutive words joined by spaces, repeats included; of the whole sequence if there are fewer; none of none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.frombuffer(xxh64_digest(joined, SEED), ">u8").astype(np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-k])]
    return np.frombuffer(b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]), ">u8").astype(np.uint64)


_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.frombuffer(b"".join([xxh64_digest(w, seed) for w in words]), ">u8").astype(np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), np.uint64(base))]), dtype=np.uint64)[:n]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive numbers, in time that does not grow with k; empty if there are fewer."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(len(h), _P), dtype=np.uint64)])
        return mix((total[k:] - total[:-k]) * powers(len(h) - k + 1, _INVERSE))
