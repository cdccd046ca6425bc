"""Words and word n-grams of whole batches of texts as 64-bit hashes, in numpy.

A word is [^\\x20\\x09-\\x0D]+. Its hash is a polynomial over its bytes modulo 2^64 with random byte values and an odd
base, read off prefix sums, and finally mixed; n-gram hashes are the same over word hashes. So the cost is a few
passes over the bytes, whatever the lengths. Two different words or n-grams share a hash with probability near 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(max(n, 1 << 20), base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: byte places, hashes, and where each text's words begin (one more than texts)."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(texts: list[str], lower: bool = False) -> Words:
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    edge = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    space = _SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[edge[:-1][edge[:-1] < n]] = True
    after[edge[1:][edge[1:] > 0] - 1] = True
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * power[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return Words(data, begin, end, hashes, np.searchsorted(begin, edge))


def ngram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on; places too near the end are left out. Texts are not told apart."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1] + np.uint64(k))


def ngram_places(first: np.ndarray, k: int) -> np.ndarray:
    """Whether an n-gram of k words that starts at each word stays within the word's text; as long as there are words."""
    n = int(first[-1])
    inside = np.ones(n, bool)
    for back in range(1, k):
        at = first[1:] - back
        inside[at[at >= first[:-1]]] = False
    return inside


def text_column(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]
