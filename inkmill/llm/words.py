"""Words of whole texts as 64-bit hashes, by numpy over the bytes of Arrow batches, without a Python object for each word.

A word is a run of bytes of a set; A-Z are lower-cased. Its hash is a polynomial over its bytes, taken from
running sums, and mixed; hashes of different words agree with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  #: bytes hashed at once; longer only where one word is
FACTOR, LENGTH = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)  # odd, so that they have inverses
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)


def byte_set(outside: list[tuple[int, int]]) -> np.ndarray:
    """A mask of all bytes but those of the ranges given."""
    inside = np.ones(256, dtype=bool)
    for first, last in outside:
        inside[first : last + 1] = False
    return inside


BLANK_SEPARATED = byte_set([(0x20, 0x20), (0x09, 0x0D)])  #: [^\x20\x09-\x0D]+
ALPHANUMERIC = byte_set([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])  #: letters and digits, and all beyond ASCII


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers 0 to n - 1, and its inverse to the same, both modulo 2^64."""
    out = []
    for base in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over the whole (a finaliser of two multiplications)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and how many each text has; null texts have none."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
    found, at, p, end = [], [], int(bounds[0]), int(bounds[-1])
    while p < end:
        q = cut(data, bounds, inside, p, end)
        raw = data[p:q]
        ok, new = inside[raw], np.zeros(q - p + 1, dtype=bool)
        here = bounds[np.searchsorted(bounds, p) : np.searchsorted(bounds, q, "right")]
        new[here - p] = True
        new[-1] = True
        first = np.flatnonzero(ok & (new[:-1] | ~np.concatenate([[False], ok[:-1]])))
        last = np.flatnonzero(ok & (new[1:] | ~np.concatenate([ok[1:], [False]])))
        up, down = powers(CHUNK if q - p <= CHUNK else 1 << int(q - p).bit_length())
        terms = (LOWER[raw] + np.uint64(1)) * up[: q - p]
        sums = np.cumsum(terms)
        found.append(mix((sums[last] - sums[first] + terms[first]) * down[first] ^ (last - first + 1).astype(np.uint64) * LENGTH))
        at.append(first + p)
        p = q
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.searchsorted(np.concatenate(at), bounds)
    return np.concatenate(found), np.diff(place)


def cut(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, p: int, end: int) -> int:
    """Where the chunk from p on ends: between texts, or else between words, or else behind a word longer than a chunk."""
    q = min(p + CHUNK, end)
    if q == end:
        return q
    b = int(bounds[np.searchsorted(bounds, q, "right") - 1])
    if b > p:
        return b
    gaps = np.flatnonzero(~inside[data[p:q]])
    if len(gaps):
        return p + int(gaps[-1]) + 1
    stop, q = int(bounds[np.searchsorted(bounds, p, "right")]), p + CHUNK
    while q < stop and inside[data[q]]:
        gaps = np.flatnonzero(~inside[data[q : q + CHUNK]])
        q = min(stop, q + (int(gaps[0]) if len(gaps) else CHUNK))
    return min(q, stop)
