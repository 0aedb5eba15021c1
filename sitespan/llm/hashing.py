"""64-bit hashes of all words of many texts at once, in numpy.

A word's hash is a polynomial over its bytes, taken from prefix sums mod 2**64:
no object is made for a word, and nothing is remembered. Words are split at
U+0020 and U+0009 to U+000D alone, with A-Z in lower case. Words of LONG bytes
or more go through xxhash.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

BLOCK = 1 << 18  # bytes hashed at once
LONG = 1 << 16
_SPACES = re.compile(rb"[ \t-\r]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, _BASE)]))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _of_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of at most BLOCK bytes that begin and end with whole words."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[a], [True]])))
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * _POWER[: len(a)], dtype=np.uint64)])
        h = mixed((sums[ends] - sums[starts]) * _POWER[BLOCK - starts])
    for i in np.flatnonzero(ends - starts >= LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h, starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and how many each text has."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts).lower()
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data) and not _IS_SPACE[data[end]]:
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # a word that fills the block
                m = _SPACES.search(data, end)
                end = m.start() if m else len(data)
                hashes.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64))
                starts.append(np.array([at]))
                at = end
                continue
            end = cut + 1
        h, s = _of_block(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), begins))
