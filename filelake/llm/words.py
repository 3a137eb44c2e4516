"""Words of many texts at once, as 64-bit hashes, by numpy over the UTF-8 bytes of an Arrow batch.

A word's hash is a polynomial over random values of its bytes, mixed with its length; a shingle's is
multilinear in its words' hashes. Each is a function of the bytes alone, so it is the same in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 - 2  # odd, and 3 modulo 8


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = stream(256, 11)[LOWER]
STEP = stream(64, 23) | U(1)
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes of a word: all but white space; or letters, digits and all beyond ASCII.
NOT_SPACE = ~SPACES
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        full = np.full(max(n, 1 << 20), base & (2**64 - 1), U)
        full[0] = 1
        _powers[kind] = np.multiply.accumulate(full)
    return _powers[kind][:n]


@dataclass
class Words:
    start: np.ndarray  # byte at which each word begins
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray  # index of each text's first word; one more than texts

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.off[1:], np.diff(self.off)) - np.arange(len(self.hash))


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_SPACE) -> Words:
    """Words of texts data[offs[i]:offs[i+1]], lower-cased A-Z; no word crosses texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(len(offs), np.int64))
    is_in = inside[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_in[:-1]
    cut = offs[:-1][offs[:-1] < n]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_in[1:]
    after[cut[cut > 0] - 1] = False
    start, end = np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum(VALUE[data] * _power("up", n), out=total[1:])
        hashed = (total[end] - total[start]) * _power("down", n)[start]
        hashed = mix(hashed + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return Words(start, end, hashed, np.searchsorted(start, offs).astype(np.int64))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and the offset of each text's first. A text of fewer words, but
    not none, has its whole sequence as its one shingle."""
    n, count = len(w.hash), np.diff(w.off)
    have = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(have)]).astype(np.int64)
    with np.errstate(over="ignore"):
        padded = np.concatenate([w.hash, np.zeros(k, U)])
        full = np.zeros(n, U)
        for j in range(k):
            full += padded[j : j + n] * STEP[j]
        at = np.arange(off[-1]) + np.repeat(w.off[:-1] - off[:-1], have)
        out = full[at] + U(k)
        for i in np.flatnonzero((count > 0) & (count < k)):
            own = w.hash[w.off[i] : w.off[i + 1]]
            out[off[i]] = (own * STEP[: len(own)]).sum(dtype=U) + U(len(own))
        return mix(out), off


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
