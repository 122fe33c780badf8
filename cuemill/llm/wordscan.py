"""Vectorised word scanning over the UTF-8 bytes of a batch of texts.

Every byte of a multi-byte character is 0x80 or more, so a word class that excludes ASCII characters only can be decided
byte by byte. Words, their 64-bit hashes and the hashes of word n-grams come out as numpy arrays without a Python loop
over rows or words.

A word's hash reads it eight bytes at a time, each step a keyed bijection of state and bytes with multiplications and
shifts between (no polynomial, so no family of words collides by algebra; two words of at most eight bytes and one length
never do). Words over ``LONG`` bytes take a keyed BLAKE2b. Runs of words are hashed from their words' hashes; callers that
take equal hashes of runs for equal runs use ``identity``, whose two values are independent, or compare the words.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
_KEY, _SECOND = np.uint64(0x8F1BBCDC5A827999), np.uint64(0x6ED9EBA1CA62C1D6)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LONG = 64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _alphanumeric() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = table[ord("a") : ord("z") + 1] = table[0x80:] = True
    return table


def _not_space() -> np.ndarray:
    table = np.ones(256, bool)
    table[0x20] = table[0x09:0x0E] = False
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALPHANUMERIC = _alphanumeric()
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _not_space()


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n of each at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(17, (n - 1).bit_length())
        made = []
        with np.errstate(over="ignore"):
            for x in (base, pow(base, -1, 1 << 64)):
                out = np.full(size, x, np.uint64)
                out[0] = 1
                made.append(np.multiply.accumulate(out))
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the low and high bits of a hash are usable alone."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """Hash of values[s:e] for each s, e."""
    up, down = powers(len(values) + 1, base)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def _hash_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of raw[s:e] for each s, e."""
    aligned = np.zeros(len(raw) // 8 + 2, np.uint64)
    aligned.view(np.uint8)[: len(raw)] = raw
    length = ends - starts
    with np.errstate(over="ignore"):
        out = (length.astype(np.uint64) * _K2) ^ _KEY
        todo = np.flatnonzero(length <= LONG)
        at, left = starts[todo], length[todo]
        while len(todo):
            shift = (at & 7).astype(np.uint64) << np.uint64(3)
            chunk = aligned[at >> 3] >> shift
            chunk |= (aligned[(at >> 3) + 1] << (np.uint64(63) - shift)) << np.uint64(1)
            spare = np.maximum(8 - left, 0).astype(np.uint64) << np.uint64(3)
            h = out[todo] ^ ((chunk << spare) >> spare)
            h *= _K1
            h ^= h >> np.uint64(29)
            h *= _K2
            h ^= h >> np.uint64(32)
            out[todo] = h
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"cuemill").digest(), "little")
    return mix(out)


@dataclass
class Words:
    """Words of a block of texts: byte range and hash of each, and the n + 1 word offsets of the rows."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_end(self) -> np.ndarray:
        """For each word, the index after the last word of its row."""
        return np.repeat(self.rows[1:], self.counts)

    def gram_starts(self, k: int) -> np.ndarray:
        """Starts of the runs of k words inside one row."""
        n = max(0, len(self.hashes) - k + 1)
        return np.flatnonzero(np.arange(k, k + n) <= self.row_end()[:n])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of k words inside one row, and their hashes."""
        starts = self.gram_starts(k)
        return starts, _ranges(self.hashes, starts, starts + k)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the word runs [start, end)."""
        return _ranges(self.hashes, starts, ends)

    def identity(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the word runs [start, end)."""
        return self.spans(starts, ends), _ranges(mix(self.hashes ^ _SECOND), starts, ends, _BASES[1])

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def scan(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts raw[offsets[i]:offsets[i + 1]]; ``lower`` lower-cases A-Z first."""
    offsets = offsets - offsets[0]
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = table[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(raw):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        before[edges] = after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(raw, starts, ends, _hash_bytes(raw, starts, ends), np.searchsorted(starts, offsets))


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, equal to those of ``scan``."""
    encoded = [w.encode("utf-8") for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in encoded])]).astype(np.int64)
    return _hash_bytes(np.frombuffer(b"".join(encoded), dtype=np.uint8), offsets[:-1], offsets[1:])


def hash_run(hashes: np.ndarray) -> np.uint64:
    """Hash of one run of word hashes, equal to that of ``Words.grams``."""
    return _ranges(hashes, np.array([0]), np.array([len(hashes)]))[0]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of word hashes, in another order than those of ``Words.grams``."""
    return mix(_ranges(values, starts, ends, _BASES[1]))
