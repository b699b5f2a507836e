"""Words of many texts at once: their places and 64-bit hashes, as numpy arrays over the texts' bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_BYTES = np.arange(256)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes between words: white space of ASCII, or all of ASCII but letters and digits.
WHITE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
NOT_ALPHANUMERIC = (_BYTES < 128) & ~np.array([chr(b).isalnum() for b in _BYTES])

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        steps = np.full(max(n, 1 << 21), _BASE, np.uint64), np.full(max(n, 1 << 21), _UNBASE, np.uint64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(s, dtype=np.uint64)]) for s in steps]
    return _powers[0], _powers[1]


class ByteHashes:
    """Hashes of any substrings of one byte array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def word_places(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE):
    """Starts, ends and text numbers of all words; no word goes over the end of a text."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~between[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE):
    """The hash of each word, A-Z in lower case, and its text number."""
    starts, ends, owner = word_places(data, offsets, between)
    return ByteHashes(LOWER[data]).between(starts, ends), owner


#: Words of more bytes are hashed one by one.
_LONG_WORD = 1024
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chained_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of substrings, eight bytes after eight through :func:`mix`; unlike sums, no pattern of bytes cancels out."""
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    sizes = ends - starts
    hashes = mix(sizes.astype(np.uint64) + np.uint64(_BASE))
    going, at = np.flatnonzero((sizes > 0) & (sizes <= _LONG_WORD)), 0
    while len(going):
        read = eights[starts[going] + at].view("<u8").ravel() & _HEADS[np.minimum(sizes[going] - at, 8)]
        hashes[going] = mix(hashes[going] ^ read)
        at += 8
        going = going[sizes[going] > at]
    for k in np.flatnonzero(sizes > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        hashes[k] = int.from_bytes(digest, "little")
    return hashes


def shingles(words: np.ndarray, owner: np.ndarray, n_texts: int, size: int):
    """Hashes of all runs of ``size`` words and their text numbers.

    A text with fewer words, but at least one, has its whole sequence as the only run.
    """
    counts = np.bincount(owner, minlength=n_texts)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    span = np.minimum(counts, size)
    runs = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    owners = np.repeat(np.arange(n_texts), runs)
    begins = np.arange(len(owners)) - np.repeat(np.cumsum(runs) - runs, runs) + firsts[owners]
    total = np.zeros(len(owners), np.uint64)
    for k in range(size):
        there = span[owners] > k
        factor = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        total[there] += mix(words[begins[there] + k] + np.uint64(k + 1)) * factor
    return mix(total + span[owners].astype(np.uint64)), owners


def distinct(hashes: np.ndarray, owner: np.ndarray, n_texts: int):
    """Sorted distinct hashes of each text, one text after the other, and the offsets of the texts."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[first], o[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=n_texts))]).astype(np.int64)
