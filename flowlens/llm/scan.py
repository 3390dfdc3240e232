r"""Scans of UTF-8 bytes with NumPy: byte classes, words and 64-bit word hashes.

Words are `[^\x20\x09-\x0D]+`. Texts are scanned in pieces of at most CHUNK bytes that end at blanks, so memory doesn't grow
with a text; only a single word of CHUNK bytes or more is longer, and its arrays never are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
SPACE, CAPITAL, SYMBOL, FOLLOWS = 1, 2, 4, 8
#: Bits of each byte: blank, capital letter, one of #$%&*|, a byte that goes on with a code point.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] |= SPACE
CLASSES[0x41:0x5B] |= CAPITAL
CLASSES[list(b"#$%&*|")] |= SYMBOL
CLASSES[0x80:0xC0] |= FOLLOWS
#: Lower case of A-Z alone.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        both = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for p in both:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        _powers[:] = both
    return _powers[0], _powers[1]


def pieces(data: np.ndarray, size: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is one long word) of consecutive pieces of at most size bytes that cut no word; a word of size bytes or more is a piece of its own."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        if end == n and end - at < size:
            yield at, end, False
            return
        gap = np.flatnonzero(CLASSES[data[at:end]] & SPACE)
        if len(gap):
            end = at + int(gap[-1]) + 1
            yield at, end, False
        else:
            while end < n and not len(gap := np.flatnonzero(CLASSES[data[end : end + size]] & SPACE)):
                end = min(n, end + size)
            end += int(gap[0]) if len(gap) and end < n else 0
            yield at, end, True
        at = end


def word_bounds(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of first and last bytes of words; offsets: where each text begins, and the end."""
    word = (kinds & SPACE) == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    some = offsets[:-1][offsets[1:] > offsets[:-1]]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    first[some], last[ends] = word[some], word[ends]
    return first, last


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], by prefix sums of a polynomial."""
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def long_hash(word: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little"))


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] differ, for each pair; eight bytes at a time."""
    out = np.zeros(len(a), bool)
    left = np.arange(len(a))
    room = np.zeros(8, np.uint8)
    for k in range(0, 64, 8):
        if not len(left):
            return out
        n = np.minimum(sizes[left] - k, 8)
        unlike = (_eight(data, a[left] + k, room) ^ _eight(data, b[left] + k, room)) & _MASKS[n]
        out[left[unlike != 0]] = True
        left = left[(unlike == 0) & (sizes[left] > k + 8)]
    for i in left.tolist():  # the same 64 bytes, and more
        out[i] = not np.array_equal(data[a[i] : a[i] + sizes[i]], data[b[i] : b[i] + sizes[i]])
    return out


def _eight(data: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The eight bytes from each place; beyond the end anything."""
    n = len(data)
    if n < 8:
        data = np.concatenate([data, room])
        n = len(data)
    inside = np.minimum(at, n - 8)
    every = np.ndarray((n - 7,), np.dtype("<u8"), data, 0, (1,))
    late = (at - inside).astype(np.uint64) * np.uint64(8)
    return every[inside] >> np.minimum(late, np.uint64(63))
