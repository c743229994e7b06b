"""Word shingles of whole texts as 64-bit hashes, by numpy over UTF-8 bytes.

Words are runs of bytes other than space and the control characters 9 to 13, with A-Z in lower case. A word's hash is
a polynomial over mixed bytes, taken from prefix sums; a shingle's hash combines the hashes of its words in order.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes hashed at once; memory is about 40 times that.
SEGMENT = 1_000_000
_U = np.uint64
#: The longest tables of powers asked for so far; see forget.
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A value for each byte (capital letters as small ones), and which bytes belong to words."""
    byte = np.arange(256, dtype=np.uint64)
    byte[65:91] += _U(32)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return mix(byte * _U(0x9E3779B97F4A7C15) + _U(0x51ED270B)), ~space


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        _POWERS.clear()
        for b in (base, inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, out=p))
    return _POWERS


def forget() -> None:
    """Drop the tables of powers that the worker keeps."""
    _POWERS.clear()


def _hash_segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, inside = _tables()
    word = inside[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    size = 1 << max(20, (len(data) - 1).bit_length())  # one table for all segments but those with a very long word
    power, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word; long texts are cut at white space, never inside a word."""
    data = np.frombuffer(text, np.uint8)
    inside = _tables()[1]
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data):
            gaps = np.flatnonzero(~inside[data[end : end + SEGMENT]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + SEGMENT)
        s, h = _hash_segment(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; with fewer words, of all of them as one; none without words."""
    if not len(words):
        return words
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix(total * _U(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return total


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The set of each text's shingles, ascending by hash."""
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, words = word_hashes(b" ".join(texts))
    cut = np.searchsorted(starts, bounds)
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(cut, cut[1:], strict=False)]
