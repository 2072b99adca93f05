"""Hashes of words, shingles and windows of many texts at once, in numpy.

Texts are UTF-8 bytes. Words are what ASCII white space (space, tab to carriage return)
leaves, as bytes.split() has it. A word's hash is the sum of a mixed value for each of its bytes
and places; a polynomial modulo 2**64 would be the same for certain long words, whatever its base.
Shingles and windows, of few words, are Rabin-Karp polynomials over word hashes.
"""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 18  # bytes that are hashed at a time
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BASES = [int(x) * 8 + 5 for x in _RANDOM.integers(1 << 40, 1 << 60, 4)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base & (1 << 64) - 1, dtype=np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _polynomials(values: np.ndarray, first: np.ndarray, after: np.ndarray, base: int) -> np.ndarray:
    """Of values[first:after], for each pair of bounds."""
    n = len(values)
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return (sums[after] - sums[first]) * powers(inverse, n + 1)[first]


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, after = edge[::2], edge[1::2]
    sizes = after - first
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    each = place.astype(np.uint64) << np.uint64(8) | data[word].astype(np.uint64)
    sums = np.zeros(len(each) + 1, dtype=np.uint64)
    np.cumsum(mixed(each + np.uint64(_BASES[0])), out=sums[1:])
    return sums[ends] - sums[ends - sizes], first, after


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of a text, hashed in pieces of limited size."""
    parts, at = [], 0
    while at < len(blob):
        to = min(len(blob), at + _PIECE)
        while to < len(blob) and not _SPACE[blob[to]]:
            to += 1
        h, first, after = _piece(np.frombuffer(blob, dtype=np.uint8, count=to - at, offset=at))
        parts.append((h, first + at, after + at))
        at = to
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    h, first, after = (np.concatenate(x) for x in zip(*parts, strict=True))
    return mixed(h), first, after


class Words:
    """Word hashes of several texts, one after the other.

    bounds[i]:bounds[i + 1] are the words of text i; first and after are byte positions in
    blob, in which the texts follow each other with one line end after each.
    """

    def __init__(self, texts: list[bytes]):
        self.blob = b"\n".join([*texts, b""])
        self.hashes, self.first, self.after = word_hashes(self.blob)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.bounds = np.searchsorted(self.first, self.starts)

    def windows(self, n: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of the n words from each start, and which starts lie in one text."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        at = np.arange(total - n + 1)
        if n <= 8:
            h = self.hashes[: len(at)].copy()
            for k in range(1, n):
                h *= np.uint64(_BASES[salt])
                h += self.hashes[k : k + len(at)]
        else:
            h = _polynomials(self.hashes, at, at + n, _BASES[salt])
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return mixed(h), text[at] == text[at + n - 1]

    def shingles(self, n: int) -> list[np.ndarray]:
        """Per text, the distinct hashes of n consecutive words, sorted; a text of fewer words,
        but not none, has one shingle of all."""
        h, inside = self.windows(n)
        out = []
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(h[a : b - n + 1]))
            else:
                out.append(self.whole(a, b))
        return out

    def whole(self, a: int, b: int) -> np.ndarray:
        """One hash of words a to b, other than any window's of another length; none if empty."""
        if a == b:
            return np.zeros(0, dtype=np.uint64)
        h = np.uint64(b - a)
        with np.errstate(over="ignore"):
            for x in self.hashes[a:b]:
                h = h * np.uint64(_BASES[1]) + x
            return mixed(np.array([h * np.uint64(_BASES[2])]))


def grouped(sizes: list[int], most: int = 1 << 20):
    """Bounds of slices of about `most` bytes, a longer text alone."""
    at = 0
    while at < len(sizes):
        to, size = at + 1, sizes[at]
        while to < len(sizes) and size + sizes[to] <= most:
            size += sizes[to]
            to += 1
        yield at, to
        at = to
