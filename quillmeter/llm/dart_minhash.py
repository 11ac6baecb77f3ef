"""Weighted MinHash signatures by throwing darts (DartMinHash), in numpy, for many texts at a time.

A text is the weighted set of its shingles (five words; fewer words make one
shingle of all), a shingle's weight being how often it occurs.  Over each
shingle lies a plane of weight and rank with hashed darts, one per unit of area
on average.  The weight axis is cut into regions [0, 1), [1, 2), [2, 4), ...;
within a region darts come in order of rank as a Poisson process whose rate is
the region's width, each at a uniform place of the width.  A text of total
weight w catches the darts that fall below its weights at a rank under
(k ln k + 2k) / w, about k ln k + 2k of them however many shingles there are.
Each dart belongs to one of the k coordinates, and the earliest on each is the
signature's value; a coordinate without a dart doubles the bound.  Two texts
agree on a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np

SHINGLE = 5
BANDS, ROWS = 32, 5
#: Bits that stand for a coordinate in ``packed``.
BITS = 4

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
_table = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_places = np.random.default_rng(21).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1) * 2.0**-53


class Shingles(NamedTuple):
    """The distinct shingles of several texts, text after text and sorted within each, with their weights; text i has those up to ends[i]."""

    hashes: np.ndarray
    weights: np.ndarray
    ends: np.ndarray

    def of(self) -> np.ndarray:
        """The text of each shingle."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def sizes(self) -> np.ndarray:
        """The total weight of each text."""
        total = np.concatenate([[0], np.cumsum(self.weights)])
        ends = np.concatenate([[0], self.ends])
        return total[ends[1:]] - total[ends[:-1]]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One hash a word, and the number of words of each text: words end at white space, A-Z count as a-z."""
    lines = [t.encode().lower().split() for t in texts]
    n = np.array([len(x) for x in lines], np.int64)
    data = np.frombuffer(b"".join([b" ".join(x) + b" " for x in lines if x]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), n
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends, prepend=-1))
    power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(int(place.max()), GOLDEN)]))
    return mix(np.add.reduceat(_table[data] * power[place], starts)), n


def shingles(texts: list[str]) -> Shingles:
    words, n = word_hashes(texts)
    size = np.minimum(n, SHINGLE)
    last = np.where(n > 0, n - size + 1, 0)
    of = np.repeat(np.arange(len(texts)), last)
    first = np.repeat(np.cumsum(n) - n - (np.cumsum(last) - last), last) + np.arange(len(of))
    found = size[of].astype(np.uint64)
    for j in range(SHINGLE):
        there = first if j == 0 or (n >= SHINGLE).all() else first[j < size[of]]
        if len(there) == len(first):
            found += words[np.minimum(first + j, len(words) - 1)] * _places[j] if len(words) else U(0)
        else:
            found[j < size[of]] += words[there + j] * _places[j]
    found = mix(found)
    order = np.argsort(found)
    order = order[np.argsort(of[order], kind="stable")]
    found, of = found[order], of[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(fresh)
    return Shingles(found[at], np.diff(at, append=len(found)), np.cumsum(np.bincount(of[at], minlength=len(texts))))


def unit_cells(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """(cells, ends): a cell for each unit of a shingle's weight, so that texts share cells as their weights overlap."""
    again = np.arange(int(s.weights.sum())) - np.repeat(np.cumsum(s.weights) - s.weights, s.weights)
    cells = np.repeat(s.hashes, s.weights) + again.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(cells), np.cumsum(s.sizes())


def fingerprints(s: Shingles) -> list[bytes]:
    """128 bits that stand for each text's weighted set: texts with equal ones have a similarity of 1."""
    both = np.stack([s.hashes, s.weights.astype(np.uint64)], axis=1)
    starts = np.concatenate([[0], s.ends[:-1]]) if len(s.ends) else s.ends
    return [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts.tolist(), s.ends.tolist())]


def _regions(s: Shingles) -> tuple[np.ndarray, ...]:
    """(key, low, width, weight, text) of every region of weight that lies at least partly below its shingle's weight."""
    of, parts, low, width = s.of(), [], 0.0, 1.0
    level, on = 0, np.arange(len(s.hashes))
    while len(on):
        parts.append((mix(s.hashes[on] + U(level * 0xE7037ED1A0B428DB & (1 << 64) - 1)), np.full(len(on), low), np.full(len(on), width), s.weights[on].astype(np.float64), of[on]))
        low, width, level = low + width, max(1.0, low + width), level + 1
        on = on[s.weights[on] > low]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _caught(regions: tuple[np.ndarray, ...], bound: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dart, rank, text) of all darts in these regions under their text's bound."""
    key, low, width, weight, of = regions
    reached, step, out, later = np.zeros(len(key)), 0, [], max(1, block // 4)
    while len(key):
        number = np.arange(step + 1, step + block + 1, dtype=np.uint64) * GOLDEN
        dart = mix(key[None, :] + number[:, None])
        rank = np.log(_uniform(mix(dart ^ U(0x5851F42D4C957F2D))))
        rank /= -width
        rank[0] += reached
        np.cumsum(rank, axis=0, out=rank)
        under = rank < bound[of]
        more = under[-1].copy()
        whole = low + width <= weight
        if not whole.all():
            under &= whole | (low + width * _uniform(mix(dart ^ U(0x2545F4914F6CDD1D))) <= weight)
        at = np.flatnonzero(under)
        out.append((dart.ravel()[at], rank.ravel()[at], of[at % len(key)]))
        reached, step, block = rank[-1, more], step + block, later
        key, low, width, weight, of = (x[more] for x in (key, low, width, weight, of))
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(s: Shingles, k: int = BANDS * ROWS) -> np.ndarray:
    """(text, k): the earliest dart on each coordinate; zeros for a text without shingles."""
    size = s.sizes()
    out = np.zeros((len(size), k), np.uint64)
    bound = np.where(size > 0, (k * math.log(k) + 2 * k) / np.maximum(size, 1), 0.0)
    regions = _regions(s) if len(s.hashes) else None
    todo = np.flatnonzero(size > 0)
    while len(todo):
        level = np.zeros(len(size), np.int64)
        level[todo] = np.log2(np.maximum(bound[todo], 1)).astype(np.int64) + 1  # texts with like bounds take blocks of like size
        first = np.full(len(size) * k, np.inf)
        for g in np.unique(level[todo]).tolist():
            on = level[regions[4]] == g
            dart, rank, of = _caught(tuple(x[on] for x in regions), bound, 1 << (g - 1))
            slot = of * k + ((dart >> U(33)) % U(k)).astype(np.int64)
            np.minimum.at(first, slot, rank)
            earliest = rank == first[slot]
            out.reshape(-1)[slot[earliest]] = dart[earliest]
        todo = todo[np.isinf(first.reshape(-1, k)[todo]).any(axis=1)]
        bound[todo] *= 2
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(text, bands): one 64-bit key for each band of a text's values; keys of different bands differ."""
    rows = values.reshape(len(values), bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * U(0xA0761D6478BD642F)
    for j in range(rows.shape[2]):
        key = mix(key ^ rows[:, :, j])
    return key.view(np.int64)


def packed(values: np.ndarray) -> np.ndarray:
    """(text, longs): ``BITS`` hashed bits of each coordinate.  Of texts of similarity s, a share of about (1 + s) / 2 of the bits agrees."""
    bits = np.unpackbits((mix(values) & U((1 << BITS) - 1)).astype(np.uint8)[:, :, None], axis=2)[:, :, -BITS:]
    return np.ascontiguousarray(np.packbits(bits.reshape(len(values), -1), axis=1)).view(np.int64)
