"""Exact search for 64-bit hashes that differ in a few bits."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np

BLOCK, CELLS = 1 << 16, 1 << 17  # comparisons and rows at a time; they bound the memory of a step, not the work


def parts(distance: int, k: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of k pieces of a hash: two hashes within ``distance`` are within the radius in a piece at least.

    The radii plus one add up to distance + 1, so more differing bits would be needed to leave every piece.
    """
    cuts = [64 * i // k for i in range(k + 1)]
    pieces = sorted(((cuts[i], cuts[i + 1] - cuts[i]) for i in range(k)), key=lambda p: -p[1])
    q, r = divmod(distance + 1, k)
    return [(s, w, q - (i >= r)) for i, (s, w) in enumerate(pieces) if q >= (i >= r)]


def cheapest(nx: int, ny: int, distance: int) -> list[tuple[int, int, int]]:
    """The pieces with the least expected time; none where comparing all is faster. Any choice finds the same pairs."""
    best, least = [], 1.8 * nx * ny
    for k in range(4, 65):
        some, cost = parts(distance, k), 0.0
        for _, w, t in some:
            masks, keys = sum(comb(w, i) for i in range(min(t, w) + 1)), min(1 << w, nx)
            cost += masks / (1 << w) * ny * (1.8 * nx + 6 * keys) + keys * (50_000 + 15 * masks) + 100 * (nx + ny)
        if cost < least:
            best, least = some, cost
    return best


def _hits(x: np.ndarray, y: np.ndarray, distance: int, room: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and distances of all close pairs, by blocks that fit ``room``, buffers of bits and counts."""
    wide = min(len(y), len(room[0]) >> 3)
    rows = max(1, len(room[0]) // max(1, wide))
    for j in range(0, len(y), wide or 1):
        some = y[j : j + wide]
        for i in range(0, len(x), rows):
            own = x[i : i + rows, None]
            n = len(own) * len(some)
            d = room[1][:n]
            np.bitwise_count(np.bitwise_xor(own, some, out=room[0][:n].reshape(len(own), -1)).ravel(), out=d)
            if d.min() <= distance:
                at = np.flatnonzero(d <= distance)
                yield at // len(some) + i, at % len(some) + j, d[at]


def _gathered(hits: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same in pieces of about CELLS entries, as a few entries cost as much as many."""
    some, n = [], 0
    for h in hits:
        some.append(h)
        n += len(h[0])
        if n >= CELLS:
            yield tuple(map(np.concatenate, zip(*some, strict=True)))
            some, n = [], 0
    if some:
        yield tuple(map(np.concatenate, zip(*some, strict=True)))


def _in_piece(x: np.ndarray, y: np.ndarray, distance: int, piece: tuple[int, int, int], room: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All close pairs that are within the radius in this piece, and others by chance."""
    shift, width, radius = piece
    mask = np.uint64((1 << width) - 1)
    kx, ky = ((v >> np.uint64(shift) & mask).astype(np.int64) for v in (x, y))
    ox, oy = np.argsort(kx, kind="stable"), np.argsort(ky, kind="stable")
    ys, counts = y[oy], np.bincount(ky, minlength=1 << width)
    starts = np.cumsum(counts) - counts
    near = np.arange(1 << width)
    near = near[np.bitwise_count(near) <= radius]
    keys, first = np.unique(kx[ox], return_index=True)
    for key, own in zip(keys.tolist(), np.split(ox, first[1:]), strict=True):
        there = near ^ key
        size = counts[there]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(starts[there] - (ends - size), size)
        for i, j, d in _hits(x[own], ys[at], distance, room):
            yield own[i], oy[at[j]], d


def close(x: np.ndarray, y: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in x, positions in y, distances) of all pairs of unsigned hashes within ``distance``, each pair once.

    For each piece, the hashes of y that stand within the piece's radius of a key are compared with those of x under the key;
    a pair counts at the first piece in which it is within the radius.
    """
    chosen = cheapest(len(x), len(y), distance)
    room = np.empty(BLOCK, np.uint64), np.empty(BLOCK, np.uint8)
    if not chosen:
        yield from _gathered(_hits(x, y, distance, room))
    for n, piece in enumerate(chosen):
        for i, j, d in _gathered(_in_piece(x, y, distance, piece, room)):
            other, fresh = x[i] ^ y[j], np.ones(len(i), bool)
            for s, w, t in chosen[:n]:
                fresh &= np.bitwise_count(other >> np.uint64(s) & np.uint64((1 << w) - 1)) > t
            yield i[fresh], j[fresh], d[fresh]


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of entries whose sizes add up to CELLS at most, or single ones."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELLS, "right")))
        yield slice(i, j)
        i = j


class _Classes:
    """Distinct hashes of some rows, and the rows of each."""

    def __init__(self, h: np.ndarray) -> None:
        self.hashes, inverse, self.counts = np.unique(h, return_inverse=True, return_counts=True)
        self.order, self.starts = np.argsort(inverse, kind="stable"), np.cumsum(self.counts) - self.counts

    def rows(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the classes c, and the position in c of each."""
        size = self.counts[c]
        at = np.arange(size.sum()) + np.repeat(self.starts[c] - (np.cumsum(size) - size), size)
        return self.order[at], np.repeat(np.arange(len(c)), size)


def close_rows(x: np.ndarray, y: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of all pairs within ``distance``; without y, pairs of different rows of x, each once.

    Equal hashes are compared once; their rows come out in bounded pieces.
    """
    cx = _Classes(x)
    cy = cx if y is None else _Classes(y)
    for i, j, d in close(cx.hashes, cy.hashes, distance):
        if y is None:
            half = i <= j
            i, j, d = i[half], j[half], d[half]
        for s in _slices(cx.counts[i]):
            a, at = cx.rows(i[s])
            ja, da, ia = j[s][at], d[s][at], i[s][at]
            for p in _slices(cy.counts[ja]):
                b, of = cy.rows(ja[p])
                out = a[p][of], b, da[p][of]
                if y is None:
                    once = (ia[p][of] != ja[p][of]) | (out[0] < b)
                    out = tuple(v[once] for v in out)
                if len(out[0]):
                    yield out


def average_hashes(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A row's bits value >= mean, the first value highest; values that aren't known add nothing and give 0."""
    total, out = np.zeros(len(values)), np.zeros(len(values), np.int64)
    for k in range(values.shape[1]):  # in order, as SQL adds them
        total += np.where(known[:, k], values[:, k], 0.0)
    mean = total / values.shape[1]
    for k in range(values.shape[1]):
        v = values[:, k]
        out = out << 1 | (known[:, k] & ((v >= mean) | np.isnan(v)))  # SQL puts NaN above all others
    return out
