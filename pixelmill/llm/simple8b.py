"""Simple-8b word-aligned coding of unsigned ids, in blocks that decode independently.

A 64-bit word holds a selector in its top four bits and ``count`` values of ``bits`` bits below, the
first lowest. Selectors 0 and 1 stand for 240 and 120 zeros. A value of 2**60 or more is escaped: a
word of selector 15 with payload 2**60 - 1, then the raw value. Blocks hold ``BLOCK`` ids; the word
offset of each block is stored, so blocks are coded and decoded side by side.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 1024
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
TOP = (1 << 60) - 1


SMALL = np.frexp(np.arange(1 << 16, dtype=np.float32))[1].astype(np.uint8)  # bit lengths


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of each value (64-bit safe)."""
    if not len(v) or v.max() < len(SMALL):
        return SMALL[v.astype(np.uint16)]
    hi, lo = (v >> U(32)).astype(np.float64), (v & U(0xFFFFFFFF)).astype(np.float64)
    n = np.frexp(lo)[1]
    return np.where(hi > 0, 32 + np.frexp(hi)[1], n).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, U), np.zeros(1, np.int64)
    stride = BLOCK + 240
    flat = np.zeros(blocks * BLOCK, np.asarray(ids).dtype)
    flat[:n] = ids
    v = np.zeros((blocks, stride), flat.dtype)
    v[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = np.zeros(v.shape, np.uint8)
    width[:, :BLOCK] = _bits(flat).reshape(blocks, BLOCK)
    v = v.ravel()
    # widest value among the next c, by doubling
    reach, c = {1: width}, 1
    while c < 128:
        w = reach[c].copy()
        w[:, :-c] = np.maximum(w[:, :-c], reach[c][:, c:])
        reach[2 * c], c = w, 2 * c
    sel = np.full(width.shape, 15, np.uint8)
    for s in range(14, -1, -1):
        k = int(COUNT[s])
        p = 1 << (k.bit_length() - 1)
        w = reach[p].copy()
        if k > p:
            w[:, : -(k - p)] = np.maximum(w[:, : -(k - p)], reach[p][:, k - p :])
        np.copyto(sel, np.uint8(s), where=w <= WIDTH[s])
    # follow all blocks side by side
    end = np.arange(blocks) * stride + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    step, pos, at = COUNT.astype(np.int16)[sel].ravel(), np.arange(blocks) * stride, []
    while len(pos):
        at.append(pos)
        pos = pos + step[pos]
        more = pos < end
        pos, end = pos[more], end[more]
    at = np.sort(np.concatenate(at))
    who, s = at // stride, sel.ravel()[at]
    escape = (s == 15) & (v[at] >= TOP) if v.dtype.itemsize == 8 else np.zeros(len(at), bool)
    slot = np.arange(len(at)) + np.cumsum(escape) - escape
    words = np.zeros(len(at) + int(escape.sum()), U)
    for k in range(16):
        mine = np.flatnonzero((s == k) & ~escape)
        word = np.full(len(mine), k << 60, U)
        if WIDTH[k]:
            for j in range(COUNT[k]):
                word |= v[at[mine] + j].astype(U) << U(j * int(WIDTH[k]))
        words[slot[mine]] = word
    words[slot[escape]] = U(15 << 60) | U(TOP)
    words[slot[escape] + 1] = v[at[escape]]
    per = np.bincount(who, 1 + escape, blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of the blocks whose words start at ``offsets``."""
    blocks = len(offsets) - 1
    raw = np.zeros(len(words), bool)
    head = words == (U(15 << 60) | U(TOP))
    # an escape word is never itself a raw value; in a run of equal words they alternate
    if head.any():
        run = np.flatnonzero(head)
        start = np.concatenate([[True], np.diff(run) > 1])
        first = run[np.maximum.accumulate(np.where(start, np.arange(len(run)), 0))]
        esc = run[(run - first) % 2 == 0]
        raw[esc + 1] = True
        head = np.zeros(len(words), bool)
        head[esc] = True
    s = (words >> U(60)).astype(np.int64)
    count = np.where(raw, 0, COUNT[s])
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    before = np.cumsum(count) - count
    place = before - before[offsets[:-1]][block] if len(words) else before
    stride = BLOCK + 240
    out, at = np.zeros(blocks * stride, U), block * stride + place
    for k in range(2, 16):
        mine = np.flatnonzero((s == k) & ~raw & ~head)
        mask, first, word = U((1 << int(WIDTH[k])) - 1), at[mine], words[mine]
        for j in range(COUNT[k] if len(mine) else 0):
            out[first + j] = (word >> U(j * int(WIDTH[k]))) & mask
    e = np.flatnonzero(head)
    if len(e):
        out[at[e]] = words[e + 1]
    return out.reshape(blocks, stride)[:, :BLOCK].reshape(-1)[:n]
