"""Word-shingle sets of texts, vectorised over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
MIX = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))  # splitmix64's constants


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + MIX[0]
        x = (x ^ (x >> U(30))) * MIX[1]
        x = (x ^ (x >> U(27))) * MIX[2]
        return x ^ (x >> U(31))


def give_back() -> None:
    """Return freed memory to the system: workers live on and share an executor's limit with its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def slices(batch: pa.RecordBatch, col: str, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(col))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut], [*cut, len(size)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes: (values, offsets).

    A-Z is lower-cased; words are runs without space or control 9 to 13. A text with fewer than k
    words has its whole word sequence as one shingle, a null or wordless text has none.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, off = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off] if len(flat) else off * 0
    enc = flat.filter(pa.array(keep)).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in enc.dictionary.to_pylist()), U, len(enc.dictionary))
    w = table[enc.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, U)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        if len(w) >= k:
            roll = w[: len(w) - k + 1].copy()
            for j in range(1, k):
                roll = roll * MIX[1] + w[j : len(w) - k + 1 + j]
            inside = doc[: len(roll)] == doc[k - 1 :]
            roll, rdoc = mix(roll[inside]), doc[: len(roll)][inside]
        else:
            roll, rdoc = np.zeros(0, U), np.zeros(0, np.int64)
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            h = n[few].astype(U)
            for j in range(k - 1):
                has = n[few] > j
                h[has] = h[has] * MIX[2] + w[off[few[has]] + j]
            roll, rdoc = np.concatenate([roll, mix(h ^ MIX[0])]), np.concatenate([rdoc, few])
            order = np.argsort(rdoc, kind="stable")
            roll, rdoc = roll[order], rdoc[order]
    at = np.searchsorted(rdoc, np.arange(len(n) + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        roll[a:b].sort()
    new = np.ones(len(roll), bool)
    new[1:] = (roll[1:] != roll[:-1]) | (rdoc[1:] != rdoc[:-1])
    return roll[new], np.concatenate([[0], np.cumsum(new, dtype=np.int64)])[at]


def set_signature(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, equal for equal sets."""
    n = np.diff(off)
    out = []
    for salt in (U(1), U(0x5851F42D4C957F2D)):
        m = mix(values ^ salt)
        total = np.zeros(len(n), U)
        full = n > 0
        if full.any():
            with np.errstate(over="ignore"):
                total[full] = np.add.reduceat(m, off[:-1][full])
        out.append(mix(total ^ n.astype(U)).view(np.int64))
    return out[0], out[1]
