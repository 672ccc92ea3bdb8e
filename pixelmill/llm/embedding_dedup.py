"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Each of ``tables`` hashes concatenates ``width`` cross-polytope codes; a code is the signed axis
nearest to the vector after three rounds of random signs and a fast Hadamard transform. Besides its
own bucket a vector enters the buckets of its next best codes (multiprobe). Pairs that share a
bucket are verified by the exact cosine; a pair is counted in the first bucket that it shares, so
pairs are never written out.

Cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label
or id is null, links with nothing and keeps its own id as component. Equal vectors of one label are
one class that counts for all its members. Vectors of different lengths never link. Rows that repeat
an id are kept, each with the links of its own vector. Extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import connected_components, materialize

BLOCK = 2048  # members of a bucket that are compared with as many others in one go
SHARD_ROWS = 40_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        v = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = v[:, :, 0, :].copy(), v[:, :, 1, :]
        v[:, :, 0, :] = a + b
        v[:, :, 1, :] = a - b
        h *= 2
    return x


def bucket_codes(unit: np.ndarray, tables: int, width: int, probes: int, seed: int) -> np.ndarray:
    """[vectors, tables, probes] codes; probe 0 is the vector's own bucket."""
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size), np.float32)
    padded[:, :d] = unit
    rng = np.random.default_rng([seed, size])
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        best, gap, second = [], [], []
        for _ in range(width):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice(np.float32([-1, 1]), size))
                y /= np.float32(size**0.5)
            mag = np.abs(y)
            top = np.argpartition(-mag, 1, axis=1)[:, :2]
            m = np.take_along_axis(mag, top, 1)
            top = np.where(m[:, :1] >= m[:, 1:], top, top[:, ::-1])
            axis = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            best.append(axis[:, 0])
            second.append(axis[:, 1])
            gap.append(np.abs(m[:, 0] - m[:, 1]))
        base, gaps = np.stack(best, 1), np.stack(gap, 1)
        # probes: subsets of codes moved to the second best axis, cheapest total gap first
        moves = np.array([[(s >> k) & 1 for k in range(width)] for s in range(1 << width)])
        cost = gaps @ moves.T
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            mv = moves[order[:, p]].astype(bool)
            code = np.where(mv, np.stack(second, 1), base)
            key = np.full(n, t, np.int64)
            for k in range(width):
                key = key * (2 * size) + code[:, k]
            out[:, t, p] = key
    return out


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs_in_runs(start: np.ndarray, size: np.ndarray):
    """Index pairs i < j inside runs, in chunks of bounded size."""
    for s in np.unique(size[size >= 2]):
        iu, ju = np.triu_indices(s, 1)
        first = start[size == s]
        step = max(1, 200_000 // len(iu))
        for c in range(0, len(first), step):
            f = first[c : c + step, None]
            yield (f + iu).ravel(), (f + ju).ravel()


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def links_of_vectors(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, tables: int = 8, width: int = 3, probes: int = 3, seed: int = 7,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept, class_size.

    The setting is the same at every size: three codes a hash in eight tables, with three probes, miss a
    pair at the threshold with a probability of about 3e-7 at 64 dimensions and 3e-5 at 768. More codes
    (``width``) make smaller buckets and want more tables for the same loss.
    """
    v = F.col("vec")
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    fine = (
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    )
    keyed = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h1", F.xxhash64("label", "vec")).withColumn("h2", F.xxhash64("vec", F.lit(1), "label"))
    classes = materialize(
        keyed.filter("fine").groupBy("h1", "h2", "label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes"
    )

    def emit(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            lengths = np.array([len(x) for x in t["vec"]]) if len(t) else np.zeros(0, int)
            for d in np.unique(lengths):
                s = t.filter(pa.array(lengths == d))
                codes = bucket_codes(_unit(s["vec"].combine_chunks()), tables, width, probes, seed).reshape(len(s), -1)
                k = codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(s["rep"].to_numpy(), k)), pa.array(np.repeat(s["lh"].to_numpy(), k)), pa.array(codes.ravel())], names=["rep", "lh", "code"]
                )

    # buckets hold ids only; vectors join where a bucket has company
    lh = F.xxhash64("label", F.size("vec"))
    members = materialize(classes.select("rep", "vec", lh.alias("lh")).mapInArrow(emit, "rep long, lh long, code long"), "buckets")
    counts = members.groupBy("lh", "code").agg(F.count("*").alias("n")).filter("n > 1")
    nb = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = (
        members.join(counts, ["lh", "code"])
        .withColumn("nb", nb)
        .withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("rep", "lh", "code", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    )
    spread = materialize(spread, "blocks")
    shards = max(1, -(-spread.count() // SHARD_ROWS))
    work = spread.join(classes.select("rep", "vec", "m", lh.alias("lh")), ["rep", "lh"]).withColumn(
        "shard", F.pmod(F.xxhash64("lh", "code", "bi", "bj"), F.lit(shards))
    )

    def compare(t: pa.Table) -> pa.Table:
        rep, m = t["rep"].to_numpy(), t["m"].to_numpy()
        lhs, code = t["lh"].to_numpy(), t["code"].to_numpy()
        bi, bj, blk = (t[c].to_numpy() for c in ("bi", "bj", "blk"))
        order = np.lexsort((rep, blk, bj, bi, code, lhs))
        rep, m, code, bi, bj, blk, lhs = (x[order] for x in (rep, m, code, bi, bj, blk, lhs))
        vec = t["vec"].combine_chunks().take(pa.array(order))
        new = np.ones(len(rep), bool)
        new[1:] = (code[1:] != code[:-1]) | (lhs[1:] != lhs[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(rep)))
        lengths = np.diff(vec.offsets.to_numpy())
        links, ea, eb = np.zeros(len(rep), np.int64), [], []
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            where = np.full(len(rep), -1)
            where[at] = np.arange(len(at))
            unit = _unit(vec.take(pa.array(at)))
            uniq, inv, row_of = np.unique(rep[at], return_index=True, return_inverse=True)
            codes_u, known = np.empty((len(uniq), tables, probes), np.int64), np.zeros(len(uniq), bool)

            def codes_of(rows):
                """Codes of rows; each vector's are made again once it has a link, few vectors have one."""
                u = row_of[where[rows]]
                new = np.unique(u[~known[u]])
                if len(new):
                    codes_u[new] = bucket_codes(unit[inv[new]], tables, width, probes, seed)
                    known[new] = True
                return codes_u[u]

            def keep(i, j):
                """Linked pairs whose first shared bucket is this one."""
                if not len(i):
                    return
                ci, cj, here = codes_of(i), codes_of(j), code[i]
                first = np.full(len(i), np.iinfo(np.int64).max)
                for p in range(probes):
                    for q in range(probes):
                        eq = ci[:, :, p] == cj[:, :, q]
                        first = np.minimum(first, np.where(eq, ci[:, :, p], np.iinfo(np.int64).max).min(axis=1))
                ok = first == here
                i, j = i[ok], j[ok]
                np.add.at(links, i, m[j])
                np.add.at(links, j, m[i])
                ea.append(i)
                eb.append(j)

            mine = lengths[start] == d
            small = mine & (size <= 64)
            same = bi[start] == bj[start]
            for i, j in _pairs_in_runs(start[small], size[small]):
                ok = (bi[i] == bj[i]) | (blk[i] != blk[j])
                i, j = i[ok], j[ok]
                cos = np.einsum("ij,ij->i", unit[where[i]], unit[where[j]])
                ok = cos >= threshold
                keep(i[ok], j[ok])
            for r in np.flatnonzero(mine & ~small):
                lo, hi = start[r], start[r] + size[r]
                mid = hi if same[r] else lo + int((blk[lo:hi] == bi[lo]).sum())
                for c in range(lo, mid if not same[r] else hi, 256):
                    ce = min(c + 256, mid if not same[r] else hi)
                    base = c + 1 if same[r] else mid
                    cos = unit[where[c:ce]] @ unit[where[base:hi]].T
                    x, y = np.nonzero(cos >= threshold)
                    i, j = x + c, y + base
                    ok = i < j
                    i, j = i[ok], j[ok]
                    for s in range(0, len(i), 50_000):
                        keep(i[s : s + 50_000], j[s : s + 50_000])
        if ea:
            a, b = np.concatenate(ea), np.concatenate(eb)
            nodes, inv = np.unique(rep, return_inverse=True)
            root = nodes[_roots(len(nodes), inv[a], inv[b])]
            total = np.bincount(inv, links, len(nodes)).astype(np.int64)
            hit = total > 0
            nodes, total, root = nodes[hit], total[hit], root[hit]
        else:
            nodes, total, root = (np.zeros(0, np.int64),) * 3
        return pa.table({"rep": nodes, "links": total, "root": root})

    found = materialize(work.groupBy("shard").applyInArrow(compare, "rep long, links long, root long"), "links")
    n = found.groupBy("rep").agg(F.sum("links").alias("others"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("h1", "h2", "rep", "m")
        .join(n, "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", "m", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "rep").alias("component"))
    )
    return (
        keyed.select("vec_id", "fine", "h1", "h2")
        .join(known.withColumn("fine", F.lit(True)), ["h1", "h2", "fine"], "left")
        .select(
            "vec_id", F.coalesce(F.col("m") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"), F.coalesce("m", F.lit(1)).cast("long").alias("class_size"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
