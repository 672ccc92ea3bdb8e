"""Exact self-join of documents by the Jaccard similarity of their word shingles (parity sketches).

For sets A, B with J(A, B) >= t the symmetric difference is at most (1 - t) / (1 + t) * (|A| + |B|).
Every size band has a sketch of G segments; each shingle is XOR-hashed into one segment, so a
shingle in only one of the sets changes only one segment, and the number of segments that differ
bounds the symmetric difference from below. With at most D differences in a band, at least G - D
segments agree. G is chosen so that a set has fewer than G - D empty segments; then a pair agrees in
some segment that isn't empty, and joining on (band, segment, XOR) finds it. A set with more empty
segments than that emits its empty segments too, so nothing is lost. In the same way, segments that
hold only frequent shingles (of passages that many documents share) are left out where enough others are left. A set takes part in the band of
its own size and in those of larger partners.

Pairs that meet in a segment are pruned by size and by a parity bit sketch whose Hamming distance
bounds the symmetric difference, and verified by exact intersection. Large groups are not expanded
to pairs: a first round takes each member with the smallest one; later ones, only where members of one
segment are still in different components, take each member with its nearest ones of other components
by sketch, and the last takes every pair of different components that is left.

Cases: a null or wordless text has an empty set and links with nothing; equal sets (copies) are one
node; fewer words than k are one shingle. A row without id gets a null component id.
Rows that repeat an id are kept, each judged by its own text. Extra columns are ignored. Shingles and sets are
compared by 64-bit hashes.

Keys meet in buckets, whose number follows from the counted sizes of the sets. A key that a sample shows
to be held by many sets (a third of all, say) is dealt to several slots by member; its slots share
one head, the smallest member of all, and go on as one segment set. Members are kept in rows of at
most ``ROW``. Rows of a large class, and classes of a large component, meet their result in several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import Shipped, bitmap, connected_components, drop_ids, in_bitmap, materialize, parts, small_batches, spread_join
from pixelmill.llm.shingles import U, mix, set_signature, shingle_sets, slices

SAMPLE = 3000  # documents, about, in which frequent shingles are looked for; any choice of them gives the same links
OFTEN = 6  # of these documents
SLACK = 0.02  # room for segments with frequent shingles only
BAND = 1.5  # ratio of the largest to the smallest size of a band
SLICE = 3_000_000  # bytes of text that are shingled at once
FLUSH = 1_500_000  # keys that a task holds before it hands them on
BLOCK = 1024
MOST_WORDS = 1024  # of a sketch: 65,536 parity bits
SHARD_ROWS = 100_000
BUCKET_KEYS = 500_000  # keys that meet in one task, about
HOT = 30  # sets of the sample that hold a key whose members may be dealt to slots
SLOT = 250_000  # members of a slot, about
ROW = 100_000  # members in a row
NEAREST = (1, 8, None)  # partners of a member that a later round takes; the last takes all that are left
FEWEST = 100  # rows of one key that are never spread
WHOLE = 8  # sets of so many members are compared pair by pair at once


def bands(largest: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(smallest participant, largest, D, G) for each size band up to ``largest``; t = num / den."""
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * BAND) - 1)
        least = -(-num * lo // den)
        most = 2 * hi * (den - num) // (den + num)
        g = most + 1
        while g < 8 * (most + least + 1):
            lam = least / g
            full, sd = g * -np.expm1(-lam), (g * np.exp(-lam) * max(1e-9, 1 - (1 + lam) * np.exp(-lam))) ** 0.5
            if full - 3 * sd >= most + 1 + SLACK * least:
                break
            g += max(1, g // 50)
        out.append((least, hi, most, g))
        lo = hi + 1
    return out


class Frequent:
    """A fixed set of shingles, as a sorted array behind a small bit table."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.values >> U(44)).astype(np.int64)] = True

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = self.table[(x >> U(44)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.values, x[maybe]), max(0, len(self.values) - 1))
        out[maybe] = self.values[at] == x[maybe] if len(self.values) else False
        return out


def segment_keys(values: np.ndarray, off: np.ndarray, num: int, den: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set index, 64-bit key) of every segment that a set has to emit.

    A segment is strong if it holds a shingle that isn't frequent. A set with more than D strong
    segments emits these, one with more than D filled ones all filled ones, others all. Of a pair,
    the set with the stronger rule has an agreeing segment that the rule takes, and the other emits it too.
    """
    n = np.diff(off)
    sets, keys = [], []
    if not len(n) or not n.max():
        return np.zeros(0, np.int64), np.zeros(0, U)
    rare = ~frequent.holds(values) if frequent is not None else np.ones(len(values), bool)
    for s, (least, hi, most, g) in enumerate(bands(-(-int(n.max()) * den // num), num, den)):
        who = np.flatnonzero((n >= max(1, least)) & (n <= hi))
        if not len(who) or most == 0:  # with no difference allowed only equal sets match
            continue
        m = n[who]
        pos = np.repeat(off[who], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        x = mix(values[pos] ^ U(s * 2 + 1))
        seg = ((x >> U(32)) * U(g) >> U(32)).astype(np.int64) + np.repeat(np.arange(len(who)) * g, m)
        order = np.argsort(seg, kind="stable")
        seg, x = seg[order], x[order]
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        xor, at = np.bitwise_xor.reduceat(x, first), seg[first]
        strong = np.logical_or.reduceat(rare[pos][order], first)
        filled = np.bincount(at // g, minlength=len(who))
        many = np.bincount(at[strong] // g, minlength=len(who))
        emit = strong | (many <= most)[at // g]
        lost = np.flatnonzero(filled <= most)
        more = [np.setdiff1d(np.arange(w * g, (w + 1) * g), at[np.searchsorted(at, w * g) : np.searchsorted(at, (w + 1) * g)]) for w in lost]
        at, xor = np.concatenate([at[emit], *more]), np.concatenate([xor[emit], np.zeros(sum(map(len, more)), U)])
        sets.append(who[at // g])
        keys.append(mix(mix((at % g).astype(U) * U(4096) + U(s)) ^ xor))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(sets), np.concatenate(keys)


class Slots:
    """The keys whose members are dealt: slot ``first[i] + (a hash of the member) % n[i]`` of key i."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]
        self.first = np.cumsum(self.n) - self.n

    def of(self, keys: np.ndarray, sigs: np.ndarray) -> np.ndarray:
        """The slot of each key and member, -1 for keys that meet in one place."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        salt = (mix(sigs.view(U) ^ U(7)) % self.n[at].astype(U)).astype(np.int64)
        return np.where(self.keys[at] == keys, self.first[at] + salt, -1)

    def owner(self, slot: int) -> int:
        return int(np.searchsorted(self.first, slot, side="right")) - 1


def most_keys(rows: DataFrame, num: int, den: int) -> int:
    """About how many keys the sets of ``rows`` (n) emit at most, from counts by size."""
    sizes = rows.filter("n > 0").groupBy(F.floor(F.log2("n") * 4).alias("bin")).agg(F.count("*").alias("k"), F.max("n").alias("n")).collect()  # four rows a power of two
    if not sizes:
        return 0
    every = bands(-(-max(r["n"] for r in sizes) * den // num), num, den)
    return sum(r["k"] * sum(min(r["n"], g) for least, hi, most, g in every if most and least <= r["n"] <= hi) for r in sizes)


def parity_bits(values: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The parity sketch of each set: a shingle flips one of at least n bits, a power of two."""
    n = np.diff(off)
    out: list[bytes] = [b""] * len(n)
    words = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).astype(int).clip(2), 4, MOST_WORDS)
    for w in np.unique(words):
        who = np.flatnonzero(words == w)
        m = n[who]
        pos = np.repeat(off[who], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        bit = (mix(values[pos] ^ U(99)) & U(64 * w - 1)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(who)) * 64 * w, m) + bit, minlength=len(who) * 64 * w).astype(np.uint8) & 1
        packed = np.packbits(odd.reshape(len(who), -1), axis=1)
        for i, row in zip(who, packed, strict=True):
            out[i] = row.tobytes()
    return out


def folded(x: np.ndarray) -> np.ndarray:
    """Sketches of half the length: both halves XORed."""
    h = x.shape[-1] // 2
    return x[..., :h] ^ x[..., h:]


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches, the longer folded: at most the symmetric difference of their sets."""
    u, v = np.frombuffer(x, U), np.frombuffer(y, U)
    while len(u) > len(v):
        u = folded(u)
    while len(v) > len(u):
        v = folded(v)
    return int(np.bitwise_count(u ^ v).sum())


def _binary(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def links_of_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set), text_hash and component_key (equal
    inside a component, whatever its ids; null without words), for every row of ``docs``.

    Only the components are complete. The links that they rest on are neither all found nor returned:
    of a segment set of more than ``WHOLE`` members, pairs inside one component are not looked at again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = src.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def profile(batches):
        for big in batches:
            for b in slices(big, "text", SLICE):
                v, off = shingle_sets(b.column(1), k)
                s1, s2 = set_signature(v, off)
                cols = [b.column(0), b.column(2), pa.array(np.diff(off)), pa.array(s1), pa.array(s2), _binary(parity_bits(v, off))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n", "s1", "s2", "sketch"])

    rows = materialize(hashed.mapInArrow(profile, "doc_id long, text_hash long, n long, s1 long, s2 long, sketch binary"), "profiles")
    classes = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    buckets = max(parts(spark), -(-most_keys(rows, num, den) // BUCKET_KEYS))
    documents = docs.count()
    every = max(1, documents // SAMPLE)
    some = materialize(src.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), "sample")

    def sampled(batches):
        for big in batches:
            for b in slices(big, "text", SLICE):
                v, off = shingle_sets(b.column(1), k)
                _, one = np.unique(set_signature(v, off)[0], return_index=True)
                u, c = np.unique(np.concatenate([v[off[i] : off[i + 1]] for i in one]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["v", "c"])

    often = some.mapInArrow(sampled, "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN).select("v").toArrow()  # bounded by the sample
    frequent_ = Frequent(often["v"].to_numpy().view(U))

    def held_keys(batches):
        for big in batches:
            for b in slices(big, "text", SLICE):
                v, off = shingle_sets(b.column(1), k)
                who, key = segment_keys(v, off, num, den, frequent_)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(set_signature(v, off)[0][who])], names=["key", "s1"])

    shared = some.mapInArrow(held_keys, "key long, s1 long").distinct().groupBy("key").agg(F.count("*").alias("c"))
    shared = shared.withColumn("n", F.ceil(F.col("c") * (every / SLOT))).filter((F.col("c") >= HOT) & (F.col("n") > 1)).toArrow()  # bounded by the sample
    slots = Slots(shared["key"].to_numpy().view(U), 1 << np.ceil(np.log2(np.maximum(shared["n"].to_numpy(), 1))).astype(np.int64))
    sent = Shipped(spark, (frequent_, slots))

    def emit(batches):
        frequent, slots = sent.get()
        held: list[tuple] = []

        def flush():
            sig = np.concatenate([h[0] for h in held])
            base = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
            who = np.concatenate([h[1] + b for h, b in zip(held, base, strict=True)])
            key = np.concatenate([h[2] for h in held])
            held.clear()
            # within a task, copies are one set
            sig, inv = np.unique(sig, return_inverse=True)
            who = inv[who]
            slot = slots.of(key, sig[who])
            to = np.where(slot < 0, ((key >> U(32)) % U(buckets)).astype(np.int64), buckets + slot)
            low = np.where(slot < 0, key & U(0xFFFFFFFF), U(0)).astype(np.uint32)
            order = np.lexsort((who, low, to))
            to, low, who = to[order], low[order], who[order]
            new = np.ones(len(to), bool)
            new[1:] = (to[1:] != to[:-1]) | (low[1:] != low[:-1]) | (who[1:] != who[:-1])
            to, low, who = to[new], low[new], who[new]
            cols: list[list] = [[], [], [], []]
            edge = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                used, idx = np.unique(who[a:b], return_inverse=True)
                kind = np.uint16 if len(used) <= 65536 else np.uint32
                for c, y in zip(cols, (int(to[a]), low[a:b].tobytes(), idx.astype(kind).tobytes(), sig[used].tobytes()), strict=True):
                    c.append(y)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *map(_binary, cols[1:])], names=["bucket", "low", "idx", "sigs"])

        size = 0
        for big in batches:
            for b in slices(big, "text", SLICE):
                v, off = shingle_sets(b.column(1), k)
                who, key = segment_keys(v, off, num, den, frequent)
                held.append((set_signature(v, off)[0], who, key))
                size += len(key)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        lows, sigs = [], []
        for low, idx, sig in zip(t["low"].to_pylist(), t["idx"].to_pylist(), t["sigs"].to_pylist(), strict=True):
            s = np.frombuffer(sig, np.int64)
            lows.append(np.frombuffer(low, np.uint32))
            sigs.append(s[np.frombuffer(idx, np.uint16 if len(s) <= 65536 else np.uint32)])
        low, sig = np.concatenate(lows), np.concatenate(sigs)
        order = np.argsort(low, kind="stable")
        low, sig = low[order], sig[order]
        twin = np.full(len(low), t["bucket"][0].as_py() >= buckets)
        twin[1:] |= low[1:] == low[:-1]
        twin[:-1] |= low[1:] == low[:-1]
        low, sig = low[twin], sig[twin]
        order = np.lexsort((sig, low))
        low, sig = low[order], sig[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (sig[1:] != sig[:-1])
        low, sig = low[new], sig[new]
        start = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        size = np.diff(np.append(start, len(low)))
        slot = t["bucket"][0].as_py() - buckets
        hot = slots.owner(slot) if slot >= 0 else -1
        ids = np.zeros(0, np.int64)
        if len(start):
            ids = mix(np.add.reduceat(mix(sig.view(U)), start)).view(np.int64)
            least = 1 if hot >= 0 else 2
            ids[size < least] = 0
            ids, at = np.unique(ids, return_index=True)
            ids, at = ids[size[at] >= least], at[size[at] >= least]
        cols: list[list] = [[], [], [], [], [], []]
        for i, x in zip(at if len(start) else (), ids, strict=True):
            for part, a in enumerate(range(start[i], start[i] + size[i], ROW)):
                own = sig[a : min(a + ROW, start[i] + size[i])]
                for c, y in zip(cols, (int(x), part, hot, int(size[i]), int(sig[start[i]]), own.tobytes()), strict=True):
                    c.append(y)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), _binary(cols[5])], names=["set_id", "part", "hot", "size", "head", "members"])

    blobs = src.mapInArrow(emit, "bucket long, low binary, idx binary, sigs binary").repartition(buckets, "bucket")
    met = blobs.groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches([meet(t)]), "set_id long, part long, hot long, size long, head long, members binary")
    if len(slots.keys):  # the slots of a key share the smallest member of all
        met = materialize(met, "slots")
        heads = met.filter("hot >= 0").groupBy("hot").agg(F.min("head").alias("top"), F.sum(F.when(F.col("part") == 0, F.col("size"))).alias("all"))
        met = met.join(F.broadcast(heads), "hot", "left").withColumns({"head": F.coalesce("top", "head"), "size": F.coalesce("all", "size")})  # bounded by the sample
    sets = materialize(met.dropDuplicates(["set_id", "head", "part"]).select("head", "size", "members"), "sets")

    def stars(batches):
        for b in batches:
            out = []
            for head, size, m in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                x = np.frombuffer(m, np.int64)
                if size <= WHOLE and size == len(x):
                    i, j = np.triu_indices(len(x), 1)
                    out.append(np.stack([x[i], x[j]]))
                else:
                    x = x[x != head]
                    out.append(np.stack([np.full(len(x), head), x]))
            if out:
                p = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    pairs = materialize(sets.select("head", "size", "members").mapInArrow(stars, "a long, b long").distinct(), "stars")
    nodes = pairs.select(F.col("a").alias("s1")).unionAll(pairs.select("b")).distinct()
    sketches = materialize(rows.filter("n > 0").join(nodes, "s1", "left_semi").select("s1", "n", "sketch").dropDuplicates(["s1"]), "sketches")

    def close(batches):
        for b in batches:
            na, x, nb, y = (b.column(c).to_pylist() for c in (2, 3, 4, 5))
            ok = [apart(x[i], y[i]) * (num + den) <= (den - num) * (na[i] + nb[i]) for i in range(len(na))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def plausible(cand: DataFrame) -> DataFrame:
        """Pairs whose sizes and parity sketches allow the similarity."""
        x = sketches.select(F.col("s1").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
        y = sketches.select(F.col("s1").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
        both = cand.join(x, "a").join(y, "b").filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        return both.select("a", "b", "na", "x", "nb", "y").mapInArrow(close, "a long, b long")

    def verify(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    reps = classes.groupBy("s1").agg(F.min("rep").alias("rep")).filter("rep is not null")

    def shingles_of(nodes: DataFrame) -> DataFrame:
        """(s1, shingles) of the sets named by ``nodes`` (s1), read again from their texts; a few more may come."""
        bits = spark.sparkContext.broadcast(bitmap(reps.join(nodes, "s1", "left_semi"), "rep"))

        def reread(batches):
            for big in batches:
                big = big.filter(pa.array(in_bitmap(bits.value, big.column(2).to_numpy())))
                for b in slices(big, "text", SLICE) if len(big) else ():
                    v, off = shingle_sets(b.column(1), k)
                    blobs = _binary([v[a:c].tobytes() for a, c in zip(off[:-1], off[1:], strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(set_signature(v, off)[0]), blobs], names=["s1", "shingles"])

        read = src.filter("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
        return materialize(read.mapInArrow(reread, "s1 long, shingles binary"), "shingles")

    def linked(cand: DataFrame, texts: DataFrame) -> DataFrame:
        """The candidate pairs whose sets are similar enough."""
        near = cand.select("a", "b").join(texts.select(F.col("s1").alias("b"), F.col("shingles").alias("y")), "b")
        near = near.join(texts.select(F.col("s1").alias("a"), F.col("shingles").alias("x")), "a")
        return materialize(near.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")

    tested = materialize(plausible(pairs), "near")
    edges = linked(tested, shingles_of(tested.select(F.col("a").alias("s1")).unionAll(tested.select("b")).distinct()))

    # later rounds: larger sets whose members are not in one component yet
    def rows_of(batches):
        for b in batches:
            m = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            if m:
                p = np.unique(np.stack([np.repeat(b.column(0).to_numpy(), [len(x) for x in m]), np.concatenate(m)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["set_id", "node"])

    def across(most: int | None):
        """Plausible pairs of different components; the ``most`` nearest of each member in a block, or all."""

        def run(t: pa.Table) -> pa.Table:
            c = {x: t[x].to_numpy() for x in ("set_id", "node", "comp", "blk", "bi", "bj", "n")}
            order = np.lexsort((c["node"], c["blk"], c["bj"], c["bi"], c["set_id"]))
            c = {x: y[order] for x, y in c.items()}
            raw = t["sketch"].to_pylist()
            raw = [np.frombuffer(raw[i], U) for i in order]
            length = np.array([len(x) for x in raw], np.int64)
            row, full, half = np.zeros(len(raw), np.int64), {}, {}
            for w in np.unique(length):
                at = np.flatnonzero(length == w)
                row[at] = np.arange(len(at))
                full[w] = np.stack([raw[i] for i in at])
                half[w] = folded(full[w])
            new = np.ones(len(order), bool)
            new[1:] = (c["set_id"][1:] != c["set_id"][:-1]) | (c["bi"][1:] != c["bi"][:-1]) | (c["bj"][1:] != c["bj"][:-1])
            start = np.append(np.flatnonzero(new), len(order))
            out = [np.zeros((3, 0), np.int64)]
            for lo, hi in zip(start[:-1], start[1:], strict=True):
                same = c["bi"][lo] == c["bj"][lo]
                mid = hi if same else lo + int((c["blk"][lo:hi] == c["bi"][lo]).sum())
                found = [np.zeros((3, 0), np.int64)]
                for i in range(lo, mid):
                    j = np.arange(i + 1 if same else mid, hi)
                    ni, nj = c["n"][i], c["n"][j]
                    j = j[(c["comp"][j] != c["comp"][i]) & (den * np.minimum(ni, nj) >= num * np.maximum(ni, nj))]
                    if not len(j):
                        continue
                    w, far = length[i], np.zeros(len(j), np.int64)
                    for step, mine, other in ((w, full[w], full.get(w)), (2 * w, full[w], half.get(2 * w)), (w // 2, half[w], full.get(w // 2))):
                        at = np.flatnonzero(length[j] == step)
                        if len(at):
                            far[at] = np.bitwise_count(other[row[j[at]]] ^ mine[row[i]]).sum(axis=1)
                    ok = far * (num + den) <= (den - num) * (ni + c["n"][j])
                    found.append(np.stack([np.full(ok.sum(), i), j[ok], far[ok]]))
                f = np.concatenate(found, axis=1)
                if most is not None and f.shape[1]:
                    f = f[:, np.argsort(f[2], kind="stable")]
                    keep = np.zeros(f.shape[1], bool)
                    for side in (0, 1):  # the nearest of each member on either side
                        o = np.argsort(f[side], kind="stable")
                        first = np.searchsorted(f[side][o], f[side][o])
                        keep[o[np.arange(len(o)) - first < most]] = True
                    f = f[:, keep]
                out.append(np.stack([c["node"][f[0]], c["node"][f[1]], f[2]]))
            p = np.unique(np.sort(np.concatenate(out, axis=1)[:2], axis=0), axis=1)
            return pa.table({"a": p[0], "b": p[1]})

        return run

    # sets with the same smallest member are taken together: near copies meet in many segments
    inside = materialize(sets.filter(F.col("size") > WHOLE).select("head", "members").mapInArrow(rows_of, "set_id long, node long").distinct(), "members")
    texts, comp = None, connected_components(edges)
    for most in NEAREST:
        placed = materialize(inside.join(comp, "node", "left").select("set_id", "node", F.coalesce("component", "node").alias("comp")), "placed")
        mixed = placed.groupBy("set_id").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).filter("c0 < c1")
        spread = (
            placed.join(mixed, "set_id")
            .withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
            .withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("set_id", "node", "comp", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
        )
        spread = materialize(spread, "blocks")
        shards = max(1, -(-spread.count() // SHARD_ROWS))
        work = spread.join(sketches.withColumnRenamed("s1", "node"), "node").withColumn("shard", F.pmod(F.xxhash64("set_id", "bi", "bj"), F.lit(shards)))
        seen = materialize(work.groupBy("shard").applyInArrow(across(most), "a long, b long").distinct(), "seen")
        if seen.isEmpty():
            break
        if texts is None:
            # a member of a plausible pair is in its own nearest pair, so later rounds need no others
            ends = materialize(seen.select(F.col("a").alias("node")).unionAll(seen.select("b")).distinct(), "ends")
            inside = materialize(inside.join(ends, "node", "left_semi"), "members")
            texts = shingles_of(ends.withColumnRenamed("node", "s1"))
        late = seen.join(tested, ["a", "b"], "left_anti")
        more = linked(late, texts)
        tested = tested.unionAll(seen)
        if not more.isEmpty():
            edges = materialize(edges.unionAll(more), "edges")
            comp = connected_components(edges)
    share = max(FEWEST, documents // (8 * parts(spark)))  # rows of a class, or classes of a component, that one task may take
    joined = materialize(classes.join(comp.select(F.col("node").alias("s1"), "component"), "s1"), "joined")
    tops = joined.groupBy("component").agg(F.min("rep").alias("top"), F.count("*").alias("members"))
    known = spread_join(joined, tops, ["component"], "members", share).select("n", "s1", "s2", "component", "top")
    known = classes.join(known, ["n", "s1", "s2"], "left").select(
        "n", "s1", "s2", "copies", F.col("rep").alias("class_id"), F.coalesce("component", "s1").alias("component_key"), F.coalesce("top", "rep").alias("top")
    )
    worded = spread_join(rows.drop("sketch").filter("n > 0"), materialize(known, "known"), ["n", "s1", "s2"], "copies", share)
    wordless = rows.filter("n = 0").select("doc_id", "text_hash", "n")  # they have no class, and may be many
    return worded.unionByName(wordless, allowMissingColumns=True).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"), "text_hash", "component_key",
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (rows without id last), then text hash.

    Rows are told apart by id and text; of rows that repeat the first one, one stays. Texts without words all stay.
    """
    linked = materialize(links_of_documents(docs, id_col=id_col, text_col=text_col, **options), "linked").filter("component_key is not null")
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_hash")
    keyed = linked.select("component_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", key.alias("key")).alias("row"))
    # joined on the key of a row, not on its component: a group may hold a third of all rows
    firsts = keyed.groupBy("component_key").agg(F.min("row").alias("first")).select(F.col("first.key").alias("key"), F.lit(True).alias("first"))
    rows = keyed.groupBy(F.col("row.key").alias("key")).agg(F.count("*").alias("m"))
    told = materialize(rows.join(firsts, "key", "left").select(F.col("key").alias("__row"), "m", "first"), "told")
    gone = told.filter("first is null").select("__row")
    repeated = told.filter("first and m > 1").select("__row")
    row = F.xxhash64(F.col(id_col).cast("long").isNull(), F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    named = docs.withColumn("__row", row)
    kept = drop_ids(named, gone.unionAll(repeated), "__row")
    if not repeated.isEmpty():
        kept = kept.unionByName(named.join(repeated, "__row", "left_semi").dropDuplicates(["__row"]))
    return kept.select(*docs.columns)
