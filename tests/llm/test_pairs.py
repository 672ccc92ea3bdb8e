"""Operators on pairs against brute force: vectors, documents, components."""

import inspect
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelmill.llm import parity_join as PJ
from pixelmill.llm.common import connected_components, drop_ids, spread_join
from pixelmill.llm.embedding_dedup import bucket_codes, hadamard, links_of_vectors
from pixelmill.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_ids(spark):
    docs = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(200)], "doc_id long, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    got = sorted(r["text"] for r in drop_ids(docs, gone, "doc_id").collect())
    assert got == sorted(f"t{i}" for i in range(200) if i == 0 or i % 3)


def test_hadamard_is_orthogonal():
    h = hadamard(np.eye(16, dtype=np.float32))
    assert np.allclose(h @ h.T, 16 * np.eye(16))


def brute_vectors(rows):
    ok = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    deg, edges = defaultdict(int), []
    for (i, a, u), (j, b, v) in itertools.combinations(ok, 2):
        if a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
            deg[i] += 1
            deg[j] += 1
            edges.append((i, j))
    return deg, roots([r[0] for r in rows if r[0] is not None], edges)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(30):
        base = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 7))):
            rows.append((n, int(rng.integers(0, 2)), (base + rng.normal(size=24) * 0.12).astype(np.float32).tolist()))
            n += 1
    rows += [(n + k, r[1], r[2]) for k, r in enumerate(rows[:20])]  # exact copies
    n = len(rows)
    rows += [(n, 0, None), (n + 1, 0, [0.0] * 24), (n + 2, 0, [float("nan")] * 24), (n + 3, None, rows[0][2]), (n + 4, 0, []), (n + 5, 0, [None] * 24), (n + 6, 0, [1.0, 0.0, 0.0]), (n + 7, 0, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, label int, embedding array<float>, vec string")
    got = {r["vec_id"]: r for r in links_of_vectors(df).collect()}
    deg, comp = brute_vectors(rows)
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (deg[i], comp[i], comp[i] == i)


@pytest.mark.parametrize("dim", [24, 64, 128, 768])
def test_recall_at_the_threshold(dim):
    """Of pairs at a cosine of just 0.98, those that share a bucket under the shipped setting."""
    rng, n = np.random.default_rng(dim), 2000
    x, noise = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * noise
    p = {k: v.default for k, v in inspect.signature(links_of_vectors).parameters.items()}
    a, b = (bucket_codes(v, p["tables"], p["width"], p["probes"], p["seed"]) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= 0.999


def test_vectors_null_ids_and_empty(spark):
    schema = "vec_id long, label int, embedding array<float>"
    got = links_of_vectors(spark.createDataFrame([(None, 1, [1.0, 2.0]), (5, 1, [1.0, 2.0]), (6, 1, [1.0, 2.0])], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert links_of_vectors(spark.createDataFrame([], schema)).count() == 0


def test_large_bucket_in_blocks(spark, monkeypatch):
    from pixelmill.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, 1, (base + rng.normal(size=16) * 0.08).astype(np.float32).tolist()) for i in range(150)]
    got = {r["vec_id"]: r for r in links_of_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    deg, comp = brute_vectors(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: deg[i] for i, *_ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == comp


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_documents(rows):
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(sets, edges)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["Wort%d" % i for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=60))
    rows: list = []
    for _ in range(40):
        base = rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 8, 12, 30, 90, 300]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 25])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = rng.choice([" ", "\n", "\t "]).join(w)
            rows.append(rng.choice([text, text.upper(), text + " " + passage]) if len(w) > 100 else rng.choice([text, text.lower()]))
    rows += [None, "", " \n\t ", "ÄÖ ü x", "äÖ ü x"]
    return list(enumerate(rows))


@pytest.mark.parametrize("whole", [8, 2])
def test_documents_against_brute_force(spark, whole, monkeypatch):
    monkeypatch.setattr(PJ, "WHOLE", whole)  # the later rounds, too
    monkeypatch.setattr(PJ, "BLOCK", 16)
    rows = corpus(whole)
    got = {r["doc_id"]: r for r in PJ.links_of_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")).collect()}
    n, comp = brute_documents(rows)
    assert {i: r["n_shingles"] for i, r in got.items()} == n
    assert {i: r["component_id"] for i, r in got.items()} == comp


@pytest.mark.parametrize("row", [10, 1000])
def test_members_of_hot_keys_are_dealt_to_slots(spark, row, monkeypatch):
    """Slots of five members, many keys: the same components as brute force."""
    monkeypatch.setattr(PJ, "HOT", 4)
    monkeypatch.setattr(PJ, "SLOT", 5)
    monkeypatch.setattr(PJ, "ROW", row)
    monkeypatch.setattr(PJ, "BUCKET_KEYS", 500)
    made = []
    init = PJ.Slots.__init__
    monkeypatch.setattr(PJ.Slots, "__init__", lambda self, keys, n: (made.append(n.copy()), init(self, keys, n))[1])
    rng = random.Random(11)
    base = [f"v{i}" for i in range(60)]
    texts = [t for _, t in corpus(3)][:60]
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{i}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in PJ.links_of_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert made and made[0].max() > 1  # the branch was taken
    n, comp = brute_documents(rows)
    assert got == {i: (n[i], comp[i]) for i, _ in rows}


def test_documents_of_the_small_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in PJ.links_of_documents(d).collect()}
    n, comp = brute_documents(rows)
    assert got == {i: (n[i], comp[i]) for i, _ in rows}


def test_documents_without_id_and_empty(spark):
    schema = "doc_id long, text string"
    got = PJ.links_of_documents(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (2, 2), (3, 2)]
    assert len({r["component_key"] for r in got}) == 1
    assert PJ.links_of_documents(spark.createDataFrame([], schema)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, near, other = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t u", "z1 z2 z3 z4 z5 z6 z7"
    rows = [(5, a), (5, a), (9, near), (None, a), (7, other), (9, other), (None, None), (None, None), (1, ""), (2, " "), (None, "only here and nowhere else"), (4, "x1 x2 x3 x4 x5 x6"), (None, "x1 x2 x3 x4 x5 x6")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, s1 int").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"] or "-") for r in PJ.one_of_each(docs).collect()))
    assert got == sorted([(5, a), (7, other), (0, "-"), (0, "-"), (1, "-"), (2, " "), (0, "only here and nowhere else"), (4, "x1 x2 x3 x4 x5 x6")])
    assert PJ.one_of_each(docs).columns == docs.columns and PJ.one_of_each(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.floats(0, 1))
def test_similar_sets_share_a_segment(n, seed, part):
    """The guarantee behind the join: every pair of different sets at 0.75 or more meets in a key."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    most = int((len(a) * 2) * 25 / 175 * part)
    drop = int(rng.integers(0, most + 1))
    b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, most - drop, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < 75 * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    common = PJ.Frequent(np.concatenate([a, b])[rng.random(len(a) + len(b)) < rng.choice([0, 0.1, 0.9])])
    who, key = PJ.segment_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 75, 100, common)
    assert set(key[who == 0].tolist()) & set(key[who == 1].tolist())
    x, y = PJ.parity_bits(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert PJ.apart(x, y) <= len(a) + len(b) - 2 * both


def test_shingles_of_slices():
    import pyarrow as pa

    texts = pa.array(["x", None, "a b c d e a b c d e", "", "q w e r"])
    v, off = shingle_sets(texts)
    assert np.diff(off).tolist() == [1, 0, 5, 0, 1]
    v2, off2 = shingle_sets(texts.slice(2, 3))
    assert np.array_equal(v2, v[off[2] :]) and np.diff(off2).tolist() == [5, 0, 1]


def test_entry_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert PJ.links_of_documents(d.withColumn("s1", F.lit(1)).withColumn("component", F.lit(2))).collect()[0]["component_id"] == 1


def test_rows_of_a_large_class_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(PJ, "FEWEST", 3)
    small = spark.createDataFrame([(1, 40, "one"), (2, 2, "two"), (3, 1, "three")], "k long, copies long, name string")
    big = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 2), (3, 1)) for i in range(n)], "k long, i long")
    got = spread_join(big, small, ["k"], "copies", 3)
    assert got.columns == ["k", "i", "copies", "name"]
    assert sorted((r["k"], r["i"], r["name"]) for r in got.collect()) == sorted((k, i, t) for k, n, t in ((1, 40, "one"), (2, 2, "two"), (3, 1, "three")) for i in range(n))
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in (0, 59)] * 20
    rows = [(i, t) for i, t in enumerate([*near, *[" ".join(words)] * 40, *[None] * 40, "alone in here with six words"])]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in PJ.links_of_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == (56, 0) for i in range(80)) and all(out[i] == (0, i) for i in range(80, 120)) and out[120] == (2, 120)
