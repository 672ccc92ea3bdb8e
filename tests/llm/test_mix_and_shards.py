"""Mixing, sharding and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from pixelmill.llm import cube_mixing, histogram_shards, registry

SF = "/root/testdata/sf0.001"


def test_water_filling():
    t = cube_mixing.water_fill({"b": 100, "a": 10, None: 50, "c": 0}, (3, 1, 2), 1.5, 2.0)
    assert abs(sum(t.values()) - 240) < 1e-9 and t["a"] == 20 and t["c"] == 0 and all(t[k] <= 2 * n + 1e-9 for k, n in {"a": 10, "b": 100, None: 50}.items())
    # null comes last: weights a 3, b 1, c 2, null 3
    assert t[None] == 100 and t["b"] == 120
    assert cube_mixing.water_fill({}, (3, 1, 2), 1.5, 2.0) == {}


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_totals(seed):
    rng = np.random.default_rng(seed)
    n = 500
    x, m, w = np.full(n, 0.37), np.ones(n), rng.integers(1, 900, n).astype(float)
    y = cube_mixing.flight(x, m, w, rng.random(2 * n + 4), False)
    assert ((y > 0) & (y < 1)).sum() <= 2
    assert abs(y.sum() - x.sum()) < 1e-5 and abs((y * w).sum() - (x * w).sum()) < 1e-2
    z = cube_mixing.flight(x, m, w, rng.random(2 * n + 4), True)
    assert set(np.unique(z)) <= {0.0, 1.0} and abs((z * w).sum() - (x * w).sum()) <= w.max()


def test_flight_keeps_probabilities():
    rng = np.random.default_rng(0)
    x = np.array([0.2, 0.5, 0.7, 0.3, 0.9])
    w = np.array([5.0, 1, 3, 3, 8])
    mean = np.mean([cube_mixing.flight(x, np.ones(5), w, rng.random(20), True) for _ in range(4000)], axis=0)
    assert np.abs(mean - x).max() < 0.04


@pytest.mark.parametrize("seed", range(8))
def test_flight_against_the_null_space(seed):
    """The cube method by definition: a null vector of the constraints by singular values, for three units at a time."""
    rng = np.random.default_rng(seed)
    n = 40
    x, a, b = rng.random(n), rng.integers(1, 3, n).astype(float), rng.integers(1, 60, n).astype(float)
    draws = rng.random(3 * n)
    y, live, r = x.copy(), [], iter(draws)
    for k in range(n):
        live.append(k)
        if len(live) < 3:
            continue
        u = np.linalg.svd(np.stack([a[live], b[live]]))[2][-1]
        i, j, m = live
        if np.dot(u, [a[j] * b[m] - a[m] * b[j], a[m] * b[i] - a[i] * b[m], a[i] * b[j] - a[j] * b[i]]) < 0:
            u = -u
        p = y[live]
        with np.errstate(divide="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + (up if next(r) * (up + down) < down else -down) * u
        y[live] = np.where(np.abs(p) < 1e-7, 0, np.where(np.abs(p - 1) < 1e-7, 1, p))
        live = [q for q in live if 0 < y[q] < 1]
    got = cube_mixing.flight(x, a, b, draws, False)
    assert np.allclose(got, y, atol=1e-5)


def test_mix_of_the_small_tables(spark):
    a = registry.op6_cube_mixing(spark, SF).collect()
    b = registry.op6_cube_mixing(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(a, key=key) == sorted(b, key=key)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(a) == len(docs)
    per = {}
    for r in a:
        assert r["size"] == len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"])]) and 0 <= r["taken"] <= 2 * r["size"]
        s = per.setdefault(docs[r["doc_id"]]["source"], [0, 0, r["target"], r["source_size"], 0])
        s[0] += r["taken"]
        s[1] += r["size"]
        s[4] = max(s[4], r["size"])
    for taken, size, target, source_size, most in per.values():
        assert size == source_size and abs(taken - target) <= most + 1


def test_mix_edge_cases(spark):
    schema = "doc_id long, source string, text string, m int"
    rows = [(1, None, "a b c", 0), (None, "s", "x y", 0), (None, "s", "x y", 0), (2, "s", None, 0), (3, "s", "", 0), (4, "t", None, 0)]
    got = cube_mixing.taken_words(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert cube_mixing.taken_words(spark.createDataFrame([], schema)).count() == 0
    mixed = cube_mixing.mixed_documents(spark.createDataFrame(rows, schema))
    assert mixed.columns == ["doc_id", "source", "text", "m"]
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cube_mixing, "BLOCK", 8)
    rows = [(i, f"s{i % 3}", "w " * (1 + i * 7 % 50)) for i in range(400)]
    got = cube_mixing.taken_words(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in range(3):
        own = [r for r in got if r["doc_id"] % 3 == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60


def check_shards(rows, got, shards=40, tolerance=0.02):
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards for s in size)
    for own in size.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total, most = sum(r["size"] for r in got), max((r["size"] for r in got), default=0)
    for s in range(shards):
        assert abs(sum(r["size"] for r in size.get(s, [])) - total / shards) <= most + tolerance * total / shards + 1
    last = None
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        k = (r["doc_id"] if r["doc_id"] is not None else -(2**63) - 1, r["text_crc32"])
        assert last is None or last <= k
        last = k


def test_shards_of_the_small_tables(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = registry.op9_histogram_shards(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, got)
    for r in got:
        raw = rows[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)


def test_shards_with_skewed_keys_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), "x" * int(rng.integers(0, 300))) for i in np.unique(np.concatenate([np.arange(3000), 2**62 + np.arange(2000), -(2**63) + np.arange(10), rng.integers(-(2**62), 2**62, 500)]))]
    rows += [(None, "null id"), (None, None), (2**63 - 1, "last"), (5, "again"), (5, "again")]
    got = histogram_shards.shard_by_bytes(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")).collect()
    check_shards(rows, got)


def test_shards_of_one_key_and_of_nothing(spark):
    rows = [(7, f"text number {i}") for i in range(2000)]  # one id, different texts
    check_shards(rows, histogram_shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect(), tolerance=0.05)
    assert histogram_shards.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = histogram_shards.shard_by_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_registered_queries():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)}
    assert names <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, out = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF).cache()
        kept[name] = out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
    rows = docs.collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(kept["language_id"]) >= 0.97 * len(rows)
    comp = {r["doc_id"]: r["component_id"] for r in registry.op5_parity_join(spark, SF).collect()}
    stay = {r["doc_id"] for r in kept["language_id"]}
    assert {r["doc_id"] for r in kept["parity_join"]} == {i for i in stay if i == min(j for j in stay if comp[j] == comp[i])}
    assert len(kept["pii"]) == len(kept["parity_join"])
    hits = 0
    for r in kept["pii"]:
        before = texts[r["doc_id"]]
        gone = [m.group() for p in PLAIN for m in re.finditer(p, before)]
        hits += len(gone)
        assert r["n_chars"] == len(r["text"]) and not any(g in r["text"] for g in gone)
        if not gone and re.fullmatch(r"[\w .,;\n]*", before) and before.isascii() and " at " not in before:
            assert r["text"] == before
    assert hits >= 5
    assert sorted(r["doc_id"] for r in kept["byte_bpe"]) == sorted(r["doc_id"] for r in kept["cube_mixing"])
    once = {r["doc_id"] for r in kept["parity_join"]}
    taken = Counter(r["doc_id"] for r in kept["cube_mixing"])
    assert set(taken) <= once and max(taken.values()) <= 2
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in kept["pii"]}
    per, goal, most = Counter(), Counter(), Counter()
    for r in kept["pii"]:
        goal[r["source"]] += size[r["doc_id"]]
        per[r["source"]] += size[r["doc_id"]] * taken[r["doc_id"]]
        most[r["source"]] = max(most[r["source"]], size[r["doc_id"]])
    want = cube_mixing.water_fill(dict(goal), (3, 1, 2), 1.5, 2.0)
    assert all(abs(per[s] - want[s]) <= most[s] + 1 for s in want)


PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+[0-9][ ().0-9-]{9,14}[0-9]")


def test_pipeline_of_nulls_repeats_and_extra_columns(spark):
    words = {"en": "the quick brown fox jumped over the lazy dog and ran home".split(), "de": "der schnelle braune fuchs sprang über den faulen hund nach haus".split()}
    rng = random.Random(5)
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choices(words[lang], k=30)) + (" mail x@y.zz" if i % 5 == 0 else "")
        rows.append((i, text, lang, ("web", "book", None)[i % 3], len(text)))
    rows += [(200, rows[3][1], None, None, 1), (3, rows[3][1], "en", "book", 1), (None, rows[4][1], None, "web", None), (201, None, None, None, None), (202, "", "en", "web", 0), (None, None, None, None, None), (203, "12 34 !!", "en", None, 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    extra = docs.selectExpr("*", "1 as score", "'r' as rejected", "2L as s1", "'k' as spans", "5 as copies", "'x' as component_id")
    out = {}
    for some in (docs, extra, docs.limit(0)):
        d = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == some.columns
            out.setdefault(name, []).append(sorted(map(tuple, d.select("doc_id", "text", "source").collect()), key=str))
        d = corpus_pipeline.STAGES[-1][1](spark, d, SF)
        out.setdefault("tokens", []).append(sorted(map(tuple, d.select("doc_id", "n_tokens", "ids_sha256").collect()), key=str))
    for name, (plain, wide, none) in out.items():
        assert plain == wide and plain and none == [], name
    first = [r[0] for r in out["language_id"][0]]
    assert not {201, 202, 203} & set(first) and len(first) == 83
    kept = out["parity_join"][0]
    assert len(kept) == len(set(kept)) and not any(r[0] in (200, None) for r in kept)
    assert not any("x@y.zz" in r[1] for r in out["pii"][0]) and any("[EMAIL]" in r[1] for r in out["pii"][0])


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
