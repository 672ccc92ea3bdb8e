"""Mini-cases of regions, labels, paths, kernels, sources, models and streaming."""

import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import hamming as H
from pixelmill.functions import kernels as K
from pixelmill.functions import scalars as S
from pixelmill.operators import dedup as D
from pixelmill.operators import evaluation as E
from pixelmill.operators import features as X
from pixelmill.operators import models as M
from pixelmill.operators import profiles as P
from pixelmill.operators import regions as R
from pixelmill.operators import splits as SP
from pixelmill.plans import catalog
from pixelmill.sources import images as I
from pixelmill.sources import manifest as MF
from pixelmill.sources import sinks as K2
from pixelmill.streaming import ingest

BOX = "sample_id long, x int, y int, w int, h int, iw int, ih int"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


# --- regions -------------------------------------------------------------------------


def test_union_of_two_boxes(spark):
    r = spark.createDataFrame([(1, 0, 0, 5, 5, 10, 10), (1, 2, 2, 5, 5, 10, 10), (2, 1, 1, 3, 3, 10, 10)], BOX)
    got = {x["sample_id"]: x["union_coverage"] for x in R.union_area(r).collect()}
    assert got == {1: 0.41, 2: 0.09}


def test_union_against_raster(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(int, rng.integers(0, 30, 2)), *map(int, rng.integers(1, 15, 2)), 50, 50) for i in range(5) for _ in range(12)]
    got = {x["sample_id"]: x["union_coverage"] for x in R.union_area(spark.createDataFrame(rows, BOX)).collect()}
    for i in range(5):
        m = np.zeros((50, 50), bool)
        for _, x, y, w, h, *_ in (r for r in rows if r[0] == i):
            m[y : y + h, x : x + w] = True
        assert got[i] == pytest.approx(m.mean())


def test_aggregate_values(spark):
    df = spark.createDataFrame([(1, "f", 0.2), (1, "f", 0.6), (1, "g", 0.2), (1, "h", None), (1, "h", float("nan"))], "sample_id long, feature string, value double")
    got = {r["feature"]: r for r in R.aggregate_long(df).collect()}
    assert got["f"]["mean"] == pytest.approx(0.4) and got["f"]["std"] == pytest.approx(0.2)
    assert got["g"]["std"] == 0 and got["h"]["mean"] is None and got["h"]["valid_count"] == 0
    with pytest.raises(ValueError, match="unknown statistics"):
        R.aggregate_long(df, stats=("mean", "mode"))
    v = [3.0, 1.0, 4.0, 1.0, 5.0]
    r = R.aggregate_long(spark.createDataFrame([(1, "f", x) for x in v], df.schema)).first()
    assert r["p10"] == pytest.approx(np.percentile(v, 10)) and r["iqr"] == pytest.approx(np.subtract(*np.percentile(v, [75, 25])))


def test_row_alignment(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, int(rng.integers(0, 900)), 10, int(rng.integers(4, 40)), 100, 1000) for i in range(20) for _ in range(9)]
    got = {r["sample_id"]: r["row_error"] for r in R.row_alignment(spark.createDataFrame(rows, BOX)).collect()}
    for i in range(20):
        lines = []
        for v in sorted((y + h) / 2 / 1000 for s, _, y, _, h, *_ in rows if s == i):
            for line in lines:
                if abs(v - sum(line) / len(line)) <= 0.02:
                    line.append(v)
                    break
            else:
                lines.append([v])
        assert got[i] == pytest.approx(np.mean([abs(v - np.mean(line)) for line in lines for v in line]))


def test_empty_image_row(spark):
    images = spark.createDataFrame([(1,), (2,)], "sample_id long")
    out = {r["sample_id"]: r for r in R.image_row(spark.createDataFrame([(1, 2, 3, 4, 5, 100, 100)], BOX).transform(R.number_regions), images).collect()}
    assert out[2]["no_detection"] == 1 and out[2]["region_count"] == 0 and out[2]["mean_iou"] is None
    assert out[1]["no_detection"] == 0 and out[1]["mean_iou"] == 0.0 and out[1]["nearest_gap_x"] is None


def test_boxes(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    assert tuple(one(spark, S.clip_box(*lit(-4, 7, 20, 8, 12, 10)))) == (0, 7, 12, 3)
    assert one(spark, S.clip_box(*lit(20, 0, 5, 5, 12, 10))) is None
    assert tuple(one(spark, S.padded_box(*lit(2, 2, 10, 30, 12, 100)))) == (2, 0, 10, 34)  # half to even: 1.5 -> 2, 0.5 -> 0, 33.5 -> 34
    assert tuple(one(spark, S.padded_box(*lit(3, 10, 10, 10, 100, 100)))) == (2, 10, 12, 10)  # 2.5 -> 2, 13.5 -> 14, 9.5 -> 10, 20.5 -> 20
    assert X.padded_crop((3, 10, 10, 10), 100, 100, 0.05) == (2, 10, 14, 20)
    poly = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.2, 2.8), (5.1, 3.0), (2.0, 7.5))))
    assert tuple(one(spark, S.polygon_box(poly))) == (1, 2, 6, 8)


# --- scalars --------------------------------------------------------------------------


@pytest.mark.parametrize(("path", "ok"), [("a/b.png", True), ("../x", False), ("a/../../x", False), ("a/../b", True), ("/abs", False), ("C:\\x", False), ("a\\..\\..\\x", False), ("", False), (".", False)])
def test_paths(spark, path, ok):
    assert one(spark, S.safe_relative_path(F.lit(path))) is ok


def test_scalars(spark):
    assert one(spark, S.slug(F.lit("a b/ü.png"))) == "a_b_.png" and one(spark, S.slug(F.lit("///"))) == "image"
    assert one(spark, S.prototype_label(F.lit(" Real "))) == "non_ai_generated" and one(spark, S.pilot_label(F.lit("fake"))) == "AI_GENERATED"
    with pytest.raises(Exception, match="unknown label"):
        one(spark, S.prototype_label(F.lit("cat"), strict=True))
    assert one(spark, S.sigmoid(F.lit(-800.0))) == 0.0 and one(spark, S.sigmoid(F.lit(800.0))) == 1.0
    assert one(spark, S.logit(F.lit(0.0))) == float("-inf") and one(spark, S.logit(F.lit(0.5))) == 0.0
    assert one(spark, S.finite(F.lit(float("nan")))) is None
    assert [one(spark, S.bool_like(F.lit(x))) for x in ("Yes", "0", "1.0")] == [True, False, None]


# --- duplicates, leakage, sampling ---------------------------------------------------------


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 15)
    rows = [(i, int(base[i % 15] ^ np.int64(sum(1 << int(b) for b in rng.integers(0, 63, i % 4))))) for i in range(60)] + [(60, 0), (61, -1), (62, 0)]
    for d in (0, 3, 4):
        got = {(r["a"], r["b"], r["distance"]) for r in D.near_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", d).collect()}
        want = {(a, b, n) for a, x in rows for b, y in rows if a < b and (n := ((x ^ y) & (2**64 - 1)).bit_count()) <= d}
        assert got == want


@pytest.mark.parametrize("pieces", [None, 4, 6, 17])
def test_hamming_search_finds_every_pair_once(monkeypatch, pieces):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64 - 1, 20, dtype=np.uint64)

    def some(n):
        flips = np.zeros(n, np.uint64)
        for b in range(64):
            flips |= (rng.random(n) < 0.1).astype(np.uint64) << np.uint64(b)
        return base[rng.integers(0, 20, n)] ^ flips

    x = np.concatenate([some(300), some(20).repeat(9)])
    y = np.concatenate([some(200), x[::7]])
    if pieces:
        monkeypatch.setattr(H, "cheapest", lambda nx, ny, d: H.parts(d, pieces))
        monkeypatch.setattr(H, "BLOCK", 64)
        monkeypatch.setattr(H, "CELLS", 50)
    for d in (0, 3, 16, 20):
        assert all(sum(t + 1 for _, _, t in H.parts(d, k)) == d + 1 for k in range(1, 65))
        for other in (y, None):
            got = sorted((*((a, b) if other is not None else sorted((a, b))), n) for p in H.close_rows(x, other, d) for a, b, n in zip(*(v.tolist() for v in p), strict=True))
            all_ = np.bitwise_count(x[:, None] ^ (x if other is None else other))
            assert got == [(a, b, int(all_[a, b])) for a, b in np.argwhere(all_ <= d).tolist() if other is not None or a < b]


def test_near_pairs_of_far_hashes_compare_few(spark, monkeypatch):
    """At distance 16, bands of 3 or 4 equal bits met 1.3 times all pairs."""
    rng = np.random.default_rng(4)
    x, y = (rng.integers(0, 2**64 - 1, 40_000, dtype=np.uint64) for _ in "xy")
    met, hits = [], H._hits
    monkeypatch.setattr(H, "_hits", lambda a, b, d, room: met.append(len(a) * len(b)) or hits(a[:0], b, d, room))
    assert not list(H.close_rows(x, y, 16)) and 0 < sum(met) < 0.35 * len(x) * len(y)
    df = spark.createDataFrame([(1, 5), (2, 5)], "id long, h long")
    assert "Join" not in D.near_pairs(df, "id", "h", 16)._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_of_blocks_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAST_BLOCK", 20)
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", int(h)) for i, h in enumerate(rng.integers(-(2**63), 2**63 - 1, 60))] + [(f"c{i}", 7) for i in range(40)]
    rows += [("k3", 7), ("c1", 6), (None, 7), ("z", None), ("c2", 7)]  # an id twice, once with an equal hash; nulls
    got = sorted(tuple(r) for r in D.near_pairs(spark.createDataFrame(rows, "id string, h long"), "id", "h", 16).collect())
    known = [r for r in rows if None not in r]
    assert got == sorted((a, b, n) for a, x in known for b, y in known if a < b and (n := ((x ^ y) & (2**64 - 1)).bit_count()) <= 16)
    assert D.near_pairs(spark.createDataFrame([], "id long, h long"), "id", "h", 16).count() == 0


def test_hashes_of_odd_vectors_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    nan, inf, v = float("nan"), float("inf"), rng.normal(size=(6, 64)).tolist()
    v[1][3], v[2][5], v[3][7] = None, nan, inf
    rows = [*enumerate(v), (6, None), (7, []), (8, [None] * 64), (9, v[0]), (10, [1.5] * 64), (None, v[0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("avg_hash", "near_dup_pairs"):
        got = [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, duck.sql(catalog.oracle_sql()[name]).fetchall())), name


def test_marks_of_copies(spark):
    rows = [(1, "s", 7, "ai", "b"), (2, "s", 7, "ai", "a"), (3, "t", 8, "ai", "c"), (4, "u", 9, "ai", "d"), (5, "u", 9, "real", "e")]
    df = spark.createDataFrame(rows, "id int, sha string, h long, label string, path string")
    kept = {r["id"]: r["status"] for r in D.mark_duplicates(df, "sha", "label", ["path"]).collect()}
    assert kept == {1: "excluded", 2: "included", 3: "included", 4: "review", 5: "review"}
    out = {r["id"]: r["status"] for r in D.prepare_marks(df, id_col="id", key="sha", hash_col="h", label="label", order=["path"]).collect()}
    assert out == {1: "excluded", 2: "review", 3: "included", 4: "review", 5: "review"}  # no copy stays included


def test_leakage(spark):
    df = spark.createDataFrame([("s", "g", "train"), ("s", "g2", "test"), ("t", "g", None)], "sha256 string, group_id string, split string")
    with pytest.raises(ValueError, match="exact duplicate"):
        D.check_leakage(df, {"sha256": "exact duplicate"})
    D.check_leakage(df, {"group_id": "group"})


def test_unique_ids_pass_over_taken_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a"), (5, "b")], "n int, b string")
    got = {r["n"]: r["unique_id"] for r in D.unique_ids(df, F.col("b"), ["n"]).collect()}
    assert got == {1: "a", 2: "a_3", 3: "a_2", 4: "a_4", 5: "b"} and len(set(got.values())) == 5


def test_balanced(spark):
    df = spark.createDataFrame([(i, "ai" if i % 3 else "real") for i in range(30)], "id int, label string")
    for out in (D.balanced_sample(df, "label", "id", 1), D.balanced_shuffle(df, "label", "id", {"ai": 43, "real": 42})):
        n = {r["label"]: r["count"] for r in out.filter("selected").groupBy("label").count().collect()}
        assert n == {"ai": 10, "real": 10}


def test_compare_runs_and_sets(spark):
    a = spark.createDataFrame([(1, 0.5, 0), (2, 0.5, 1), (3, 0.1, 0)], "id int, s double, y int")
    b = spark.createDataFrame([(1, 0.5, 0), (2, 0.6, 1), (4, 0.1, 0)], a.schema)
    got = {(r["id"], r["reason"]) for r in D.compare_runs(a, b, "id", "s", "y").collect()}
    assert got == {(2, "score"), (3, "unexpected") if (3, "unexpected") in got else (3, "missing"), (4, "missing") if (4, "missing") in got else (4, "unexpected")}
    assert not D.same_keys(a, b, "id") and D.same_keys(a, a, "id")
    assert D.schema_difference(["a", "b"], ["b", "c"]) == (["a"], ["c"])


def test_split(spark):
    df = spark.createDataFrame([(i, f"g{i // 2}", "ai" if (i // 2) % 2 else "real") for i in range(240)], "id int, g string, label string")
    out = SP.group_split(df, "g", "label", 42)
    assert D.leaks(out, "g").isEmpty()
    n = {(r["split"], r["label"]): r["n"] for r in out.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert len(n) == 6
    size = {s: sum(v for k, v in n.items() if k[0] == s) / 240 for s in ("train", "validation", "test")}
    assert abs(size["test"] - 0.15) < 0.06 and abs(size["validation"] - 0.15) < 0.06
    with pytest.raises(ValueError, match="at least 12"):
        SP.group_split(df.limit(5), "g", "label", 1)
    with pytest.raises(ValueError, match="more than one label"):
        SP.group_split(df.withColumn("label", F.when(F.col("id") == 0, "ai").otherwise(F.col("label"))), "g", "label", 1)


# --- evaluation ---------------------------------------------------------------------------


def test_threshold_rules(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, 0.4), (1, 0.6)], "y int, s double")
    assert E.best_threshold(df, "y", "s", 0.5).first()["threshold"] == 0.5  # as good as 0.6 and nearer the default
    none = E.best_threshold(df.withColumn("y", F.lit(0)), "y", "s", 0.5).first()
    assert none["threshold"] == 0.5 and none["method"] == "estimator_default_no_validation_signal"


def test_running_totals(spark):
    rng = np.random.default_rng(3)
    rows = [(float(k), int(v)) for k, v in zip(rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    out = {r["k"]: r["cum_v"] for r in E.running_totals(spark.createDataFrame(rows, "k double, v long"), "k", ["v"], descending=True, ranges=7).collect()}
    assert all(out[k] == sum(v for j, v in rows if j >= k) for k, _ in rows)


def test_metrics_and_reports(spark, tmp_path):
    rows = [(f"s{i}", i % 2, 0.9 if i % 2 else 0.1, i % 2, 0.5, 2, False, "a" * 64) for i in range(4)]
    p = spark.createDataFrame(rows, "sample_id string, true_label int, score double, predicted_label int, threshold double, region_count int, no_detection boolean, input_sha256 string")
    m = E.confusion(p, "true_label", "predicted_label").first().asDict()
    assert (m["tn"], m["tp"], m["f1"]) == (2, 2, 1.0)
    K2.evaluation_report(m, p, str(tmp_path))
    got, back = K2.load_report(spark, str(tmp_path))
    assert got == m and back.count() == 4
    K2.write_json(f"{tmp_path}/metrics.json", m | {"f1": 0.5})
    with pytest.raises(ValueError, match="metrics differ"):
        K2.load_report(spark, str(tmp_path))


def test_cliffs_delta_and_spearman(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 40), rng.integers(2, 12, 30)
    rows = [("f", 0, float(v)) for v in a] + [("f", 1, float(v)) for v in b] + [("f", 1, None)]
    got = E.cliffs_delta(spark.createDataFrame(rows, "feature string, label int, value double")).first()["delta"]
    assert got == pytest.approx(np.sign(b[:, None] - a[None, :]).mean())


def test_profiles(spark):
    df = spark.createDataFrame([("a", "png"), ("a", "png"), ("b", "jpg")], "label string, format string")
    assert P.class_separation(df, "label", ["format"]).first()["separated"]
    assert not P.class_separation(df.union(spark.createDataFrame([("b", "png")], df.schema)), "label", ["format"]).first()["separated"]


# --- kernels --------------------------------------------------------------------------------


def test_schema_has_282_columns():
    assert len(X.region_registry()) == 34 and len(X.model_columns()) == 282
    assert [len(X.model_columns(g)) for g in X.SUBSETS.values()] == [60, 66, 89, 89, 41, 282]
    assert len(json.loads(X.schema_json())["model_columns"]) == 282


def bar():
    g = np.zeros((12, 20), np.uint8)
    g[4:8, 3:17] = 255
    return g


def test_components_against_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(20):
        m = rng.random((15, 17)) < 0.45
        labels, n = K.components(m)
        seen, count = np.zeros_like(m), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            count += 1
            todo, part = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                part.append(labels[a, b])
                for c in range(max(0, a - 1), min(15, a + 2)):
                    for d in range(max(0, b - 1), min(17, b + 2)):
                        if m[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            assert len(set(part)) == 1
        assert n == count and (labels > 0).sum() == m.sum()


def test_kernels_on_a_bar():
    v = X.region_features(bar(), (3, 4, 20, 12), (100, 100), polygon=np.array([(0, 0), (20, 0), (20, 12), (0, 12)], float))
    assert v["sharpness.laplacian_variance"] > 0 and 0 < v["edge.canny_density"] < 1 and v["contrast.gray_std"] > 0
    assert v["shape.component_count"] == 1 and v["shape.hole_count"] == 0 and v["geometry.orientation"] == 0
    assert 2 < v["stroke.width_median"] <= 5 and v["texture.gray_entropy"] == pytest.approx(-(56 / 240) * np.log2(56 / 240) - (184 / 240) * np.log2(184 / 240))
    assert set(v) == {n for n, _ in X.region_registry()}


def test_shapes_by_hand():
    g = np.full((10, 20), 250, np.uint8)
    g[2:6, 2:6], g[2:6, 10:18] = 0, 0  # areas 16 and 32
    v = X.region_features(g, (0, 0, 20, 10), (100, 100))
    assert v["shape.component_count"] == 2 and v["shape.component_area_median"] == pytest.approx(24 / 200)
    assert v["shape.component_aspect_median"] == pytest.approx((1 + 2) / 2) and v["shape.hole_count"] == 0
    assert X._shapes(np.eye(4, dtype=bool) & False) == {}
    dots = np.zeros((9, 9), bool)
    dots[1, 1] = dots[5, 5] = True  # components under three pixels don't count
    assert X._shapes(dots) == {}


def test_thin_crops_and_crops_without_foreground():
    for shape in ((1, 1), (1, 3), (5, 1)):
        v = X.region_features(np.arange(np.prod(shape), dtype=np.uint8).reshape(shape) * 40, (0, 0, *shape[::-1]), (10, 10))
        assert v["texture.glcm_contrast"] is None and v["texture.glcm_homogeneity"] is None
    flat = X.region_features(np.full((8, 8), 90, np.uint8), (0, 0, 8, 8), (10, 10))
    assert all(flat[n] is None for n in flat if n.startswith(("stroke.", "shape.")))
    assert (flat["texture.glcm_contrast"], flat["texture.glcm_homogeneity"]) == (0, 1)


def test_names_groups_and_formulas():
    rows = {r["name"]: r for r in X.feature_dictionary()}
    assert rows["layout.overlap_ratio"]["group"] == "spacing_alignment" and rows["shape.hole_count"]["group"] == "stroke_shape"
    assert rows["gradient.magnitude_p90.max"]["formula_id"] == "gradient-sobel-p90-v1" and rows["quality.no_detection"]["model_input"]
    assert {r["group"] for r in rows.values()} == {*X.GROUPS, "quality"} and len(rows) == 34 + 282


def test_tiny_and_empty_crops():
    v = X.region_features(np.zeros((2, 2), np.uint8), (0, 0, 2, 2), (10, 10))
    assert v["sharpness.laplacian_variance"] is None and v["gradient.orientation_entropy"] is None
    e = X.region_features(np.zeros((0, 0), np.uint8), (0, 0, 0, 0), (10, 10))
    assert e["contrast.gray_std"] is None and e["geometry.aspect_ratio"] is None


def test_shapes_and_distances():
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[3:6, 3:6] = False
    assert K.holes(ring) == 1 and K.holes(~ring) == 1
    square = np.ones((5, 5), bool)
    assert K.perimeter(K.contour(square)) == 16 and K.polygon_area(K.hull(K.contour(square))) == 16
    d = K.distance(np.pad(square, 1))
    assert d[3, 3] == pytest.approx(0.955 * 3, abs=1e-6) and d[0].max() == 0
    thin = K.skeleton(np.pad(np.ones((3, 20), bool), 2))
    assert 0 < thin.sum() <= 20
    assert K.otsu(np.array([[10] * 5 + [200] * 5], np.uint8)) in range(10, 200)
    rot = np.array([(0, 0), (10, 10), (5, 15), (-5, 5)], float)
    assert abs(K.min_area_angle(rot)) == pytest.approx(45)
    assert K.fill_polygons([np.array([(1, 1), (4, 1), (4, 3), (1, 3)])], 6, 6).sum() == 12


def test_lbp_and_glcm_of_flat_images():
    flat = np.full((6, 6), 80, np.uint8)
    con, hom = K.glcm(flat)
    assert (con, hom) == (0, 1)
    assert (K.lbp_uniform(flat)[2:-2, 2:-2] == 8).all()


def test_hashes():
    g = np.repeat(np.repeat(np.array([[0, 255], [255, 0]], np.uint8), 16, 0), 16, 1)
    assert K.average_hash(g).bit_count() == 32 and K.dct_hash(g) != K.dct_hash(255 - g)
    assert K.dct_hash(g) == K.dct_hash(g)


def test_localize_reasons():
    polys = [[(0, 0), (1, 0), (1, 1), (0, 1)], [(30, 30), (40, 30), (40, 40)], [], [("a", "b"), (1, 2), (3, 4)], [(0, 0), (float("nan"), 1), (2, 2)], [(-4, -3), (18, -3), (18, 12), (-4, 12)]]
    boxes, reasons = X.localize(polys, 20, 20)
    assert reasons == ["too_small", "empty_after_clipping", "malformed_polygon", "malformed_point", "malformed_point"]
    assert X.localize([None, 5, [(1, 1), (2,), (3, 3)], [(0, 0), (2.5, 0), (2.5, 2.5)], [(0, 0), (2, 0), (2, 9)]], 20, 20)[1] == ["malformed_polygon", "malformed_polygon", "malformed_point", "too_small"]
    assert boxes[0]["flags"] == ["clipped_geometry"] and (boxes[0]["x"], boxes[0]["w"], boxes[0]["h"]) == (0, 18, 12)


# --- sources and sinks --------------------------------------------------------------------------


def test_png_round_trip():
    img = np.random.default_rng(6).integers(0, 256, (13, 9, 3), dtype=np.uint8)
    assert np.array_equal(I.decode_png(I.encode_png(img)), img)
    with pytest.raises(ValueError, match="not a PNG"):
        I.decode_png(b"GIF89a")


def test_png_filters_and_alpha():
    import struct
    import zlib

    rng = np.random.default_rng(7)
    px = rng.integers(0, 256, (5, 4, 4), dtype=np.uint8)
    raw, prev = b"", np.zeros(16, int)
    for y, f in enumerate((0, 1, 2, 3, 4)):
        line = px[y].ravel().astype(int)
        left, corner = np.concatenate([np.zeros(4, int), line[:-4]]), np.concatenate([np.zeros(4, int), prev[:-4]])
        p = left + prev - corner
        a, b, c = abs(p - left), abs(p - prev), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, prev, corner))
        guess = (0 * line, left, prev, (left + prev) // 2, paeth)[f]
        raw += bytes([f]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        prev = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = I.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(I.decode_png(png, composite=False), px[..., :3])
    a = px[..., 3:] / 255
    assert np.array_equal(I.decode_png(png), np.rint(px[..., :3] * a + 255 * (1 - a)).astype(np.uint8))


def test_fixture_images_to_features(spark, tmp_path):
    img = I.fixtures(spark, 2).cache()
    long_ = X.extract(img, K.detect_dark)
    n = long_.groupBy("sample_id").agg(F.count_distinct("region_id").alias("regions")).collect()
    assert len(n) == 4 and all(3 <= r["regions"] <= 5 for r in n)
    bad = img.select("sample_id", "height", (F.col("width") + 1).alias("width"), "rgb")
    assert {r["status"] for r in X.extract(bad, K.detect_dark).collect()} == {"failed"}
    files = img.collect()
    for label in ("real", "fake"):
        os.makedirs(f"{tmp_path}/{label}")
    for r in files:
        with open(f"{tmp_path}/{'fake' if r['label'] == 'ai_generated' else 'real'}/{r['sample_id']}.png", "wb") as f:
            f.write(I.encode_png(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)))
    open(f"{tmp_path}/notes.json", "w").write("{}")
    scan = MF.class_folders(spark, str(tmp_path), {"non_ai_generated": "real", "ai_generated": "fake"})
    assert scan.count() == 4
    inside, skipped = MF.tree(spark, str(tmp_path), {"non_ai_generated": "real", "ai_generated": "fake"})
    assert inside.count() == 4 and [r["relative_path"] for r in skipped.collect()] == ["notes.json"]
    ras = I.rasters(scan.select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("long").alias("sample_id"), "content"))
    assert ras.filter("rgb is null").count() == 0
    assert K2.overlays(img, K.detect_dark).count() == 4


def manifest_row(**kw):
    row = dict.fromkeys(MF.COLUMNS, "v") | {"sample_id": "s1", "relative_path": "a.png", "label": "real", "category": "receipt", "width": "3", "height": "4", "format": "png", "sha256": "a" * 64, "split": "", "inclusion_status": "included", "exclusion_reason": ""}
    return row | kw


@pytest.mark.parametrize(("change", "what"), [({}, None), ({"relative_path": "../outside.png"}, "relative_path"), ({"label": "cat"}, "label"), ({"width": "0"}, "width"), ({"sha256": "zz"}, "sha256"), ({"inclusion_status": "review"}, "exclusion_reason"), ({"source_id": " "}, "source_id"), ({"split": "dev"}, "split")])
def test_manifest_validation(spark, tmp_path, change, what):
    with open(f"{tmp_path}/m.csv", "wb") as f:
        f.write(K2.csv_bytes([manifest_row(**change), manifest_row(sample_id="s2")]))
    if what is None:
        out = MF.load(spark, f"{tmp_path}/m.csv")
        assert out.columns == MF.COLUMNS and out.first()["label"] == "non_ai_generated"
        K2.write_manifest(out, f"{tmp_path}/out")
        assert MF.read_csv(spark, f"{tmp_path}/out").count() == 2
    else:
        with pytest.raises(ValueError, match=what):
            MF.load(spark, f"{tmp_path}/m.csv")


def test_checkpoint_and_predictions(spark, tmp_path):
    with open(f"{tmp_path}/c.jsonl", "w") as f:
        f.write('{"image_id": "a", "seq": 1, "v": 1}\nbroken\n{"image_id": "a", "seq": 2, "v": 2}\n{"image_id": "b", "seq": 3, "v": 3}\n')
    got = {r["image_id"]: r["v"] for r in MF.read_checkpoint(spark, f"{tmp_path}/c.jsonl", "image_id string, seq long, v int").collect()}
    assert got == {"a": 2, "b": 3}
    rows = [{"sample_id": "a", "true_label": 1, "score": "x", "predicted_label": 1, "threshold": 0.5, "region_count": 1, "no_detection": "false", "input_sha256": ""}]
    with open(f"{tmp_path}/p.csv", "wb") as f:
        f.write(K2.csv_bytes(rows))
    with pytest.raises(ValueError, match="invalid predictions"):
        MF.read_predictions(spark, f"{tmp_path}/p.csv")


def test_feature_scan(spark):
    df = spark.createDataFrame([("a", "REAL", 1.0, "x"), ("b", "ai_generated", 2.0, "y")], "sample_id string, label string, f double, split string")
    splits = spark.createDataFrame([("a", "train")], "sample_id string, split string")
    out, features = MF.read_features(spark, df, splits)
    assert features == ["f"] and {r["sample_id"]: (r["label"], r["split"]) for r in out.collect()} == {"a": (0, "train"), "b": (1, None)}
    with pytest.raises(ValueError, match="not features"):
        MF.read_features(spark, df.withColumn("relative_path_length", F.lit(1)), splits)
    with pytest.raises(ValueError, match="not numbers"):
        MF.read_features(spark, df.withColumn("g", F.lit("abc")), splits)
    with pytest.raises(ValueError, match="unique"):
        MF.read_features(spark, df.union(df), splits)


def test_run_catalog_and_zip(spark, tmp_path):
    for i, t in enumerate(("2026-01-01T00:00:00Z", "2026-03-01T00:00:00Z")):
        os.makedirs(f"{tmp_path}/r{i}")
        K2.run_manifest(f"{tmp_path}/r{i}/run_manifest.json", run_id=f"r{i}", started_at=t, config={}, counts={}, selected_model_id="m")
    runs = MF.run_catalog(spark, str(tmp_path), "m").collect()
    assert len(runs) == 2
    assert K2.zip_folder(str(tmp_path), f"{tmp_path}.zip") == ["r0/run_manifest.json", "r1/run_manifest.json"]
    assert K2.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'


# --- models ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(72):
        y = i % 2
        s = y * 2 + rng.normal(0, 0.5)
        rows.append((f"s{i}", y, "train" if i < 40 else "validation" if i < 52 else "test", float(s), float(s + rng.normal(0, 0.05)), None if i % 7 == 0 else float(rng.normal())))
    return spark.createDataFrame(rows, "sample_id string, label int, split string, `geometry.signal` double, `texture.correlated` double, noise double").cache()


FEATURES = ["geometry.signal", "texture.correlated", "noise"]


def test_imputer_and_scaler(spark, frame):
    m = M.MedianImputer(["noise"]).fit(frame)
    want = np.median([r["noise"] for r in frame.collect() if r["noise"] is not None])
    assert m.medians["noise"] == pytest.approx(want) and m.indicators == ["missing_noise"]
    none = M.MedianImputer(["x"]).fit(frame.withColumn("x", F.lit(None).cast("double")))
    assert none.medians == {"x": 0.0}


def test_selection_package_and_explanation(spark, frame, tmp_path):
    part = lambda s: frame.filter(F.col("split") == s)
    grid = [M.candidate("lr", {"C": 1.0}, FEATURES), M.candidate("svm_linear", {"C": 1.0}, FEATURES), M.candidate("rf", {"trees": 5, "depth": 4, "leaf": 1}, FEATURES), M.candidate("odd", {}, FEATURES)]
    model, rows = M.select_model(part("train"), part("validation"), "label", grid)
    assert [r["status"] for r in rows] == ["completed"] * 3 + ["failed"]
    assert M.evaluate(model, part("test"), "label", model.threshold)["f1"] > 0.8
    M.save_package(model, str(tmp_path / "p"))
    back = M.load_package(str(tmp_path / "p"), FEATURES)
    a = {r["sample_id"]: r["model_score"] for r in model.score(part("test")).collect()}
    b = {r["sample_id"]: r["model_score"] for r in back.score(part("test")).collect()}
    assert a == pytest.approx(b)
    with pytest.raises(ValueError, match="schema"):
        M.load_package(str(tmp_path / "p"), FEATURES[:1])
    lr = grid[0].fit(part("train"), "label")
    sums = {r["sample_id"]: r["m"] for r in M.explain(lr, part("test"), "sample_id").groupBy("sample_id").agg(F.sum("contribution").alias("m")).collect()}
    for r in lr.score(part("test")).collect():
        assert 1 / (1 + np.exp(-(sums[r["sample_id"]] + lr.model.intercept))) == pytest.approx(r["model_score"], abs=1e-8)
    files = [p for p in (tmp_path / "p" / "model").rglob("*.parquet")] or list((tmp_path / "p" / "model").rglob("part-*"))
    files[0].write_bytes(b"tampered")
    with pytest.raises(ValueError, match="hashes"):
        M.load_package(str(tmp_path / "p"))


def test_grid_and_ablation(frame):
    assert len(M.candidate_grid(FEATURES)) == 27
    part = lambda s: frame.filter(F.col("split") == s)
    rows = M.ablation(part("train"), part("validation"), part("test"), "label", M.candidate("lr", {"C": 1.0}, FEATURES), {"signal": ["geometry.signal"], "none": ["absent"]}, ["noise"])
    assert rows[0]["status"] == "completed" and rows[0]["feature_count"] == 2 and rows[1]["status"] == "unavailable"


def test_permutation(frame):
    out = {r["feature"]: r for r in M.permutation_linear(frame, "sample_id", "label", {"geometry.signal": 3.0, "noise": 0.0}, -3.0, 0.0, repeats=4).collect()}
    assert out["geometry.signal"]["mean_abs_score_change"] >= 0 and out["noise"]["f1_drop_mean"] == 0


# --- streaming ---------------------------------------------------------------------------------------


def test_stream_upsert_and_windows(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "sample_id long, v int"
    spark.createDataFrame([(1, 1), (2, 2), (2, 2)], schema).write.parquet(src)
    go = lambda: ingest.upsert_batches(spark.readStream.schema(schema).parquet(src), lambda d: d.withColumn("w", F.col("v") * 2), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    go()
    spark.createDataFrame([(2, 9), (3, 3)], schema).write.mode("append").parquet(src)
    go()
    got = sorted((r["sample_id"], r["w"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 2), (2, 4), (3, 6)]
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = ingest.windowed_counts(e, "ts", "event_type", "value")
    assert out.agg(F.sum("n")).first()[0] == e.count()


# --- command line ---------------------------------------------------------------------------------------


def test_extract_train_evaluate_predict(spark, tmp_path):
    from pixelmill import cli

    root = f"{tmp_path}/data"
    for label in ("real", "fake"):
        os.makedirs(f"{root}/{label}")
    rows = I.fixtures(spark, 10).collect()
    for r in rows:
        with open(f"{root}/{'fake' if r['label'] == 'ai_generated' else 'real'}/{r['sample_id']}.png", "wb") as f:
            f.write(I.encode_png(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)))
    config = f"{tmp_path}/c.json"
    K2.write_json(config, {"groups": ["geometry_density", "contrast_sharpness"], "candidates": "lr"})
    go = lambda *a: cli.main([*a, "--config", config], spark)
    assert go("extract-features", "--root", root, "--real", "real", "--ai", "fake", "--out", f"{tmp_path}/f") == 0
    wide = spark.read.parquet(f"{tmp_path}/f/image_features")
    assert wide.count() == 20 and len(wide.columns) == 4 + (7 + 5) * 8 + 3 + 1
    split = F.when(F.pmod("sample_id", F.lit(3)) == 0, "validation").when(F.pmod("sample_id", F.lit(3)) == 1, "test").otherwise("train")
    wide.select("sample_id", split.alias("split")).write.option("header", True).csv(f"{tmp_path}/s")
    assert go("train", "--features", f"{tmp_path}/f", "--splits", f"{tmp_path}/s", "--out", f"{tmp_path}/m") == 0
    assert go("evaluate", "--features", f"{tmp_path}/f", "--splits", f"{tmp_path}/s", "--model", f"{tmp_path}/m", "--out", f"{tmp_path}/e") == 0
    assert go("predict", "--image", f"{root}/real/0.png", "--model", f"{tmp_path}/m", "--out", f"{tmp_path}/p") == 0
    assert go("predict", "--image", f"{root}/absent.png", "--model", f"{tmp_path}/m", "--out", f"{tmp_path}/q") == 2
    assert json.load(open(f"{tmp_path}/q/run_manifest.json"))["status"] == "failed"


def test_extract_gives_every_column_and_failed_rows(spark, tmp_path):
    from pixelmill import cli

    root = f"{tmp_path}/data"
    for label in ("real", "fake"):
        os.makedirs(f"{root}/{label}")
    for k, r in enumerate(I.fixtures(spark, 1).collect()):
        with open(f"{root}/real/{k}.png", "wb") as f:
            f.write(I.encode_png(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)))
    open(f"{root}/fake/blank.png", "wb").write(I.encode_png(np.full((40, 30, 3), 255, np.uint8)))
    open(f"{root}/fake/bad.png", "wb").write(b"broken")
    assert cli.main(["extract-features", "--root", root, "--real", "real", "--ai", "fake", "--out", f"{tmp_path}/f"], spark) == 0
    wide = spark.read.parquet(f"{tmp_path}/f/image_features")
    names = json.load(open(f"{tmp_path}/f/feature_schema.json"))["model_columns"]
    assert len(names) == 282 and wide.columns == ["sample_id", "label", "processing_status", "processing_error", *names]
    rows = wide.collect()
    status = sorted(r["processing_status"] for r in rows)
    assert status == ["failed", "no_detection", *["ok"] * (len(rows) - 2)]
    for r in rows:
        if r["processing_status"] == "failed":
            assert r["processing_error"] and all(r[n] is None for n in names) and r["label"] == "ai_generated"
        elif r["processing_status"] == "no_detection":
            assert r["quality.no_detection"] == 1 and (r["density.region_count"], r["density.union_coverage"]) == (0, 0) and r["layout.overlap_ratio"] is None
        else:
            assert r["quality.no_detection"] == 0 and r["density.region_count"] >= 1 and 0 < r["density.union_coverage"] <= 1 and r["layout.overlap_ratio"] is not None
    with pytest.raises(ValueError, match="failed rows"):
        MF.read_features(spark, wide, wide.select("sample_id", F.lit("train").alias("split")))


def test_normalized_geometry(spark):
    df = spark.sql("select 10 x, 20 y, 30 w, 5 h, 40 iw, 50 ih, array(named_struct('x', 10.0D, 'y', 25.0D)) p")
    got = df.select(S.normalized_box(*(F.col(c) for c in ("x", "y", "w", "h", "iw", "ih"))).alias("b"), S.normalized_polygon(F.col("p"), F.col("iw"), F.col("ih")).alias("p")).first()
    assert tuple(got["b"]) == (0.25, 0.4, 0.75, 0.1) and [tuple(q) for q in got["p"]] == [(0.25, 0.5)]


def test_confusion_and_ablation_scans(spark, tmp_path):
    def put(name, text):
        open(f"{tmp_path}/{name}", "w").write(text)
        return f"file://{tmp_path}/{name}"

    assert MF.read_confusion(spark, put("c.csv", "tn,fp,fn,tp\n5,0,1,7\n")) == {"tn": 5, "fp": 0, "fn": 1, "tp": 7}
    for text, why in (("tn,fp,fn\n1,2,3\n", "shape"), ("tn,fp,fn,tp\n1,2,3,4\n1,2,3,4\n", "shape"), ("tn,fp,fn,tp\n1,2,x,4\n", "integer"), ("tn,fp,fn,tp\n1,2,1.5,4\n", "integer"), ("tn,fp,fn,tp\n1,-2,3,4\n", "negative")):
        with pytest.raises(ValueError, match=why):
            MF.read_confusion(spark, put("c.csv", text))
    head = "feature_group,feature_count,status,test_f1,test_tp\n"
    rows = MF.read_ablation(spark, put("a.csv", head + "texture,41,completed,0.96,120\nshape,0,unavailable,,\n")).orderBy("feature_group").collect()
    assert [(r["feature_group"], r["feature_count"], r["test_f1"], r["test_tp"]) for r in rows] == [("shape", 0, None, None), ("texture", 41, 0.96, 120)]
    for text, why in (("feature_group,status\na,completed\n", "required"), (head + "a,1,completed,,\na,1,completed,,\n", "repeats"), (head + "a,1,odd,,\n", "invalid"), (head + "a,1,completed,abc,\n", "finite"), (head + "a,1,completed,NaN,\n", "finite")):
        with pytest.raises(ValueError, match=why):
            MF.read_ablation(spark, put("a.csv", text))


def test_running_totals_and_ranks_by_group(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), float(np.round(rng.normal(), 1)) if rng.random() > 0.05 else None) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = E.average_ranks(df, "v", ["g"]).collect()
    assert len(got) == 400
    for r in got:
        own = [v for g, v in rows if g == r["g"] and v is not None]
        want = None if r["v"] is None else sum(v < r["v"] for v in own) + (sum(v == r["v"] for v in own) + 1) / 2
        assert r["rank"] == want


def test_blocked_columns_and_manifest_case(spark):
    wide = spark.createDataFrame([(1, "ai_generated", 1.0)], "sample_id long, label string, ocr_len double")
    with pytest.raises(ValueError, match="not features"):
        MF.read_features(spark, wide, wide.select("sample_id", F.lit("train").alias("split")))
    row = {c: "x" for c in MF.COLUMNS} | {"relative_path": "a/b.png", "label": "ai_generated", "category": "Receipt", "inclusion_status": "Included", "width": "3", "height": "4", "format": "png", "sha256": "A" * 64, "split": ""}
    got = MF.with_violations(spark.createDataFrame([tuple(row.values())], list(row))).first()
    assert got["violations"] == [] and (got["category"], got["inclusion_status"]) == ("receipt", "included")


def test_best_fold_by_definition(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 5)), rng.choice(["a", "b"], p=[0.8, 0.2]).item()) for _ in range(90)]
    per = {x: sum(lab == x for _, lab in rows) for x in "ab"}
    loss = {
        f: abs(sum(g == f for g, _ in rows) / 90 - 0.2) + sum(abs(sum((g, lab) == (f, x) for g, lab in rows) / per[x] - 0.2) for x in per) for f in range(5)
    }
    got = SP.best_fold(spark.createDataFrame(rows, "f int, label string"), "f", "label", 0.2).first()
    want = min(loss, key=lambda f: (round(loss[f], 12), f))
    assert (got["fold"], got["n"]) == (want, sum(g == want for g, _ in rows)) and got["loss"] == pytest.approx(loss[want])


# --- preparation and reviews ------------------------------------------------------------------------------


def test_prepare_dataset(spark, tmp_path):
    from pixelmill.sources import prepare as PR

    rng = np.random.default_rng(9)
    root = f"{tmp_path}/dataset"
    for d, names in (("0_real", ["same.png", "two.png", "copy.png"]), ("1_fake", ["same.png", "two.png", "bad.png"])):
        os.makedirs(f"{root}/{d}")
        for n in names:
            smooth = K.resize_lanczos(rng.integers(0, 256, (6, 4, 3), dtype=np.uint8), 60, 40)
            open(f"{root}/{d}/{n}", "wb").write(b"broken" if n == "bad.png" else I.encode_png(smooth))
    open(f"{root}/0_real/copy.png", "wb").write(open(f"{root}/0_real/two.png", "rb").read())
    open(f"{root}/notes.json", "w").write("{}")
    got = PR.prepare(spark, root, {"non_ai_generated": "0_real", "ai_generated": "1_fake"}, f"{tmp_path}/out", width=32, height=48)
    assert got == {"files": 6, "skipped": 1, "decode_failures": 1, "included": 2, "excluded": 2, "review": 1}
    m = MF.load(spark, f"{tmp_path}/out/manifest")
    assert m.filter("inclusion_status = 'included'").select("label").distinct().count() == 2
    img = spark.read.parquet(f"{tmp_path}/out/images").collect()
    assert len(img) == 2 and all(I.decode_png(r["png"]).shape == (48, 32, 3) for r in img)
    inv = {r["path"].rsplit("/", 1)[1]: r for r in PR.inventory(MF.class_folders(spark, root, {"ai_generated": "1_fake"})).collect()}
    assert (inv["same.png"]["format"], inv["same.png"]["width"], inv["same.png"]["height"], inv["same.png"]["aspect"]) == ("PNG", 40, 60, 0.666667)
    assert inv["bad.png"]["status"] == "unreadable"


def test_headers_of_other_formats():
    from pixelmill.sources.prepare import image_header

    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x78\x00\x50\x03" + b"\x00" * 20
    assert image_header(jpeg) == ("JPEG", "RGB", 80, 120)
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00\x00\x00\x00\x00" + (79).to_bytes(3, "little") + (119).to_bytes(3, "little")
    assert image_header(webp) == ("WEBP", "RGB", 80, 120)
    assert image_header(b"") == (None, None, None, None)


def test_reviews_and_summaries(spark):
    from pixelmill.operators import review as RV

    p = spark.createDataFrame([("a", 1, 0, 0.1, "a" * 64), ("b", 0, 0, 0.2, "b" * 64), ("c", 0, 1, 0.9, "c" * 64)], "sample_id string, true_label int, predicted_label int, score double, input_sha256 string")
    r = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("b", 0, 1)], "sample_id string, true_label int, predicted_label int")
    assert {tuple(x) for x in RV.review_mismatches(p, r).collect()} == {("a", "listed twice"), ("b", "not an error"), ("c", "not listed")}
    ab = spark.createDataFrame([("all_enabled", 0.9, 0.8), ("texture", 0.8, 0.6)], "feature_group string, test_f1 double, test_accuracy double")
    assert {x["feature_group"]: round(x["delta_f1"], 6) for x in RV.group_summary(ab).collect()} == {"all_enabled": 0.0, "texture": -0.1}
    assert RV.reuse_checksums(p.withColumn("input_sha256", F.lit("")), p).filter("sample_id = 'b'").first()["input_sha256"] == "b" * 64
    with pytest.raises(ValueError, match="runs differ"):
        RV.reuse_checksums(p, p.filter("sample_id <> 'a'"))


def test_clahe_and_lanczos():
    g = np.tile(np.arange(100, 140, dtype=np.uint8), (40, 1))
    out = K.clahe(g)
    assert out.shape == g.shape and out.std() > g.std()
    assert np.array_equal(K.resize_lanczos(g, 40, 40), g) and K.resize_lanczos(np.full((9, 7), 50, np.uint8), 20, 31).tolist() == [[50] * 31] * 20
    assert K.restore(np.array([(4, 4), (16, 12)]), 2, 2).tolist() == [[2, 2], [8, 6]]
