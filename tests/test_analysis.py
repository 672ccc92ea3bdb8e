"""Gates, policies, geometry of other detectors, feature analysis."""

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import evaluation, features, gates
from pixelmill.operators import models as M
from pixelmill.sources import analysis, geometry

NAMES = ["geometry.signal", "texture.correlated", "noise"]
GROUPS = dict(zip(NAMES, ("geometry", "texture", "texture"), strict=True))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(90):
        y = i % 2
        s = y * 2 + rng.normal(0, 0.4)
        out.append((f"s{i}", y, "train" if i < 60 else "test", float(s), float(s * 2 + rng.normal(0, 0.1)), None if i % 8 == 0 else float(rng.normal())))
    return spark.createDataFrame(out, "sample_id string, label int, split string, `geometry.signal` double, `texture.correlated` double, noise double").cache()


def test_resume_only_with_the_same_settings(tmp_path):
    config = {"detector": {"min_size": 20, "gpu": False}, "seed": 1}
    own = gates.start_or_resume(str(tmp_path), config, resume=True)
    assert gates.start_or_resume(str(tmp_path), {"detector": {"min_size": 20, "gpu": True}, "seed": 1}, resume=True) == own
    with pytest.raises(ValueError, match="another configuration"):
        gates.start_or_resume(str(tmp_path), config | {"seed": 2}, resume=True)
    gates.start_or_resume(str(tmp_path), config | {"seed": 2}, resume=False)


def test_package_and_report_gates():
    config = {"detector": {"min_size": 20}, "features": {"pad": 0.05}}
    package = {"state": {"features": ["a", "b"]}, "model_id": "m", "threshold": 0.5, **gates.package_hashes(config)}
    gates.check_package(package, config, ["a", "b", "c"])
    with pytest.raises(ValueError, match="features_config_sha256"):
        gates.check_package(package, config | {"features": {}})
    with pytest.raises(ValueError, match=r"missing: \['b'\]"):
        gates.check_package(package, config, ["a"])
    run = {"status": "completed", "model_id": "m", "threshold": 0.5 + 1e-13, "detector_config_sha256": package["detector_config_sha256"]}
    gates.check_report(run, package)
    for bad in ({"status": "failed"}, {"threshold": 0.6}, {"threshold": None}, {"model_id": "n"}):
        with pytest.raises(ValueError):
            gates.check_report(run | bad, package)


def test_artifact_policy_and_summary(spark, tmp_path):
    images = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, None)], "sample_id long, processing_status string")
    assert [sorted(r[0] for r in gates.kept_by_policy(images, p).collect()) for p in gates.POLICIES] == [[1, 2, 3], [2, 3], []]
    with pytest.raises(ValueError):
        gates.kept_by_policy(images, "some")
    long_ = spark.createDataFrame([(1, "r0", "w", "ok"), (1, "r0", "glcm", "unavailable"), (1, "r1", "w", "ok")], "sample_id long, region_id string, feature string, status string")
    lines = {r["sample_id"]: r["line"] for r in gates.summary_lines(images, long_).collect()}
    assert lines == {1: "sample_id=1 status=ok regions=2 failed_features=glcm", 2: "sample_id=2 status=failed regions=0 failed_features=", 3: "sample_id=3 status= regions=0 failed_features="}
    for name in ("a", "b"):
        gates.configure_logging(f"{tmp_path}/{name}.log").info(lines[1])
    assert (tmp_path / "a.log").read_text().count("\n") == (tmp_path / "b.log").read_text().count("\n") == 1
    gates.configure_logging()
    assert [type(h) for h in gates.LOG.handlers] == [logging.StreamHandler]


def test_nested_geometry():
    square = [(1.0, 2.0), (5.0, 2.0), (5.0, 4.0), (1.0, 4.0)]
    assert geometry.polygons_of([[[1, 5, 2, 4]]]) == geometry.polygons_of([1, 5, 2, 4]) == geometry.polygons_of(np.array([[1, 5, 2, 4]])) == [square]
    assert geometry.polygons_of([], [[[[0, 0], [4, 0], [2, 3]], "x", [[1, 1]]]]) == [[(0.0, 0.0), (4.0, 0.0), (2.0, 3.0)]]
    assert geometry.polygons_of(None, None) == [] and geometry.polygons_of([[[1, 5, 2, 4], [0, 9, 0, 9]], []])[1][1] == (9.0, 0.0)


def test_regions_from_a_table(spark):
    rgb = np.random.default_rng(1).integers(0, 255, (40, 60, 3), dtype=np.uint8)
    images = spark.createDataFrame([(i, 40, 60, bytearray(rgb.tobytes())) for i in (1, 2)], "sample_id long, height int, width int, rgb binary")
    boxes = spark.createDataFrame([(1, [[2.0, 3.0], [22.0, 3.0], [22.0, 13.0], [2.0, 13.0]]), (1, None)], "sample_id long, polygon array<array<double>>")
    given = geometry.with_polygons(images, boxes)
    out = features.extract(given, None).collect()
    assert {(r["sample_id"], r["x"], r["y"], r["w"], r["h"]) for r in out if r["status"] == "region"} == {(1, 2, 3, 20, 10)}
    same = features.extract(images.filter("sample_id = 1"), lambda g: [[(2, 3), (22, 3), (22, 13), (2, 13)]]).collect()
    assert sorted(map(str, out)) == sorted(map(str, same))


def test_permutation_of_any_model(rows):
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    model = M.candidate("rf", {"trees": 10, "depth": 4, "leaf": 1}, NAMES).fit(train, "label")
    out = {r["feature"]: r for r in M.permutation_any(model, test, "sample_id", "label", repeats=3, strata=1)}
    assert set(out) == set(NAMES)
    assert max(out["geometry.signal"]["mean_abs_score_change"], out["texture.correlated"]["mean_abs_score_change"]) > 0.05
    assert all(abs(r["accuracy_drop_mean"]) <= 1 and r["f1_drop_std"] >= 0 for r in out.values())


def test_analysis_files(spark, rows, tmp_path):
    dev, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    permuted = [r.asDict() for r in M.permutation_linear(test, "sample_id", "label", {"geometry.signal": 3.0, "texture.correlated": 0.0, "noise": 0.0}, -3.0, 0.0, repeats=3).collect()]
    ablation = spark.createDataFrame([("all_enabled", "completed", 0.9, 0.8), ("texture", "completed", 0.7, 0.6), ("x", "unavailable", None, None)], "feature_group string, status string, test_f1 double, test_accuracy double")
    report = analysis.summarize(test, dev, "label", GROUPS, permuted, ablation)
    first = report["feature_influence"][0]
    pairs = [(r["feature_a"], r["feature_b"]) for r in report["feature_redundancy"]]
    assert first["cliffs_delta_ai_vs_non_ai"] > 0.8 and pairs == [("geometry.signal", "texture.correlated")]
    y1 = sorted(r[0] for r in test.filter("label = 1").select(F.col("`geometry.signal`")).collect())
    by = {r["feature"]: r for r in report["feature_influence"]}
    assert by["geometry.signal"]["ai_median"] == pytest.approx(np.median(y1)) and by["noise"]["non_ai_missing_rate"] > 0
    paths = analysis.write_analysis(report, f"{tmp_path}/a")
    assert len(paths) == 4 and json.load(open(paths[0]))["feature_redundancy"][0]["group_b"] == "texture"
    assert "texture: test F1 0.7000, against all -0.2000" in analysis.text(report) and "- x" not in analysis.text(report)
    assert analysis.study_wording({"Fixture"})[0] != analysis.study_wording({"fixture", "camera"})[0] == analysis.study_wording(set())[0]


@pytest.mark.parametrize("family", ["lr", "svm_linear", "rf"])
def test_local_explanation(rows, family):
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    params = {"trees": 5, "depth": 3, "leaf": 1} if family == "rf" else {"C": 1.0}
    model = M.candidate(family, params, NAMES).fit(train, "label")
    out = M.local_explanation(model, test, "sample_id", 1).collect()
    assert len(out) == test.count()
    if family == "rf":
        assert all(r["status"] == "global_only" and r["total"] is None and 0 <= r["model_score"] <= 1 for r in out)
        return
    parts = {}
    for r in M.explain(model, test, "sample_id").collect():
        own = parts.setdefault(r["sample_id"], dict.fromkeys(NAMES, 0.0))
        own[r["feature"]] += r["contribution"]
    for r in out:
        own = parts[r["sample_id"]]
        assert r["status"] == "available" and r["total"] == pytest.approx(sum(own.values()))
        up = sorted(((v, f) for f, v in own.items() if v > 0), key=lambda x: (-x[0], x[1]))[:1]
        down = sorted((v, f) for f, v in own.items() if v < 0)[:1]
        assert [x["feature"] for x in r["positive"]] == [f for _, f in up] and [x["feature"] for x in r["negative"]] == [f for _, f in down]
        assert r["rest"] == pytest.approx(sum(own.values()) - sum(v for v, _ in up + down), abs=1e-12)


def test_quantiles_against_percentile(spark):
    rng = np.random.default_rng(3)
    data = [(None if i % 3 == 0 else i % 3, None if i % 11 == 0 else float(rng.integers(0, 40)) if i % 2 else float(rng.normal())) for i in range(600)] + [(7, None), (8, 1.5)]
    df = spark.createDataFrame(data, "g int, v double")
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = {r[0]: r[1:] for r in evaluation.quantiles(df, "v", ["g"], shares).collect()}
    assert set(got) == {None, 1, 2, 8}
    for g, q in got.items():
        assert q == pytest.approx(np.percentile([v for k, v in data if k == g and v is not None], [100 * p for p in shares]))
    assert evaluation.quantiles(df, "v", [], [0.5]).first()[0] == pytest.approx(np.median([v for _, v in data if v is not None]))
    assert evaluation.quantiles(df.filter("false"), "v", [], [0.5]).first() is None
