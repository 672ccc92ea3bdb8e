"""Command line: prepare, validate, split, extract, train, evaluate, predict."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions.kernels import detect_dark
from pixelmill.operators import dedup, features, gates, models, regions, splits
from pixelmill.sources import images, manifest, prepare, sinks

DEFAULTS = {"seed": 42, "width": 1024, "height": 1536, "near_distance": 4, "groups": features.GROUPS, "candidates": "full"}


def merged(base: dict, over: dict) -> dict:
    """Deep merge of a configuration over its defaults."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | None) -> dict:
    if not path:
        return dict(DEFAULTS)
    with open(path) as f:
        return merged(DEFAULTS, json.load(f))


def wide_features(long_: DataFrame, samples: DataFrame, groups: list[str]) -> DataFrame:
    """One row per sample with processing_status, processing_error and the model columns; failed samples have no values."""
    names = [n for n, _ in features.region_registry(groups)]
    boxes = long_.filter("status = 'region'").select("sample_id", "x", "y", "w", "h", "iw", "ih")
    failed = long_.filter("status = 'failed'").groupBy("sample_id").agg(F.min("reason").alias("processing_error"))
    out = samples.join(failed, "sample_id", "left").join(regions.image_level(boxes), "sample_id", "left")
    if names:
        ok = long_.filter("status = 'ok'").select("sample_id", "feature", "value")
        out = out.join(regions.wide_row(regions.aggregate_long(ok), names), "sample_id", "left")
    lives = F.col("processing_error").isNull()
    none = F.col("`density.region_count`").isNull()
    out = out.withColumn(features.INDICATOR, F.when(lives, none.cast("double")))
    density = [n for n in features.image_features(groups) if n.startswith("density.")]
    out = out.withColumns({n: F.when(lives, F.coalesce(F.col(f"`{n}`"), F.lit(0.0))) for n in density})
    status = F.when(~lives, "failed").when(F.col(f"`{features.INDICATOR}`") == 1, "no_detection").otherwise("ok")
    return out.select(*samples.columns, status.alias("processing_status"), "processing_error", *(F.col(f"`{c}`") for c in features.model_columns(groups)))


def cmd_prepare(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    return prepare.prepare(spark, a.root, {"non_ai_generated": a.real, "ai_generated": a.ai}, a.out, seed=config["seed"], width=config["width"], height=config["height"])


def cmd_validate(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    m = manifest.load(spark, a.manifest).cache()
    dups = dedup.duplicate_groups(m, "sha256", "sample_id")
    dedup.check_leakage(m, {"sha256": "exact duplicate", "group_id": "group"})
    return {"rows": m.count(), "duplicate_groups": dups.count()}


def cmd_split(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    m = manifest.load(spark, a.manifest).filter("inclusion_status = 'included'")
    out = splits.group_split(m.drop("split"), "group_id", "label", config["seed"], sha="sha256")
    sinks.write_manifest(out, f"{a.out}/splits")
    return {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}


def cmd_extract(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    """Features of the PNG files of two label folders."""
    files = manifest.class_folders(spark, a.root, {"non_ai_generated": a.real, "ai_generated": a.ai})
    files = files.withColumn("sample_id", F.xxhash64("sha256"))
    files = files.dropDuplicates(["sample_id"])
    long_ = features.extract(images.rasters(files), detect_dark, config["groups"])
    wide = wide_features(long_, files.select("sample_id", "label"), config["groups"])
    sinks.write_features(long_, wide, a.out)
    sinks.write_json(f"{a.out}/feature_schema.json", json.loads(features.schema_json(config["groups"])))
    status = {r["processing_status"]: r["count"] for r in spark.read.parquet(f"{a.out}/image_features").groupBy("processing_status").count().collect()}
    return {"files": sum(status.values()), "failed": status.get("failed", 0), "no_detection": status.get("no_detection", 0)}


def cmd_train(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    data, names = manifest.read_features(spark, spark.read.parquet(f"{a.features}/image_features"), spark.read.option("header", True).csv(a.splits))
    data = data.cache()
    grid = models.candidate_grid(names, config["seed"])
    grid = grid if config["candidates"] == "full" else [c for c in grid if c.family == config["candidates"]]
    model, rows = models.select_model(data.filter("split = 'train'"), data.filter("split = 'validation'"), "label", grid)
    os.makedirs(a.out, exist_ok=True)
    models.save_package(model, f"{a.out}/package", gates.package_hashes(config))
    sinks.write_json(f"{a.out}/comparison.json", rows)
    return {"selected": model.family, "threshold": model.threshold}


def cmd_evaluate(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    model = models.load_package(f"{a.model}/package")
    data, _ = manifest.read_features(spark, spark.read.parquet(f"{a.features}/image_features"), spark.read.option("header", True).csv(a.splits))
    return models.evaluate(model, data.filter("split = 'test'"), "label", model.threshold)


def cmd_predict(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    """Score and explain one PNG file with a package that was trained with the same settings."""
    model = models.load_package(f"{a.model}/package")
    gates.check_package(models.read_manifest(f"{a.model}/package"), config, features.model_columns(config["groups"]))
    with open(a.image, "rb") as f:
        content = f.read()
    files = spark.createDataFrame([(0, bytearray(content))], "sample_id long, content binary")
    long_ = features.extract(images.rasters(files), detect_dark, config["groups"])
    wide = wide_features(long_, files.select("sample_id"), config["groups"])
    failed = wide.filter("processing_status = 'failed'").first()
    if failed:
        raise ValueError(f"image cannot be measured: {failed['processing_error']}")
    row = models.local_explanation(model, wide, "sample_id").first().asDict(recursive=True)
    score = row.pop("model_score")
    label = "ai_generated" if score >= model.threshold else "non_ai_generated"
    return {"score": score, "label": label, "threshold": model.threshold, "explanation": {k: v for k, v in row.items() if k != "sample_id"}}


COMMANDS = {
    "prepare-dataset": (cmd_prepare, ["root", "real", "ai"]),
    "validate-data": (cmd_validate, ["manifest"]), "create-splits": (cmd_split, ["manifest"]), "extract-features": (cmd_extract, ["root", "real", "ai"]),
    "train": (cmd_train, ["features", "splits"]), "evaluate": (cmd_evaluate, ["features", "splits", "model"]), "predict": (cmd_predict, ["image", "model"]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pixelmill")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, needs) in COMMANDS.items():
        p = sub.add_parser(name)
        for n in needs:
            p.add_argument(f"--{n}", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--config")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("pixelmill").getOrCreate()
    config, started = load_config(a.config), sinks.now_utc()
    os.makedirs(a.out, exist_ok=True)
    try:
        result, status = COMMANDS[a.command][0](spark, a, config), "completed"
    except Exception as e:
        result, status = {"error": str(e)[:500]}, "failed"
    run_id = f"{a.command}-{started}"
    sinks.run_manifest(f"{a.out}/run_manifest.json", run_id=run_id, started_at=started, config=config, counts=result, status=status)
    print(json.dumps({"run_id": run_id, "status": status, "result": result}))
    return 0 if status == "completed" else 2


if __name__ == "__main__":
    sys.exit(main())
