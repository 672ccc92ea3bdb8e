"""Gates on configurations and packages, artifact policies, one-line summaries."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.sources.sinks import sha256_json, write_json

LOG = logging.getLogger("pixelmill")
RUN_ONLY = ("languages", "gpu", "mode")  # settings of the detector that change no measured value
POLICIES = ("all", "failures", "none")


def fingerprint(config: dict) -> str:
    """Hash of the settings that change results."""
    detector = config.get("detector")
    if isinstance(detector, dict):
        config = config | {"detector": {k: v for k, v in detector.items() if k not in RUN_ONLY}}
    return sha256_json(config)


def start_or_resume(folder: str, config: dict, resume: bool) -> str:
    """Record the configuration of a run in ``folder``; resuming with another one is an error."""
    path, own = f"{folder}/run_metadata.json", fingerprint(config)
    if resume and os.path.exists(path):
        with open(path) as f:
            before = json.load(f).get("config_fingerprint")
        if before != own:
            raise ValueError(f"{folder} was made with another configuration")
    os.makedirs(folder, exist_ok=True)
    write_json(path, {"config_fingerprint": own, "config": config})
    return own


def package_hashes(config: dict) -> dict[str, str]:
    """What a package states about the configuration it was trained with."""
    return {f"{part}_config_sha256": sha256_json(config.get(part, {})) for part in ("detector", "features")}


def check_package(manifest: dict, config: dict, columns: list[str] | None = None) -> None:
    """Raise if a package was trained with other detector or feature settings, or needs columns that aren't there."""
    wrong = [k for k, v in package_hashes(config).items() if manifest.get(k) and manifest[k] != v]
    if wrong:
        raise ValueError(f"package and configuration differ: {wrong}")
    absent = [c for c in manifest["state"]["features"] if columns is not None and c not in columns]
    if absent:
        raise ValueError(f"columns of the package are missing: {absent[:5]}")


def check_report(run: dict, manifest: dict) -> None:
    """Raise unless a finished run and a package name the same model, schema, splits, detector and threshold."""
    if run.get("status") != "completed":
        raise ValueError("the run is not completed")
    pairs = {k: (run.get(k), manifest.get(k)) for k in ("model_id", "feature_schema_sha256", "split_manifest_sha256", "detector_config_sha256")}
    wrong = [k for k, (a, b) in pairs.items() if a != b]
    a, b = run.get("threshold"), manifest.get("threshold")
    if a is None or b is None or abs(a - b) > max(1e-9 * max(abs(a), abs(b)), 1e-12):
        wrong.append("threshold")
    if wrong:
        raise ValueError(f"run and package differ: {wrong}")


def kept_by_policy(images: DataFrame, policy: str, status: str = "processing_status") -> DataFrame:
    """The images whose artifacts are kept: all, failures (any status but ok, null too) or none."""
    if policy not in POLICIES:
        raise ValueError(f"policy has to be one of {POLICIES}")
    return images if policy == "all" else images.filter(F.lit(policy == "failures") & ~F.coalesce(F.col(status) == "ok", F.lit(False)))


def summary_lines(images: DataFrame, long_: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, line): status, regions and failed features of every image in one line."""
    per = long_.groupBy(key).agg(
        F.count_distinct("region_id").alias("regions"), F.array_sort(F.collect_set(F.when(~F.col("status").isin("ok", "region", "failed"), F.col("feature")))).alias("bad")
    )  # bounded by the feature names
    parts = {key: F.col(key).cast("string"), "status": F.col("processing_status"), "regions": F.coalesce("regions", F.lit(0)).cast("string"), "failed_features": F.array_join("bad", ",")}
    line = F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(""))) for k, v in parts.items()))
    return images.select(key, "processing_status").join(per, key, "left").select(key, line.alias("line"))


def configure_logging(path: str | None = None) -> logging.Logger:
    """One console handler, and one for ``path``; calling it again replaces the file, not the console."""
    LOG.setLevel(logging.INFO)
    LOG.propagate = False
    for h in list(LOG.handlers):
        LOG.removeHandler(h)
        h.close()
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    for h in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        LOG.addHandler(h)
    return LOG
