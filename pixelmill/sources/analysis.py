"""The files and the text of a feature analysis."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import evaluation, profiles, review
from pixelmill.sources.sinks import csv_bytes, write_json

NOTES = [
    "Groups compared by ablation are the main evidence; values of single features describe the test split only.",
    "Nothing here was used to fit, tune or select the model.",
    "Coefficients and contributions are associations in the fitted model, not causes.",
    "Correlated features share importance; pairs are taken from training and validation rows only.",
]


def study_wording(provenance: set[str]) -> tuple[str, str]:
    """(title, limits) of a report: inputs that are all generated fixtures are evidence about the software only."""
    kinds = {p.lower() for p in provenance}
    if kinds and kinds <= {"fixture", "generated_fixture"}:
        return "Fixture evaluation report", "All inputs are generated fixtures: the figures test the software and say nothing about real images."
    return "Pilot evaluation report", "The figures hold for the given dataset, configuration and split; they establish no general authenticity."


def influence(test: DataFrame, label: str, groups: dict[str, str], permuted: list[dict]) -> list[dict]:
    """One row a feature: permutation figures, class medians, spreads, missing rates and Cliff's delta, most important first."""
    names = list(groups)
    summary = {(r[label], r["feature"]): r for r in profiles.class_summary(test, label, names).collect()}  # two rows a feature
    delta = {r["feature"]: r["delta"] for r in evaluation.cliffs_delta(profiles.unpivot(test, [label], names), label).collect()}
    by = {r["feature"]: r for r in permuted}
    out = []
    for f in names:
        row = {"feature": f, "group": groups[f], **{k: by.get(f, {}).get(k) for k in ("f1_drop_mean", "f1_drop_std", "accuracy_drop_mean", "accuracy_drop_std", "mean_abs_score_change")}}
        for code, name in ((0, "non_ai"), (1, "ai")):
            s = summary.get((code, f))
            row |= {f"{name}_{k}": s[k] if s else None for k in ("median", "iqr", "missing_rate")}
        out.append(row | {"cliffs_delta_ai_vs_non_ai": delta.get(f)})
    low = float("-inf")
    return sorted(out, key=lambda r: (-(low if r["f1_drop_mean"] is None else r["f1_drop_mean"]), -(low if r["mean_abs_score_change"] is None else r["mean_abs_score_change"]), r["feature"]))


def redundancy(development: DataFrame, groups: dict[str, str], least: float) -> list[dict]:
    """Feature pairs whose rank correlation on the development rows is at least ``least``, strongest first."""
    rows = evaluation.spearman_pairs(development, list(groups), least).orderBy(F.desc(F.abs("rho")), "a", "b").collect()  # bounded by the pairs of features
    return [
        {
            "feature_a": r["a"], "group_a": groups[r["a"]], "feature_b": r["b"], "group_b": groups[r["b"]], "spearman_r": r["rho"],
            "absolute_spearman_r": abs(r["rho"]), "source_split": "train_and_validation",
        }
        for r in rows
    ]


def summarize(test: DataFrame, development: DataFrame, label: str, groups: dict[str, str], permuted: list[dict], ablation: DataFrame, least: float = 0.9) -> dict:
    """The whole report as plain values."""
    return {
        "group_summary": [r.asDict() for r in review.group_summary(ablation).collect()], "feature_influence": influence(test, label, groups, permuted),
        "feature_redundancy": redundancy(development, groups, least), "interpretation_notes": NOTES,
    }


def write_analysis(report: dict, folder: str) -> list[str]:
    """feature_analysis.json and one CSV for each table; the paths written."""
    os.makedirs(folder, exist_ok=True)
    write_json(f"{folder}/feature_analysis.json", report)
    paths = [f"{folder}/feature_analysis.json"]
    for name, key in (("feature_influence", "feature_influence"), ("feature_group_summary", "group_summary"), ("feature_redundancy", "feature_redundancy")):
        paths.append(f"{folder}/{name}.csv")
        with open(paths[-1], "wb") as f:
            f.write(csv_bytes(report[key]))
    return paths


def text(report: dict) -> str:
    """The report for readers: groups, the feature with the largest drop, limits."""

    def shown(v, form):
        return "unavailable" if v is None else format(v, form)

    done = [r for r in report["group_summary"] if r.get("status") == "completed"]
    lines = ["## Feature analysis", *(f"- {r['feature_group']}: test F1 {shown(r['test_f1'], '.4f')}, against all {shown(r['delta_f1'], '+.4f')}" for r in done)]
    if report["feature_influence"]:
        top = report["feature_influence"][0]
        lines.append(f"Largest drop of F1 when permuted: `{top['feature']}` ({top['group']}), {shown(top['f1_drop_mean'], '.4f')}.")
    return "\n".join([*lines, "", "### Limits", *(f"- {n}" for n in report["interpretation_notes"])]) + "\n"
