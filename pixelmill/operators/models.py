"""Preprocessing, candidate models, selection, ablation, permutation and explanations."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions.scalars import sigmoid
from pixelmill.operators.evaluation import best_threshold, confusion


@dataclass
class MedianImputer:
    """Exact medians; an indicator for each column that has nulls at fit; all-null columns become 0."""

    columns: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> MedianImputer:
        cells = [F.percentile(F.col(f"`{c}`").cast("double"), F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(self.columns)]
        cells += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(self.columns)]
        row = df.agg(*cells).first()
        self.medians = {c: row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(self.columns)}
        self.missing = [c for i, c in enumerate(self.columns) if row[f"n{i}"]]
        return self

    @property
    def indicators(self) -> list[str]:
        return [f"missing_{c}" for c in self.missing]

    def transform(self, df: DataFrame) -> DataFrame:
        flags = {f"missing_{c}": F.col(f"`{c}`").isNull().cast("double") for c in self.missing}
        df = df.withColumns(flags) if flags else df
        return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(self.medians[c])) for c in self.columns})


@dataclass
class Standardizer:
    """(x - mean) / population deviation; a constant column is divided by 1."""

    columns: list[str]
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Standardizer:
        cells = [f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("a", F.avg), ("s", F.stddev_pop))]
        row = df.agg(*cells).first()
        self.moments = {c: (row[f"a{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in self.moments.items()})


@dataclass
class FittedModel:
    family: str
    params: dict
    features: list[str]
    imputer: MedianImputer
    scaler: Standardizer
    model: object
    fourier: tuple | None = None
    threshold: float = 0.5

    def prepared(self, df: DataFrame) -> DataFrame:
        out = self.scaler.transform(self.imputer.transform(df))
        names = [*self.features, *self.imputer.indicators]
        if self.fourier is not None:
            weights, phases = self.fourier
            scale = (2 / len(phases)) ** 0.5
            for i, (w, p) in enumerate(zip(weights, phases, strict=True)):
                dot = sum((F.col(f"`{c}`") * float(x) for c, x in zip(names, w, strict=True)), F.lit(float(p)))
                out = out.withColumn(f"__rff{i}", F.cos(dot) * scale)
            names = [f"__rff{i}" for i in range(len(phases))]
        clean = {f"__x{i}": F.col(f"`{c}`") for i, c in enumerate(names)}
        return VectorAssembler(inputCols=list(clean), outputCol="__v").transform(out.withColumns(clean)).drop(*clean, *(n for n in names if n.startswith("__rff")))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with model_score: a probability, or the margin of an SVM."""
        raw = df.withColumn("__keep", F.struct(*(F.col(f"`{c}`") for c in df.columns)))
        out = self.model.transform(self.prepared(raw))
        col = "rawPrediction" if self.family.startswith("svm") else "probability"
        return out.select(*(F.col(f"__keep.`{c}`").alias(c) for c in df.columns), vector_to_array(col)[1].alias("model_score"))


@dataclass
class Candidate:
    family: str
    params: dict
    features: list[str]
    seed: int = 42

    @property
    def default_threshold(self) -> float:
        return 0.0 if self.family.startswith("svm") else 0.5

    def fit(self, df: DataFrame, label: str) -> FittedModel:
        imputer = MedianImputer(self.features).fit(df)
        filled = imputer.transform(df)
        names = [*self.features, *imputer.indicators]
        scaler = Standardizer(names).fit(filled)
        out = FittedModel(self.family, self.params, self.features, imputer, scaler, None, threshold=self.default_threshold)
        if self.family == "svm_rbf":
            out.fourier = self._fourier(len(names))
        data = out.prepared(df).select("__v", F.col(label).cast("double").alias("__y")).cache()
        n = data.count()
        c = self.params.get("C", 1.0)
        common = {"featuresCol": "__v", "labelCol": "__y"}
        if self.family == "lr":
            est = LogisticRegression(regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200, **common)
        elif self.family in ("svm_linear", "svm_rbf"):
            est = LinearSVC(regParam=1 / (c * max(1, n)), standardization=False, maxIter=100, **common)
        elif self.family == "rf":
            est = RandomForestClassifier(numTrees=self.params["trees"], maxDepth=min(30, self.params.get("depth") or 30), minInstancesPerNode=self.params["leaf"], seed=self.seed, **common)
        else:
            raise ValueError(f"unknown family {self.family}")
        out.model = est.fit(data)
        data.unpersist()
        return out

    def _fourier(self, width: int, count: int = 100) -> tuple:
        """Random Fourier features of the RBF kernel: the margin is linear in them, at any number of rows."""
        import numpy as np

        gamma = self.params.get("gamma", "scale")
        gamma = 1 / max(1, width) if gamma == "scale" else float(gamma)  # columns have unit variance
        rng = np.random.default_rng(self.seed)
        return rng.normal(0, (2 * gamma) ** 0.5, (count, width)).tolist(), rng.uniform(0, 2 * np.pi, count).tolist()


def candidate(family: str, params: dict, features: list[str], seed: int = 42) -> Candidate:
    return Candidate(family, params, features, seed)


def score_with(c: Candidate, df: DataFrame, label: str) -> DataFrame:
    return c.fit(df, label).score(df)


def candidate_grid(features: list[str], seed: int = 42) -> list[Candidate]:
    """27 candidates: 3 logistic regressions, 3 linear and 9 RBF machines, 12 forests."""
    cs = (0.1, 1.0, 10.0)
    grid = [Candidate("lr", {"C": c}, features, seed) for c in cs]
    grid += [Candidate("svm_linear", {"C": c}, features, seed) for c in cs]
    grid += [Candidate("svm_rbf", {"C": c, "gamma": g}, features, seed) for c in cs for g in ("scale", 0.01, 0.1)]
    grid += [Candidate("rf", {"trees": t, "depth": d, "leaf": m}, features, seed) for t in (200, 500) for d in (None, 10) for m in (1, 2, 5)]
    return grid


def evaluate(model: FittedModel, df: DataFrame, label: str, threshold: float) -> dict:
    s = model.score(df).withColumn("__p", (F.col("model_score") >= threshold).cast("int"))
    return confusion(s, label, "__p").first().asDict()


def select_model(train: DataFrame, validation: DataFrame, label: str, grid: list[Candidate], threads: int = 4) -> tuple[FittedModel, list[dict]]:
    """Fit all candidates, take the best by validation F1, precision, accuracy, family and parameters; refit on both.

    The threshold chosen on validation is kept after the refit. A candidate that fails is a row with
    its error; only if all fail is an error raised.
    """

    def one(c: Candidate) -> dict:
        row = {"family": c.family, "params": json.dumps(c.params, sort_keys=True)}
        try:
            m = c.fit(train, label)
            best = best_threshold(m.score(validation), label, "model_score", c.default_threshold).first()
            t = best["threshold"] if best else c.default_threshold
            return row | evaluate(m, validation, label, t) | {"status": "completed", "threshold": t, "candidate": c}
        except Exception as e:  # a failed candidate is reported, not fatal
            return row | {"status": "failed", "error": str(e)[:300], "candidate": c}

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, grid))
    done = [r for r in rows if r["status"] == "completed"]
    if not done:
        raise ValueError(f"every candidate failed: {rows[0].get('error') if rows else 'no candidates'}")
    done.sort(key=lambda r: (-r["f1"], -r["precision"], -r["accuracy"], r["family"], r["params"]))
    best = done[0]
    final = best["candidate"].fit(train.unionByName(validation), label)
    final.threshold = best["threshold"]
    return final, [{k: v for k, v in r.items() if k != "candidate"} for r in rows]


def ablation(train: DataFrame, validation: DataFrame, test: DataFrame, label: str, base: Candidate, groups: dict[str, list[str]], always: list[str]) -> list[dict]:
    """One refit for each feature group with the same family and parameters; failures are rows."""
    out = []
    for name, columns in groups.items():
        cols = list(dict.fromkeys([*columns, *always]))
        row = {"feature_group": name, "feature_count": len(cols), "model_family": base.family}
        try:
            c = Candidate(base.family, base.params, cols, base.seed)
            m = c.fit(train, label)
            t = best_threshold(m.score(validation), label, "model_score", c.default_threshold).first()["threshold"]
            v = evaluate(m, validation, label, t)
            final = c.fit(train.unionByName(validation), label)
            e = evaluate(final, test, label, t)
            out.append(row | {"status": "completed", "validation_f1": v["f1"], "test_f1": e["f1"], "test_accuracy": e["accuracy"], **{f"test_{k}": e[k] for k in ("tn", "fp", "fn", "tp")}})
        except Exception as err:  # reported as a row
            out.append(row | {"status": "unavailable", "error": str(err)[:300]})
    return out


def permutation_linear(df: DataFrame, key: str, label: str, coefficients: dict[str, float], intercept: float, threshold: float, repeats: int = 20, seed: int = 42) -> DataFrame:
    """Per feature: mean and spread of the drops of F1 and accuracy, and mean |score change|, when its values are permuted.

    A linear margin changes by coefficient * (permuted - own), so rows are not scored again. Values
    are dealt by hashed order within each (feature, repeat): rows and values are ranked by two
    hashes and joined on the rank, in 64 strata that are permuted on their own.
    """
    strata = 64
    margin = sum((F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) * c for f, c in coefficients.items()), F.lit(float(intercept)))
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(c).alias("c"), F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias("value")) for f, c in coefficients.items()))
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), margin.alias("margin"), F.inline(cells))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("s", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(strata)))
    from pyspark.sql import Window

    def rank(salt: int):
        return F.row_number().over(Window.partitionBy("feature", "rep", "s").orderBy(F.xxhash64("id", "feature", "rep", F.lit(seed + salt)), "id"))

    a = rows.withColumn("k", rank(1))
    b = rows.select("feature", "rep", "s", F.col("value").alias("other"), rank(2).alias("k"))
    m = a.join(b, ["feature", "rep", "s", "k"]).withColumn("moved", F.col("margin") + F.col("c") * (F.col("other") - F.col("value")))
    m = m.withColumns({"p0": (F.col("margin") >= threshold).cast("int"), "p1": (F.col("moved") >= threshold).cast("int")})

    def f1(p: str):
        tp, fp, fn = (F.count_if((F.col("label") == y) & (F.col(p) == q)) for y, q in ((1, 1), (0, 1), (1, 0)))
        return F.coalesce(F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double")), F.lit(0.0))

    def right(p: str):
        return F.avg((F.col(p) == F.col("label")).cast("double"))

    per = m.groupBy("feature", "rep").agg(
        (f1("p0") - f1("p1")).alias("drop"), (right("p0") - right("p1")).alias("fewer"), F.avg(F.abs(sigmoid(F.col("moved")) - sigmoid(F.col("margin")))).alias("change")
    )
    return per.groupBy("feature").agg(
        F.avg("drop").alias("f1_drop_mean"), F.stddev_pop("drop").alias("f1_drop_std"), F.avg("fewer").alias("accuracy_drop_mean"), F.stddev_pop("fewer").alias("accuracy_drop_std"),
        F.avg("change").alias("mean_abs_score_change"),
    )


def permutation_any(model: FittedModel, df: DataFrame, key: str, label: str, repeats: int = 20, seed: int = 42, strata: int = 64) -> list[dict]:
    """The figures of ``permutation_linear`` for a model of any family: rows are scored again, all repeats of a feature in one pass.

    Values change places inside ``strata`` hashed parts of the rows, so no task holds a whole column.
    """
    from pyspark.sql import Window

    # rows are named once, then matched by rank in their part
    named = df.select(F.col(key).alias("__id"), F.col(label).alias("__y"), *(F.col(f"`{c}`").cast("double").alias(c) for c in model.features))
    base = model.score(named).withColumnRenamed("model_score", "__own")
    parts = base.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("__s", F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(strata)))
    out = []
    for n, f in enumerate(model.features):

        def rank(salt: int, n: int = n):
            return F.row_number().over(Window.partitionBy("__rep", "__s").orderBy(F.xxhash64("__id", "__rep", F.lit(seed + 2 * n + salt)), "__id"))

        other = parts.select("__rep", "__s", F.col(f"`{f}`").alias("__v"), rank(1).alias("__k"))
        moved = parts.withColumn("__k", rank(0)).join(other, ["__rep", "__s", "__k"]).withColumn(f, F.col("__v"))
        scored = model.score(moved.select("__id", "__y", "__rep", "__own", *(F.col(f"`{c}`") for c in model.features)))
        cells = []
        for c, name in (("__own", "own"), ("model_score", "new")):
            hit = F.col(c) >= model.threshold
            tp, fp, fn = (F.count_if((F.col("__y") == y) & (hit == q)) for y, q in ((1, True), (0, True), (1, False)))
            cells += [F.coalesce(F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double")), F.lit(0.0)).alias(f"f1_{name}"), F.avg((hit.cast("int") == F.col("__y")).cast("double")).alias(f"acc_{name}")]
        per = scored.groupBy("__rep").agg(*cells, F.avg(F.abs(F.col("model_score") - F.col("__own"))).alias("change"))
        f1, acc = F.col("f1_own") - F.col("f1_new"), F.col("acc_own") - F.col("acc_new")
        row = per.agg(
            F.avg(f1).alias("f1_drop_mean"), F.stddev_pop(f1).alias("f1_drop_std"), F.avg(acc).alias("accuracy_drop_mean"), F.stddev_pop(acc).alias("accuracy_drop_std"),
            F.avg("change").alias("mean_abs_score_change"),
        ).first()
        out.append({"feature": f} | row.asDict())
    return out


def explain(model: FittedModel, df: DataFrame, key: str) -> DataFrame:
    """Additive contributions of a linear model: (key, feature, component, contribution); others have none."""
    if model.family not in ("lr", "svm_linear"):
        return df.sparkSession.createDataFrame([], f"{df.select(key).schema[0].simpleString()}, feature string, component string, contribution double")
    names = [*model.features, *model.imputer.indicators]
    weights = model.model.coefficients.toArray().tolist()
    out = model.scaler.transform(model.imputer.transform(df))
    cells = [
        F.struct(
            F.lit(n.removeprefix("missing_") if n in model.imputer.indicators else n).alias("feature"),
            F.lit("indicator" if n in model.imputer.indicators else "value").alias("component"), (F.col(f"`{n}`") * w).alias("contribution"),
        )
        for n, w in zip(names, weights, strict=True)
    ]
    return out.select(key, F.inline(F.array(*cells)))


def local_explanation(model: FittedModel, df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, status, model_score, intercept, total, positive, negative, rest): the n largest contributions of either sign.

    A feature's value and indicator count together; ``rest`` is the sum of the others. Status is available only if intercept
    and contributions give the model's score again (margins within 1e-9, probabilities within 1e-8), else unavailable;
    models that aren't linear have global_only and nulls. Every row is judged by itself, nothing is shuffled.
    """
    scored = model.score(df)
    part = "array<struct<feature: string, contribution: double>>"
    kinds = {"intercept": "double", "total": "double", "positive": part, "negative": part, "rest": "double"}
    if model.family not in ("lr", "svm_linear"):
        return scored.select(key, F.lit("global_only").alias("status"), "model_score", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    names = [*model.features, *model.imputer.indicators]
    weights = dict(zip(names, model.model.coefficients.toArray().tolist(), strict=True))
    out = model.scaler.transform(model.imputer.transform(scored))

    def share(f: str):
        return sum((F.col(f"`{c}`") * weights[c] for c in (f, f"missing_{f}") if c in weights), F.lit(0.0))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x["contribution"])

    def largest(sign: int):
        mine = F.filter("__cells", lambda x: x["contribution"] * sign > 0)
        ranked = F.array_sort(F.transform(mine, lambda x: F.struct((x["contribution"] * -sign).alias("down"), x["feature"].alias("feature"))))
        return F.slice(F.transform(ranked, lambda x: F.struct(x["feature"].alias("feature"), (x["down"] * -sign).alias("contribution"))), 1, n)

    cells = F.array(*(F.struct(F.lit(f).alias("feature"), share(f).alias("contribution")) for f in model.features))
    out = out.select(key, "model_score", F.lit(float(model.model.intercept)).alias("intercept"), cells.alias("__cells"))
    out = out.withColumns({"total": total(F.col("__cells")), "positive": largest(1), "negative": largest(-1)})
    margin = F.col("intercept") + F.col("total")
    again, room = (margin, 1e-9) if model.family == "svm_linear" else (sigmoid(margin), 1e-8)
    gap = F.abs(again - F.col("model_score"))
    within = gap <= room * F.greatest(F.lit(1.0), F.abs("model_score"))
    status = F.when(within & ~F.isnan(gap), "available").otherwise("unavailable")
    rest = F.col("total") - total(F.col("positive")) - total(F.col("negative"))
    return out.select(key, status.alias("status"), "model_score", "intercept", "total", "positive", "negative", rest.alias("rest"))


def _store(folder: str) -> tuple:
    """(session, URI, file system, path maker) of a folder; one without a scheme is on this machine."""
    spark = SparkSession.active()
    uri = folder.rstrip("/") if "://" in folder else "file://" + os.path.abspath(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    return spark, uri, path(uri).getFileSystem(spark._jsc.hadoopConfiguration()), path


def file_hashes(folder: str) -> dict[str, str]:
    """SHA-256 of every file of the package's model by its relative name, read through the file system of its URI."""
    spark, uri, fs, path = _store(folder)
    root, out = fs.makeQualified(path(uri)).toUri().getPath() + "/", {}
    files = fs.listFiles(path(uri + "/model"), True)
    fs.setVerifyChecksum(False)  # a changed file is to differ from its hash, not to fail
    try:
        while files.hasNext():
            at = files.next().getPath()
            name = at.toUri().getPath().removeprefix(root)
            if not name.endswith(".crc"):
                stream = fs.open(at)
                out[name] = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
                stream.close()
    finally:
        fs.setVerifyChecksum(True)
    return out


def read_manifest(folder: str) -> dict:
    spark, uri, fs, path = _store(folder)
    stream = fs.open(path(uri + "/package.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def save_package(model: FittedModel, folder: str, extra: dict | None = None) -> dict:
    """Write the fitted model, its preprocessing and a manifest with the hash of every file to a folder or URI.

    Executors write the model, so on a cluster ``folder`` has to name a shared place (a URI).
    """
    spark, uri, fs, path = _store(folder)
    if uri.startswith("file:") and not spark.sparkContext.master.startswith("local") and "://" not in folder:
        raise ValueError("on a cluster a package needs the URI of a shared folder")
    model.model.write().overwrite().save(f"{uri}/model")
    state = {
        "family": model.family, "params": model.params, "features": model.features, "medians": model.imputer.medians, "missing": model.imputer.missing,
        "moments": model.scaler.moments, "fourier": model.fourier, "threshold": model.threshold, "label_mapping": {"non_ai_generated": 0, "ai_generated": 1},
    }
    manifest = (extra or {}) | {"state": state, "files": file_hashes(folder)}
    stream = fs.create(path(uri + "/package.json"), True)
    stream.write(json.dumps(manifest, sort_keys=True, allow_nan=False).encode())
    stream.close()
    return manifest


def load_package(folder: str, expected_features: list[str] | None = None) -> FittedModel:
    """Read a package; a changed file or another feature schema is an error."""
    from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel, RandomForestClassificationModel

    manifest = read_manifest(folder)
    if manifest["files"] != file_hashes(folder):
        raise ValueError("package files do not match their hashes")
    s = manifest["state"]
    if expected_features is not None and expected_features != s["features"]:
        raise ValueError("feature schema differs from the package")
    kind = {"lr": LogisticRegressionModel, "rf": RandomForestClassificationModel}.get(s["family"], LinearSVCModel)
    imputer = MedianImputer(s["features"], s["medians"], s["missing"])
    scaler = Standardizer(list(s["moments"]), {k: tuple(v) for k, v in s["moments"].items()})
    out = FittedModel(s["family"], s["params"], s["features"], imputer, scaler, kind.load(_store(folder)[1] + "/model"), threshold=s["threshold"])
    out.fourier = tuple(s["fourier"]) if s["fourier"] else None
    return out


__all__ = ["Candidate", "FittedModel", "MedianImputer", "Standardizer", "ablation", "candidate", "candidate_grid", "evaluate", "explain", "load_package", "local_explanation", "permutation_any", "permutation_linear", "read_manifest", "save_package", "score_with", "select_model"]
