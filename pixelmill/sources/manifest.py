"""Manifest sources: typed CSV scans with validation, label folders, checkpoints, predictions, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions.scalars import bool_like, pilot_label, prototype_label, safe_relative_path

# Column order and vocabularies of the manifest.
COLUMNS = [
    "sample_id", "relative_path", "label", "category", "source_id", "group_id", "provenance_type", "acquisition_type", "generator_id", "width", "height",
    "format", "sha256", "split", "inclusion_status", "exclusion_reason",
]
FORMATS = ("PNG", "JPEG", "WEBP")
STATUSES = ("included", "excluded", "review")
SPLITS = ("train", "validation", "test")
EXTENSIONS = ("png", "jpg", "jpeg", "webp")
BLOCKED = ("recognized_text", "ocr", "word", "semantic", "language", "merchant", "amount", "filename", "relative_path", "source_id", "generator")


def read_csv(spark: SparkSession, path: str, columns: list[str] = COLUMNS) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)


def with_violations(m: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Typed manifest with an array of what is wrong with each row.

    ``files`` (relative_path, sha256, width, height of the stored files) adds the checks against them.
    """
    c = F.col
    num = lambda k: c(k).try_cast("int")
    label, status = prototype_label(c("label")), F.lower(F.coalesce(F.nullif(F.trim("inclusion_status"), F.lit("")), F.lit("included")))
    category = F.lower(F.trim("category"))
    wrong = [
        (F.coalesce(F.trim("sample_id"), F.lit("")) == "", "sample_id"),
        (~safe_relative_path(F.coalesce("relative_path", F.lit(""))), "relative_path"),
        (label.isNull(), "label"),
        (~status.isin(*STATUSES), "inclusion_status"),
        ((status == "included") & ~F.coalesce(category == "receipt", F.lit(False)), "category"),
        ((status != "included") & (F.coalesce(F.trim("exclusion_reason"), F.lit("")) == ""), "exclusion_reason"),
        (F.coalesce(num("width"), F.lit(0)) <= 0, "width"),
        (F.coalesce(num("height"), F.lit(0)) <= 0, "height"),
        (~F.coalesce(F.upper("format").isin(*FORMATS), F.lit(False)), "format"),
        (~F.coalesce(F.lower("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256"),
        ((F.coalesce(c("split"), F.lit("")) != "") & ~c("split").isin(*SPLITS), "split"),
        *((F.coalesce(F.trim(k), F.lit("")) == "", k) for k in ("source_id", "group_id", "provenance_type", "acquisition_type")),
    ]
    if files is not None:
        f = files.select("relative_path", F.col("sha256").alias("f_sha"), F.col("width").alias("f_w"), F.col("height").alias("f_h"), F.lit(True).alias("f_here"))
        m = m.join(f, "relative_path", "left")
        wrong += [
            (c("f_here").isNull(), "missing file"),
            (c("f_here").isNotNull() & (c("f_sha") != F.lower("sha256")), "checksum"),
            (c("f_here").isNotNull() & ((c("f_w") != num("width")) | (c("f_h") != num("height"))), "dimensions"),
        ]
    bad = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in wrong)))
    dup = m.groupBy("sample_id").agg(F.count("*").alias("__n"))
    out = m.withColumn("violations", bad).join(dup, "sample_id", "left")
    out = out.withColumn("violations", F.when(c("__n") > 1, F.array_append("violations", F.lit("duplicate sample_id"))).otherwise(c("violations")))
    typed = {
        "label": label, "category": category, "width": num("width"), "height": num("height"), "format": F.upper("format"), "inclusion_status": status, "split": F.nullif("split", F.lit("")),
        "generator_id": F.coalesce(F.nullif(F.trim("generator_id"), F.lit("")), F.lit("unknown")), "exclusion_reason": F.coalesce("exclusion_reason", F.lit("")),
    }
    return out.withColumns(typed).select(*COLUMNS, "violations")


def load(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """The valid manifest; raises with the first bad rows."""
    out = with_violations(read_csv(spark, path), files)
    bad = out.filter(F.size("violations") > 0).orderBy("sample_id").limit(5).collect()
    if bad:
        raise ValueError("invalid manifest rows: " + "; ".join(f"{r['sample_id']}: {', '.join(r['violations'])}" for r in bad))
    return out.drop("violations")


def load_pilot(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Pilot manifest: image_path and label needed, other columns optional; relative paths hang on ``root``."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    missing = {"image_path", "label"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    extra = [c for c in ("image_id", "source_group", "design_category", "conversion_pipeline") if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in extra}) if extra else raw
    p = F.col("image_path")
    full = F.when(p.rlike(r"^(/|[A-Za-z]:|[a-z0-9]+://)"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    stem = F.regexp_extract(p, r"([^/\\]+?)(\.[^.]*)?$", 1)
    return raw.select(F.coalesce(F.nullif(F.trim("image_id"), F.lit("")), stem).alias("image_id"), full.alias("image_path"), pilot_label("label").alias("label"), *(F.nullif(c, F.lit("")).alias(c) for c in ("source_group", "design_category", "conversion_pipeline")))


def class_folders(spark: SparkSession, root: str, folders: dict[str, str]) -> DataFrame:
    """(path, label, length, sha256, content) of images in one folder for each label; not recursive."""
    glob = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
    out = None
    for label, folder in folders.items():
        part = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root}/{folder}").withColumn("label", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out.select("path", "label", "length", F.sha2("content", 256).alias("sha256"), "content")


def tree(spark: SparkSession, root: str, folders: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(files in label folders at any depth with their label, skipped files)."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("://")[-1] + "/", "")
    every = every.withColumn("relative_path", rel)
    label = F.lit(None).cast("string")
    for name, folder in folders.items():
        label = F.when(F.col("relative_path").startswith(folder + "/"), name).otherwise(label)
    image = F.lower(F.element_at(F.split("relative_path", r"\."), -1)).isin(*EXTENSIONS)
    every = every.withColumn("label", F.when(image, label))
    order = F.lower("relative_path")
    return every.filter("label is not null").withColumn("order", order), every.filter("label is null").select("relative_path", "length")


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str = "image_id") -> DataFrame:
    """The last record of each key in line order; corrupt lines and those without a key are left out.

    Line order is the file, then the byte offset that the writer stored in ``seq``.
    """
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    return raw.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


PREDICTIONS = ["sample_id", "true_label", "score", "predicted_label", "threshold", "region_count", "no_detection", "input_sha256"]


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Typed predictions; raises if a value isn't what its column needs."""
    p = read_csv(spark, path, PREDICTIONS)
    typed = p.select(
        "sample_id", F.col("true_label").try_cast("int").alias("true_label"), F.col("score").try_cast("double").alias("score"), F.col("predicted_label").try_cast("int").alias("predicted_label"),
        F.col("threshold").try_cast("double").alias("threshold"), F.col("region_count").try_cast("int").alias("region_count"), bool_like(F.col("no_detection")).alias("no_detection"), F.coalesce("input_sha256", F.lit("")).alias("input_sha256"),
    )
    inf = float("inf")
    ok = (
        F.col("sample_id").isNotNull() & F.col("true_label").isin(0, 1) & F.col("predicted_label").isin(0, 1) & (F.abs("score") < inf) & (F.abs("threshold") < inf)
        & (F.col("region_count") >= 0) & F.col("no_detection").isNotNull()
    )
    bad = typed.filter(~F.coalesce(ok, F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"invalid predictions: {[r['sample_id'] for r in bad]}")
    return typed


def read_features(spark: SparkSession, df: DataFrame, splits: DataFrame, key: str = "sample_id", label: str = "label") -> tuple[DataFrame, list[str]]:
    """(matrix joined to its splits with integer labels, feature columns); rows without split stay and can be counted."""
    features = [c for c in df.columns if c not in (key, label, "split", "processing_status", "processing_error")]
    blocked = [c for c in features if any(t in c.lower() for t in BLOCKED)]
    if blocked:
        raise ValueError(f"columns that are not features: {blocked}")
    if "processing_status" in df.columns and not df.filter("processing_status = 'failed'").isEmpty():
        raise ValueError("the matrix has failed rows")
    if not df.groupBy(key).count().filter("count > 1").isEmpty() or not df.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "").isEmpty():
        raise ValueError("sample ids must be unique and not empty")
    from pixelmill.functions.scalars import label_code

    cast = df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in features})
    lost = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(features))).first()
    kept = cast.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(features))).first()
    text = [c for i, c in enumerate(features) if lost[f"n{i}"] != kept[f"n{i}"]]
    if text:
        raise ValueError(f"columns that are not numbers: {text}")
    out = cast.drop("split").join(splits.select(key, "split"), key, "left")
    return out.withColumn(label, label_code(F.col(label))), features


def read_confusion(spark: SparkSession, path: str) -> dict[str, int]:
    """tn, fp, fn and tp of a CSV with exactly one row of counts that are no less than 0."""
    df = spark.read.option("header", True).csv(path)
    counts = ("tn", "fp", "fn", "tp")
    if not set(counts) <= set(df.columns):
        raise ValueError("the confusion matrix has an invalid shape")
    rows = df.select(*(F.trim(c).try_cast("decimal(38,10)").alias(c) for c in counts)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the confusion matrix has an invalid shape")
    if any(rows[0][c] is None or rows[0][c] % 1 for c in counts):
        raise ValueError("the confusion matrix has a count that is no integer")
    if any(rows[0][c] < 0 for c in counts):
        raise ValueError("the confusion matrix has a negative count")
    return {c: int(rows[0][c]) for c in counts}


# Columns of the ablation table.
ABLATION_INTEGERS = ("feature_count", "test_zero_division", "test_sample_count", "test_tn", "test_fp", "test_fn", "test_tp")
ABLATION_NUMBERS = ("threshold", "validation_f1", "test_accuracy", "test_precision", "test_recall", "test_f1")


def read_ablation(spark: SparkSession, path: str) -> DataFrame:
    """The feature-group ablation CSV with typed metrics; raises for repeated groups, unknown states and numbers that aren't finite."""
    df = spark.read.option("header", True).csv(path)
    if not {"feature_group", "feature_count", "status"} <= set(df.columns):
        raise ValueError("the ablation table lacks required columns")
    if not df.filter("coalesce(feature_group, '') = '' or coalesce(status, '') not in ('completed', 'unavailable')").isEmpty():
        raise ValueError("the ablation table has an invalid row")
    if not df.groupBy("feature_group").count().filter("count > 1").isEmpty():
        raise ValueError("the ablation table repeats a group")
    numbers = [c for c in (*ABLATION_INTEGERS, *ABLATION_NUMBERS) if c in df.columns]
    cast = {c: F.col(c).try_cast("double") for c in numbers}
    wrong = [F.col(c).isNotNull() & (F.trim(c) != "") & ~F.coalesce(F.abs(v) < float("inf"), F.lit(False)) for c, v in cast.items()]
    if not df.filter(F.exists(F.array(*wrong), lambda x: x)).isEmpty():
        raise ValueError("the ablation table has a metric that is no finite number")
    return df.withColumns({c: v.cast("long") if c in ABLATION_INTEGERS else v for c, v in cast.items()})


def run_catalog(spark: SparkSession, root: str, model_id: str | None = None) -> DataFrame:
    """Completed runs under root/*/run_manifest.json, the latest first."""
    schema = "run_id string, status string, selected_model_id string, completed_at_utc string"
    runs = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/run_manifest.json").withColumn("path", F.col("_metadata.file_path"))
    runs = runs.filter("status = 'completed'")
    if model_id is not None:
        runs = runs.filter(F.col("selected_model_id") == model_id)
    return runs.withColumn("completed", F.try_to_timestamp("completed_at_utc")).orderBy(F.desc_nulls_last("completed"), F.desc("path"))
