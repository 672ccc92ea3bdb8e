"""Mix sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words; a document enters floor(p) times for sure, with
p = target / source size, and once more with the fractional part as inclusion probability. The cube
method moves these probabilities through the null space of two balancing constraints, the number of
documents and the number of words, until they are 0 or 1: first inside blocks of hashed documents,
then over what the blocks leave undecided (two documents each at most), level by level. The last
two documents of a source are the landing problem: one more move on the word total alone, then a
draw for the last one. All randomness is hashed from the seed and the rows, so reruns agree.

Cases: a null text has size 0; a document of size 0 and a source without words take nothing. Null
is a source of its own, ordered last. Rows alike in id, source and text are one unit and share a
decision. Null ids are allowed. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.common import WORD, materialize

BLOCK = 1024
EPS = 1e-9


def water_fill(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, cap: float) -> dict[str | None, float]:
    """Targets by weight, each at most ``cap`` times its source; the excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if rest * w[s] / total > cap * sizes[s]]
        if not over:
            out.update({s: rest * w[s] / total for s in open_})
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        rest -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def _step(x: list[float], u: list[float], draw: float) -> None:
    up = min(((1 - p) / v if v > 0 else -p / v) for p, v in zip(x, u, strict=True) if v)
    down = min((p / v if v > 0 else (p - 1) / v) for p, v in zip(x, u, strict=True) if v)
    move = up if draw * (up + down) < down else -down
    for i, v in enumerate(u):
        p = x[i] + move * v
        x[i] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p


def flight(prob: np.ndarray, count: np.ndarray, words: np.ndarray, draws: np.ndarray, landing: bool) -> np.ndarray:
    """Probabilities after the flight; at most two stay fractional, none with ``landing``."""
    x, a, b = prob.tolist(), count.tolist(), words.tolist()
    live: list[int] = []
    r = iter(draws)
    for k in range(len(x)):
        if not 0 < x[k] < 1:
            continue
        live.append(k)
        if len(live) == 3:
            i, j, m = live
            u = [a[j] * b[m] - a[m] * b[j], a[m] * b[i] - a[i] * b[m], a[i] * b[j] - a[j] * b[i]]
            if not any(u):
                u = [float(a[j]), -float(a[i]), 0.0]
            top = max(abs(v) for v in u)
            p = [x[i], x[j], x[m]]
            _step(p, [v / top for v in u], next(r))
            x[i], x[j], x[m] = p
            live = [q for q in live if 0 < x[q] < 1]
    if landing:
        if len(live) == 2:
            i, j = live
            p = [x[i], x[j]]
            _step(p, [b[j] / max(b[i], b[j]), -b[i] / max(b[i], b[j])], next(r))
            x[i], x[j] = p
            live = [q for q in live if 0 < x[q] < 1]
        for k in live:
            x[k] = 1.0 if next(r) < x[k] else 0.0
    return np.array(x)


def _fly(names: list[str], seed: int, level: int, last: bool):
    """The flight of one block of one source."""

    def fly(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2"], ignore_index=True)
        draws = np.random.default_rng([seed, level, int(key[0]), int(key[1])]).random(2 * len(pdf) + 4)
        pdf["x"] = flight(pdf["x"].to_numpy(), pdf["m"].to_numpy(float), (pdf["m"] * pdf["size"]).to_numpy(float), draws, last)
        return pdf[names]

    return fly


def row_keys(id_col: str, source_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit keys of a row's id, source and text, nulls apart from values."""
    flags = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in (id_col, source_col, text_col)))
    return F.xxhash64(flags, id_col, source_col, text_col), F.xxhash64(text_col, source_col, id_col, flags, F.lit(1))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11,
) -> DataFrame:
    """One row per distinct (id, source, text): its keys k1, k2, multiplicity, size, source_size, target, copies."""
    spark = docs.sparkSession
    k1, k2 = row_keys(id_col, source_col, text_col)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), k1.alias("k1"), k2.alias("k2"))
    units = materialize(rows.groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count("*").alias("m")), "units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("n"), F.count("*").alias("units")).collect()  # a row for each source
    goal = water_fill({r["source"]: r["n"] for r in sums}, weights, share, cap)
    table = [(i, r["source"], r["n"], goal[r["source"]], goal[r["source"]] / r["n"] if r["n"] else 0.0, r["units"]) for i, r in enumerate(sums)]
    sources = spark.createDataFrame(table, "sid int, source string, source_size long, target double, p double, units long")
    whole = F.floor(F.col("p") + EPS)
    part = F.when((F.col("size") > 0) & (F.col("p") - whole > EPS), F.col("p") - whole).otherwise(0.0)
    start = units.join(sources, units["source"].eqNullSafe(sources["source"]), "inner").select(
        "sid", "doc_id", "size", "k1", "k2", "m", "units", whole.cast("int").alias("sure"), part.alias("x")
    )
    schema = T.StructType([f for f in start.schema.fields if f.name != "units"])
    names = schema.names
    done, open_ = None, start
    blocks = {i: max(1, -(-t[5] // BLOCK)) for i, t in enumerate(table)}
    level = 0
    while True:
        last = all(b == 1 for b in blocks.values())
        nb = F.greatest(F.lit(1), F.ceil(F.col("units") / BLOCK)) if level == 0 else None
        if level:
            per = spark.createDataFrame([(i, b) for i, b in blocks.items()], "sid int, nb int")
            open_ = open_.join(per, "sid")
            nb = F.col("nb")
        blocked = open_.withColumn("blk", F.pmod(F.xxhash64("k1", F.lit(seed + level)), nb).cast("int")).select(*names, "blk")
        out = materialize(blocked.groupBy("sid", "blk").applyInPandas(_fly(names, seed, level, last), schema), "flight")
        settled = out.filter("x = 0 or x = 1")
        done = settled if done is None else done.unionAll(settled)
        if last or not table:
            break
        open_ = out.filter("x > 0 and x < 1")
        blocks = {i: max(1, -(-2 * b // BLOCK)) if b > 1 else 1 for i, b in blocks.items()}
        level += 1
    return done.join(sources.drop("source", "units", "p"), "sid").select(
        "doc_id", "k1", "k2", "m", "size", "source_size", "target", (F.col("sure") + F.col("x").cast("int")).alias("copies")
    )


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies, for every row of ``docs``."""
    d = mix(docs, **options)
    return d.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    kept = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).filter("copies > 0")
    kept = kept.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("copies").alias("__copies"))
    k1, k2 = row_keys(id_col, source_col, text_col)
    out = docs.withColumns({"__k1": k1, "__k2": k2}).join(kept, ["__k1", "__k2"])
    return out.withColumn("__one", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
