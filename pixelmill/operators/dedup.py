"""Duplicates, review marks, leakage, balanced samples and set checks over a manifest."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions.hamming import close_rows

LEAST_BLOCK, MOST_BLOCK = 8192, 262_144  # rows of a block: fewer aren't worth a task, more don't fit it


def duplicate_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys that more than one row has, with their ids in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(id_col)).alias("ids")).filter(F.size("ids") > 1)


def mark_duplicates(df: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """Add status: the first row of a group stays, others are excluded; groups with mixed labels go to review.

    The group's figures come from an aggregate with map-side combining, not from a window over the group.
    """
    first = F.min(F.struct(*order)).alias("__first")
    g = df.groupBy(key).agg(F.count("*").alias("copies"), F.count_distinct(label).alias("labels"), first)
    own = F.struct(*order) == F.col("__first")
    status = F.when(F.col("labels") > 1, "review").when(own, "included").otherwise("excluded")
    return df.join(g, key).withColumn("status", status).drop("__first", "labels")


def near_pairs(df: DataFrame, id_col: str, hash_col: str, distance: int) -> DataFrame:
    """Pairs (a, b, distance) with a < b whose 64-bit hashes differ in at most ``distance`` bits.

    Rows are dealt to blocks by their hash and id, so that copies spread; each pair of blocks is a task's, which searches it
    exactly (``functions/hamming.py``). The number of blocks follows the rows; it changes no result.
    """
    n = df.count()
    blocks = max(1, min(16, n // LEAST_BLOCK), -(-n // MOST_BLOCK))
    rows = df.select(F.col(id_col).alias("id"), F.col(hash_col).cast("long").alias("h"))
    packed = rows.groupBy(F.pmod(F.xxhash64("id", "h"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "h")).alias("rows"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = packed.select("block", F.col("rows.id").alias("ids"), F.col("rows.h").alias("hashes"), other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    sent = sent.select((high * (high + 1) / 2 + low).cast("int").alias("task"), (low == high).alias("alone"), "ids", "hashes")

    def run(batches):
        waiting: dict[int, tuple] = {}
        for batch in batches:
            for k, (task, alone) in enumerate(zip(batch["task"].to_pylist(), batch["alone"].to_pylist(), strict=True)):
                ids, h = batch["ids"][k].values, batch["hashes"][k].values
                kept = pa.compute.and_(pa.compute.is_valid(ids), pa.compute.is_valid(h))
                own = ids.filter(kept), h.filter(kept).to_numpy().view("u8")
                if not alone and task not in waiting:
                    waiting[task] = own
                    continue
                mate = own if alone else waiting.pop(task)
                for i, j, d in close_rows(own[1], None if alone else mate[1], distance):
                    yield pa.RecordBatch.from_arrays([own[0].take(pa.array(i)), mate[0].take(pa.array(j)), pa.array(d, pa.int32())], names=["i", "j", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    pairs = sent.repartitionById(blocks * (blocks + 1) // 2, "task").mapInArrow(run, f"i {kind}, j {kind}, distance int").filter("i <> j")
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")


def prepare_marks(df: DataFrame, *, id_col: str, key: str, hash_col: str, label: str, order: list[str], distance: int = 0) -> DataFrame:
    """Duplicate marks, then review for every included row that has a near duplicate.

    Copies of one label are at distance 0, so the row kept of such a group goes to review, too.
    """
    marked = mark_duplicates(df, key, label, order)
    if distance == 0:
        near = df.groupBy(hash_col).agg(F.count("*").alias("n")).filter("n > 1").select(hash_col)
        hit = marked.join(near.withColumn("__near", F.lit(True)), hash_col, "left")
    else:
        p = near_pairs(df, id_col, hash_col, distance)
        ids = p.select(F.col("a").alias(id_col)).union(p.select("b")).distinct()
        hit = marked.join(ids.withColumn("__near", F.lit(True)), id_col, "left")
    near_ = F.coalesce("__near", F.lit(False))
    return hit.withColumn("near_duplicate", near_).withColumn("status", F.when(near_ & (F.col("status") == "included"), "review").otherwise(F.col("status"))).drop("__near")


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split; rows without split don't count."""
    g = df.filter(F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return g.filter(F.size("splits") > 1)


def check_leakage(df: DataFrame, keys: dict[str, str], split: str = "split") -> None:
    """Raise with the first keys that are in more than one split."""
    for key, what in keys.items():
        bad = [r[key] for r in leaks(df, key, split).orderBy(key).limit(5).collect()]
        if bad:
            raise ValueError(f"{what} in more than one split: {bad}")


def occurrence_ids(df: DataFrame, prefix: Column, key: str, order: list[str]) -> DataFrame:
    """Add occurrence_id: prefix-key16, with -dupNN from the second copy of a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    base = F.concat_ws("-", prefix, F.substring(key, 1, 16))
    return df.withColumn("__n", n).withColumn("occurrence_id", F.concat(base, F.when(F.col("__n") > 0, F.format_string("-dup%02d", F.col("__n"))).otherwise(""))).drop("__n")


def unique_ids(df: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """Add unique_id: the base, with _2, _3, ... for later rows of a base; generated names that a base has are passed over."""
    n = F.row_number().over(Window.partitionBy("__base").orderBy(*order))
    out = df.withColumn("__base", base).withColumn("__n", n)
    taken = out.select(F.col("__base").alias("__stem")).distinct()
    # names stem_k that are bases of their own, by stem
    hit = taken.select(F.regexp_extract("__stem", r"^(.*)_(\d+)$", 1).alias("__base"), F.regexp_extract("__stem", r"^(.*)_(\d+)$", 2).try_cast("int").alias("k")).filter("k >= 2")
    used = hit.groupBy("__base").agg(F.array_sort(F.collect_set("k")).alias("__used"))
    out = out.join(used, "__base", "left")
    bump = F.aggregate(F.coalesce("__used", F.array().cast("array<int>")), F.col("__n"), lambda s, k: F.when(k <= s, s + 1).otherwise(s))
    return out.withColumn("unique_id", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", bump.cast("string")))).drop("__base", "__n", "__used")


def balanced_sample(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Add selected: as many rows of each label as the smallest has, by the hash of seed and id."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)
    df = df.withColumn("__h", h).withColumn("__part", F.substring("__h", 1, 3))  # 4,096 ranges of the hash
    sizes = df.groupBy(label, "__part").agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = sizes.groupBy(label).agg(F.sum("__k").alias("__all")).agg(F.min("__all").alias("__least"))
    known = sizes.select(F.col(label).alias("__label"), F.col("__part").alias("__p"), before.alias("__before")).crossJoin(F.broadcast(least))
    n = F.row_number().over(Window.partitionBy(label, "__part").orderBy("__h", id_col))
    out = df.withColumn("__n", n).join(F.broadcast(known), F.col(label).eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__p")))
    return out.withColumn("selected", F.col("__n") + F.col("__before") <= F.col("__least")).drop("__h", "__part", "__n", "__label", "__p", "__before", "__least")


def balanced_shuffle(df: DataFrame, label: str, id_col: str, seeds: dict[str, int]) -> DataFrame:
    """The same by a Mersenne shuffle of each label's sorted ids; for manifests that fit a driver."""
    ids: dict[str, list] = {}
    for r in df.select(label, id_col).collect():
        ids.setdefault(r[0], []).append(r[1])
    least, chosen = min(map(len, ids.values()), default=0), []
    for k, own in ids.items():
        own.sort()
        random.Random(seeds[k]).shuffle(own)
        chosen += own[:least]
    keep = df.sparkSession.createDataFrame([(c,) for c in chosen], df.select(id_col).schema)
    return df.join(keep.withColumn("selected", F.lit(True)), id_col, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def schema_difference(expected: list[str], actual: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names."""
    return sorted(set(expected) - set(actual)), sorted(set(actual) - set(expected))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables have the same set of keys."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def compare_runs(ours: DataFrame, theirs: DataFrame, key: str, score: str, label: str, rel: float = 1e-9) -> DataFrame:
    """Rows of a full outer join on ``key`` that differ, with the reason."""
    a = ours.select(key, F.col(score).alias("score_a"), F.col(label).alias("label_a"), F.lit(True).alias("in_a"))
    b = theirs.select(key, F.col(score).alias("score_b"), F.col(label).alias("label_b"), F.lit(True).alias("in_b"))
    j = a.join(b, key, "full_outer")
    reason = (
        F.when(F.col("in_a").isNull(), "missing").when(F.col("in_b").isNull(), "unexpected").when(~F.col("label_a").eqNullSafe(F.col("label_b")), "label")
        .when(F.abs(F.col("score_a") - F.col("score_b")) > F.greatest(rel * F.greatest(F.abs("score_a"), F.abs("score_b")), F.lit(1e-12)), "score")
    )
    return j.withColumn("reason", reason).filter("reason is not null").select(key, "reason")
