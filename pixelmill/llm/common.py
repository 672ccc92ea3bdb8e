"""Shared helpers: table access, scratch tables in the shared folder, id bitmaps, components."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pixelmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelmill-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let this session hand at most ``rows`` texts to Python at once; long texts then fit small workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def without(df: DataFrame, added: list[str], *needed: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names compare as Spark does, in any case).

    The columns that the operator reads can't be replaced: one that is named so is an error.
    """
    gone = {c.lower() for c in added}
    if gone & {c.lower() for c in needed}:
        raise ValueError(f"an input column has the name of a result: {sorted(gone & {c.lower() for c in needed})}")
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(big: DataFrame, small: DataFrame, on: list[str], count: str, most: int) -> DataFrame:
    """``big`` with the columns of ``small``, which has one row for each key and in ``count`` that key's rows in ``big``.

    Rows of a key with more than ``most`` are dealt to several tasks, each with its copy of the key's row. Keys are not null;
    the list of such keys that is sent to the tasks has at most rows of ``big`` / ``most`` entries.
    """
    slots = F.ceil(F.col(count) / most).cast("int")
    hot = small.filter(F.col(count) > most).select(*on, slots.alias("__slots"))
    dealt = big.withColumn("__row", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("__slot", F.pmod("__row", F.coalesce("__slots", F.lit(1))).cast("int")).drop("__row", "__slots")
    copies = small.withColumn("__slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    return dealt.join(copies, [*on, "__slot"]).drop("__slot")


class Shipped:
    """An object of this package on its way to the tasks, once for each executor."""

    def __init__(self, spark: SparkSession, obj: object):
        self.blob = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    def get(self):
        return pickle.loads(self.blob.value)


# --- fixed-size bitmaps of ids -------------------------------------------------

BITMAP_BITS = 1 << 29  # at most 64 MB, whatever the input


def bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """A one-hash bitmap of the ids, of bounded size, so it can be sent to every task."""
    n = ids.count()
    bits = min(BITMAP_BITS, 1 << max(16, (16 * n).bit_length()))
    pos = F.pmod(F.xxhash64(F.col(col)), F.lit(bits))
    rows = (
        ids.select(pos.alias("p"))
        .select(F.expr("p div 64").cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether ids whose ``xxhash64`` is ``hashed`` may be in the bitmap (no false negatives)."""
    p = np.mod(hashed, len(bits) * 64)
    return (bits[p >> 6].view(np.uint64) >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1


def drop_ids(docs: DataFrame, gone: DataFrame, col: str) -> DataFrame:
    """Anti-join on ``col`` that shuffles only rows that a fixed-size bitmap can't clear."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(gone, col))

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd

        return pd.Series(in_bitmap(bits.value, h.to_numpy()))

    hashed = F.coalesce(F.xxhash64(F.col(col)), F.lit(0))
    sure = docs.filter(F.col(col).isNull() | ~maybe(hashed))
    rest = docs.filter(F.col(col).isNotNull() & maybe(hashed)).join(gone.select(col).distinct(), col, "left_anti")
    return sure.unionByName(rest)


# --- connected components --------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for nodes that have an edge.

    Every node hooks on its smallest neighbour, the graph is contracted, and so on; each round at
    least halves the nodes of a component. Self-loops and repeated edges are allowed, nulls are not.
    """
    spark = edges.sparkSession

    def tidy(x: Column, y: Column, df: DataFrame) -> DataFrame:
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()

    e, maps = materialize(tidy(F.col("a"), F.col("b"), edges), "edges"), []
    while not e.isEmpty():
        both = e.select(F.col("b").alias("node"), F.col("a").alias("near")).unionAll(e.select("a", "b"))
        hook = both.groupBy("node").agg(F.min("near").alias("near"))
        m = materialize(hook.select("node", F.least("node", "near").alias("up")), "hooks")
        maps.append(m)
        left = m.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = m.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        e = materialize(tidy(F.col("ua"), F.col("ub"), e.join(left, "a").join(right, "b")), "edges")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    out = maps[-1].select("node", F.col("up").alias("component"))
    for m in reversed(maps[:-1]):
        nxt = out.select(F.col("node").alias("up"), "component")
        out = m.join(nxt, "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return out
