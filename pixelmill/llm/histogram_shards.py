"""Shards of near-equal bytes by histogram sort.

Documents are ordered by (id, CRC of the text). Candidate key boundaries are probed: each round
counts, over all partitions, the exact bytes between neighbouring probes inside the intervals that
still hold a wanted byte rank, and puts new probes into the cells that hold one, until every
splitter is within tolerance or cuts between two keys. Then rows are exchanged once. Each shard is
made of several key ranges, so no task ever holds a whole shard; slots add the exact row counts of
the ranges before to the rank inside the range. DataFrame operations only.

Cases: a null text has no bytes besides the overhead and CRC 0; null ids come first; repeated rows
are neighbours and keep a slot each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import materialize, parts

DEC = "decimal(38,0)"


def _array(values: list[int]) -> Column:
    return F.array(*(F.lit(Decimal(v)).cast(DEC) for v in values))


def _rank(key: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` are at most ``key``: a binary search over a literal array."""
    if not edges:
        return F.lit(0)
    arr, steps = _array(edges), [1 << b for b in range(len(edges).bit_length() - 1, -1, -1)]

    def go(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(edges)) & (key >= F.get(arr, at + step - 1)), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go)


def splitters(rows: DataFrame, wanted: list[tuple[int, int]], total: int, low: int, high: int, probes: int = 64) -> list[int]:
    """Keys at which about the wanted bytes lie below; ``wanted`` holds (byte rank, tolerance), sorted."""
    cuts: list[int | None] = [None] * len(wanted)
    home = {i: (low, high + 1, 0) for i in range(len(wanted))}  # open interval and exact bytes below it
    while home:
        spans = sorted(set(home.values()))
        p = max(probes, 4096 // len(spans))
        widths = [-(-(hi - lo) // p) for lo, hi, _ in spans]
        at = _rank(F.col("key"), [lo for lo, _, _ in spans]) - 1
        inside = rows.select("key", "size", at.alias("span")).filter("span >= 0")
        inside = inside.select("key", "size", "span", (F.col("key") - F.get(_array([s[0] for s in spans]), F.col("span"))).cast(DEC).alias("off"))
        cell = F.floor(F.col("off") / F.get(_array(widths), F.col("span")))
        exact = F.expr("off div 1") if all(w == 1 for w in widths) else cell
        inside = inside.withColumn("cell", exact.cast("long")).filter(F.col("key") < F.get(_array([s[1] for s in spans]), F.col("span")))
        hist: dict[int, list] = {}
        for r in inside.groupBy("span", "cell").agg(F.sum("size").alias("b"), F.min("key").alias("k0"), F.max("key").alias("k1")).collect():
            hist.setdefault(r["span"], []).append((int(r["k0"]), int(r["k1"]), int(r["b"])))  # at most len(spans) * p rows
        nxt = {}
        for i, span in home.items():
            below = span[2]
            rank, tol = wanted[i]
            cells = sorted(hist.get(spans.index(span), []))
            cuts[i] = span[1]
            for k0, k1, b in cells:
                if below + b < rank:
                    below += b
                    continue
                if b <= tol or k0 == k1:
                    cuts[i] = k0 if rank - below < below + b - rank else k1 + 1
                else:
                    nxt[i] = (k0, k1 + 1, below)
                break
        home = nxt
    return cuts


def shard_by_bytes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16, tolerance: float = 0.001
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    ident = F.coalesce(F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(2**63)), F.lit(Decimal(-1))).cast("decimal(21,0)")
    key = (ident * F.lit(Decimal(2**32)) + F.col("text_crc32").cast("decimal(10,0)")).cast(DEC)
    rows = materialize(base.withColumn("key", key), "sizes")
    s = rows.agg(F.sum("size").alias("t"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    total = int(s["t"] or 0)
    ranges = max(16, 2 * -(-parts(docs.sparkSession) // shards))  # of each shard
    many = shards * ranges
    wanted = []
    for i in range(1, many):
        loose = 0.05 * total / many
        wanted.append((total * i // many, int(tolerance * total / shards if i % ranges == 0 else loose)))
    cuts = splitters(rows, wanted, total, int(s["lo"]), int(s["hi"])) if total else []
    for i in range(1, len(cuts)):
        cuts[i] = max(cuts[i], cuts[i - 1])
    placed = rows.withColumn("part", _rank(F.col("key"), cuts))
    n = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    first, run = [], 0
    for p in range(many):
        run = 0 if p % ranges == 0 else run
        first.append(run)
        run += n.get(p, 0)
    w = Window.partitionBy("part").orderBy("key", "size")
    slot = F.get(F.array(*map(F.lit, first)), F.col("part")).cast("long") + F.row_number().over(w) - 1
    return placed.withColumn("slot", slot).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("part") / ranges).cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
