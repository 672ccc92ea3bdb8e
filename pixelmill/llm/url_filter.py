"""URL verdicts: host rules first, then gradient-boosted trees on lexical features.

Rules name a host and a path prefix; a rule fits its host and all subdomains. URLs that a rule
decides are the labelled ones. From them, trees learn (log loss, histogram splits) on length, host
length, depth, digit ratio, character entropy, parameter counts, hyphens, labels of the host, longest
path part and suffix statistics: the smoothed share of blocked URLs, and the number of labelled
ones, of the host's last label and of its last two, in ``BUCKETS`` hash buckets. The statistics
cover all labelled rows; the trees are fitted on at most ``sample`` of them, those with the smallest
hash, each without its own label in the statistics. Only their numbers go to the driver.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged from
its empty features. Without labelled URLs of both kinds everything undecided gets the verdict of the
only kind, else ``allow``. Very long URLs are read whole. Repeated rows and ties are kept; other columns
are kept, and one that is named like an added one (in any case) is replaced by it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import Shipped, ddl, without

BUCKETS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 32
FEATURES = (
    "length", "host_length", "depth", "digits", "entropy", "host_entropy", "parameters", "query_length", "fragment", "hyphens", "host_labels",
    "longest_part", "https", "suffix_share", "suffix_log", "suffix2_share", "suffix2_log",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    # the reluctant prefix stops at the first ://
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; rules are (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def suffix_bucket(host: Column, labels: int) -> Column:
    tail = F.substring_index(host, ".", -labels)
    return (F.pmod(F.xxhash64(tail, F.lit(labels)), F.lit(BUCKETS))).cast("int")


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else url
    query = rest.split("#", 1)[0].partition("?")[2]
    parts = [p for p in path.split("/") if p]
    n = max(1, len(url))
    return [
        len(url), len(host), len(parts), sum(c.isdigit() for c in url) / n, entropy(url), entropy(host), sum(1 for q in query.split("&") if q), len(query),
        float("#" in rest), url.count("-"), host.count(".") + bool(host), max(map(len, parts), default=0), float(url[:8].lower() == "https://"),
    ]


class Boosted:
    """Gradient-boosted trees for log loss; trees are arrays of (feature, threshold, left, right, value)."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, least: int = 20, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.prior, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            self.prior = 50.0 if len(y) and y.all() else -50.0
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.rate * self._walk(tree, x)
        return self

    def _grow(self, b: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray) -> list:
        tree: list = []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(tree)
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.append([-1, 0.0, 0, 0, gs / (hs + self.ridge)])
            best = (1e-6, -1, 0)
            if depth and len(rows) >= 2 * self.least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    cg, ch, cn = (np.cumsum(np.bincount(b[rows, j], w, k))[:-1] for w in (g[rows], h[rows], None))
                    gain = cg**2 / (ch + self.ridge) + (gs - cg) ** 2 / (hs - ch + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(cn < self.least) | (len(rows) - cn < self.least)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, i)
            if best[1] >= 0:
                _, j, i = best
                left = b[rows, j] <= i
                tree[at][:2] = [j, float(edges[j][i])]
                tree[at][2] = node(rows[left], depth - 1)
                tree[at][3] = node(rows[~left], depth - 1)
            return at

        node(np.arange(len(g)), self.depth)
        return [np.array(c) for c in zip(*tree, strict=True)]

    def _walk(self, tree: list, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.prior)
        for t in self.trees:
            s += self.rate * self._walk(t, x)
        return 1 / (1 + np.exp(-s))


def suffix_features(n: np.ndarray, blocked: np.ndarray, share: float) -> list[np.ndarray]:
    """Smoothed share of blocked URLs and log count of the suffix."""
    return [(blocked + 5 * share) / (n + 5), np.log1p(n)]


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, url_col: str = "url", sample: int = 20_000, cut: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the trees' probability of block; null where a rule decides)."""
    pages = without(pages, ["host", "path", "rule", "verdict", "score"], url_col)
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    base = pages.select("*", host.alias("host"), path.alias("path"))
    name, say = rule_of(F.col("host"), F.col("path"), rules)
    own = [F.col(f"`{url_col}`").cast("string").alias("__url"), say.alias("__say"), suffix_bucket(F.col("host"), 1).alias("__s1"), suffix_bucket(F.col("host"), 2).alias("__s2")]
    base = base.select("*", name.alias("rule"), *own)
    known = base.filter("__say is not null").select("__url", "host", "path", (F.col("__say") == "block").cast("int").alias("y"), "__s1", "__s2")
    # suffix statistics over all labelled rows: at most 2 * BUCKETS rows come back
    seen = known.select(F.explode(F.array("__s1", F.col("__s2") + BUCKETS)).alias("b"), "y").groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("k")).collect()
    n, k = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for r in seen:
        n[r["b"]], k[r["b"]] = r["n"], r["k"]
    share = (k.sum() + 1) / (n.sum() + 2)

    def measure(batches):
        for b in batches:
            c = b.to_pydict()
            x = [lexical(u, h, p) for u, h, p in zip(c["__url"], c["host"], c["path"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(3), b.column(4), b.column(5)], names=["x", "y", "s1", "s2"])

    some = known.orderBy(F.xxhash64("__url", F.lit(3)), "__url", "y").limit(sample).mapInArrow(measure, "x array<double>, y int, s1 int, s2 int").toArrow()
    model = Boosted()
    if len(some):
        y = some["y"].to_numpy().astype(float)
        x = some["x"].combine_chunks().flatten().to_numpy().reshape(len(some), -1)
        b = np.stack([some["s1"].to_numpy(), some["s2"].to_numpy() + BUCKETS], 1)
        stats = [c for j in (0, 1) for c in suffix_features(n[b[:, j]] - 1, k[b[:, j]] - y, share)]
        model.fit(np.column_stack([x, *stats]), y)
    else:
        model.prior = -50.0
    sent = Shipped(pages.sparkSession, (model, n, k, share))
    names = base.columns
    at = {c: names.index(c) for c in ("host", "path", "__url", "__say", "__s1", "__s2")}
    out_names = names[: len(names) - len(own)]

    def run(batches):
        model, n, k, share = sent.get()
        for b in batches:
            c = {key: b.column(i).to_pylist() for key, i in at.items()}
            todo = [i for i, s in enumerate(c["__say"]) if s is None]
            score: list = [None] * b.num_rows
            if todo:
                x = np.array([lexical(c["__url"][i], c["host"][i], c["path"][i]) for i in todo])
                s = np.array([[c["__s1"][i], c["__s2"][i] + BUCKETS] for i in todo])
                x = np.column_stack([x, *(f for j in (0, 1) for f in suffix_features(n[s[:, j]], k[s[:, j]], share))])
                for i, p in zip(todo, model.probability(x), strict=True):
                    score[i] = float(p)
            verdict = [s if s is not None else "block" if p >= cut else "allow" for s, p in zip(c["__say"], score, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(out_names)], pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=[*out_names, "verdict", "score"])

    return base.mapInArrow(run, f"{ddl(base.select(*out_names))}, verdict string, score double")
