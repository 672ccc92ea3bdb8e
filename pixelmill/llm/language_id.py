"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and cut into runs of letters; a word is a character sequence from its start
mark to its end mark. A gram packs up to ``ORDER`` character codes of 12 bits, so that its context
and its suffix are shifts and masks; the character code of code points above 4,095 is hashed. Gram
counts cover all labelled training rows, and none is left out: driver and executors hold a model that
grows with the distinct grams of each language. Each language keeps
sorted arrays for each order: grams with their interpolated log probability, contexts with their
back-off weight. The logs of the most frequent grams are kept ready for all languages (``CACHE``);
others are looked up in the arrays, with the same result. A document gets the language of the lowest
cross-entropy per character.

Rejection is calibrated: from all its training documents come each language's median cross-entropy
and its spread by length; one with fewer than ``FEW`` is never held to narrower limits than its own or
those of the others. A text further than ``tolerance`` spreads
above its language's median is rejected, as is one without letters.

The score is the share of the best language in the likelihoods of all, each taken over at most ``SURE``
characters, as the full length would make every score 0 or 1; it decides nothing.

Cases: a null text, or one without a letter (combining marks alone are none), gets ``und`` and score 0. Rows
with null language train nothing. Without any training row every text gets ``und``. Repeated rows are kept,
ties go to the first language by code point, an empty table gives an empty one. Other columns are kept;
one that is named like an added one (in any case) is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import Shipped, ddl, materialize, small_batches, without
from pixelmill.llm.shingles import slices

ORDER = 5
BITS = 12
MASK = (1 << BITS) - 1
FULL = [(1 << (BITS * o)) - 1 for o in range(ORDER + 1)]
START, END = 1, 2  # code points that are no letters
CACHE = 6_000_000  # log probabilities that are kept ready; any number gives the same results
SURE = 60
FEW = 30  # documents that are too few for limits of their own
COLLECT = 2_000_000  # grams that go to the driver at once
CELLS = 4096


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word index of each token, token offsets of each text, distinct words); words are runs of letters."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    words = pc.split_pattern(pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " "), " ")
    flat, off = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off]
    enc = flat.filter(pa.array(keep)).dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False), off, enc.dictionary


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each predicted character, offsets of each word); a gram ends in that character."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    text = chr(START) + (chr(END) + chr(START)).join(words.to_pylist()) + chr(END)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(cp <= MASK, cp, 3 + (cp * 2654435761 >> 7) % (MASK - 3))
    head = np.flatnonzero(cp == START)
    place = np.arange(len(cp)) - np.repeat(head, np.diff(np.append(head, len(cp))))
    gram = code.copy()
    for j in range(1, ORDER):
        prev = np.concatenate([np.zeros(j, np.int64), code])[: len(code)]
        gram |= np.where(place >= j, prev << (BITS * j), 0)
    off = np.append(head, len(cp)) - np.arange(len(head) + 1)
    return gram[place > 0], off


class Model:
    """Interpolated Kneser-Ney over packed grams; ``tables[language][order]`` holds sorted arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.tables = {lang: self._fit(*counts[lang]) for lang in self.languages}
        self.grams = self._frequent(counts)
        self.logs = self._resolve(self.grams)
        self.limits: dict[str, tuple[float, float, float]] = {}

    @staticmethod
    def _frequent(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The grams whose logs are kept ready, sorted: the most frequent ones of each language."""
        most = CACHE // max(1, len(counts)) ** 2
        own = [g if len(g) <= most else g[np.argpartition(n, len(n) - most)[len(n) - most :]] for g, n in counts.values()]
        return np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)

    @staticmethod
    def _fit(gram: np.ndarray, n: np.ndarray) -> list:
        """For each order: (grams, log probabilities, contexts, log back-off weights)."""
        by = [None] * (ORDER + 1)
        left = gram, n.astype(np.float64)
        size = np.ones(len(gram), int)
        for o in range(1, ORDER):
            size += gram > FULL[o]
        more = np.zeros(0, np.int64)
        for o in range(ORDER, 0, -1):
            own = size == o
            g, c = left[0][own], left[1][own]
            if len(more):  # continuation counts: distinct left extensions
                s, k = np.unique(more & FULL[o], return_counts=True)
                g, c = np.concatenate([g, s]), np.concatenate([c, k.astype(np.float64)])
                g, inv = np.unique(g, return_inverse=True)
                c = np.bincount(inv, c, len(g))
            else:
                at = np.argsort(g)
                g, c = g[at], c[at]
            by[o], more = (g, c), g
        symbols = len(by[1][0]) + 1
        out: list = [None] * (ORDER + 1)
        for o in range(1, ORDER + 1):
            g, c = by[o]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            ctx, inv = np.unique(g >> BITS, return_inverse=True)
            total = np.bincount(inv, c, len(ctx))
            kinds = np.bincount(inv, minlength=len(ctx))
            back = np.log(np.maximum(d * kinds / np.maximum(total, 1e-9), 1e-9))
            if o == 1:
                lower = np.full(len(g), -np.log(symbols))
            else:
                lg, lp = out[o - 1][0], out[o - 1][1]
                lower = lp[np.minimum(np.searchsorted(lg, g & FULL[o - 1]), len(lg) - 1)]
            p = np.maximum(c - d, 0) / np.maximum(total[inv], 1e-9) + np.exp(back[inv] + lower)
            out[o] = (g, np.log(p), ctx, back)
        out[0] = -np.log(symbols)
        return out

    def _resolve(self, grams: np.ndarray) -> np.ndarray:
        """[grams, languages] log probabilities with back-off to shorter contexts."""
        res = np.zeros((len(grams), len(self.languages)))
        for i, lang in enumerate(self.languages):
            tab = self.tables[lang]
            open_, g = np.arange(len(grams)), grams.copy()
            for o in range(ORDER, 0, -1):
                if not len(open_):
                    break
                here = (g > FULL[o - 1]) if o > 1 else np.ones(len(g), bool)
                keys, lp, ctx, back = tab[o]
                at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                hit = here & (keys[at] == g) if len(keys) else np.zeros(len(g), bool)
                res[open_[hit], i] += lp[at[hit]]
                miss = here & ~hit
                if len(ctx):
                    c = g >> BITS
                    at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                    seen = miss & (ctx[at] == c)
                    res[open_[seen], i] += back[at[seen]]
                open_, g = open_[~hit], np.where(here, g & FULL[o - 1], g)[~hit] if o > 1 else g[~hit]
            res[open_, i] += tab[0]
        return res

    def word_logs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """([words, languages] log probabilities, predicted characters of each word)."""
        gram, off = grams_of(words)
        uniq, inv = np.unique(gram, return_inverse=True)
        at = np.minimum(np.searchsorted(self.grams, uniq), max(len(self.grams) - 1, 0))
        known = self.grams[at] == uniq if len(self.grams) else np.zeros(len(uniq), bool)
        logs = np.empty((len(uniq), len(self.languages)))
        logs[known] = self.logs[at[known]]
        logs[~known] = self._resolve(uniq[~known])
        total = np.stack([np.add.reduceat(logs[inv, i], off[:-1]) for i in range(len(self.languages))], 1) if len(gram) else np.zeros((0, len(self.languages)))
        return total, np.diff(off)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """([texts, languages] cross-entropy per character, predicted characters)."""
        idx, off, words = words_of(texts)
        total, chars = self.word_logs(words)
        n = np.concatenate([[0], np.cumsum(chars[idx])])[off]
        length = np.diff(n)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.diff(off) > 0
        if full.any():
            for i in range(len(self.languages)):
                out[full, i] = -np.add.reduceat(total[idx, i], off[:-1][full]) / length[full]
        return out, length

    def judge(self, texts: pa.Array, tolerance: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(language or und, score, rejected, lowest cross-entropy) of each text."""
        if not self.languages or not len(texts):
            z = np.zeros(len(texts))
            return ["und"] * len(texts), z, np.ones(len(texts), bool), z
        h, length = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h.min(axis=1)
        score = 1 / np.exp(-(h - low[:, None]) * np.minimum(length, SURE)[:, None]).sum(axis=1)
        none = ~pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        mu, a, b = np.array([self.limits.get(x, (np.inf, 0.0, 0.0)) for x in self.languages]).T
        far = low > mu[best] + tolerance * (a[best] + b[best] / np.sqrt(np.maximum(length, 1)))
        lang = np.array([*self.languages, "und"], dtype=object)[np.where(none, len(self.languages), best)]
        return lang.tolist(), np.where(none, 0.0, score), none | far, low


def collected(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of each language; at most about ``COLLECT`` rows go to the driver at once."""
    found: dict[str, list] = {}
    shares = -(-counted.count() // COLLECT)
    for k in range(shares):
        t = counted.filter(F.pmod(F.xxhash64("gram"), F.lit(shares)) == k).toArrow()
        lang = t["lang"].combine_chunks().dictionary_encode()
        code, gram, n = lang.indices.to_numpy(), t["gram"].to_numpy(), t["n"].to_numpy()
        for i, x in enumerate(lang.dictionary.to_pylist()):
            found.setdefault(x, []).append((gram[code == i], n[code == i]))
    return {x: tuple(map(np.concatenate, zip(*found.pop(x), strict=True))) for x in sorted(found)}


def medians(m: DataFrame, col: str) -> dict[str, tuple[int, float]]:
    """(rows, exact median of ``col``) of each language.

    Rows are counted in ``CELLS`` equal cells between the smallest and the largest value, then in the cell that holds
    the middle row, and so on until one value is left; the driver gets counts of cells only.
    """
    v = m.select("lang", F.col(col).cast("double").alias("v"))
    rows, within = {}, {}
    for r in v.groupBy("lang").agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # a row for each language
        rows[r["lang"]] = r["k"]
        within |= {(r["lang"], at): (at, r["lo"], r["hi"]) for at in {(r["k"] - 1) // 2, r["k"] // 2}}
    while left := [(x, at, lo, hi) for (x, at), (_, lo, hi) in within.items() if lo < hi]:
        spans = F.broadcast(m.sparkSession.createDataFrame(left, "lang string, at long, lo double, hi double"))
        cell = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)
        inside = v.join(spans, "lang").filter("v between lo and hi").groupBy("lang", "at", cell.alias("cell"))
        cells = inside.agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("cell").collect()
        skip, found = {key: rank for key, (rank, _, _) in within.items()}, {}
        for r in cells:
            key = r["lang"], r["at"]
            if key not in found and skip[key] < r["k"]:
                found[key] = skip[key], r["lo"], r["hi"]
            skip[key] -= r["k"]
        within |= found
    return {x: (k, float(np.mean([within[x, at][1] for at in {(k - 1) // 2, k // 2}]))) for x, k in rows.items()}


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every language of ``train``; counts cover all its rows."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def count(batches):
        held: dict[str, list] = {}

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            g, inv = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return g, np.bincount(inv, np.concatenate([y for _, y in parts]), len(g))

        for big in batches:
            for b in slices(big, "text"):
                langs = b.column(0).dictionary_encode()
                code = langs.indices.to_numpy(zero_copy_only=False)
                idx, off, words = words_of(b.column(1))
                gram, at = grams_of(words)
                owner = np.repeat(code, np.diff(off))
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    n = np.bincount(idx[owner == i], minlength=len(words))
                    w = np.repeat(n, np.diff(at))
                    held.setdefault(lang, []).append(merge([(gram[w > 0], w[w > 0])]))
                    if len(held[lang]) > 16:
                        held[lang] = [merge(held[lang])]
        for lang, p in held.items():
            g, n = merge(p)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = materialize(rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    model = Model(collected(counted))
    if not model.languages:
        return model
    sent = Shipped(train.sparkSession, model)

    def measure(batches):
        model = sent.get()
        for big in batches:
            for b in slices(big, "text"):
                h, length = model.entropies(b.column(1))
                ok = length > 0
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(h.min(axis=1)[ok]), pa.array(length[ok])], names=["lang", "h", "n"])

    m = materialize(rows.select("lang", "text").mapInArrow(measure, "lang string, h double, n long"), "measured")
    mid, half = medians(m, "h"), medians(m, "n")
    at = train.sparkSession.createDataFrame([(x, mid[x][1], half[x][1]) for x in mid], "lang string, mu double, half double")
    spread = F.abs(F.col("h") - F.col("mu")) * 1.4826
    wide, short = F.avg(F.when(F.col("n") >= F.col("half"), spread)), F.avg(spread * F.sqrt("n"))
    for r in m.join(F.broadcast(at), "lang").groupBy("lang").agg(wide.alias("wide"), short.alias("short")).collect():
        model.limits[r["lang"]] = (mid[r["lang"]][1], max(r["wide"], 0.05), max(r["short"], 1.0))
    sure = [model.limits[x] for x in mid if mid[x][0] >= FEW] or list(model.limits.values())
    for x in mid:
        if mid[x][0] < FEW:
            model.limits[x] = tuple(map(max, zip(model.limits[x], *sure, strict=True)))
    return model


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", tolerance: float = 8.0) -> DataFrame:
    """``docs`` with lang_pred, score, rejected and cross_entropy (nats per character)."""
    small_batches(docs.sparkSession)
    sent = Shipped(docs.sparkSession, model)
    docs = without(docs, ["lang_pred", "score", "rejected", "cross_entropy"], text_col)
    names = docs.columns

    def run(batches):
        model = sent.get()
        for big in batches:
            for b in slices(big, text_col):
                lang, score, rejected, low = model.judge(b.column(names.index(text_col)), tolerance)
                new = [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(low)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, "lang_pred", "score", "rejected", "cross_entropy"])

    return docs.mapInArrow(run, f"{ddl(docs)}, lang_pred string, score double, rejected boolean, cross_entropy double")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", tolerance: float = 8.0) -> DataFrame:
    """The rows of ``docs``, as they are, that the model doesn't reject."""
    small_batches(docs.sparkSession)
    sent = Shipped(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = sent.get()
        for big in batches:
            for b in slices(big, text_col):
                yield b.filter(pa.array(~model.judge(b.column(at), tolerance)[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC of the id as text puts a row into the held-out fold (a null id is not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
