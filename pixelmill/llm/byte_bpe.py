"""Byte-level BPE encoding of whole texts in overlapping chunks, and decoding.

Every text is cut into chunks of ``CHUNK`` code points that overlap by ``OVERLAP`` on each side. Each
chunk is pre-tokenised on its own, so its first boundaries may be wrong. Two neighbours are stitched
at the first place in their overlap where both have a boundary, before white space and not at a
chunk's ragged end: there the pre-tokens have resynchronised. The pieces between such places are
encoded; their ids follow one another. Where an overlap has no such place (one very long word), its
chunks are one piece. The pattern must not look back, may look ahead by one character, and may match
white space only alone or before other characters, as the usual ones do; a boundary that two chunks
share is then one of the whole text.

One pass reads the texts. Chunks of texts of up to ``spread`` code points are stitched where they were
read. Longer texts are cut into spans of ``SPAN`` code points, by the same rule, which are dealt to all
executors, first for the boundaries and again for the pieces; the ids come together by document.
Decoding concatenates the bytes of the ids.

Cases: a null text is empty and has no ids. Special tokens' strings are ordinary text. Repeated rows
are kept; an empty table gives an empty one. Rows keep their columns, or those in ``keep``; a column that
is named like an added one (in any case) is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import ddl, materialize, parts, small_batches, without
from pixelmill.llm.shingles import slices

CHUNK, OVERLAP = 2048, 128
SPAN, SPAN_OVERLAP = 32_768, 512  # of texts whose work is dealt
SPREAD = 16_384


class Codec:
    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tool = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)

    def starts(self, chunk: str) -> list[int]:
        """Where the pre-tokens of a chunk begin."""
        ends = list(accumulate(map(len, self.pattern.findall(chunk)), initial=0))
        if ends[-1] == len(chunk):  # they cover the chunk
            return ends[:-1]
        return [m.start() for m in self.pattern.finditer(chunk)]

    def zones(self, chunk: str, lead: int, overlap: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
        """Boundaries before white space in the overlaps with the chunk before and the chunk after, relative to the chunk.

        None are in the last pre-token, which the chunk's end may have cut.
        """
        if first and last:
            return [], []
        starts = self.starts(chunk)[:-1]
        left = [] if first else starts[bisect_left(starts, 1) : bisect_left(starts, lead + overlap)]
        right = [] if last else starts[bisect_left(starts, max(1, len(chunk) - 2 * overlap)) :]
        return tuple([p for p in zone if chunk[p].isspace() and not chunk[p - 1].isspace()] for zone in (left, right))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text: chunks, stitched, then encoded piece by piece."""
        spans = chunk_spans(len(text), CHUNK, OVERLAP)
        zone = [(a, *self.zones(text[a:b], lead, OVERLAP, not k, k + 1 == len(spans))) for k, (a, b, lead) in enumerate(spans)]
        cut = [0, *stitch([(a, left) for a, left, _ in zone], [(a, right) for a, _, right in zone]), len(text)]
        return np.array([i for a, b in pairwise(cut) for i in self.tool.encode_ordinary(text[a:b])], np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tool.decode_bytes(ids.tolist())


def chunk_spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, lead) of each chunk; ``lead`` code points of it belong to the chunk before."""
    return [(max(0, a - overlap), min(n, a + chunk + overlap), min(a, overlap)) for a in range(0, n, chunk)]


def stitch(left: list[tuple[int, list[int]]], right: list[tuple[int, list[int]]]) -> list[int]:
    """The first common boundary of each pair of neighbours, where there is one."""
    out = []
    for (a, r), (b, s) in zip(right, left[1:], strict=False):
        both = {a + p for p in r} & {b + p for p in s}
        if both and (not out or min(both) > out[-1]):
            out.append(min(both))
    return out


def codec(ranks: str, pattern: str) -> Codec:
    """This worker's codec; kept on the library's module, as functions here travel by value."""
    import tiktoken

    kept = vars(tiktoken).setdefault("_pixelmill_codecs", {})
    if (ranks, pattern) not in kept:
        kept[ranks, pattern] = Codec(ranks, pattern)
    return kept[ranks, pattern]


NEW = "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def _digest(ids: list[np.ndarray], tool: Codec, with_ids: bool) -> list[pa.Array]:
    raw = [x.astype("<u4").tobytes() for x in ids]
    return [
        pa.array([len(x) for x in ids], pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary()),
        pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([hashlib.sha256(tool.decode(x)).hexdigest() for x in ids], pa.string()),
    ]


def encode(
    docs: DataFrame, *, ranks: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True, spread: int = SPREAD
) -> DataFrame:
    """``docs`` (its columns in ``keep``, or all) with n_tokens, ids (little-endian uint32; null unless ``with_ids``), ids_sha256 and decoded_sha256."""
    small_batches(docs.sparkSession)
    kept = docs if keep is None else docs.select(*keep)
    kept = without(kept, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"], text_col)
    names = kept.columns
    src = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias("__text"))
    fields = ddl(src.select(*names))

    def read(batches):
        tool = codec(ranks, pattern)
        for big in batches:
            for b in slices(big, "__text"):
                texts = [t or "" for t in b.column(len(names)).to_pylist()]
                far = [len(t) > spread for t in texts]
                found = _digest([np.zeros(0, np.uint32) if f else tool.encode(t) for t, f in zip(texts, far, strict=True)], tool, with_ids)
                later = pa.array([t if f else None for t, f in zip(texts, far, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *found, later], names=[*names, "n_tokens", "ids", "ids_sha256", "decoded_sha256", "__text"])

    # written once, so that long texts are dealt without a second look at the others
    first = materialize(src.mapInArrow(read, f"{fields}{', ' if names else ''}{NEW}, __text string"), "encoded")
    done = first.filter("__text is null").drop("__text")
    return done.unionByName(_deal(first.filter("__text is not null").select(*names, "__text"), names, fields, ranks, pattern, with_ids))


def _deal(docs: DataFrame, names: list[str], fields: str, ranks: str, pattern: str, with_ids: bool) -> DataFrame:
    """The same for long texts, whose spans are dealt to all executors."""
    docs = materialize(docs.withColumn("__key", F.expr("uuid()")), "long-texts")  # written once, so the keys stay
    n = parts(docs.sparkSession)

    def cut(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = chunk_spans(len(t), SPAN, SPAN_OVERLAP)
                for i, (a, e, lead) in enumerate(spans):
                    row = [[k], [i], [len(spans)], [a], [lead], [t[a:e]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["key", "i", "of", "a", "lead", "chunk"])

    chunks = docs.select("__key", "__text").mapInArrow(cut, "key string, i long, of long, a long, lead long, chunk string")
    chunks = materialize(chunks.repartition(n, "key", "i"), "spans")

    def look(batches):
        tool = codec(ranks, pattern)
        for b in batches:
            c = b.to_pydict()
            zone = [tool.zones(t, lead, SPAN_OVERLAP, not i, i + 1 == of) for t, lead, i, of in zip(c["chunk"], c["lead"], c["i"], c["of"], strict=True)]
            cols = [pa.array([[a + p for p in z[s]] for a, z in zip(c["a"], zone, strict=True)], pa.list_(pa.int64())) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["key", "i", "left", "right"])

    zones = chunks.mapInArrow(look, "key string, i long, left array<long>, right array<long>")
    after = zones.select("key", (F.col("i") - 1).alias("i"), F.col("left").alias("theirs"))
    met = zones.join(after, ["key", "i"], "left").select("key", "i", F.array_min(F.array_intersect("right", F.coalesce("theirs", F.array().cast("array<long>")))).alias("cut"))
    # spans without a common boundary go on in the piece of the span before
    order = Window.partitionBy("key").orderBy("i")
    cuts = materialize(
        met.withColumn("piece", F.coalesce(F.sum(F.col("cut").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("from", F.max("cut").over(order.rowsBetween(Window.unboundedPreceding, -1))),
        "cuts",
    )
    joined = chunks.join(cuts, ["key", "i"])

    def put(t: pa.Table) -> pa.Table:
        tool = codec(ranks, pattern)
        c = t.sort_by([("i", "ascending")]).to_pydict()
        text, base = c["chunk"][0], c["a"][0]
        for chunk, a in list(zip(c["chunk"], c["a"], strict=True))[1:]:
            text = text[: a - base] + chunk
        begin = (c["from"][0] or 0) - base
        stop = c["cut"][-1]
        ids = tool.encode(text[begin : len(text) if stop is None else stop - base]).astype("<u4")
        return pa.table({"key": [c["key"][0]], "piece": pa.array([c["piece"][0]], pa.int64()), "piece_ids": pa.array([ids.tobytes()], pa.binary())})

    pieces = joined.groupBy("key", "piece").applyInArrow(put, "key string, piece long, piece_ids binary")
    whole = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "piece_ids"))).alias("__pieces"))
    out = docs.drop("__text").join(whole.withColumnRenamed("key", "__key"), "__key").select(*names, "__pieces")

    def finish(batches):
        tool = codec(ranks, pattern)
        for b in batches:
            ids = [np.frombuffer(b"".join(x["piece_ids"] for x in p), "<u4") for p in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *_digest(ids, tool, with_ids)], names=[*names, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return out.mapInArrow(finish, f"{fields}{', ' if names else ''}{NEW}")
