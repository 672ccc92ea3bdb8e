"""Token ids of documents in Simple-8b files, in ascending id order, and their reader.

Texts are encoded with a byte-level tokenizer file and the ``tokenizers`` library as it comes, without
special tokens added; the string of a special token in a text is that token, as the library has it by
default. Where the file is a plain byte-level BPE (checked: pre-tokenizer, model options, no normaliser),
merges never cross a pre-token: the library encodes each distinct pre-token once, and a text's ids are
put together from them. Texts with characters outside plain Latin or with a string of an added token,
and all texts of any other file, go to the library whole. An end id follows every document. Documents are dealt by id ranges and sorted; each task writes segments of
about ``SEGMENT`` ids. The container is Parquet, so any store that Spark writes takes it and lost
tasks are redone by its commit protocol: part, segment, n_ids, doc_ids and null flags, lengths
(uint32), block offsets (int64) and words (uint64), all little-endian. An index table has the ids
before each part; both together give each document's start.

Cases: a null text is empty and has the end id only; null ids come first; repeated ids are ordered
by text hash; an empty table writes no segment.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.llm import simple8b
from pixelmill.llm.common import parts, shared_dir
from pixelmill.llm.shingles import slices

SEGMENT = 1 << 20
SLICE = 6_000_000  # bytes of text that are encoded at once
MOST_WORDS = 700_000  # distinct pre-tokens that a worker remembers
# Characters whose classes agree in every regular-expression engine; other texts take the long way.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
ODD = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e{LETTER}‐-‧‰-⁞€]")
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")


# The byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the others come from 256 on.
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_LEVEL = dict(zip([*_OWN, *(b for b in range(256) if b not in _OWN)], [*map(chr, _OWN), *(chr(256 + i) for i in range(256 - len(_OWN)))], strict=True))


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE with the usual pre-tokens and nothing else that changes ids."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(not t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


class Encoder:
    """Ids of texts; remembers the ids of pre-tokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = plain_byte_level(spec)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.forget()

    def whole(self, text: str) -> bool:
        """Whether the library has to encode the text itself."""
        return not self.plain or bool(ODD.search(text)) or any(a in text for a in self.added)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Add the ids of pre-tokens: the library's merges over the byte-level form of each."""
        merge = self.tool.model.tokenize
        got = [[t.id for t in merge(w.encode().decode("latin-1").translate(BYTE_LEVEL))] for w in words]
        n = np.fromiter(map(len, got), np.int64, len(got))
        end = self.start[-1] + n.sum()
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.start[-1]], np.zeros(int(end) + len(self.ids) - self.start[-1], np.uint32)])
        self.ids[self.start[-1] : end] = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        odd = [self.whole(t) for t in texts]
        split = [[] if o else PRE_TOKEN.findall(t) for t, o in zip(texts, odd, strict=True)]
        count = np.fromiter(map(len, split), np.int64, len(split))
        enc = pa.array(chain.from_iterable(split), pa.string(), size=int(count.sum())).dictionary_encode()
        words = enc.dictionary.to_pylist()
        if len(self.index) > MOST_WORDS:
            self.forget()
        known = np.fromiter((-1 if i is None else i for i in map(self.index.get, words)), np.int64, len(words))
        fresh = np.flatnonzero(known < 0)
        known[fresh] = np.arange(len(fresh)) + len(self.index)
        self.learn([words[i] for i in fresh])
        idx = known[enc.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        n = self.start[idx + 1] - self.start[idx]
        flat = self.ids[np.repeat(self.start[idx] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        off = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        if any(odd):
            rest = self.tool.encode_batch_fast([t for t, o in zip(texts, odd, strict=True) if o], add_special_tokens=False)
            whole = {i: np.array(e.ids, np.uint32) for i, e in zip(np.flatnonzero(odd), rest, strict=True)}
            pieces = [whole.get(i, flat[off[i] : off[i + 1]]) for i in range(len(texts))]
            return np.concatenate(pieces), np.array(list(map(len, pieces)), np.int64)
        return flat, np.diff(off)


def encoder(path: str) -> Encoder:
    """This worker's encoder; kept on the library's module, as functions here travel by value."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_pixelmill_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


FILE = "part int, segment long, n_ids long, doc_ids binary, nulls binary, lengths binary, offsets binary, words binary"


def write(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of ``docs`` under ``path``."""
    n = parts(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def segment(number: int, held: list) -> pa.RecordBatch:
        ids, docs_, nulls, lens = (np.concatenate(x) for x in zip(*held, strict=True))
        words, offsets = simple8b.encode(ids)
        blobs = [docs_.tobytes(), np.packbits(nulls).tobytes(), lens.astype(np.uint32).tobytes(), offsets.tobytes(), words.tobytes()]
        cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)]
        return pa.RecordBatch.from_arrays(cols, names=["part", "segment", "n_ids", "doc_ids", "nulls", "lengths", "offsets", "words"])

    def run(batches):
        enc, held, size, number = encoder(tokenizer), [], 0, 0
        for big in batches:
            for b in slices(big, "text", SLICE):
                gc.disable()  # millions of strings and no cycles
                ids, lens = enc.encode(b.column(1).to_pylist())
                gc.enable()
                full = np.full(len(ids) + len(lens), end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[np.cumsum(lens + 1) - 1] = False
                full[keep] = ids
                key = pc.fill_null(b.column(0), 0).to_numpy()
                held.append((full, key, b.column(0).is_null().to_numpy(zero_copy_only=False), lens + 1))
                size += len(full)
                if size >= SEGMENT:
                    yield segment(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield segment(number, held)

    src.mapInArrow(run, FILE).write.parquet(f"{path}/segments")
    files = docs.sparkSession.read.schema(FILE).parquet(f"{path}/segments")
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    by_part = {r["part"]: r["n"] for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    base, rows = 0, []
    for p in sorted(by_part):
        rows.append((p, base))
        base += by_part[p]
    bases = docs.sparkSession.createDataFrame(rows, "part int, base long")
    before = F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")
    sizes.withColumn("before", before).join(bases, "part").select("part", "segment", (F.col("base") + F.col("before")).alias("first")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32) of every document in the files."""
    files = spark.read.schema(FILE).parquet(f"{path}/segments")
    index = spark.read.schema("part int, segment long, first long").parquet(f"{path}/index")

    def run(batches):
        for b in batches:
            for part in range(b.num_rows):
                c = {k: b.column(i)[part].as_py() for i, k in enumerate(b.schema.names)}
                lens = np.frombuffer(c["lengths"], np.uint32).astype(np.int64)
                ids = simple8b.decode(np.frombuffer(c["words"], np.uint64), np.frombuffer(c["offsets"], np.int64), c["n_ids"]).astype("<u4")
                end = np.cumsum(lens)
                nulls = np.unpackbits(np.frombuffer(c["nulls"], np.uint8))[: len(lens)].astype(bool)
                doc = pa.array(np.frombuffer(c["doc_ids"], np.int64), mask=nulls)
                raw = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(np.concatenate([[0], end * 4]).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([doc, pa.array(c["first"] + end - lens), pa.array(lens), raw], names=["doc_id", "start", "n_tokens", "ids"])

    return files.join(index, ["part", "segment"]).select("*").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, *, tokenizer: str, **options) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written to the shared folder."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/pixelmill-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer=tokenizer, **options)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
