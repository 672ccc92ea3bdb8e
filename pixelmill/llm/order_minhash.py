"""Order MinHash fingerprints of whole texts, and of each text edited with the next document.

A text's words form k-mers of ``K`` words, each numbered by its occurrence. Numbered k-mers are
hashed into ``BUCKETS`` buckets (one permutation split into ranges, instead of one permutation for
each bucket); in every bucket the two smallest are selected, put into text order and hashed as a
tuple. Words in another order give other tuples, so the share of equal tuples follows edit distance
more closely than plain MinHash. DataFrame functions only: arrays inside a row, no exploding.

A k-mer is one long: its hash and, in the lowest bits, its position. A text takes as many position bits
as its k-mers need, so that any text fits (a string of 2 GB has fewer than 2^30 words) and short ones
keep long hashes to tell repeats by. The ``HASH_BITS`` upper bits, which every text has, are the k-mer's
identity in the tuples, so fingerprints of texts of any length compare.

A fingerprint is the list of (bucket, 16-bit tuple hash), as hex; likeness is the number of equal
entries over the number of buckets that either has.

Cases: a null text is empty; an empty text has an empty fingerprint; two empty fingerprints are
alike (1.0). Fewer than K words are one k-mer. Documents go by descending id, nulls last, ties by
text hash; a table of one row follows itself. Repeated rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import parts

K = 2
BUCKETS = 64  # six bits
MOST_POS_BITS = 30  # 2^30 words don't fit in a string
HASH_BITS = 64 - MOST_POS_BITS
SPACE = " \t\n\x0b\x0c\r"


def _count(n: Column) -> Column:
    """[0, ..., n - 1]."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _name(x: Column) -> Column:
    """The part of a k-mer's hash that every text has."""
    return F.shiftright(x, MOST_POS_BITS)


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 58)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, an array of ints bucket * 65536 + tuple hash, sorted by bucket.

    Each step is a column of its own, so that arrays which a lambda indexes are computed once.
    """
    w, n, p, a, b = (f"{out}_{x}" for x in ("w", "n", "p", "a", "b"))
    keep = [c for c in df.columns]
    trimmed = F.btrim(F.col(text), F.lit(SPACE))
    df = df.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    df = df.withColumn(n, F.greatest(F.size(w) - (K - 1), F.least(F.size(w), F.lit(1))))
    df = df.withColumn(p, F.length(F.bin(F.col(n).cast("long"))))  # position bits
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(p)) - 1
    full = lambda x: F.call_function("shiftright", x, F.col(p))
    kmer = F.transform(
        _count(F.col(n)),
        lambda i: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(K))).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
    )
    df = df.select(*keep, p, F.sort_array(kmer).alias(a))
    at = lambda j: F.get(F.col(a), j)

    def occurrence(x: Column, j: Column) -> Column:
        """j minus the start of the run of equal k-mers, which a binary search finds."""
        lo = F.aggregate(
            F.array(*(F.lit(1 << s) for s in range(MOST_POS_BITS - 1, -1, -1))), j,
            lambda q, s: F.when((q - s >= 0) & (full(at(q - s)) == full(x)), q - s).otherwise(q),
        )
        return j - lo

    def numbered(x: Column, j: Column) -> Column:
        same = lambda d: (j >= d) & (full(at(j - d)) == full(x))
        occ = F.when(~same(2), F.lit(1)).when(~same(3), F.lit(2)).when(~same(4), F.lit(3)).otherwise(occurrence(x, j))
        again = F.xxhash64(_name(x), occ).bitwiseAND(F.bitwise_not(low)).bitwiseOR(x.bitwiseAND(low))
        return F.when((j > 0) & (full(at(j - 1)) == full(x)), again).otherwise(x)

    df = df.select(*keep, p, F.sort_array(F.transform(F.col(a), numbered)).alias(b))
    first = F.filter(F.col(b), lambda x, j: (j < 2) | (_bucket(F.get(F.col(b), j - 2)) != _bucket(x)))
    df = df.select(*keep, p, first.alias(a))

    def entry(j: Column) -> Column:
        x, y = at(j), at(j + 1)
        pair = y.isNotNull() & (_bucket(x) == _bucket(y))
        swap = pair & (y.bitwiseAND(low) < x.bitwiseAND(low))
        tup = F.when(~F.coalesce(pair, F.lit(False)), F.xxhash64(_name(x))).when(swap, F.xxhash64(_name(y), _name(x))).otherwise(F.xxhash64(_name(x), _name(y)))
        return (_bucket(x) * 65536 + tup.bitwiseAND(F.lit(0xFFFF))).cast("int")

    heads = F.filter(_count(F.size(a)), lambda j: (j == 0) | (_bucket(at(j - 1)) != _bucket(at(j))))
    return df.select(*keep, F.transform(heads, entry).alias(out))


def likeness(x: str, y: str) -> Column:
    """Equal entries over buckets that either fingerprint has."""
    bucket = lambda c: F.transform(F.col(c), lambda e: F.shiftright(e, 16))
    either = F.size(F.array_union(bucket(x), bucket(y)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.col(x), F.col(y))) / F.greatest(either, F.lit(1)))


def as_text(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda e: F.lpad(F.lower(F.hex(e)), 6, "0")), "")


def with_guests(docs: DataFrame, id_col: str) -> DataFrame:
    """Add range and guest: rows by range of the id, with the row that follows a range as its guest.

    Ids are cut into ranges; the top rows of a range are also sent to the range above, so one
    exchange is enough and no task sees more than its ranges.
    """
    ranges = max(32, 4 * parts(docs.sparkSession))
    ids = docs.select(F.col(id_col).alias("i"))
    qs = ids.agg(F.percentile_approx("i", [q / ranges for q in range(1, ranges)], 20 * ranges).alias("q")).first()["q"]
    cuts = sorted(set(qs or []))
    # the range of an id: binary search over the cuts; null ids are in the lowest range
    edges = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<long>")
    steps = F.array(*(F.lit(1 << s) for s in range(max(1, len(cuts)).bit_length() - 1, -1, -1)))
    rank = lambda i: F.aggregate(
        steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & F.coalesce(F.get(edges, p + s - 1) < i, F.lit(False)), p + s).otherwise(p)
    )
    tops = {r["r"]: r["m"] for r in ids.groupBy(rank(F.col("i")).alias("r")).agg(F.max("i").alias("m")).collect()}  # one row a range
    used = sorted(tops)
    up = {r: used[(k + 1) % len(used)] for k, r in enumerate(used)}  # the range of the row before a range's top; the highest goes on with the lowest
    if used:
        top = F.get(F.array(*(F.lit(tops.get(r)).cast("long") for r in range(used[-1] + 1))), F.col("range"))
        to = F.get(F.array(*(F.lit(up.get(r)).cast("int") for r in range(used[-1] + 1))), F.col("range"))
    else:
        top, to = F.lit(None).cast("long"), F.lit(0)
    places = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(to.alias("range"), F.lit(True).alias("guest")))
    here = docs.withColumn("range", rank(F.col(id_col))).withColumn("place", F.explode(F.filter(places, lambda p: ~p["guest"] | F.col(id_col).eqNullSafe(top))))
    here = here.withColumns({"range": F.col("place.range"), "guest": F.col("place.guest")}).drop("place")
    return here


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    here = with_guests(src, "doc_id")
    here = here.repartition(4 * parts(docs.sparkSession), "range")
    here = with_fingerprint(here, "text", "fp")
    w = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    here = here.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).filter(~F.col("guest"))
    here = here.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    here = here.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    here = here.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    here = with_fingerprint(here, "edited", "efp")
    return here.select(
        "doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
