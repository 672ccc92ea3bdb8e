"""Queries over manifests: duplicates, leakage, cross-tables, profiles, joins, sets, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import scalars as S
from pixelmill.operators import dedup as D
from pixelmill.operators import profiles as P
from pixelmill.plans.region_queries import rounded
from pixelmill.plans.tables import MANIFEST_SQL, manifest, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "lang", "source", "n_chars")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", S.average_hash(F.col("embedding")).alias("h"))


def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.duplicate_groups(_docs(spark, sf_dir), "sha256", "doc_id")
    return g.select("sha256", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mark_duplicates(_docs(spark, sf_dir), "sha256", "source", ["n_chars", "doc_id"]).select("doc_id", "copies", "status")


def dup_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("h", F.conv(F.substring("sha256", 1, 15), 16, 10).cast("long"))
    return D.prepare_marks(docs, id_col="doc_id", key="sha256", hash_col="h", label="lang", order=["doc_id"]).select("doc_id", "near_duplicate", "status")


def avg_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(spark, sf_dir).select("vec_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(_hashes(spark, sf_dir), "vec_id", "h", 16)


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.leaks(manifest(spark, sf_dir), "group_id")
    return out.select("group_id", F.array_join("splits", ",").alias("splits"))


def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cross_table(manifest(spark, sf_dir), "label", ["format", "acquisition", "split"])


def grouping_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumn("ratio", F.when(F.col("sample_id") % 4 != 0, F.col("price") / 1000)).withColumn("flat", F.lit(1.0))
    return rounded(P.quality_profile(m, ["price", "ratio", "flat"], "split", "label"), 4)


def counter_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).groupBy("label", "format").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"))


def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("flags", F.json_object_keys("props")).withColumn("flags", F.array_union("flags", F.array("event_type")))
    return P.flag_histogram(e, "flags")


def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    return P.terciles(e, "v", "event_type")


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumn("odd", F.when(F.col("sample_id") % 2 == 1, F.col("price")))
    return rounded(P.class_summary(m, "label", ["price", "odd"]), 4)


def class_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumn("tell", F.when(F.col("label") == "ai_generated", "png").otherwise("jpg"))
    return P.class_separation(m, "label", ["format", "acquisition", "tell"])


def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audit(manifest(spark, sf_dir), {"ai_generated": 5000, "non_ai_generated": 300, "other": 0}, "label")


def split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    splits = m.filter("split is not null").select("sample_id", "split")
    out = m.drop("split").join(splits, "sample_id", "left")
    return out.groupBy(F.coalesce("split", F.lit("(none)")).alias("split"), "label").agg(F.count("*").alias("n"))


def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    done = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def semi_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rich = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def ref_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    ours = m.filter("sample_id % 50 <> 0")
    theirs = m.filter("sample_id % 60 <> 0").withColumn("price", F.col("price") + F.when(F.col("sample_id") % 70 == 0, 1).otherwise(0))
    theirs = theirs.withColumn("label", F.when(F.col("sample_id") % 80 == 0, "other").otherwise(F.col("label")))
    return D.compare_runs(ours.dropDuplicates(["sample_id"]), theirs.dropDuplicates(["sample_id"]), "sample_id", "price", "label")


def lookup_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    some = d.filter("doc_id % 3 = 0").select("doc_id", F.col("sha256").alias("input_sha256"))
    return d.join(some, "doc_id", "left").select("doc_id", F.coalesce("input_sha256", F.lit("")).alias("input_sha256"))


def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")).distinct()
    return t.select("feature", F.explode(F.array(*map(F.lit, ("mean", "median", "std")))).alias("stat")).select(F.concat_ws(".", "feature", "stat").alias("column_name"))


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    both = m.filter("split = 'train'").unionByName(m.filter("split = 'validation'"))
    return both.groupBy("split", "label").agg(F.count("*").alias("n"))


def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("band")).exceptAll(
        s.select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).cast("long").alias("band"))
    )


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 500).cast("long").alias("band")).intersect(
        s.select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 500).cast("long").alias("band"))
    )


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.slug(F.col("url")).alias("slug"), S.slug(F.regexp_replace("url", "[A-Za-z0-9]", "!")).alias("bare"))


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    tail = F.concat(F.when(F.col("page_id") % 5 == 0, "../").when(F.col("page_id") % 5 == 1, "/").when(F.col("page_id") % 5 == 2, "C:\\").otherwise("a/"), F.col("page_id").cast("string"))
    return p.select("page_id", S.safe_relative_path(tail).alias("safe"), S.safe_relative_path(F.concat(F.lit("a/b/../"), tail)).alias("deep"))


def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    word = F.when(k == 0, " Real ").when(k == 1, "AI-generated").when(k == 2, "non_ai_generated").when(k == 3, "FAKE").when(k == 4, "ai").otherwise("other")
    proto, pilot = S.prototype_label(word), S.pilot_label(word)
    return e.select("event_id", proto.alias("prototype"), pilot.alias("pilot"), S.label_code(F.coalesce(proto, pilot)).alias("code"))


def scalar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 7
    word = F.when(k == 0, "yes").when(k == 1, " TRUE").when(k == 2, "0").when(k == 3, "").when(k == 4, "1.0").when(k == 5, "2.5e3").otherwise("x")
    return rounded(e.select("event_id", S.bool_like(word).alias("flag"), S.number(word).alias("number"), S.sigmoid(F.col("value") - 50).alias("sigmoid"), S.close(F.col("value"), F.col("value") * (1 + 1e-10)).alias("close")))


def occurrence_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return D.occurrence_ids(d, F.col("lang"), "sha256", ["doc_id"]).select("doc_id", "occurrence_id")


def unique_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("img"), (F.col("doc_id") % 40).cast("string")).alias("base"))
    return D.unique_ids(d, F.col("base"), ["doc_id"]).select("doc_id", "unique_id")


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return D.balanced_sample(d, "lang", "doc_id", 42).select("doc_id", "selected")


def checkpoint_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each user, as a resumed run reads its checkpoint."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.filter(F.lower("p_type").contains("st") | F.lower("p_name").contains("st")).select("p_partkey", "p_type")


def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-25 report: influence order by drop, change, name."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 4).alias("drop"), F.round(F.avg("l_tax"), 4).alias("change"))
    return o.orderBy(F.desc("drop"), F.desc(F.abs("change")), "l_suppkey").limit(25)


QUERIES = {
    f.__name__: f
    for f in (
        exact_dups, dup_keep_first, dup_review, avg_hash, near_dup_pairs, leakage_check, label_crosstab, grouping_profile, counter_group_by, flag_histogram, terciles,
        class_summary, class_separation, expected_counts, split_join, anti_resume, semi_selected, ref_compare, lookup_checksums, feature_statistics, set_union, set_except,
        set_intersect, slug, path_safety, label_normalize, scalar_checks, occurrence_id, unique_id, balanced_sample, checkpoint_last, file_hashes, text_search, top_features,
    )
}

M = f"WITH {MANIFEST_SQL}"
DOCS_SQL = "docs AS (SELECT doc_id, sha256(text) AS sha256, lang, source, n_chars FROM documents)"
HASH_SQL = """v AS (SELECT vec_id, embedding AS e, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS mean FROM embeddings),
bits AS (SELECT vec_id, list_aggregate(list_transform(e, lambda x: CASE WHEN CAST(x AS DOUBLE) >= mean THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM v)"""

ORACLE = {
    "exact_dups": f"WITH {DOCS_SQL} SELECT sha256, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM docs GROUP BY sha256 HAVING count(*) > 1",
    "dup_keep_first": f"""WITH {DOCS_SQL}, g AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS copies, row_number() OVER (PARTITION BY sha256 ORDER BY n_chars, doc_id) AS n FROM docs),
k AS (SELECT sha256, count(DISTINCT source) AS labels FROM docs GROUP BY sha256)
SELECT doc_id, copies, CASE WHEN labels > 1 THEN 'review' WHEN n = 1 THEN 'included' ELSE 'excluded' END AS status FROM g JOIN k USING (sha256)""",
    "dup_review": f"""WITH {DOCS_SQL}, g AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS copies, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS n FROM docs),
k AS (SELECT sha256, count(DISTINCT lang) AS labels FROM docs GROUP BY sha256)
SELECT doc_id, copies > 1 AS near_duplicate, CASE WHEN labels > 1 THEN 'review' WHEN n > 1 THEN 'excluded' WHEN copies > 1 THEN 'review' ELSE 'included' END AS status FROM g JOIN k USING (sha256)""",
    "avg_hash": f"WITH {HASH_SQL} SELECT vec_id, bits FROM bits",
    "near_dup_pairs": f"""WITH {HASH_SQL} SELECT a.vec_id AS a, b.vec_id AS b, CAST(hamming(a.bits, b.bits) AS INT) AS distance FROM bits a JOIN bits b ON a.vec_id < b.vec_id AND hamming(a.bits, b.bits) <= 16""",
    "leakage_check": f"{M} SELECT group_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM manifest WHERE split IS NOT NULL GROUP BY group_id HAVING count(DISTINCT split) > 1",
    "label_crosstab": f"""{M} SELECT 'format' AS dimension, format AS value, label, count(*) AS n FROM manifest GROUP BY 2, 3 UNION ALL
SELECT 'acquisition', acquisition, label, count(*) FROM manifest GROUP BY 2, 3 UNION ALL SELECT 'split', split, label, count(*) FROM manifest GROUP BY 2, 3""",
    "grouping_profile": f"""{M}, f AS (SELECT split, label, 'price' AS feature, price AS value FROM manifest
UNION ALL SELECT split, label, 'ratio', CASE WHEN sample_id % 4 <> 0 THEN price / 1000 END FROM manifest UNION ALL SELECT split, label, 'flat', 1.0::DOUBLE FROM manifest),
g AS (SELECT feature, split, label, grouping(split) AS gs, grouping(label) AS gl, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, CAST(0 AS BIGINT) AS nonfinite, min(value) AS least, max(value) AS greatest, count(DISTINCT value) AS unique_values
FROM f GROUP BY GROUPING SETS ((feature), (feature, split), (feature, label)))
SELECT feature, CASE WHEN gs = 1 AND gl = 1 THEN 'all' WHEN gs = 0 THEN 'split' ELSE 'label' END AS level, CASE WHEN gs = 0 THEN split WHEN gl = 0 THEN label END AS member, n, nulls, nonfinite,
round(least, 4) AS least, round(greatest, 4) AS greatest, unique_values, unique_values <= 1 AS constant FROM g""",
    "counter_group_by": f"{M} SELECT label, format, count(*) AS n, count(DISTINCT group_id) AS groups FROM manifest GROUP BY 1, 2",
    "flag_histogram": "WITH f AS (SELECT unnest(list_distinct(list_append(json_keys(props), event_type))) AS flag FROM events) SELECT flag, count(*) AS n FROM f GROUP BY 1",
    "terciles": """WITH e AS (SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events),
q AS (SELECT quantile_cont(v, 1.0::DOUBLE / 3) AS a, quantile_cont(v, 2.0::DOUBLE / 3) AS b FROM e)
SELECT event_type, CASE WHEN v IS NULL THEN 'unavailable' WHEN v <= a THEN 'low' WHEN v <= b THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n FROM e, q GROUP BY 1, 2""",
    "class_summary": f"""{M}, f AS (SELECT label, 'price' AS feature, price AS value FROM manifest UNION ALL SELECT label, 'odd', CASE WHEN sample_id % 2 = 1 THEN price END FROM manifest)
SELECT label, feature, count(value) AS n, round(min(value), 4) AS least, round(max(value), 4) AS greatest, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median,
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(avg(CAST(value IS NULL AS INT)), 4) AS missing_rate FROM f GROUP BY 1, 2""",
    "class_separation": f"""{M}, f AS (SELECT label, 'format' AS dimension, format AS value FROM manifest UNION ALL SELECT label, 'acquisition', acquisition FROM manifest
UNION ALL SELECT label, 'tell', CASE WHEN label = 'ai_generated' THEN 'png' ELSE 'jpg' END FROM manifest),
p AS (SELECT dimension, value, count(DISTINCT label) AS k, min(label) AS lo FROM f WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT dimension, max(k) = 1 AND count(DISTINCT lo) FILTER (k = 1) > 1 AS separated FROM p GROUP BY 1""",
    "expected_counts": f"""{M}, w AS (SELECT * FROM (VALUES ('ai_generated', 5000), ('non_ai_generated', 300), ('other', 0)) t(label, expected)), n AS (SELECT label, count(*) AS n FROM manifest GROUP BY 1)
SELECT coalesce(w.label, n.label) AS label, coalesce(n, 0) AS n, CAST(expected AS BIGINT) AS expected, coalesce(n, 0) IS NOT DISTINCT FROM expected AS ok FROM w FULL JOIN n ON w.label = n.label""",
    "split_join": f"{M} SELECT coalesce(split, '(none)') AS split, label, count(*) AS n FROM manifest GROUP BY 1, 2",
    "anti_resume": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)",
    "semi_selected": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "ref_compare": f"""{M}, a AS (SELECT * FROM manifest WHERE sample_id % 50 <> 0), b AS (SELECT sample_id, CASE WHEN sample_id % 80 = 0 THEN 'other' ELSE label END AS label, price + CASE WHEN sample_id % 70 = 0 THEN 1 ELSE 0 END AS price FROM manifest WHERE sample_id % 60 <> 0),
j AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, CASE WHEN a.sample_id IS NULL THEN 'missing' WHEN b.sample_id IS NULL THEN 'unexpected' WHEN a.label <> b.label THEN 'label'
WHEN abs(a.price - b.price) > greatest(1e-9 * greatest(abs(a.price), abs(b.price)), 1e-12) THEN 'score' END AS reason FROM a FULL JOIN b ON a.sample_id = b.sample_id)
SELECT * FROM j WHERE reason IS NOT NULL""",
    "lookup_checksums": f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256 ELSE '' END AS input_sha256 FROM docs",
    "feature_statistics": "SELECT DISTINCT p_brand || '.' || s AS column_name FROM part, (VALUES ('mean'), ('median'), ('std')) t(s)",
    "set_union": f"{M} SELECT split, label, count(*) AS n FROM manifest WHERE split IN ('train', 'validation') GROUP BY 1, 2",
    "set_except": "SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 100) AS BIGINT) AS band FROM customer EXCEPT ALL SELECT s_nationkey, CAST(floor(s_acctbal / 100) AS BIGINT) FROM supplier",
    "set_intersect": "SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 500) AS BIGINT) AS band FROM customer INTERSECT SELECT s_nationkey, CAST(floor(s_acctbal / 500) AS BIGINT) FROM supplier",
    "slug": """SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'image') AS slug,
coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[A-Za-z0-9]', '!', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'image') AS bare FROM pages""",
    "path_safety": "SELECT page_id, page_id % 5 IN (3, 4) AS safe, page_id % 5 <> 0 OR true AS deep FROM pages",
    "label_normalize": """WITH p AS (SELECT event_id, event_id % 6 AS k FROM events),
q AS (SELECT event_id, CASE k WHEN 0 THEN 'non_ai_generated' WHEN 1 THEN 'ai_generated' WHEN 2 THEN 'non_ai_generated' END AS prototype, CASE k WHEN 0 THEN 'REAL' WHEN 1 THEN 'AI_GENERATED' WHEN 3 THEN 'AI_GENERATED' WHEN 4 THEN 'AI_GENERATED' END AS pilot FROM p)
SELECT *, CASE coalesce(prototype, pilot) WHEN 'non_ai_generated' THEN 0 WHEN 'ai_generated' THEN 1 WHEN 'REAL' THEN 0 WHEN 'AI_GENERATED' THEN 1 END AS code FROM q""",
    "scalar_checks": """WITH p AS (SELECT *, event_id % 7 AS k FROM events), w AS (SELECT *, CASE k WHEN 0 THEN 'yes' WHEN 1 THEN ' TRUE' WHEN 2 THEN '0' WHEN 3 THEN '' WHEN 4 THEN '1.0' WHEN 5 THEN '2.5e3' ELSE 'x' END AS word FROM p)
SELECT event_id, CASE WHEN lower(trim(word)) IN ('1', 'true', 'yes') THEN true WHEN lower(trim(word)) IN ('0', 'false', 'no', '') THEN false END AS flag, try_cast(word AS DOUBLE) AS number,
round(1 / (1 + exp(-(value - 50))), 6) AS sigmoid, value IS NOT NULL AS close FROM w""",
    "occurrence_id": f"""WITH {DOCS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) - 1 AS n FROM docs)
SELECT doc_id, lang || '-' || left(sha256, 16) || CASE WHEN n > 0 THEN format('-dup{{:02d}}', n) ELSE '' END AS occurrence_id FROM n""",
    "unique_id": """WITH b AS (SELECT doc_id, 'img' || (doc_id % 40) AS base, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS unique_id FROM b""",
    "balanced_sample": """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS selected FROM r""",
    "checkpoint_last": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id FROM r WHERE n = 1",
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "text_search": "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'st') OR contains(lower(p_name), 'st')",
    "top_features": """SELECT l_suppkey, round(avg(l_discount), 4) AS drop, round(avg(l_tax), 4) AS change FROM lineitem GROUP BY 1 ORDER BY 2 DESC, abs(round(avg(l_tax), 4)) DESC, 1 LIMIT 25""",
}
