"""DuckDB SQL for the operators that SQL can express."""

from pixelmill.llm.url_filter import LOWER, UPPER

CLOSURE = """
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

VECTORS = f"""WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
links AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.label = b.label AND a.id < b.id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings), {CLOSURE},
n AS (SELECT x, count(*) AS k FROM edges GROUP BY x)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON vec_id = comp.id LEFT JOIN n ON vec_id = n.x"""

DOCUMENTS = rf"""WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT id, unnest(s) AS g FROM s),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN s a ON x = a.id JOIN s b ON y = b.id WHERE 100 * c >= 75 * (len(a.s) + len(b.s) - c)),
nodes AS (SELECT id FROM s), {CLOSURE}
SELECT s.id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN comp USING (id)"""

# The parts of queries that SQL can express, without their models' and methods' own columns; tests compare them.
PARTS = {
    "op2_url_filter": f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, rest FROM r),
p AS (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '(?s)^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rh, rp, say)),
fits AS (SELECT page_id, rh || rp AS rule, say, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, f.say FROM p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1""",
    "op6_cube_mixing": r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, n, w, FALSE AS full_, CAST(1.5 * (SELECT sum(n) FROM s) AS DOUBLE) AS rest FROM s
  UNION ALL
  SELECT round + 1, source, n, w, full_ OR over_, rest - sum(CASE WHEN over_ AND NOT full_ THEN 2.0 * n ELSE 0 END) OVER ()
  FROM (SELECT *, NOT full_ AND rest * w / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0) > 2 * n AS over_, bool_or(NOT full_ AND rest * w / nullif(open_, 0) > 2 * n) OVER () AS go
        FROM (SELECT *, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS open_ FROM fill)) WHERE go),
last AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
t AS (SELECT source, n, CASE WHEN full_ THEN 2.0 * n ELSE rest * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target FROM last)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "op9_histogram_shards": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, 'bytes' AS law FROM documents",
    "op4_order_minhash": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(nx, 1, n // 2)) AS edited_sha256 FROM n""",
}
