"""DuckDB SQL of the queries that SQL can express."""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

OP6 = """
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS g,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY g ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
), sources AS (
  SELECT g, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(g)) - 1) % 3] AS w FROM sized GROUP BY g
), ratio AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, g) AS n FROM sources
), levels AS (
  SELECT n - 1 AS k, source_size, w,
    (SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total,
    sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft
  FROM ratio
), level AS (
  SELECT total, lft FROM levels WHERE NOT (3 * source_size * lft < total * w) ORDER BY k LIMIT 1
), targets AS (
  SELECT g, source_size, CASE WHEN CAST(3 * source_size AS DOUBLE) < CAST(total AS DOUBLE) * w / lft THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(total AS DOUBLE) * w / lft END AS target FROM sources, level
), cut AS (
  SELECT o.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target + 0.5) AS BIGINT) // t.source_size ELSE 0 END AS whole
  FROM ordered o JOIN targets t USING (g)
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken, source
FROM cut
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH n AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256, {_FOLDED} AS body FROM documents),
g AS (SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body, doc_id) AS nth FROM n)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND nth = 1) AS kept, text_sha256 FROM g
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), f AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic
  FROM d
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
  SELECT filter_order, s.step, bits[s.step] AS b, CAST(coalesce(list_sum(bits[1:s.step - 1]), 0) AS INTEGER) AS earlier
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) s
), counted AS (
  SELECT part, filter_order, step, b,
    sum(CASE WHEN fails & (earlier | b) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & b > 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & b > 0 AND fails & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & b > 0 AND fails & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & b > 0 AND fails & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, g GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM counted
"""

SQL = {"op2_topk": OP2, "op6_mixing": OP6, "op10_exact_dedup": OP10, "op12_filter_audit": OP12}
