"""DuckDB SQL for the registered queries that SQL can express."""

OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-4,1)+1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM inter JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100*k >= 80*(na.n + nb.n - k)
), both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+least(len(w),10)-1], ' ') AS key, least(len(w),10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w)-9,1)+1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM d, ks WHERE len(w) >= k
), hit AS (
  SELECT doc_id, i, pos.k, item_id FROM pos JOIN win ON win.k = pos.k AND win.key = array_to_string(pos.w[i:i+pos.k-1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+k)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items,
       sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h
), rules(verdict, rh, rp) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
fit AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(fit.verdict, CASE
  WHEN regexp_matches(host, '(^|[.-])(spam-farm|link-farm|cheap-pills|cheap-meds|cheap-drugs|xxx|doubleclick)([.-]|$)') OR contains(host, 'casino') OR contains(host, 'porn') OR regexp_matches(host, '(^|[.-])poker') OR starts_with(path, '/wp-login.php') THEN 'block'
  ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""

OP7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), rep AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN rep USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op2_decontaminate": OP2, "op3_urlfilter": OP3, "op7_line_dedup": OP7}
