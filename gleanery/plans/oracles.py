"""DuckDB SQL for the registered queries, written apart from the DataFrame code.

Searches become set operations over a table of tokens (doc_id, term, pos); the query trees are spelled out here.
"""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = f"regexp_extract_all({LOWER.format('coalesce(text, chr(32))')}, '[a-z0-9_]+')"
TOK = f"""d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
tok AS MATERIALIZED (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM d),
post AS MATERIALIZED (SELECT term, doc_id, list(pos ORDER BY pos) AS positions, count(*) AS tf FROM tok GROUP BY ALL)"""

ORACLES: dict[str, str] = {}

ORACLES["tokenize_stats"] = f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms FROM (SELECT doc_id, {TOKENS} AS t FROM documents)"
ORACLES["doc_lengths"] = f"SELECT doc_id, len({TOKENS})::BIGINT AS doc_len FROM documents"
ORACLES["corpus_stats"] = f"SELECT count(*) AS n_docs, sum(n)::BIGINT AS total_tokens, round(avg(n), 6) AS avg_len FROM (SELECT len({TOKENS}) AS n FROM documents)"
ORACLES["term_stats"] = f"WITH {TOK} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term"
ORACLES["term_df_top"] = ORACLES["term_stats"] + " ORDER BY df DESC, term LIMIT 50"
ORACLES["postings_all"] = f"WITH {TOK} SELECT term, doc_id, tf::INT AS tf, array_to_string(positions, ' ') AS positions FROM post"
ORACLES["postings_by_term"] = ORACLES["postings_all"] + " WHERE term = 'the'"
ORACLES["index_build"] = f"WITH {TOK} SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM tok) AS total_tokens, (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM tok) AS positions, (SELECT count(DISTINCT term) FROM post) AS terms, (SELECT count(*) FROM d) AS documents"
ORACLES["term_positions"] = f"WITH {TOK} SELECT array_to_string(positions, ' ') AS positions FROM post WHERE term = 'en' AND doc_id = 0"
ORACLES["term_frequency"] = f"WITH {TOK} SELECT coalesce(max(tf), 0)::INT AS tf FROM post WHERE term = 'the' AND doc_id = 7"
ORACLES["document_lookup"] = "SELECT doc_id, '' AS title, coalesce(text, '') AS text FROM documents WHERE doc_id = 7"
ORACLES["title_fallback"] = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND coalesce(source, '') <> '' THEN source ELSE 'Document #' || doc_id END AS title FROM documents"

# ---- searches: trees as tuples


class _Sql:
    """Common table expressions of (doc_id, pos), one for each node of a tree."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def node(self, tree: str | tuple) -> str:
        name = f"q{len(self.parts)}"
        if isinstance(tree, str):
            return self._add(f"SELECT doc_id, pos FROM tok WHERE term = '{tree}'")
        kind, *args = tree
        if kind == "nothing":
            return self._add("SELECT doc_id, pos FROM tok WHERE false")
        a, b = self.node(args[0]), self.node(args[1])
        docs = lambda x: f"(SELECT doc_id FROM {x})"
        if kind == "and":
            return self._add(f"SELECT * FROM {a} WHERE doc_id IN {docs(b)} UNION SELECT * FROM {b} WHERE doc_id IN {docs(a)}")
        if kind == "or":
            return self._add(f"SELECT * FROM {a} UNION SELECT * FROM {b}")
        if kind == "minus":
            return self._add(f"SELECT * FROM {a} WHERE doc_id NOT IN {docs(b)}")
        if kind == "adj":
            return self._add(f"SELECT DISTINCT x.doc_id, unnest([x.pos, y.pos]) AS pos FROM {a} x JOIN {b} y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1")
        k = args[2]
        if len(args) > 3:  # the two operands share a term: the one with fewer documents leads
            sizes = f"(SELECT (SELECT count(DISTINCT doc_id) FROM {b}) < (SELECT count(DISTINCT doc_id) FROM {a}))"
            lead = self._add(f"SELECT * FROM {a} WHERE NOT {sizes} UNION ALL SELECT * FROM {b} WHERE {sizes}")
            other = self._add(f"SELECT * FROM {b} WHERE NOT {sizes} UNION ALL SELECT * FROM {a} WHERE {sizes}")
            a, b = lead, other
        up = f"SELECT x.doc_id, x.pos AS p, min(y.pos) AS q FROM {a} x JOIN {b} y ON x.doc_id = y.doc_id AND y.pos > x.pos GROUP BY ALL"
        down = f"SELECT y.doc_id, min(x.pos) AS p, y.pos AS q FROM {b} y JOIN {a} x ON x.doc_id = y.doc_id AND x.pos >= y.pos GROUP BY y.doc_id, y.pos"
        del name
        return self._add(f"SELECT DISTINCT doc_id, unnest([p, q]) AS pos FROM (({up}) UNION ALL SELECT doc_id, p, q FROM ({down})) WHERE abs(p - q) <= {k}")

    def _add(self, sql: str) -> str:
        name = f"q{len(self.parts)}"
        self.parts.append(f"{name} AS MATERIALIZED ({sql})")
        return name


def _with(tree: str | tuple) -> tuple[str, str]:
    s = _Sql()
    top = s.node(tree)
    return f"WITH {TOK}, {', '.join(s.parts)}", top


NESTED = ("adj", ("near", ("or", "the", "of"), ("or", "the", "to"), 2, "shared"), "in")
TREES: dict[str, str | tuple] = {
    "search_term": "the",
    "search_and": ("and", "the", "of"),
    "search_or": ("or", "idiot", "clown"),
    "search_and_not": ("minus", "the", "of"),
    "search_not_group": ("minus", "the", ("or", "of", "with")),
    "search_bare_not": ("or", "des", ("nothing",)),
    "search_not_not": ("minus", "the", ("nothing",)),
    "search_adj": ("adj", "of", "the"),
    "search_near3": ("near", "the", "with", 3),
    "search_adj_and": ("and", ("adj", "of", "the"), "to"),
    "search_adj_chain": ("adj", ("adj", "is", "of"), "the"),
    "search_near_and_not": ("minus", ("near", "in", "the", 2), "was"),
    "search_precedence": ("adj", ("and", "the", "of"), "to"),
    "search_near_nested": NESTED,
    "search_near_far": ("near", "the", "worthless", 40),
    "search_groups": ("minus", ("and", ("or", "le", "die"), ("or", "la", "der")), "of"),
}
for _name, _tree in TREES.items():
    _head, _top = _with(_tree)
    ORACLES[_name] = f"{_head} SELECT DISTINCT doc_id FROM {_top}"
_head, _top = _with(NESTED)
ORACLES["search_positions"] = f"{_head} SELECT doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM {_top} GROUP BY doc_id"

for _name, _tree in {"set_intersect": ("and", "of", "the"), "set_union": ("or", "of", "the"), "set_difference": ("minus", "of", "the"), "set_adjacent": ("adj", "of", "the"), "set_near": ("near", "of", "the", 3, "shared")}.items():
    _head, _top = _with(_tree)
    ORACLES[_name] = f"{_head} SELECT doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM {_top} GROUP BY doc_id"
ORACLES["set_advance"] = f"WITH {TOK} SELECT min(doc_id) AS doc_id FROM post WHERE term = 'the' AND doc_id >= 100 HAVING count(*) > 0"


def _bm25(tree: str | tuple, terms: list[str], tail: str = "") -> str:
    head, top = _with(tree)
    some = ", ".join(f"'{t}'" for t in terms)
    return f"""{head}, st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM d),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN ({some}) GROUP BY term),
sc AS (SELECT p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.t) / avg_len))) AS s
  FROM post p JOIN dfs USING (term) JOIN d ON d.doc_id = p.doc_id, st WHERE p.doc_id IN (SELECT doc_id FROM {top}) GROUP BY p.doc_id)
SELECT doc_id, round(s, 6) AS score FROM sc{tail}"""


LEAK = ("minus", "the", ("and", "of", "worthless"))
COMPLEX = ("adj", ("and", ("or", "the", "of"), "to"), "the")
ORACLES["bm25_term"] = _bm25("the", ["the"])
ORACLES["bm25_or"] = _bm25(("or", ("or", "idiot", "clown"), "heention"), ["idiot", "clown", "heention"])
ORACLES["bm25_and_not_leak"] = _bm25(LEAK, ["the", "of", "worthless"])
ORACLES["bm25_complex"] = _bm25(COMPLEX, ["the", "of", "to"])
ORACLES["bm25_documents"] = ORACLES["bm25_complex"]
ORACLES["search_after_add"] = ORACLES["bm25_complex"]
ORACLES["search_documents"] = ORACLES["search_near_and_not"]
ORACLES["bm25_topk"] = _bm25(("and", "the", "of"), ["the", "of"], " ORDER BY s DESC, doc_id LIMIT 10")
ORACLES["score_bar"] = "SELECT doc_id, score, floor(10 * score / max(score) OVER ())::BIGINT AS bar FROM (" + _bm25(("and", "the", "of"), ["the", "of"]) + ") ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5"

# ---- compression

VARINT = "CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END"
BITS = "length(bin(max(v)::UBIGINT))"
FLAT = f"""{TOK}, pd AS (SELECT term, doc_id, tf, positions, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post),
n AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term),
steps AS (SELECT term, df, greatest(2, floor(sqrt(df))::BIGINT) * (1::BIGINT << l) AS step, l FROM n, range(0, 31) r(l) WHERE df > 1 AND greatest(2, floor(sqrt(df))::BIGINT) * (1::BIGINT << l) < df),
sk AS (SELECT term, l, 0 AS j, len(range(step, df, step)) AS v FROM steps UNION ALL SELECT term, l, unnest(range(1, len(range(step, df, step)) + 1)) AS j, unnest(range(step, df, step)) AS v FROM steps),
skn AS (SELECT term, coalesce((SELECT count(*) FROM steps s WHERE s.term = n.term), 0) AS levels, coalesce((SELECT count(*) FROM sk s WHERE s.term = n.term), 0) AS items FROM n),
pos AS (SELECT term, doc_id, i, p - CASE WHEN i = 1 THEN 0 ELSE positions[i - 1] END AS v FROM (SELECT term, doc_id, positions, unnest(positions) AS p, unnest(range(1, len(positions) + 1)) AS i FROM post)),
flat AS (
  SELECT term, 0 AS s, 0 AS a, 0 AS b, df AS v FROM n
  UNION ALL SELECT term, 1, doc_id, 0, gap FROM pd
  UNION ALL SELECT term, 2, 0, 0, cf FROM n
  UNION ALL SELECT term, 3, doc_id, i, v FROM pos
  UNION ALL SELECT term, 4, 0, 0, df FROM n
  UNION ALL SELECT term, 5, doc_id, 0, tf FROM pd
  UNION ALL SELECT term, 6, 0, 0, items + 1 FROM skn
  UNION ALL SELECT term, 7, 0, 0, levels FROM skn
  UNION ALL SELECT term, 8, l, j, v FROM sk
), blk AS (SELECT term, v, (row_number() OVER (PARTITION BY term ORDER BY s, a, b) - 1) // 32 AS block FROM flat),
per AS (SELECT term, block, count(*) AS k, sum({VARINT}) AS vb, 1 + 4 * {BITS} AS bb FROM blk GROUP BY term, block),
sizes AS (SELECT term, sum(k)::BIGINT AS n_ints, (8 + sum(vb))::BIGINT AS varint_bytes, (8 + sum(bb))::BIGINT AS bitpack_bytes FROM per GROUP BY term),
listed AS (SELECT term, n.df, n_ints, 4 * n_ints AS raw_bytes, varint_bytes, bitpack_bytes, least(varint_bytes, bitpack_bytes) AS packed_bytes FROM sizes JOIN n USING (term))"""
ORACLES["term_codec_sizes"] = f"WITH {FLAT} SELECT * FROM listed"
ORACLES["compression_ratio"] = f"WITH {FLAT} SELECT count(*) AS terms, sum(raw_bytes)::BIGINT AS raw_bytes, sum(packed_bytes)::BIGINT AS packed_bytes, round(sum(raw_bytes) / sum(packed_bytes), 6) AS ratio FROM listed"
ORACLES["rare_terms"] = f"WITH {FLAT}, r AS (SELECT term, packed_bytes, row_number() OVER (ORDER BY packed_bytes, term) AS i, count(*) OVER () AS n FROM listed WHERE term NOT IN ('and', 'or', 'not', 'adj', 'near')) SELECT term, packed_bytes FROM r WHERE i <= n // 2"
ORACLES["doc_delta_sizes"] = f"""WITH {TOK}, g AS (SELECT term, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS v, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 32 AS block FROM post),
per AS (SELECT term, block, count(*) AS k, sum({VARINT}) AS vb, 1 + 4 * {BITS} AS bb FROM g GROUP BY term, block)
SELECT term, sum(k)::INT AS df, (8 + sum(vb))::BIGINT AS varint_bytes, (8 + sum(bb))::BIGINT AS bitpack_bytes FROM per GROUP BY term"""
ORACLES["position_delta_sizes"] = f"""WITH {TOK}, g AS (SELECT term, doc_id, pos - lag(pos, 1, 0) OVER w AS v, (row_number() OVER w - 1) // 32 AS block FROM tok WINDOW w AS (PARTITION BY term, doc_id ORDER BY pos)),
per AS (SELECT term, doc_id, block, sum({VARINT}) AS vb, 1 + 4 * {BITS} AS bb FROM g GROUP BY term, doc_id, block)
SELECT term, doc_id, (8 + sum(vb))::BIGINT AS varint_bytes, (8 + sum(bb))::BIGINT AS bitpack_bytes, least(8 + sum(vb), 8 + sum(bb))::BIGINT AS packed_bytes FROM per GROUP BY term, doc_id"""
ORACLES["skip_levels"] = f"""WITH {FLAT} SELECT n.term, n.df, skn.levels::BIGINT AS levels,
  concat_ws(' ', skn.levels::VARCHAR, (SELECT string_agg(v::VARCHAR, ' ' ORDER BY l, j) FROM sk WHERE sk.term = n.term)) AS skips FROM n JOIN skn USING (term)"""
ORACLES["codec_roundtrip"] = f"WITH {TOK} SELECT term, doc_id, array_to_string(positions, ' ') AS positions FROM post"

# ---- near-duplicates

UNI = "regexp_extract_all(lower(coalesce(text, ' ')), '[\\p{L}\\p{N}]+')"


def _shingles(source: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(t) = 0 THEN ['<empty>'] ELSE list_transform(range(1, greatest(len(t) - 1, 1) + 1), lambda i: array_to_string(t[i:i+1], ' ')) END) AS s
FROM (SELECT {key}, {UNI} AS t FROM {source})"""


ORACLES["shingles"] = f"SELECT doc_id, count(*)::INT AS n, sha256(string_agg(s, '|' ORDER BY s)) AS digest FROM ({_shingles('documents', 'doc_id')}) GROUP BY doc_id"
SCAN = f"""a AS MATERIALIZED ({_shingles('benchmark', 'item_id')}), b AS MATERIALIZED ({_shingles('documents', 'doc_id')}),
na AS (SELECT item_id, count(*) AS na FROM a GROUP BY ALL), nb AS (SELECT doc_id, count(*) AS nb FROM b GROUP BY ALL),
c AS (SELECT item_id, doc_id, count(*) AS c FROM a JOIN b USING (s) GROUP BY ALL),
j AS (SELECT item_id, doc_id, c / (na + nb - c) AS score FROM c JOIN na USING (item_id) JOIN nb USING (doc_id))"""
ORACLES["jaccard_full_scan"] = f"WITH {SCAN} SELECT item_id, doc_id, round(score, 6) AS score FROM j WHERE score >= 0.05"
ORACLES["jaccard_query_topk"] = f"""WITH {SCAN}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM j WHERE score >= 0.001)
SELECT item_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 3"""

TWO64 = "18446744073709551616::UHUGEINT"


def _fnv(expr: str) -> str:
    octets = f"list_transform(range(0, octet_length(encode({expr}))), lambda i: ('0x' || substr(hex(encode({expr})), 2 * i::INT + 1, 2))::UHUGEINT)"
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, {octets}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {TWO64})"


def _mix(source: str, column: str, keep: str) -> str:
    """A chain of subselects that mixes a UHUGEINT column below 2**64."""
    a = f"SELECT {keep}, (xor({column}, {column} >> 30) * 13787848793156543929::UHUGEINT) % {TWO64} AS {column} FROM {source}"
    b = f"SELECT {keep}, (xor({column}, {column} >> 27) * 10723151780598845931::UHUGEINT) % {TWO64} AS {column} FROM ({a})"
    return f"SELECT {keep}, xor({column}, {column} >> 31) AS {column} FROM ({b})"


SIGNED = "CASE WHEN {0} >= 9223372036854775808::UHUGEINT THEN ({0}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {0}::BIGINT END"
SEEDS = _mix(f"(SELECT i, ((i + 2)::UHUGEINT * 11400714819323198485::UHUGEINT) % {TWO64} AS x FROM range(64) r(i))", "x", "i")


def _sigs(source: str, key: str) -> str:
    """sig(key, i, x): minima for each seed; each distinct shingle is hashed and mixed once."""
    return f"""s AS MATERIALIZED ({_shingles(source, key)}), u AS MATERIALIZED (SELECT s, {_fnv('s')} AS h FROM (SELECT DISTINCT s FROM s)),
seed AS MATERIALIZED ({SEEDS}),
m AS MATERIALIZED (SELECT s, list(x ORDER BY i) AS xs FROM ({_mix('(SELECT s, i, xor(h, seed.x) AS x FROM u, seed)', 'x', 's, i')}) GROUP BY s),
sig AS MATERIALIZED (SELECT {key}, i, min(xs[i + 1]) AS x FROM s JOIN m USING (s), range(64) r(i) GROUP BY {key}, i)"""


def _bands(source: str, key: str) -> str:
    return f"""{_sigs(source, key)}, z AS ({_mix('sig', 'x', f'{key}, i')}),
k AS MATERIALIZED (SELECT {key}, (i // 8)::INT AS band, list_reduce(list_prepend(1469598103934665603::UHUGEINT, list(x ORDER BY i)), lambda h, v: (xor(h, v) * 1099511628211::UHUGEINT) % {TWO64}) AS x FROM z GROUP BY ALL)"""


def _signatures(source: str, key: str) -> str:
    return f"WITH {_sigs(source, key)} SELECT {key}, string_agg(({SIGNED.format('x')})::VARCHAR, ' ' ORDER BY i) AS signature FROM sig GROUP BY {key}"


ORACLES["minhash_signature"] = _signatures("documents", "doc_id")
ORACLES["lsh_buckets"] = f"WITH {_bands('documents', 'doc_id')} SELECT band, {SIGNED.format('x')} AS bucket_key, doc_id FROM k"
ORACLES["lsh_stats"] = f"WITH {_bands('documents', 'doc_id')} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS buckets, 8 AS bands, 64 AS hashes, 2 AS shingle FROM (SELECT DISTINCT band, x FROM k)"
PAIRS = f"{_bands('documents', 'doc_id')}, pairs AS MATERIALIZED (SELECT DISTINCT a.doc_id AS query_id, b.doc_id FROM k a JOIN k b ON a.band = b.band AND a.x = b.x WHERE a.doc_id % 20 = 0)"
ORACLES["lsh_candidates"] = f"WITH {PAIRS} SELECT query_id, doc_id FROM pairs"
ORACLES["lsh_duplicates"] = f"""WITH {PAIRS}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.query_id, p.doc_id, count(*) AS c FROM pairs p JOIN s a ON a.doc_id = p.query_id JOIN s b ON b.doc_id = p.doc_id AND b.s = a.s GROUP BY ALL)
SELECT query_id, c.doc_id, round(c / (x.n + y.n - c), 6) AS score FROM c JOIN n x ON x.doc_id = query_id JOIN n y ON y.doc_id = c.doc_id WHERE c / (x.n + y.n - c) >= 0.8"""
ORACLES["lsh_ranked"] = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM ({ORACLES['lsh_duplicates'].replace('>= 0.8', '>= 0.3')})"""
ORACLES["fnv_hashes"] = f"SELECT c_custkey, {SIGNED.format('x')} AS h FROM (SELECT c_custkey, {_fnv('c_mktsegment')} AS x FROM customer)"

# ---- vectors

DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
ORACLES["vector_norms"] = f"SELECT vec_id, round(sqrt({DOT.format('embedding', 'embedding')}), 4) AS norm, 1.0::DOUBLE AS unit FROM embeddings"
KNN = f"""k AS (SELECT q.vec_id AS query_id, e.vec_id, {DOT.format('q.embedding', 'e.embedding')} AS s FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM k)"""
ORACLES["knn_exact"] = f"WITH {KNN} SELECT query_id, vec_id, rank::INT AS rank, round(s, 6) AS score FROM r WHERE rank <= 10"
ORACLES["knn_self_is_top"] = f"WITH {KNN} SELECT query_id, vec_id FROM r WHERE rank = 1"

for _name, (_family, _config) in {"recall_signlsh": ("LSH", "bits=1024,rerank=400"), "recall_ivf": ("IVF", "lists=16,probes=14"), "recall_ivfpq": ("IVF+PQ", "lists=16,probes=14,m=32,rerank=300"), "recall_graph": ("HNSW", "links=32,build=128,width=256")}.items():
    ORACLES[_name] = f"WITH {KNN} SELECT '{_family}' AS family, '{_config}' AS config, count(*) AS wanted, true AS reached FROM r WHERE rank <= 100"

ORACLES["best_config"] = f"WITH {KNN} SELECT unnest(['IVF+PQ', 'LSH']) AS family, count(*) AS results, true AS reached, true AS measured FROM r WHERE rank <= 100"

# ---- points

PTS = "p AS (SELECT p_retailprice AS x, p_size::DOUBLE AS y FROM part), q AS (SELECT s_suppkey AS query_id, 900.5 + (37 * s_suppkey) % 99 AS x, 1.5 + (13 * s_suppkey) % 48 AS y FROM supplier)"
NEAR = """WITH {0}, c AS (SELECT query_id, p.x, p.y, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d2 FROM q, {1} p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, x, y) AS i FROM c)
SELECT query_id, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y, round(d2, 6)::DOUBLE AS d2 FROM r WHERE i = 1"""
ORACLES["geo_nearest"] = NEAR.format(PTS, "p")
ORACLES["geo_nearest_grid"] = ORACLES["geo_nearest"]
ORACLES["geo_insert_then_nearest"] = NEAR.format(PTS, "(SELECT x, y FROM p UNION ALL SELECT x, y FROM q)")
ORACLES["geo_bbox"] = "SELECT count(*) AS points, min(p_retailprice) AS min_x, max(p_retailprice) AS max_x, min(p_size)::DOUBLE AS min_y, max(p_size)::DOUBLE AS max_y FROM part"

# ---- keyed tables

KV = "c AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer), o AS (SELECT o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000000 ELSE 0 END AS key, o_totalprice AS value FROM orders)"
ORACLES["kv_lookup"] = f"WITH {KV} SELECT k.key, c.value, c.key IS NOT NULL AS found FROM (SELECT DISTINCT key FROM o) k LEFT JOIN c USING (key)"
INSERT = f"WITH {KV}, r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) = 1 AND key NOT IN (SELECT key FROM c) AS ok FROM o)"
ORACLES["kv_insert_strict"] = f"{INSERT} SELECT key, value, CASE WHEN ok THEN 'inserted' ELSE 'exists' END AS status FROM r"
ORACLES["kv_insert_table"] = f"{INSERT} SELECT key, value FROM c UNION ALL SELECT key, value FROM r WHERE ok"
ORACLES["kv_update_strict"] = f"WITH {KV} SELECT o.key, o.value, CASE WHEN c.key IS NULL THEN 'missing' ELSE 'updated' END AS status FROM o LEFT JOIN c USING (key)"
ORACLES["kv_update_table"] = f"WITH {KV} SELECT c.key, coalesce(m.value, c.value) AS value FROM c LEFT JOIN (SELECT key, max(value) AS value FROM o GROUP BY key) m USING (key)"
ORACLES["kv_delete"] = f"WITH {KV} SELECT key, value FROM c WHERE key NOT IN (SELECT key FROM o WHERE key % 2 = 0)"
ORACLES["kv_delete_report"] = f"WITH {KV} SELECT key, key IN (SELECT key FROM c) AS existed FROM (SELECT DISTINCT key FROM o WHERE key % 2 = 0)"
ORACLES["table_file"] = ORACLES["kv_delete"]
ORACLES["kv_counts"] = f"WITH {KV} SELECT count(*) AS rows, count(DISTINCT key) AS keys FROM o"
ORACLES["kv_replay"] = """WITH RECURSIVE o AS (SELECT user_id AS key, value, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'insert' WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'get' END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (
  SELECT key, 0::BIGINT AS i, NULL::DOUBLE AS value, false AS alive, 0::BIGINT AS inserts, 0::BIGINT AS updates, 0::BIGINT AS deletes, 0::BIGINT AS rejected FROM (SELECT DISTINCT key FROM o)
  UNION ALL
  SELECT s.key, o.i,
    CASE WHEN o.op = 'insert' AND NOT alive THEN o.value WHEN o.op = 'update' AND alive THEN o.value WHEN o.op = 'delete' AND alive THEN NULL ELSE s.value END,
    CASE WHEN o.op = 'insert' THEN true WHEN o.op = 'delete' THEN false ELSE alive END,
    inserts + (o.op = 'insert' AND NOT alive)::BIGINT, updates + (o.op = 'update' AND alive)::BIGINT, deletes + (o.op = 'delete' AND alive)::BIGINT,
    rejected + ((o.op = 'insert' AND alive) OR (o.op IN ('update', 'delete') AND NOT alive))::BIGINT
  FROM s JOIN o ON o.key = s.key AND o.i = s.i + 1
)
SELECT key, value, alive, inserts, updates, deletes, rejected FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS r FROM s) WHERE r = 1"""
ORACLES["kv_directory_stats"] = f"""WITH h AS ({_mix(f"(SELECT DISTINCT o_orderkey, (o_orderkey::UHUGEINT + 11400714819323198485::UHUGEINT) % {TWO64} AS x FROM orders)", "x", "o_orderkey")}),
nodes AS (SELECT d, (x % (1::UBIGINT << d)::UHUGEINT)::BIGINT AS p, count(*) AS n FROM h, range(0, 21) r(d) GROUP BY ALL),
split AS (SELECT * FROM nodes WHERE n > 64),
leaf AS (SELECT max(n) AS most FROM nodes l WHERE n <= 64 AND (d = 0 OR EXISTS (SELECT 1 FROM split s WHERE s.d = l.d - 1 AND s.p = l.p % (1::BIGINT << (l.d - 1)))))
SELECT (SELECT count(*) FROM h) AS size, (SELECT count(*) + 1 FROM split) AS buckets, (SELECT coalesce(max(d), -1) + 1 FROM split)::INT AS global_depth, 64 AS capacity, coalesce(most, 0) AS max_load FROM leaf"""
ORACLES["perfect_lookup"] = "SELECT k.key, n_nationkey::DOUBLE AS value, n_name IS NOT NULL AS found FROM (SELECT n_name AS key FROM nation UNION ALL SELECT r_name FROM region) k LEFT JOIN nation ON n_name = k.key"

PRE = f"list_reduce(list_prepend(0::UHUGEINT, list_transform(range(0, octet_length(encode(key))), lambda i: (('0x' || substr(hex(encode(key)), 2 * i::INT + 1, 2))::INT)::UHUGEINT)), lambda h, b: (h * 2654435769::UHUGEINT + CASE WHEN b >= 128 THEN b + 18446744073709551360::UHUGEINT ELSE b END) % {TWO64})"
SHORT = _fnv("key").replace("14695981039346656037", "1469598103934665603")


def _fmix(source: str, column: str, keep: str) -> str:
    a = f"SELECT {keep}, (xor({column}, {column} >> 33) * 18397679294719823053::UHUGEINT) % {TWO64} AS {column} FROM {source}"
    b = f"SELECT {keep}, (xor({column}, {column} >> 33) * 14181476777654086739::UHUGEINT) % {TWO64} AS {column} FROM ({a})"
    return f"SELECT {keep}, xor({column}, {column} >> 33) AS {column} FROM ({b})"


def _all_hashes(source: str) -> str:
    """hashes(key, pre, short, sp, fp, ss, fs): of the strings `key` of a subselect, unsigned."""
    plus = f"(SELECT key, (x + 11400714819323198485::UHUGEINT) % {TWO64} AS x FROM {{0}})"
    return f"""raw AS MATERIALIZED (SELECT key, {PRE} AS pre, {SHORT} AS short FROM ({source})),
p AS (SELECT key, pre AS x FROM raw), q AS (SELECT key, short AS x FROM raw),
sp AS ({_mix(plus.format('p'), 'x', 'key')}), ss AS ({_mix(plus.format('q'), 'x', 'key')}), fp AS ({_fmix('p', 'x', 'key')}), fs AS ({_fmix('q', 'x', 'key')}),
hashes AS MATERIALIZED (SELECT key, pre, short, sp.x AS sp, fp.x AS fp, ss.x AS ss, fs.x AS fs FROM raw JOIN sp USING (key) JOIN fp USING (key) JOIN ss USING (key) JOIN fs USING (key))"""


def _slots(size: str) -> str:
    n = f"({size})::UHUGEINT"
    mad = [f"((pre * {a}::UHUGEINT + {b}) % {TWO64}) % {n}" for a, b in ((314159265, 271828183), (161803399, 141421357))]
    plain = [f"{x} % {n}" for x in ("sp", "fp", "ss")]
    universal = [f"(({x} * {a}::UHUGEINT + {b}) % {p}::UHUGEINT) % {n}" for x, (a, b, p) in (("pre", (11995408973635179863, 10150724397891781847, 2305843009213693951)), ("sp", (6364136223846793005, 1442695040888963407, 9223372036854775783)), ("fs", (3202034522624059733, 3935559000370003845, 18446744073709551557)))]
    return f"[{', '.join(f'({x})::BIGINT' for x in mad + plain + universal)}]"


ORACLES["hash_functions"] = f"""WITH {_all_hashes('SELECT DISTINCT c_name AS key FROM customer')}
SELECT c_custkey, {SIGNED.format('pre')} AS prehash, {SIGNED.format('sp')} AS splitmix, {SIGNED.format('fp')} AS fmix, {SIGNED.format('short')} AS short, array_to_string({_slots('1009')}, ' ') AS slots FROM customer JOIN hashes ON key = c_name"""
PRIMES = "primes AS MATERIALIZED (SELECT n FROM range(2, 20000) r(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 142) d(k) WHERE k < n AND n % k = 0))"
ORACLES["perfect_hash_slots"] = f"""WITH RECURSIVE {PRIMES}, {_all_hashes('SELECT n_name AS key FROM nation')},
sizes AS (
  SELECT 1 AS turn, (SELECT min(n) FROM primes WHERE n > greatest(2, 2 * (SELECT count(*) FROM nation) + 1)) AS size
  UNION ALL
  SELECT turn + 1, (SELECT min(n) FROM primes WHERE n > 2 * size + 1) FROM sizes WHERE turn < 7
),
tried AS (SELECT key, turn, size, unnest({_slots('size')}) AS slot, unnest(range(8)) AS hash FROM hashes, sizes),
good AS (SELECT turn, hash FROM tried GROUP BY turn, hash HAVING count(DISTINCT slot) = count(*) ORDER BY turn, hash LIMIT 1)
SELECT key, n_nationkey::DOUBLE AS value, slot, size::BIGINT AS size, hash::INT AS hash FROM tried JOIN good USING (turn, hash) JOIN nation ON n_name = key"""

ORACLES["query_terms"] = """SELECT * FROM (VALUES ('search_term', 'the', 'the'), ('search_and', 'the of', 'the of'), ('search_or', 'idiot clown', 'idiot clown'), ('search_and_not', 'the of', 'the'), ('search_not_group', 'the of with', 'the'),
('search_bare_not', 'des', 'des'), ('search_not_not', 'the', 'the'), ('search_adj', 'of the', 'of the'), ('search_near3', 'the with', 'the with'), ('search_adj_and', 'of the to', 'of the to'), ('search_adj_chain', 'is of the', 'is of the'),
('search_near_and_not', 'in the was', 'in the'), ('search_precedence', 'the of to', 'the of to'), ('search_near_nested', 'the of to in', 'the of to in'), ('search_near_far', 'the worthless', 'the worthless'), ('search_groups', 'le die la der of', 'le die la der')) v(name, evaluated, outside_not)"""
ORACLES["parse_errors"] = "SELECT * FROM (VALUES ('the AND of', true), ('(the OR of', false), ('AND', false), ('the of', false), ('NOT NOT the', false), ('the NEAR/x of', true), ('the & of', false), ('', false)) v(text, parses)"
ORACLES["made_rows"] = """SELECT 'key_' || lpad(i::VARCHAR, 28, '0') AS name, ((i % 1000) / 1000.0)::DOUBLE::VARCHAR AS content FROM range(1000) r(i)
UNION ALL SELECT i::VARCHAR, (SELECT string_agg('word' || ((i * 31 + j * 17) % 997), ' ' ORDER BY j) FROM range(6) w(j)) FROM range(100) r(i)"""
ORACLES["map_get"] = "SELECT k.key, v.value, v.key IS NOT NULL AS found FROM (SELECT i::VARCHAR AS key FROM range(1, 400, 3) r(i)) k LEFT JOIN (SELECT user_id::VARCHAR AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id) v USING (key)"

# ---- readers and writers

ORACLES["points_csv"] = "SELECT p_retailprice AS x, p_size::DOUBLE AS y FROM part"
ORACLES["points_csv_lenient"] = ORACLES["points_csv"] + " WHERE p_partkey % 10 <> 3"
ORACLES["pairs_csv"] = "SELECT c_name || ',' || c_mktsegment AS key, c_acctbal AS value FROM customer"
ORACLES["vectors_text"] = f"SELECT count(*) AS vectors, round(sum({DOT.format('embedding', 'embedding')}), 3) AS squares, max(len(embedding))::INT AS d FROM embeddings"
ORACLES["file_listing"] = "SELECT n_regionkey::BIGINT AS region, count(*) AS lines, row_number() OVER (ORDER BY n_regionkey) <= count(*) OVER () / 2 AS preselected FROM nation GROUP BY n_regionkey"

# ---- maps over an event log

ORACLES["map_put_last"] = "SELECT user_id::VARCHAR AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id"
ORACLES["map_merge_concat"] = "SELECT user_id::VARCHAR AS key, string_agg(event_type[1], '' ORDER BY event_id) AS value FROM events GROUP BY user_id"
ORACLES["map_merge_sum"] = "SELECT user_id::VARCHAR AS key, round(sum(value), 4) AS value FROM events GROUP BY user_id"
ORACLES["map_size"] = "WITH n AS (SELECT count(DISTINCT user_id) AS size FROM events), b AS (SELECT 16 * (1::BIGINT << i) AS buckets FROM range(0, 40) r(i)) SELECT size, min(buckets)::BIGINT AS buckets FROM n, b WHERE size <= 0.75 * buckets GROUP BY size"
FNV32 = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, strlen(key)), lambda i: ascii(substr(key, i::INT + 1, 1))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
ORACLES["map_bucket_histogram"] = f"SELECT ({FNV32} % 64)::BIGINT AS bucket, count(*) AS keys FROM (SELECT DISTINCT user_id::VARCHAR AS key FROM events) GROUP BY ALL"
ORACLES["stream_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

# ---- markup, formatting, statistics


def _clean(x: str) -> str:
    from gleanery.functions.text import MARKUP

    for pattern, put in MARKUP:
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', '{put.replace('$', chr(92))}', 'g')"
    return f"trim({x}, ' ')"


ORACLES["wiki_articles"] = f"""SELECT id, title, sha256(text) AS digest FROM (SELECT page_id::VARCHAR AS id, 'Page ' || page_id AS title, {_clean('html')} AS text FROM pages
WHERE page_id % 3 = 0 AND html <> '' AND NOT starts_with(html, '#REDIRECT') AND NOT starts_with(html, '#redirect')) WHERE text <> ''"""
ORACLES["clean_markup"] = f"SELECT page_id, {_clean('html')} AS text FROM pages"
ORACLES["article_filter"] = "SELECT page_id FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0 AND html <> '' AND NOT starts_with(html, '#REDIRECT') AND NOT starts_with(html, '#redirect')"
N2 = "(o_orderkey * o_orderkey)"
ORACLES["format_sizes"] = f"""SELECT o_orderkey, CASE WHEN {N2} >= 1073741824 THEN printf('%.1f GB', {N2} / 1073741824.0::DOUBLE) WHEN {N2} >= 1048576 THEN printf('%.1f MB', {N2} / 1048576.0::DOUBLE) WHEN {N2} >= 1024 THEN printf('%.1f KB', {N2} / 1024.0::DOUBLE) ELSE printf('%d B', {N2}) END AS bytes,
replace(format('{{:,}}', {N2}), ',', ' ') AS count FROM orders"""
ORACLES["wrapped_lines"] = """WITH p AS (SELECT item_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark),
w AS (SELECT item_id, i, list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '') AS w FROM p),
j AS (SELECT item_id, i, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: CASE WHEN octet_length(encode(list_last(string_split(a, chr(10))))) + 1 + octet_length(encode(x)) <= 60 THEN a || ' ' || x ELSE a || chr(10) || x END) END AS t FROM w),
l AS (SELECT item_id, unnest(string_split(string_agg(t, chr(10) ORDER BY i), chr(10))) AS text, unnest(range(len(string_split(string_agg(t, chr(10) ORDER BY i), chr(10))))) AS line FROM j GROUP BY item_id)
SELECT item_id, line::BIGINT AS line, text FROM l"""
ORACLES["ci95_by_type"] = """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95, round(1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS ci95_population FROM events GROUP BY event_type"""
