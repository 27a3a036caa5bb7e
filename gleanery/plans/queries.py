"""The registered queries of the retrieval, similarity and keyed-table operators, all over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import codec, text
from gleanery.functions.hashing import fnv64, hash_all, hash_key
from gleanery.operators import geo, keyed, neardup, postings, search, sets, statistics, tables, vectors
from gleanery.sources import files, generate
from gleanery.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Searches by name: what is evaluated without ranking.
SEARCHES = {
    "search_term": "the",
    "search_and": "the AND of",
    "search_or": "idiot OR clown",
    "search_and_not": "the AND NOT of",
    "search_not_group": "the AND NOT (of OR with)",
    "search_bare_not": "des OR NOT of",
    "search_not_not": "the AND NOT (NOT of)",
    "search_adj": "of ADJ the",
    "search_near3": "the NEAR/3 with",
    "search_adj_and": "of ADJ the AND to",
    "search_adj_chain": "is ADJ of ADJ the",
    "search_near_and_not": "in NEAR/2 the AND NOT was",
    "search_precedence": "the AND of ADJ to",
    "search_near_nested": "((the OR of) NEAR/2 (the OR to)) ADJ in",
    "search_near_far": "the NEAR/40 worthless",
    "search_groups": "(le OR die) AND (la OR der) AND NOT of",
}
#: Searches by name: what is ranked.
RANKED = {
    "bm25_term": "the",
    "bm25_or": "idiot OR clown OR heention",
    "bm25_and_not_leak": "the AND NOT (of AND worthless)",
    "bm25_complex": "(the OR of) AND to ADJ the",
}
QUERY_EVERY = 20


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str], str] = {}


def _place(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{files.shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def engine(spark: SparkSession, sf_dir: str) -> search.Engine:
    """The stored index of a documents table, written when a session first asks for it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        path = _place(spark, "index")
        files.write_index(table(spark, sf_dir, "documents"), path)
        _STORED[key] = path
    return search.Engine.open(spark, _STORED[key])


def search_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).top("the AND of", 10)


# ---- tokens, postings, statistics


@query
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.index_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


@query
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.doc_lengths(table(spark, sf_dir, "documents"))


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = postings.corpus_stats(table(spark, sf_dir, "documents"))
    return out.select("n_docs", "total_tokens", F.round("avg_len", 6).alias("avg_len"))


@query
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.term_stats(table(spark, sf_dir, "documents"))


@query
def term_df_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.term_stats(table(spark, sf_dir, "documents")).orderBy(F.desc("df"), "term").limit(50)


@query
def postings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings.postings(table(spark, sf_dir, "documents"))
    return p.select("term", "doc_id", "tf", F.array_join("positions", " ").alias("positions"))


@query
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new stored index, and what it holds."""
    path = _place(spark, "index")
    files.write_index(table(spark, sf_dir, "documents"), path)
    posts, totals, docs = files.read_index(spark, path)
    held = posts.agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("positions"), F.countDistinct("term").alias("terms"))
    return totals.crossJoin(held).crossJoin(docs.agg(F.count(F.lit(1)).alias("documents")))  # one row each


@query
def postings_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = engine(spark, sf_dir).postings("the")
    return p.select("term", "doc_id", "tf", F.array_join("positions", " ").alias("positions"))


@query
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.term_frequency(engine(spark, sf_dir).postings("the"), "the", 7)


@query
def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.positions(engine(spark, sf_dir).postings("en"), "en", 0).select(F.array_join("positions", " ").alias("positions"))


@query
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.lookup(engine(spark, sf_dir).docs, 7)


@query
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""))
    return d.select("doc_id", postings.title_or_number(F.col("title"), F.col("doc_id")).alias("title"))


# ---- search


def _searching(words: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir).evaluate(words)


def _ranking(words: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir).search(words).select("doc_id", F.round("score", 6).alias("score"))


QUERIES |= {name: _searching(words) for name, words in SEARCHES.items()}
QUERIES |= {name: _ranking(words) for name, words in RANKED.items()}


@query
def search_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).positions(SEARCHES["search_near_nested"])
    return out.select("doc_id", F.array_join("positions", " ").alias("positions"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_flagship(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents without an index."""
    e = search.Engine(table(spark, sf_dir, "documents"))
    return e.search(RANKED["bm25_complex"]).select("doc_id", F.round("score", 6).alias("score"))


@query
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.Engine(table(spark, sf_dir, "documents")).evaluate(SEARCHES["search_near_and_not"])


@query
def search_after_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the even ids to which the odd ones are added."""
    d = table(spark, sf_dir, "documents")
    e = search.Engine.build(d.filter("doc_id % 2 = 0"), _place(spark, "index"))
    e.add(d.filter("doc_id % 2 = 1"))
    return e.search(RANKED["bm25_complex"]).select("doc_id", F.round("score", 6).alias("score"))


@query
def score_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).page("the AND of", 5, 20)
    return out.select("doc_id", F.round("score", 6).alias("score"), F.col("bar").cast("long").alias("bar"))


@query
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that each registered search looks up, and those outside any NOT."""
    rows = [(n, " ".join(search.evaluated_terms(q)), " ".join(search.outside_not(q))) for n, w in SEARCHES.items() for q in (search.parse(w),)]
    return spark.createDataFrame(rows, "name string, evaluated string, outside_not string")


@query
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text parses."""

    def parses(text: str) -> bool:
        try:
            return search.parse(text) is not None
        except search.QueryError:
            return False

    texts = ["the AND of", "(the OR of", "AND", "the of", "NOT NOT the", "the NEAR/x of", "the & of", ""]
    return spark.createDataFrame([(t, parses(t)) for t in texts], "text string, parses boolean")


# ---- posting lists


def _lists(spark: SparkSession, sf_dir: str, *words: str) -> list[DataFrame]:
    e = engine(spark, sf_dir)
    return [e.postings(w).select("doc_id", "positions") for w in words]


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.array_join("positions", " ").alias("positions"))


SETS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "set_intersect": sets.intersect,
    "set_union": sets.union,
    "set_difference": sets.difference,
    "set_adjacent": sets.adjacent,
    "set_near": lambda a, b: sets.near(a, b, 3),
}
QUERIES |= {name: (lambda spark, sf_dir, f=f: _shown(f(*_lists(spark, sf_dir, "of", "the")))) for name, f in SETS.items()}


@query
def set_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.advance(_lists(spark, sf_dir, "the")[0], 100).select("doc_id")


# ---- compression


@query
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.rarest_half(postings.list_sizes(postings.postings(table(spark, sf_dir, "documents"))))


@query
def term_codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.list_sizes(postings.postings(table(spark, sf_dir, "documents")))


@query
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = postings.list_sizes(postings.postings(table(spark, sf_dir, "documents")))
    out = s.agg(F.count(F.lit(1)).alias("terms"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("packed_bytes").alias("packed_bytes"))
    return out.withColumn("ratio", F.round(F.col("raw_bytes") / F.col("packed_bytes"), 6))


@query
def doc_delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.id_sizes(postings.postings(table(spark, sf_dir, "documents")))


@query
def position_delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings.postings(table(spark, sf_dir, "documents")).select("term", "doc_id", codec.deltas(F.col("positions")).alias("d"))
    return p.select("term", "doc_id", codec.varint_size(F.col("d")).alias("varint_bytes"), codec.bitpack_size(F.col("d")).alias("bitpack_bytes"), codec.packed_size(F.col("d")).alias("packed_bytes"))


@query
def skip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = postings.skips(postings.term_stats(table(spark, sf_dir, "documents")))
    return out.select("term", "df", F.col("levels").cast("long").alias("levels"), F.array_join("skips", " ").alias("skips"))


@query
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = postings.coded(table(spark, sf_dir, "documents"))
    return coded.select("term", "doc_id", F.array_join(codec.decoded_sums("data"), " ").alias("positions"))


# ---- near-duplicates


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")


@query
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = neardup.shingled(table(spark, sf_dir, "documents"))
    return s.select("doc_id", F.size("shingles").alias("n"), F.sha2(F.array_join(F.array_sort("shingles"), "|"), 256).alias("digest"))


@query
def jaccard_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.full_scan(*_pair(spark, sf_dir), threshold=0.05)
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query
def jaccard_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.full_scan(*_pair(spark, sf_dir), threshold=0.001)
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = neardup.minhash(neardup.shingled(table(spark, sf_dir, "documents")))
    return s.select("doc_id", F.array_join("signature", " ").alias("signature"))


def _lsh_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.buckets(neardup.minhash(neardup.shingled(neardup.check_ids(table(spark, sf_dir, "documents")))))


@query
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh_table(spark, sf_dir)


@query
def lsh_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.stats(_lsh_table(spark, sf_dir))


@query
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners of every document whose id is divisible by 20."""
    b = _lsh_table(spark, sf_dir)
    asked = b.filter(F.col("doc_id") % QUERY_EVERY == 0).withColumnRenamed("doc_id", "query_id")
    return neardup.candidates(asked, b, "query_id")


@query
def lsh_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    asked = d.filter(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("query_id"), "text")
    return neardup.find_duplicates(asked, d, query="query_id").withColumn("score", F.round("score", 6))


@query
def lsh_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three tenths or more in order of their scores."""
    d = table(spark, sf_dir, "documents")
    asked = d.filter(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("query_id"), "text")
    found = neardup.find_duplicates(asked, d, threshold=0.3, query="query_id").withColumn("score", F.round("score", 6))
    return neardup.ranked(found, "query_id")


@query
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fnv64("c_mktsegment").alias("h"))


# ---- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return base, base.filter(F.col("vec_id") % QUERY_EVERY == 0)


@query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.normalised(F.col("embedding"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", unit.alias("u"))
    return out.select("vec_id", F.round(F.sqrt(vectors.inner(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(vectors.inner(F.col("u"), F.col("u")), 6).alias("unit"))


@query
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.knn(*_vectors(spark, sf_dir), k=10)
    return out.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query
def knn_self_is_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.knn(*_vectors(spark, sf_dir), k=1)
    return out.select("query_id", "vec_id")


FINDERS: dict[str, tuple[str, str, Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "recall_signlsh": ("LSH", "bits=1024,rerank=400", lambda b, q: vectors.knn_sign_lsh(b, q, 100, bits=1024, rerank=400)),
    "recall_ivf": ("IVF", "lists=16,probes=14", lambda b, q: vectors.ivf(b, q, 100, lists=16, probes=14)),
    "recall_ivfpq": ("IVF+PQ", "lists=16,probes=14,m=32,rerank=300", lambda b, q: vectors.ivf_pq(b, q, 100, lists=16, probes=14, m=32, rerank=300)),
    "recall_graph": ("HNSW", "links=32,build=128,width=256", lambda b, q: vectors.knn_graph(b, q, 100, links=32, build=128, width=256)),
}


def _recall(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Whether nine tenths of the exact best 100 of each query are found, and how many are wanted."""
        base, asked = _vectors(spark, sf_dir)
        family, config, find = FINDERS[name]
        out = vectors.recall(vectors.knn(base, asked, 100), find(base, asked))
        return out.select(F.lit(family).alias("family"), F.lit(config).alias("config"), "wanted", (F.col("recall") >= 0.9).alias("reached"))

    return run


QUERIES |= {name: _recall(name) for name in FINDERS}


@query
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of two settings of each family by recall and then latency, measured: seconds of a search over stored vectors."""
    base, asked = _vectors(spark, sf_dir)
    truth = vectors.knn(base, asked, 100)
    tries = [("LSH", f"bits={b}", lambda b=b: vectors.knn_sign_lsh(base, asked, 100, bits=b, rerank=200)) for b in (256, 1024)]
    tries += [("IVF+PQ", f"probes={p}", lambda p=p: vectors.ivf_pq(base, asked, 100, lists=16, probes=p, m=16, rerank=200)) for p in (4, 14)]
    rows = [vectors.measured(truth, family, config, find, _place(spark, "found")) for family, config, find in tries]
    best = vectors.best_by_family(reduce(DataFrame.unionAll, rows))
    return best.select("family", "results", (F.col("recall") >= 0.9).alias("reached"), ((F.col("latency") > 0) & (F.col("bytes") > 0)).alias("measured"))


# ---- points


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    s = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").select(s.alias("query_id"), (F.lit(900.5) + F.pmod(s * 37, F.lit(99))).alias("x"), (F.lit(1.5) + F.pmod(s * 13, F.lit(48))).alias("y"))
    return p, q


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("d2", 6).alias("d2"))


@query
def geo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(geo.nearest_small(*_points(spark, sf_dir)))


@query
def geo_nearest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(geo.nearest(*_points(spark, sf_dir)))


@query
def geo_insert_then_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = _points(spark, sf_dir)
    return _found(geo.nearest(geo.insert(p, q), q))


@query
def geo_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.bounding_box(_points(spark, sf_dir)[0])


# ---- keyed tables


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by customer number, shifted so that some keys are unknown."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1_000_000).otherwise(0)).alias("key"), F.col("o_totalprice").alias("value"))


@query
def kv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.get(_customers(spark, sf_dir), _orders(spark, sf_dir).select("key").distinct())


@query
def kv_insert_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.insert(_customers(spark, sf_dir), _orders(spark, sf_dir))[1]


@query
def kv_insert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.insert(_customers(spark, sf_dir), _orders(spark, sf_dir))[0]


@query
def kv_update_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.update(_customers(spark, sf_dir), _orders(spark, sf_dir))[1]


@query
def kv_update_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.update(_customers(spark, sf_dir), _orders(spark, sf_dir))[0]


@query
def kv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.delete(_customers(spark, sf_dir), _orders(spark, sf_dir).filter("key % 2 = 0"))[0]


@query
def kv_delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.delete(_customers(spark, sf_dir), _orders(spark, sf_dir).filter("key % 2 = 0"))[1]


@query
def kv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"))


@query
def kv_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = {"signup": "insert", "purchase": "insert", "click": "update", "error": "delete"}
    op = F.lit("get")
    for event, name in ops.items():
        op = F.when(F.col("event_type") == event, name).otherwise(op)
    e = table(spark, sf_dir, "events")
    return keyed.replay(e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), "value"))


@query
def kv_directory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "orders").select(hash_key("o_orderkey").alias("h")).distinct()
    return keyed.directory_stats(h, 64)


@query
def perfect_hash_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("double").alias("value"))
    return keyed.perfect_slots(n)


@query
def hash_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hash of every customer's name, and its eight slots in a table of 1,009."""
    out = table(spark, sf_dir, "customer").select("c_custkey", hash_all("c_name", 1009).alias("h"))
    return out.select("c_custkey", "h.prehash", "h.splitmix", "h.fmix", "h.short", F.array_join("h.slots", " ").alias("slots"))


@query
def perfect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("double").alias("value"))
    slots = keyed.perfect_slots(n)
    asked = n.select("key").unionAll(table(spark, sf_dir, "region").select(F.col("r_name").alias("key")))
    return keyed.get(slots, asked)


# ---- readers and writers: what is written is read again


@query
def wiki_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a wiki dump; its articles as JSON lines, read again."""
    p = table(spark, sf_dir, "pages")
    title = F.concat(F.lit("Page "), "page_id")
    dump = p.select(title.alias("title"), (F.col("page_id") % 3).cast("int").alias("ns"), F.col("page_id").cast("string").alias("id"), F.struct(F.col("html").alias("text")).alias("revision"))
    path = _place(spark, "dump")
    dump.write.option("rowTag", "page").option("compression", "bzip2").xml(path)
    files.write_jsonl(files.articles(files.read_wiki_xml(spark, path)), f"{path}-lines")
    return files.read_jsonl(spark, f"{path}-lines").select("id", "title", F.sha2("text", 256).alias("digest"))


def _points_file(spark: SparkSession, sf_dir: str, bad: bool) -> str:
    p, path = table(spark, sf_dir, "part"), _place(spark, "points")
    line = F.concat(F.col("p_retailprice").cast("string"), F.lit(","), F.col("p_size").cast("string"))
    p.select(F.when(F.lit(bad) & (F.col("p_partkey") % 10 == 3), F.lit("bad_line")).otherwise(line).alias("value")).write.text(path)
    return path


@query
def points_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_points(spark, _points_file(spark, sf_dir, False))


@query
def points_csv_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_points_lenient(spark, _points_file(spark, sf_dir, True))


@query
def pairs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names with a comma in them, in several files, each with a header."""
    path = _place(spark, "pairs")
    c = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(","), "c_mktsegment").alias("key"), F.col("c_acctbal").alias("value"))
    c.repartition(3, "key").select(F.concat_ws(",", "key", F.col("value").cast("string")).alias("text,y")).write.option("header", True).option("quote", "").option("sep", "\t").csv(path)
    return files.read_pairs(spark, path)


@query
def vectors_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = _place(spark, "vectors"), table(spark, sf_dir, "embeddings")
    lines = e.select("vec_id", F.concat(F.lit("v"), "vec_id", F.lit(" "), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value"))
    head = e.agg(F.lit(-1).cast("long").alias("vec_id"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" "), F.max(F.size("embedding")).cast("string")).alias("value"))
    # the format is one file
    lines.unionAll(head).coalesce(1).sortWithinPartitions("vec_id").select("value").write.text(path)
    back = files.read_vectors(spark, path)
    return back.agg(F.count(F.lit(1)).alias("vectors"), F.round(F.sum(vectors.inner(F.col("embedding"), F.col("embedding"))), 3).alias("squares"), F.max(F.size("embedding")).alias("d"))


@query
def table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, path = tables.Table(_customers(spark, sf_dir)), _place(spark, "table")
    t.delete(_orders(spark, sf_dir).filter("key % 2 = 0").select("key"))
    t.sync(path)
    return tables.Table.open(spark, path).rows


@query
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, a file for each region: regions with the number of lines, and whether a listing preselects the file."""
    path = _place(spark, "files")
    table(spark, sf_dir, "nation").repartition(1, "n_regionkey").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    out = files.list_files(spark, f"{path}/*")
    return out.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region"), "lines", "preselected")


@query
def made_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded generators: keys with values, and texts of numbered words."""
    pairs = generate.pairs(spark, 1000).select(F.col("key").alias("name"), F.col("value").cast("string").alias("content"))
    return pairs.unionAll(generate.modular_text(spark, 100, 6).select(F.col("doc_id").cast("string"), "text"))


# ---- maps over an event log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), "event_type", "value")


@query
def map_put_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.put_last(_log(spark, sf_dir).select("seq", "key", F.col("event_type").alias("value")))


@query
def map_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys put into a map object and asked for, among them unknown ones."""
    m = tables.Map(spark)
    m.put(_log(spark, sf_dir).select("seq", "key", F.col("event_type").alias("value")))
    return m.get(spark.range(1, 400, 3).select(F.col("id").cast("string").alias("key")))


@query
def map_merge_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("seq", "key", F.substring("event_type", 1, 1).alias("value"))
    return keyed.merge(log, lambda old, new: F.concat(old, new), associative=True)


@query
def map_merge_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.merge_sum(_log(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query
def map_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.map_buckets(_log(spark, sf_dir))


@query
def map_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.bucket_histogram(_log(spark, sf_dir), 64)


@query
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate, over the table as a batch."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = upsert.windowed(e)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- markup, formatting, statistics


@query
def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean_markup(F.col("html")).alias("text"))


@query
def article_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("ns", F.col("page_id") % 3)
    p = p.withColumn("body", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("#REDIRECT "), "url")).otherwise(F.col("html")))
    return p.filter(text.is_article(F.col("ns"), F.col("body"))).select("page_id")


@query
def format_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_bytes(n).alias("bytes"), text.format_count(n).alias("count"))


@query
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.wrap(F.col("text"), 60)
    out = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(lines).alias("line", "text"))
    return out.select("item_id", F.col("line").cast("long").alias("line"), "text")


@query
def ci95_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = statistics.mean_ci95(e, "event_type", "value")
    b = statistics.mean_ci95(e, "event_type", "value", sample=False).select("event_type", F.col("ci95").alias("ci95_population"))
    return a.join(b, "event_type").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "ci95", "ci95_population")))
