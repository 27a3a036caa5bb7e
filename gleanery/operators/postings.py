"""Positional postings, term and corpus statistics, document lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanery.functions import codec
from gleanery.functions.plan import computed
from gleanery.functions.text import index_tokens


#: Document ids that one row of a posting list covers.
STRETCH = 4096
#: Bytes of texts that are split into words together, about.
TEXTS = 2 << 20
#: A byte of UTF-8 as part of a word, lower-cased; 0 is none.
WORD = np.array([ord(c) if (c := chr(b).lower()) == "_" or (b < 128 and c.isalnum()) else 0 for b in range(256)], np.uint8)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, term, pos): positions count from 0."""
    return docs.select("doc_id", F.posexplode(index_tokens(F.col("text"))).alias("pos", "term")).select("doc_id", "term", "pos")


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, positions, tf): ascending positions of each term in each document."""
    out = tokens(docs).groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return out.withColumn("tf", F.size("positions"))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of index_tokens of all texts, the text of each and its place there."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = WORD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = ends[:-1][ends[:-1] < len(data)]
    begins[edge] = inside[edge]
    at = np.flatnonzero(begins)
    if not len(at):
        return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(np.add.reduceat(inside.view(np.uint8), at, dtype=np.int64))]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(upto), pa.py_buffer(data[inside]))
    first = np.searchsorted(at, ends)
    n = np.diff(first)
    return words, np.repeat(np.arange(len(n)), n), np.arange(len(at)) - np.repeat(first[:-1], n)


def _coded(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    words, row, pos = _words(rows.column(1))
    if not len(words):
        return None
    ids = rows.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()[row]
    words = words.dictionary_encode()
    key = ids.astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable") if ids[-1] == rows.num_rows - 1 else np.lexsort([pos, key])
    key, pos = key[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    delta = np.diff(pos, prepend=0)
    delta[first] = pos[first]
    data = codec.binary(*codec.encode_all(delta, np.diff(np.append(first, len(key)))))
    one = order[first]
    return pa.record_batch({"term": words.dictionary.take(words.indices.take(pa.array(one))), "doc_id": rows.column(0).take(pa.array(row[one])), "data": data})


def coded(docs: DataFrame) -> DataFrame:
    """(term, doc_id, data): postings with the positions of a document as coded differences; see codec.encode.

    Documents are dealt by doc_id and split into words beside each other, about TEXTS bytes at a time, so texts are shuffled
    and not words. Rows of one doc_id, which follow each other, count together.
    """
    most = TEXTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                rows = batch.slice(low, high - low)
                if held is not None:
                    rows = pa.concat_batches([held, rows])
                if rows.num_rows:
                    code = rows.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
                    whole = int(np.flatnonzero(code != code[-1])[-1]) + 1 if code[0] != code[-1] else 0
                    if whole and (out := _coded(rows.slice(0, whole))):
                        yield out
                    held = rows.slice(whole)
        if held is not None and (out := _coded(held)):
            yield out

    rows = docs.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema["doc_id"], T.StructField("data", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def sized_postings(docs: DataFrame) -> DataFrame:
    """The same with doc_len, the number of tokens of the document."""
    rows = computed(docs, ["doc_id"], t=index_tokens(F.col("text")))
    rows = rows.select("doc_id", F.size("t").alias("doc_len"), F.posexplode("t").alias("pos", "term"))
    out = rows.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.max("doc_len").cast("long").alias("doc_len"))
    return out.select("term", "doc_id", "positions", F.size("positions").alias("tf"), "doc_len")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_len): number of tokens; no shuffle."""
    return docs.select("doc_id", F.size(index_tokens(F.col("text"))).cast("long").alias("doc_len"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, total_tokens, avg_len (0 without documents)."""
    out = doc_lengths(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_tokens"))
    return out.withColumn("avg_len", F.when(F.col("n_docs") > 0, F.col("total_tokens") / F.col("n_docs")).otherwise(F.lit(0.0)))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf): number of documents and of occurrences; one shuffle of partial sums."""
    t = index_tokens(F.col("text"))
    one = lambda a, d, c: F.transform(a, lambda w: F.struct(w.alias("term"), F.lit(d).alias("d"), F.lit(c).alias("c")))
    rows = docs.select(F.explode(F.concat(one(F.array_distinct(t), 1, 0), one(t, 0, 1))).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.d").alias("df"), F.sum("x.c").alias("cf"))


def term_frequency(posts: DataFrame, term: str, doc_id: int) -> DataFrame:
    """One row tf: 0 if the document or the term is unknown."""
    return posts.filter((F.col("term") == term) & (F.col("doc_id") == doc_id)).agg(F.coalesce(F.max("tf"), F.lit(0)).alias("tf"))


def positions(posts: DataFrame, term: str, doc_id: int) -> DataFrame:
    """(positions) of a term in a document; no row if it has none."""
    return posts.filter((F.col("term") == term) & (F.col("doc_id") == doc_id)).select("positions")


def lookup(docs: DataFrame, doc_id: int) -> DataFrame:
    """(doc_id, title, text) of one document, empty strings for nulls; no row if there is none."""
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")
    return docs.filter(F.col("doc_id") == doc_id).select("doc_id", title.alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def title_or_number(title: Column, doc_id: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit("Document #"), doc_id.cast("string"))).otherwise(title)


def skips(df: DataFrame) -> DataFrame:
    """(term, df, levels, skips): see codec.flat_skips."""
    return df.select("term", "df", F.size(codec.skip_steps(F.col("df"))).alias("levels"), codec.flat_skips(F.col("df")).alias("skips"))


def flat_list(posts: DataFrame) -> DataFrame:
    """(term, df, flat): a term's posting list as one array [n, id differences, n, position differences, n, tf, n, skips]."""
    row = F.struct("doc_id", F.col("positions").cast("array<long>").alias("positions"), F.col("tf").cast("long").alias("tf"))
    lists = posts.groupBy("term").agg(F.array_sort(F.collect_list(row)).alias("p"))
    n = F.array(F.size("p").cast("long"))
    ids = codec.deltas(F.transform("p", lambda x: x["doc_id"]))
    where = F.flatten(F.transform("p", lambda x: codec.deltas(x["positions"])))
    tfs = F.transform("p", lambda x: x["tf"])
    skip = codec.flat_skips(F.size("p")).cast("array<long>")
    parts = [n, ids, F.array(F.size(where).cast("long")), where, n, tfs, F.array(F.size(skip).cast("long")), skip]
    return computed(lists, ["term"], df=F.size("p").cast("long"), flat=F.concat(*parts))


def _section(v: Column, at: Column) -> Column:
    """Sizes of integers that stand from index `at` of a list: varint bytes, bit-packed bytes of blocks inside, (block, bits) of the outer ones."""
    first, last = F.floor(at / codec.BLOCK), F.floor((at + F.size(v) - 1) / codec.BLOCK)

    def bits(b: Column) -> Column:
        low = F.greatest(b * codec.BLOCK - at, F.lit(0).cast("long"))
        high = F.least((b + 1) * codec.BLOCK - at, F.size(v).cast("long"))
        return F.struct(b.alias("block"), codec.bit_width(F.array_max(F.slice(v, low.cast("int") + 1, (high - low).cast("int")))).alias("bits"))

    blocks = F.when(F.size(v) == 0, F.array().cast("array<struct<block:bigint,bits:int>>")).otherwise(F.transform(F.sequence(first, last), bits))
    varint = F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + codec.varint_width(x))
    return F.struct(varint.alias("varint"), blocks.alias("blocks"))


def list_sizes(posts: DataFrame) -> DataFrame:
    """(term, df, n_ints, raw_bytes, varint_bytes, bitpack_bytes, packed_bytes) of the flat posting lists; see flat_list.

    No list is ever one row: stretches of STRETCH ids are measured where they stand in the list, blocks that two parts share
    take the larger width, and sizes are added up by term. Ids are numbers.
    """
    row = F.struct("doc_id", F.col("positions").cast("array<long>").alias("positions"), F.col("tf").cast("long").alias("tf"))
    some = posts.groupBy("term", F.floor(F.col("doc_id") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(row)).alias("p"))
    some = computed(some, ["term", "stretch"], ids=F.transform("p", lambda x: x["doc_id"].cast("long")), where=F.flatten(F.transform("p", lambda x: codec.deltas(x["positions"]))), tf=F.transform("p", lambda x: x["tf"]))
    some = some.withColumns({"n": F.size("ids").cast("long"), "m": F.size("where").cast("long"), "last": F.element_at("ids", -1)})
    by = Window.partitionBy("term").orderBy("stretch")  # a row for each stretch of a term
    upto, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("term")
    zero = F.lit(0).cast("long")
    some = some.withColumns({"n0": F.coalesce(F.sum("n").over(upto), zero), "m0": F.coalesce(F.sum("m").over(upto), zero), "before": F.coalesce(F.lag("last").over(by), zero), "df": F.sum("n").over(all_), "places": F.sum("m").over(all_)})
    before = F.concat(F.array("before"), F.slice("ids", F.lit(1), F.size("ids") - 1))
    some = computed(some, ["term", "n0", "m0", "df", "places", "where", "tf"], d=F.zip_with("ids", before, lambda x, y: x - y))
    parts = [_section(F.col("d"), 1 + F.col("n0")), _section(F.col("where"), 2 + F.col("df") + F.col("m0")), _section(F.col("tf"), 3 + F.col("df") + F.col("places") + F.col("n0"))]
    measured = computed(some, ["term"], s=F.array(*parts))
    # the four numbers and the skips of a list
    one = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).cast("long").alias("places"))
    one = computed(one, ["term", "df", "places"], skip=codec.flat_skips(F.col("df")).cast("array<long>"))
    n, m, k = F.col("df"), F.col("places"), F.size("skip").cast("long")
    single = [_section(F.array(v), i) for v, i in ((n, zero), (m, 1 + n), (n, 2 + n + m), (k, 3 + 2 * n + m))]
    fixed = computed(one, ["term"], s=F.array(*single, _section(F.col("skip"), 4 + 2 * n + m)))
    every = measured.unionAll(fixed).select("term", F.explode("s").alias("s"))
    inner = F.aggregate(F.slice("s.blocks", F.lit(2), F.greatest(F.size("s.blocks") - 2, F.lit(0))), zero, lambda t, b: t + 1 + 4 * b["bits"])
    outer = F.array_distinct(F.filter(F.array(F.get("s.blocks", F.lit(0)), F.when(F.size("s.blocks") > 1, F.element_at("s.blocks", -1))), lambda b: b.isNotNull()))
    rows = computed(every, ["term"], varint=F.col("s.varint"), inner=inner, outer=outer)
    first = lambda c: F.sum(F.when(F.col("i") == 0, F.col(c)).otherwise(zero)).alias(c)
    shared = rows.select("term", "varint", "inner", F.posexplode("outer").alias("i", "b")).groupBy("term", F.col("b.block").alias("block")).agg(F.max("b.bits").alias("bits"), first("varint"), first("inner"))
    sums = shared.groupBy("term").agg(F.sum("varint").alias("varint"), F.sum(F.col("inner") + 1 + 4 * F.col("bits")).alias("packed"))
    n_ints = 4 + 2 * n + m + k
    out = one.join(sums, "term")
    out = out.select("term", "df", n_ints.alias("n_ints"), (4 * n_ints).alias("raw_bytes"), (codec.HEADER + F.col("varint")).alias("varint_bytes"), (codec.HEADER + F.col("packed")).alias("bitpack_bytes"))
    return out.withColumn("packed_bytes", F.least("varint_bytes", "bitpack_bytes"))


def id_sizes(posts: DataFrame) -> DataFrame:
    """(term, df, varint_bytes, bitpack_bytes) of each term's document ids as differences, measured by stretch as in list_sizes."""
    some = posts.groupBy("term", F.floor(F.col("doc_id") / STRETCH).alias("stretch")).agg(F.sort_array(F.collect_list(F.col("doc_id").cast("long"))).alias("ids"))
    some = some.withColumns({"n": F.size("ids").cast("long"), "last": F.element_at("ids", -1)})
    by, zero = Window.partitionBy("term").orderBy("stretch"), F.lit(0).cast("long")
    some = some.withColumns({"n0": F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), zero), "before": F.coalesce(F.lag("last").over(by), zero)})
    before = F.concat(F.array("before"), F.slice("ids", F.lit(1), F.size("ids") - 1))
    some = computed(some, ["term", "n", "n0"], d=F.zip_with("ids", before, lambda x, y: x - y))
    rows = computed(some, ["term", "n"], s=_section(F.col("d"), F.col("n0")))
    # all blocks are rows: there is one for 32 ids
    first = lambda c: F.sum(F.when(F.col("i") == 0, c).otherwise(zero))
    blocks = rows.select("term", "n", "s.varint", F.posexplode("s.blocks").alias("i", "b")).groupBy("term", F.col("b.block").alias("block"))
    blocks = blocks.agg(F.max("b.bits").alias("bits"), first(F.col("varint")).alias("varint"), first(F.col("n")).alias("n"))
    out = blocks.groupBy("term").agg(F.sum("n").cast("int").alias("df"), (codec.HEADER + F.sum("varint")).alias("varint_bytes"), (codec.HEADER + F.sum(1 + 4 * F.col("bits"))).alias("bitpack_bytes"))
    return out


#: Words of the query language, which can be no search terms.
KEYWORDS = ("and", "or", "not", "adj", "near")


def rarest_half(sizes: DataFrame) -> DataFrame:
    """(term, packed_bytes) of the half of the terms with the smaller packed lists; at the border, by term.

    Only the counts of distinct sizes, which are few, are ordered in one place; terms are ranked within the border size.
    """
    sizes = sizes.filter(~F.col("term").isin(*KEYWORDS)).select("term", "packed_bytes")
    per = sizes.groupBy("packed_bytes").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("packed_bytes").rowsBetween(Window.unboundedPreceding, -1)
    steps = per.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "half": F.floor(F.sum("n").over(Window.partitionBy()) / 2)})
    steps = steps.withColumn("open", F.col("half") - F.col("before")).filter("open > 0").select("packed_bytes", "open", "n")
    ranked = sizes.join(steps, "packed_bytes")
    border = ranked.filter("open < n").withColumn("r", F.row_number().over(Window.partitionBy("packed_bytes").orderBy("term"))).filter("r <= open")
    return ranked.filter("open >= n").select("term", "packed_bytes").unionAll(border.select("term", "packed_bytes"))
