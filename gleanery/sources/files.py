"""Readers and writers of the formats: wiki XML, JSON lines, points, keys and values, vectors, indexes, documents."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.text import clean_markup, is_article, last_comma

DOCUMENT = "id string, title string, text string"


#: Folders of sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a session on one machine without it gets a temporary folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", app.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(app.applicationId, "file://" + tempfile.mkdtemp(prefix="gleanery-"))


class BadInput(ValueError):
    """A file that must be right in every line is not."""


def read_wiki_xml(spark: SparkSession, path: str, tag: str = "page") -> DataFrame:
    """(id, title, ns, text) of the pages of XML files, bz2 or plain; pages that don't parse are left out."""
    schema = "title string, ns int, id string, revision struct<text: string>"
    reader = spark.read.schema(schema).option("rowTag", tag).option("mode", "DROPMALFORMED")
    return reader.xml(path).select("id", "title", "ns", F.coalesce("revision.text", F.lit("")).alias("text"))


def articles(pages: DataFrame) -> DataFrame:
    """(id, title, text) of main-space pages that are no redirects, cleaned, without those that are then empty."""
    kept = pages.filter(is_article(F.col("ns"), F.col("text")))
    return kept.select("id", "title", clean_markup(F.col("text")).alias("text")).filter("text <> ''")


def write_jsonl(docs: DataFrame, path: str, per_file: int | None = None) -> None:
    """JSON lines; nothing happens if path exists. per_file keeps that many rows of each input file at most."""
    if per_file is not None:
        w = Window.partitionBy(F.input_file_name()).orderBy("id")
        docs = docs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_file).drop("_n")
    docs.write.mode("ignore").json(path)


def read_jsonl(spark: SparkSession, path: str, most: int | None = None, schema: str = DOCUMENT) -> DataFrame:
    """Lines in file name order where `most` cuts; malformed lines are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if most is None:
        return rows
    return rows.withColumns({"_f": F.input_file_name(), "_r": F.monotonically_increasing_id()}).orderBy("_f", "_r").limit(most).drop("_f", "_r")


def _points(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    x, y = last_comma(F.col("value"))
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    return lines.withColumns({"a": x, "b": y}).select("value", number("a").alias("x"), number("b").alias("y"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) from lines without a header, split at the last comma; any other line is an error when it is read."""
    bad = F.col("x").isNull() | F.col("y").isNull()
    said = F.concat(F.lit("not a point: "), F.col("value"))
    ok = F.when(bad, F.raise_error(said).cast("double")).otherwise(F.col("x"))
    return _points(spark, path).select(ok.alias("x"), F.when(bad, F.raise_error(said).cast("double")).otherwise(F.col("y")).alias("y"))


def read_points_lenient(spark: SparkSession, path: str) -> DataFrame:
    """The same without the lines that are no points."""
    return _points(spark, path).filter("x is not null and y is not null").select("x", "y")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) from files with a header line, split at the last comma, so keys may have commas or be empty.

    Lines are read in splits: a header is the line at the beginning of its file. A line that doesn't fit is an error
    when it is read; so is an input that is empty.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    if lines.isEmpty():
        raise BadInput("an empty file has no header")
    # one row for each file: the first row of its first split
    heads = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("at"))
    rows = lines.join(F.broadcast(heads.select("file", "at")), ["file", "at"], "left_anti")
    key, value = last_comma(F.col("value"))
    parsed = rows.select(F.col("value").alias("line"), key.alias("key"), value.alias("v")).withColumn("value", F.expr("try_cast(trim(v) as double)"))
    bad = F.col("key").isNull() | F.col("value").isNull()
    return parsed.select("key", F.when(bad, F.raise_error(F.concat(F.lit("not a pair: "), "line")).cast("double")).otherwise(F.col("value")).alias("value"))


def read_vectors(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(vec_id, embedding) from a header `n d` and lines that end in d numbers; other lines are left out."""
    lines = spark.read.text(path)
    head = lines.first()
    if head is None or len(parts := head.value.split()) != 2 or not all(p.isdigit() for p in parts):
        raise BadInput("the first line is not `n d`")
    d = int(parts[1])
    words = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("value") != head.value).select(words.alias("w")).filter(F.size("w") >= d)
    numbers = F.transform(F.slice("w", -d, d), lambda x: x.try_cast("float"))
    vectors = rows.select(numbers.alias("embedding")).filter(F.forall("embedding", lambda x: x.isNotNull())).withColumn("vec_id", F.monotonically_increasing_id())
    out = vectors.select("vec_id", "embedding")
    return out if most is None else out.orderBy("vec_id").limit(most)


#: Of stored indexes; input bytes for one file of a bucket.
INDEX_VERSION, FILE_BYTES = 1, 128 << 20


def write_index(docs: DataFrame, path: str, buckets: int = 16) -> None:
    """A search index of documents (doc_id, text, more columns) as Parquet.

    postings (term, doc_id, positions, tf, doc_len) in folders by hash bucket of the term, sorted inside, so that a term
    reads a few row groups of one folder; documents by id; totals, a row for each part that was written.
    """
    _write_part(docs, path, buckets, "overwrite")
    meta = docs.sparkSession.createDataFrame([(INDEX_VERSION, buckets)], "version int, buckets int")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def append_index(docs: DataFrame, path: str) -> None:
    """Adds documents to a stored index; an id that it holds already, or that occurs twice, is refused."""
    spark = docs.sparkSession
    had = spark.read.parquet(f"{path}/documents").select("doc_id")
    seen = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(had.withColumn("had", F.lit(True)), "doc_id", "left")
    if bad := seen.filter("n > 1 or had or doc_id is null").head(1):
        raise BadInput(f"id {bad[0].doc_id!r} is empty or not unique")
    _write_part(docs, path, index_buckets(spark, path), "append")


def _write_part(docs: DataFrame, path: str, buckets: int, mode: str) -> None:
    from gleanery.operators import postings

    docs.sortWithinPartitions("doc_id").write.mode(mode).parquet(f"{path}/documents")
    # a bucket is dealt over files by document, so that no task writes a whole one or all of a term; how many, goes by the stored documents
    stored = docs.sparkSession.read.parquet(f"{path}/documents")
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(1, min(1 << 16, -(-size // (buckets * FILE_BYTES))))
    posts = postings.sized_postings(docs if mode == "append" else stored).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    dealt = posts.repartition(buckets * files, "bucket", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(files)))
    dealt.sortWithinPartitions("bucket", "term", "doc_id").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    postings.corpus_stats(docs).select("n_docs", "total_tokens").coalesce(1).write.mode(mode).parquet(f"{path}/totals")


def index_buckets(spark: SparkSession, path: str) -> int:
    meta = spark.read.schema("version int, buckets int").json(f"{path}/meta").first()
    if meta is None or meta.version != INDEX_VERSION:
        raise BadInput(f"{path} is an index of another version")
    return meta.buckets


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, totals (n_docs, total_tokens) and documents of write_index."""
    index_buckets(spark, path)
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("postings", "totals", "documents"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified, lines, preselected) of text files that are not empty; the first half by name is preselected."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    out = files.join(lines, "path", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    # a directory listing: one row for each file
    w = Window.orderBy("path")
    return out.withColumn("preselected", F.row_number().over(w) <= F.count(F.lit(1)).over(Window.partitionBy()) / 2)


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("modified"), "path")
