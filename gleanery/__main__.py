"""python -m gleanery clean | compression | profile: wiki dumps to JSON lines, index sizes, timed searches."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.operators import postings
from gleanery.operators.search import Engine
from gleanery.sources import files, generate


def _clean(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_jsonl(files.articles(files.read_wiki_xml(spark, f"{a.input}/*.bz2")), a.output, a.max or None)


def _compression(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_jsonl(spark, a.data).select(F.xxhash64("id", "title").alias("doc_id"), "text")
    for n in map(int, a.sizes.split(",")):
        some = rows.limit(n).withColumn("doc_id", F.row_number().over(_by_id()))
        sizes = postings.list_sizes(postings.postings(some)).agg(F.sum("raw_bytes").alias("raw"), F.sum("packed_bytes").alias("packed")).first()
        line = f"{n},{sizes.raw or 0},{sizes.packed or 0},{(sizes.raw or 0) / max(1, sizes.packed or 0):.2f}"
        print(line)
        if a.output:
            with open(a.output, "a") as f:
                f.write(line + "\n")


def _by_id():
    from pyspark.sql.window import Window

    return Window.orderBy("doc_id")  # the ids of one measured sample


def _profile(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = generate.modular_text(spark, a.size).persist()
    docs.count()
    for _ in range(a.rounds):
        began = time.perf_counter()
        hits = Engine(docs).search(a.query) if a.mode == "search" else postings.postings(docs)
        n = hits.count()
        print(f"{a.mode}: {n} rows in {time.perf_counter() - began:.3f} s")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gleanery", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean", help="articles of *.bz2 wiki dumps as JSON lines")
    c.add_argument("-input", required=True)
    c.add_argument("-output", required=True)
    c.add_argument("-max", type=int, default=0)
    c = sub.add_parser("compression", help="raw and packed sizes of posting lists of JSON lines")
    c.add_argument("-data", required=True)
    c.add_argument("-output", default="")
    c.add_argument("-sizes", default="1000")
    c = sub.add_parser("profile", help="timed index builds or searches over made texts")
    c.add_argument("-mode", choices=("build", "search"), default="search")
    c.add_argument("-size", type=int, default=10_000)
    c.add_argument("-query", default="word1 AND word17")
    c.add_argument("-rounds", type=int, default=3)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("gleanery").getOrCreate()
    {"clean": _clean, "compression": _compression, "profile": _profile}[a.command](spark, a)


if __name__ == "__main__":
    main()
