"""The registered queries of this subpackage: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.decontaminate import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.urlfilter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), cut=0.7)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gleanery.llm.line_dedup import line_counts

    out = line_counts(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
