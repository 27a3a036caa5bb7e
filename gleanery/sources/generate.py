"""Seeded synthetic inputs: the same rows for the same seed, in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "amber basil cedar delta ember frost grove heron indigo juniper kelp lotus maple north opal pine quartz river slate topaz umber violet willow zephyr"


def _unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)


def points(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(id, x, y): x in [-180, 180), y in [-90, 90), six decimals."""
    i = F.col("id")
    return spark.range(n).select("id", F.round(_unit(i, seed) * 360 - 180, 6).alias("x"), F.round(_unit(i, seed + 1) * 180 - 90, 6).alias("y"))


def pairs(spark: SparkSession, n: int, width: int = 32) -> DataFrame:
    """(key, value): padded distinct keys, value (i mod 1000) / 1000."""
    return spark.range(n).select(F.concat(F.lit("key_"), F.lpad(F.col("id").cast("string"), width - 4, "0")).alias("key"), (F.pmod("id", F.lit(1000)) / 1000).alias("value"))


def documents(spark: SparkSession, n: int, words: int = 24, seed: int = 1) -> DataFrame:
    """(doc_id, text): that many words of a list of 24."""
    some = F.array(*(F.lit(w) for w in WORDS.split()))
    pick = lambda j: F.get(some, F.pmod(F.xxhash64(F.col("id"), j, F.lit(seed)), F.lit(24)).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), pick), " ") if words > 0 else F.lit("")
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))


def modular_text(spark: SparkSession, n: int, words: int = 50) -> DataFrame:
    """(doc_id, text) of words whose numbers are sums modulo fixed primes, for profiling."""
    word = lambda j: F.concat(F.lit("word"), F.pmod(F.col("id") * 31 + j * 17, F.lit(997)).cast("string"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word), " ").alias("text"))
