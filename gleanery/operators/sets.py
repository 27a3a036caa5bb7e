"""Posting lists as DataFrames (doc_id, positions): one row for each document, positions ascending.

For whole queries `search` needs no joins; these operators combine lists that are tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.search import _near_positions, _sorted_union


def _pair(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select("doc_id", F.col("positions").alias("a")).join(b.select("doc_id", F.col("positions").alias("b")), "doc_id", how)


def merge_positions(a: Column, b: Column) -> Column:
    """Ascending, each once."""
    return _sorted_union(a, b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of both, with the positions of both."""
    return _pair(a, b, "inner").select("doc_id", _sorted_union(F.col("a"), F.col("b")).alias("positions"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of either."""
    none = F.array().cast("array<int>")
    return _pair(a, b, "full").select("doc_id", _sorted_union(F.coalesce("a", none), F.coalesce("b", none)).alias("positions"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of a that b lacks, with a's positions."""
    return a.select("doc_id", "positions").join(b.select("doc_id"), "doc_id", "left_anti")


def adjacent(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents where a position of b follows one of a, with all such pairs."""
    first = F.array_intersect("a", F.transform("b", lambda y: y - 1))
    both = _pair(a, b, "inner").select("doc_id", first.alias("f")).filter(F.size("f") > 0)
    return both.select("doc_id", _sorted_union(F.col("f"), F.transform("f", lambda x: x + 1)).alias("positions"))


def near(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Documents where positions of both are k apart at most, in either order, with the ends of such pairs.

    The list with fewer documents leads, a if they have as many.
    """
    if b.count() < a.count():
        a, b = b, a
    close = F.exists("a", lambda x: F.exists("b", lambda y: F.abs(x - y) <= k))
    return _pair(a, b, "inner").filter(close).select("doc_id", _near_positions(F.col("a"), F.col("b"), k).alias("positions"))


def advance(posts: DataFrame, target: int) -> DataFrame:
    """The first row whose doc_id is target or above, if there is one."""
    at = posts.filter(F.col("doc_id") >= target)
    return at.orderBy("doc_id").limit(1)


def frequency_at(posts: DataFrame, doc_id: int) -> DataFrame:
    """One row tf: the number of positions in that document, 0 if the list lacks it."""
    return posts.filter(F.col("doc_id") == doc_id).agg(F.coalesce(F.max(F.size("positions")), F.lit(0)).alias("tf"))
