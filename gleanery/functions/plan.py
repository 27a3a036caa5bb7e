"""Plan shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, keep: list[str], /, **columns: Column) -> DataFrame:
    """keep and new columns, each computed once for a row, however often it is used above.

    Catalyst pushes filters through projections and puts a column's expression in place of its name, also inside
    lambdas, where it would run again for every element. A generator of one row is a border to that.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_made")
    return df.select(*keep, made).select(*keep, *(F.col(f"_made.{n}").alias(n) for n in columns))
