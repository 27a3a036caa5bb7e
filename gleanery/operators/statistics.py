"""Means with 95 % confidence half-widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def half_width(x: Column, sample: bool = True) -> Column:
    """Of the mean, by the sample's or the population's standard deviation; 0 for fewer than two values."""
    sd = F.stddev_samp(x) if sample else F.stddev_pop(x)
    return F.when(F.count(x) > 1, F.lit(Z) * sd / F.sqrt(F.count(x))).otherwise(F.lit(0.0))


def mean_ci95(df: DataFrame, by: str, value: str, sample: bool = True) -> DataFrame:
    """(by, n, mean, ci95)."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), half_width(F.col(value), sample).alias("ci95"))
