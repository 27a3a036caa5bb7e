"""Planar points: bounding box, exact nearest neighbour by direct comparison or over grid cells."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources.files import shared_folder

#: Points in a grid cell at about, and how much larger cells are in the next round.
PER_CELL, GROW = 4, 3.0
#: Points that a broadcast comparison with all may have.
SMALL = 50_000
#: Distances that a worker holds at once; those of one query at least.
TILE = 1 << 18


class EmptyInput(ValueError):
    """There are no points to be near to."""


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: points, min_x, max_x, min_y, max_y."""
    return points.agg(F.count(F.lit(1)).alias("points"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def _closest(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each query's nearest point, the first of equal ones, and its squared distance; NaN is farther than all."""
    at, least = np.empty(len(qx), np.int64), np.empty(len(qx))
    step = max(1, TILE // len(px))
    for i in range(0, len(qx), step):
        with np.errstate(over="ignore", invalid="ignore"):
            d2, dy = qx[i : i + step, None] - px, qy[i : i + step, None] - py
            d2 *= d2
            dy *= dy
            d2 += dy
        best = d2.argmin(1)
        rows = np.arange(len(d2))
        for row in np.flatnonzero(np.isnan(d2[rows, best])):  # argmin takes the first NaN
            known = np.flatnonzero(~np.isnan(d2[row]))
            best[row] = known[d2[row, known].argmin()] if len(known) else 0
        at[i : i + step], least[i : i + step] = best, d2[rows, best]
    return at, least


def nearest_small(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, x, y, d2): all points are compared with each query; for at most SMALL distinct points, which are checked.

    The points are broadcast as arrays and the queries dealt over all tasks, which hold TILE distances at a time: no pair is a row.
    """
    spark = points.sparkSession
    xy = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    p = points.select(*xy).filter("x is not null and y is not null").distinct()
    n = p.count()
    if n == 0:
        raise EmptyInput("no points")
    if n > SMALL:
        return nearest(points, queries)
    rows = p.toArrow().sort_by([("x", "ascending"), ("y", "ascending")])  # NaN comes last
    shared = spark.sparkContext.broadcast((rows["x"].to_numpy(), rows["y"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        px, py = shared.value
        for batch in batches:
            qx, qy = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            at, d2 = _closest(qx, qy, px, py)
            unknown = pc.or_(batch.column(1).is_null(), batch.column(2).is_null()).to_numpy(zero_copy_only=False)
            yield pa.record_batch({"query_id": batch.column(0), "px": px[at], "py": py[at], "d2": pa.array(d2, mask=unknown)})

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = queries.select("query_id", *xy).repartition(parts, "query_id")
    schema = T.StructType([asked.schema["query_id"], *(T.StructField(c, T.DoubleType()) for c in ("px", "py", "d2"))])
    best = asked.mapInArrow(run, schema).groupBy("query_id").agg(F.min(F.struct("d2", "px", "py")).alias("m"))
    return best.select("query_id", F.col("m.px").alias("x"), F.col("m.py").alias("y"), F.col("m.d2").alias("d2"))


def _side(p: DataFrame, n: int, wide: float, high: float) -> float:
    """The side of a cell with about PER_CELL points where most points are: outliers don't make cells large."""
    (x0, x1), (y0, y1) = p.approxQuantile(["x", "y"], [0.05, 0.95], 0.01)
    w, h = (x1 - x0) or wide, (y1 - y0) or high
    return (math.sqrt(w * h * PER_CELL / n) if w and h else max(w, h) * PER_CELL / n) or 1.0


def nearest(points: DataFrame, queries: DataFrame) -> DataFrame:
    """The same over a grid: (query_id, x, y, d2), ties by (d2, x, y).

    Each query looks at the cell around the place in the points' box that is nearest to it and at the eight around that; it
    is done when its best distance is within what these cover, else it goes on to a grid of GROW times the side. So a query
    meets nine cells a round whatever the density. Equal points count once, so that a place that very many points share is
    one row. The driver holds the box, and for each round whether queries are open; these are stored between rounds.
    """
    p = points.select("x", "y").filter("x is not null and y is not null").distinct()
    box = bounding_box(p).first()
    if not box.points:
        raise EmptyInput("no points")
    wide, high = box.max_x - box.min_x, box.max_y - box.min_y
    side = _side(p, box.points, wide, high)
    inside = lambda v, low, top: F.greatest(F.lit(low), F.least(F.lit(top), v))
    ix, iy = inside(F.col("x"), box.min_x, box.max_x), inside(F.col("y"), box.min_y, box.max_y)
    open_ = queries.select("query_id", F.col("x").alias("qx"), F.col("y").alias("qy"), ix.alias("ix"), iy.alias("iy"))
    open_ = open_.withColumn("off", squared_distance(F.col("qx"), F.col("qy"), F.col("ix"), F.col("iy")))
    d2 = squared_distance(F.col("qx"), F.col("qy"), F.col("px"), F.col("py"))
    place = f"{shared_folder(points.sparkSession)}/nearest-{uuid.uuid4().hex}"
    done, turn = [], 0
    while True:
        low_x, low_y = F.lit(box.min_x), F.lit(box.min_y)
        cell = lambda v, low, side=side: F.floor((v - low) / F.lit(side))
        grid = p.select(cell(F.col("x"), low_x).alias("cx"), cell(F.col("y"), low_y).alias("cy"), F.col("x").alias("px"), F.col("y").alias("py"))
        at = open_.withColumns({"gx": cell(F.col("ix"), low_x), "gy": cell(F.col("iy"), low_y)})
        around = at.withColumn("cx", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)))
        best = around.join(grid, ["cx", "cy"]).groupBy("query_id").agg(F.min(F.struct(d2.alias("d2"), "px", "py")).alias("m"))
        now = at.join(best, "query_id", "left")
        reach = lambda v, low, g, side=side: F.least(v - (low + (g - 1) * side), low + (g + 2) * side - v)
        edge = F.least(reach(F.col("ix"), low_x, F.col("gx")), reach(F.col("iy"), low_y, F.col("gy")))
        all_ = side >= max(wide, high)
        # strictly within: a tie just outside must not be missed
        sure = F.coalesce(F.col("m.d2") < F.col("off") + edge * edge, F.lit(False)) | F.lit(all_)
        now.withColumn("sure", sure).select("query_id", "qx", "qy", "ix", "iy", "off", "m", "sure").write.parquet(f"{place}/{turn}")
        now = points.sparkSession.read.parquet(f"{place}/{turn}")
        done.append(now.filter("sure and m is not null").select("query_id", F.col("m.px").alias("x"), F.col("m.py").alias("y"), F.col("m.d2").alias("d2")))
        open_ = now.filter("not sure").drop("m", "sure")
        if all_ or open_.isEmpty():
            return reduce(DataFrame.unionAll, done)
        side, turn = side * GROW, turn + 1


def insert(points: DataFrame, new: DataFrame) -> DataFrame:
    """points with the rows of new; what stood there stays."""
    return points.select("x", "y").unionAll(new.select("x", "y"))
