"""Mixing sources to target weights: subset-sum budget fitting over counts by exact length.

Targets come from the sources' sizes alone. For each source, documents are counted by exact length; whole passes over
the source cover what they can of its target, and a bounded-knapsack dynamic programme over lengths fits the rest to the
word. Of each length, the chosen number of documents is taken in seeded order.

What a task holds of a source is one row for each distinct length, never its documents; a length that very many
documents share is dealt out over seeded buckets before it is ranked.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import Scratch, free_name, missing, split_words

SPACE = r"[\x20\x09-\x0D]+"
#: Words that are left to the dynamic programme: DP_WORDS, or LONGEST of the source's longest documents if that is more, in
#: steps of one unit if these are more than DP_SUMS. If n documents are of the commonest length, there are sqrt(n / BUCKET) buckets.
DP_WORDS, LONGEST, DP_SUMS, BUCKET = 1 << 16, 4, 1 << 22, 32


def n_words(text: Column) -> Column:
    return F.size(split_words(text, SPACE)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2) -> dict[str | None, float]:
    """share of all sizes dealt by weight, none above cap times its size; the excess is dealt again among the rest.

    Sources go by code point, null last; weights repeat over that order.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= cap * sizes[s]]
        if not full:
            return out | {s: float(unit * weight[s]) for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near to budget.

    Lengths are distinct and positive. Every length first gives its share, rounded down; shares with the largest
    remainders are rounded up while more words are open than the programme takes; a bounded knapsack settles the rest from below, and one
    document may go over if that is nearer.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    most = max(DP_WORDS, LONGEST * int(lengths.max()))
    exact = [Fraction(int(c) * budget, total) for c in counts]
    take = np.array([int(x) for x in exact], np.int64)
    left = budget - int((take * lengths).sum())
    for i in sorted(range(len(lengths)), key=lambda i: (int(exact[i]) - exact[i], -int(lengths[i]))):
        if left <= most:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths):  # only if single steps could not bring it down
        if left <= most:
            break
        n = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    for i in np.argsort(lengths):  # two documents of each length, the short ones first, are open again
        n = min(2, int(take[i]), max(0, most - left) // int(lengths[i]))
        take[i] -= n
        left += n * int(lengths[i])
    take += _knapsack(lengths, counts - take, min(left, most))
    left = budget - int((take * lengths).sum())
    over = np.where(take < counts, np.abs(lengths - left), left)
    if left and over.min() < left:  # one document more comes nearer, from above
        take[over.argmin()] += 1
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Reachable sums up to budget; each sum remembers the item that reached it first.

    Lengths count in units of their common divisor. If that leaves over DP_SUMS sums, the unit is larger and lengths are
    rounded up to it, so that sums stay below budget and miss the nearest by less than a unit for each document.
    """
    unit = max(int(np.gcd.reduce(lengths)), -(-budget // DP_SUMS))
    lengths, budget = -(-lengths // unit), budget // unit
    item: list[tuple[int, int]] = []
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int64)
    for i in np.argsort(-counts, kind="stable"):
        length, open_ = int(lengths[i]), int(min(counts[i], budget // max(1, int(lengths[i]))))
        step = 1
        while open_ > 0 and not reached[budget]:
            n = min(step, open_)
            w = n * length
            new = np.zeros_like(reached)
            new[w:] = reached[: budget + 1 - w]
            new &= ~reached
            by[new] = len(item)
            reached |= new
            item.append((int(i), n))
            open_ -= n
            step *= 2
        if reached[budget]:
            break
    out = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = item[by[at]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


#: Sources whose row goes to every task by broadcast at most: about 4 MB.
FEW = 50_000


def _mix(docs: DataFrame, rest: list[str], weights: tuple[int, ...], share: Fraction, cap: int, seed: int) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes and the other columns in a struct `rest`, for each row."""
    missing(docs, ("doc_id", "text", "source"))
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    order = F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed))
    kept = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("none"))
    sized = scratch.table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("h"), kept.alias("rest")), "sized")
    hist = scratch.table(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    totals = {r.source: (int(r.s), r.most) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("s"), F.max("docs").alias("most")).collect()}
    goal = targets({s: n for s, (n, _) in totals.items()}, weights, share, cap)
    rows = [(i, s, totals[s][0], goal[s]) for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))]
    named = spark.createDataFrame(rows, "k int, name string, source_size long, target double")
    named = F.broadcast(named) if len(rows) <= FEW else named

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        size, target = int(part.source_size.iloc[0]), float(part.target.iloc[0])
        passes = int(target // size) if size else 0
        part = part.sort_values("size")
        extra = np.zeros(len(part), np.int64)
        real = part["size"].to_numpy() > 0
        if passes < cap:
            extra[real] = fit(part["size"].to_numpy()[real], part["docs"].to_numpy()[real], round(target - passes * size))
        return part.assign(passes=passes, extra=extra)[["k", "size", "source_size", "target", "passes", "extra"]]

    by_name = F.col("source").eqNullSafe(F.col("name"))
    planned = hist.join(named, by_name).groupBy("k").applyInPandas(plan, "k int, size long, source_size long, target double, passes int, extra long")
    planned = scratch.table(planned, "plan")
    # documents of one source and length are dealt over buckets before anything is joined with them
    buckets = ceil(sqrt(max([1, *(most for _, most in totals.values())]) / BUCKET))
    keys = ["k", "size", "bucket"]
    placed = sized.join(named.select("k", "name"), by_name).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    upto = Window.partitionBy("k", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cells = cells.join(planned, ["k", "size"]).select(*keys, "source_size", "target", "passes", (F.col("extra") - F.col("before")).alias("open"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
    out = placed.withColumn("rank", rank).join(cells, keys).withColumn("times", F.col("passes") + (F.col("rank") <= F.col("open")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "rest")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 17) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken.

    size is the number of words (null text: 0), taken the words the mix takes with repeats, a multiple of size and at
    most cap times it. Null is a source of its own. Rows that tie in seeded order (equal ids and texts) are exchangeable.
    One row for each source comes to the driver. No rows give no rows; other columns are ignored.
    """
    return _mix(docs, [], weights, share, cap, seed).drop("times", "rest")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 17) -> DataFrame:
    """The rows of docs that the mix takes, all their columns, and size, source_size, target, taken and repeats.

    A document that the mix takes twice is one row with repeats 2; it is read so often. See mix for all else. An added
    column that docs has too gets underscores at its end.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    out = _mix(docs, others, weights, share, cap, seed).filter("taken > 0")
    added = {"size": "size", "source_size": "source_size", "target": "target", "taken": "taken", "repeats": "times"}
    own = [F.col(c) if c in ("doc_id", "source") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*own, *(F.col(c).alias(free_name(docs, name)) for name, c in added.items()))
