"""Keyed tables: strict insert, update and delete, operation logs, put and merge, lookups, directory statistics.

Where a single-row table would raise, a batch reports: each result has a status for each request.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.hashing import fnv1a_32, next_prime, table_hashes

MAX_DEPTH, MAX_CAPACITY = 20, 1 << 20
LOAD, FIRST_BUCKETS = 0.75, 16
#: Sequence numbers that one fold of an operation log covers.
STRETCH = 4096


class DuplicateKey(ValueError):
    """A table of unique keys was given a key twice."""


class HashSpaceExhausted(ValueError):
    """More keys than a bucket holds share all bits that a directory may use."""


def get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, found) for each row of keys."""
    t = table.select("key", "value", F.lit(True).alias("hit"))
    return keys.select("key").join(t, "key", "left").select("key", "value", F.coalesce("hit", F.lit(False)).alias("found"))


def insert(table: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with new keys, and (key, value, status): inserted, or exists if the table has the key.

    Of several requests for one key the smallest value's is first; the others find that the key exists.
    """
    per = new.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))  # equal requests are added up before they meet
    first = per.groupBy(F.col("key").alias("k")).agg(F.min("value").alias("first"))
    met = per.join(first, F.col("key").eqNullSafe(F.col("k"))).join(table.select("key", F.lit(True).alias("had")), "key", "left")
    each = met.select("key", "value", "had", "first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    wins = (F.col("i") == 1) & F.col("value").eqNullSafe(F.col("first")) & F.col("had").isNull()
    status = F.when(wins, "inserted").otherwise("exists")
    report = each.select("key", "value", status.alias("status"))
    return table.select("key", "value").unionAll(report.filter("status = 'inserted'").select("key", "value")), report


def update(table: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with new values, and (key, value, status): updated, or missing. Of several values the largest stays."""
    asked = new.groupBy("key").agg(F.max("value").alias("new"))
    out = table.select("key", "value").join(asked, "key", "left").select("key", F.coalesce("new", "value").alias("value"))
    had = new.select("key", "value").join(table.select("key", F.lit(True).alias("had")), "key", "left")
    return out, had.select("key", "value", F.when(F.col("had"), "updated").otherwise("missing").alias("status"))


def delete(table: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without the keys, and (key, existed)."""
    asked = keys.select("key").distinct()
    report = asked.join(table.select("key", F.lit(True).alias("had")), "key", "left").select("key", F.coalesce("had", F.lit(False)).alias("existed"))
    return table.select("key", "value").join(asked, "key", "left_anti"), report


def replay(log: DataFrame) -> DataFrame:
    """(key, value, alive, inserts, updates, deletes, rejected) after the log (seq, op, key, value).

    insert fails on a live key, update and delete on any other; get changes nothing. The order of a key's operations
    matters. Each stretch of STRETCH numbers is folded for both ways that it may begin, and a key's stretches are then
    chained, so a key with very many operations is no one task's work.
    """
    kind = dict(log.dtypes)["value"]
    counts = ("inserts", "updates", "deletes", "rejected")

    def begin(alive: bool) -> Column:
        # keep: the value is still the one before the stretch
        return F.struct(F.lit(alive).alias("alive"), F.lit(True).alias("keep"), F.lit(None).cast(kind).alias("value"), *(F.lit(0).cast("long").alias(c) for c in counts))

    def step(s: Column, x: Column) -> Column:
        ins, upd, rem = (x["op"] == o for o in ("insert", "update", "delete"))
        ok = (ins & ~s["alive"]) | ((upd | rem) & s["alive"])
        count = lambda name, on: (s[name] + F.when(on, 1).otherwise(0)).alias(name)
        return F.struct(
            F.when(ok, ~rem).otherwise(s["alive"]).alias("alive"),
            (s["keep"] & ~ok).alias("keep"),
            F.when(ok & rem, F.lit(None).cast(kind)).when(ok, x["v"]).otherwise(s["value"]).alias("value"),
            count("inserts", ok & ins),
            count("updates", ok & upd),
            count("deletes", ok & rem),
            count("rejected", ~ok & (ins | upd | rem)),
        )

    def chain(s: Column, x: Column) -> Column:
        got = F.when(s["alive"], x["live"]).otherwise(x["dead"])
        value = F.when(got["keep"], s["value"]).otherwise(got["value"])
        return F.struct(got["alive"].alias("alive"), F.lit(True).alias("keep"), value.alias("value"), *((s[c] + got[c]).alias(c) for c in counts))

    stretch = F.floor(F.col("seq") / STRETCH).alias("stretch")
    ops = log.groupBy("key", stretch).agg(F.array_sort(F.collect_list(F.struct("seq", "op", F.col("value").alias("v")))).alias("ops"))
    folded = ops.select("key", F.struct("stretch", F.aggregate("ops", begin(False), step).alias("dead"), F.aggregate("ops", begin(True), step).alias("live")).alias("x"))
    rows = folded.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select("key", F.aggregate("xs", begin(False), chain).alias("s")).select("key", "s.value", "s.alive", *(f"s.{c}" for c in counts))


def directory_stats(hashes: DataFrame, capacity: int) -> DataFrame:
    """One row for an insert-only load: size, buckets, global_depth, capacity, max_load.

    hashes has distinct hash values (`h`). A node of the trie over low bits splits if over capacity keys share it;
    counts by prefix are summed from the deepest level up, so the keys are read once.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity is between 1 and {MAX_CAPACITY}")
    deep = hashes.select(F.pmod("h", F.lit(1 << MAX_DEPTH)).alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    nodes = deep.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MAX_DEPTH)), lambda d: F.struct(d.alias("d"), F.pmod("low", F.pow(F.lit(2), d).cast("long")).alias("p")))).alias("x"))
    nodes = nodes.groupBy(F.col("x.d").alias("d"), F.col("x.p").alias("p")).agg(F.sum("n").alias("n"))
    # every split makes one bucket two; the deepest split is one level above the deepest bucket
    split = nodes.filter(F.col("n") > capacity).agg(F.count(F.lit(1)).alias("splits"), F.max("d").alias("deepest"))
    size = hashes.agg(F.count(F.lit(1)).alias("size"))
    # loads of leaves: nodes that do not split and whose parent does
    parent = nodes.filter(F.col("n") > capacity).select((F.col("d") + 1).alias("d"), F.col("p").alias("pp"))
    leaf = nodes.filter(F.col("n") <= capacity).withColumn("pp", F.pmod("p", F.pow(F.lit(2), F.greatest(F.col("d") - 1, F.lit(0))).cast("long")))
    load = leaf.join(parent, ["d", "pp"], "left_semi").unionByName(leaf.filter("d = 0")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_load"))
    out = size.crossJoin(split).crossJoin(load)  # one row each
    full = F.coalesce("deepest", F.lit(-1)) >= MAX_DEPTH
    checked = F.when(full, F.raise_error(F.lit("hash space exhausted")).cast("int")).otherwise((F.coalesce("deepest", F.lit(-1)) + 1).cast("int"))
    return out.select("size", (F.col("splits") + 1).alias("buckets"), checked.alias("global_depth"), F.lit(capacity).alias("capacity"), "max_load")


def put_last(log: DataFrame) -> DataFrame:
    """(key, value): the last write of (seq, key, value) wins."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def merge(log: DataFrame, merger: Callable[[Column, Column], Column], associative: bool = False) -> DataFrame:
    """(key, value): merger(old, new) folded over each key's values in seq order, the first as it is.

    With an associative merger each stretch of STRETCH numbers is folded by itself and a key's stretches are then folded, so
    that a key with very many values is no one task's work; with any other a key's values must meet in one row.
    """
    log = _stretches(log, merger) if associative else log
    rows = log.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("w"))
    return rows.select("key", _fold(merger))


def _fold(merger: Callable[[Column, Column], Column]) -> Column:
    """merger over the values of an ordered array w of (seq, value)."""
    values = F.transform("w", lambda x: x["value"])
    return F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.element_at(values, 1), merger).alias("value")


def _stretches(log: DataFrame, merger: Callable[[Column, Column], Column]) -> DataFrame:
    rows = log.groupBy("key", F.floor(F.col("seq") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("w"))
    return rows.select("key", F.col("stretch").alias("seq"), _fold(merger))


def merge_sum(log: DataFrame) -> DataFrame:
    """merge() by addition: commutative, so partial sums leave each task."""
    return log.groupBy("key").agg(F.sum("value").alias("value"))


def map_buckets(keys: DataFrame) -> DataFrame:
    """One row: size and buckets of a map that doubles from 16 while over 0.75 full."""
    n = keys.select("key").distinct().agg(F.count(F.lit(1)).alias("size"))
    grow = F.ceil(F.log2(F.greatest(F.col("size") / LOAD / FIRST_BUCKETS, F.lit(1.0)))).cast("int")
    return n.select("size", (F.lit(FIRST_BUCKETS) * F.pow(F.lit(2), grow)).cast("long").alias("buckets"))


def bucket_histogram(keys: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys): distinct keys by FNV-1a 32 modulo buckets (fewer than one means 16)."""
    n = buckets if buckets >= 1 else FIRST_BUCKETS
    return keys.select("key").distinct().groupBy(F.pmod(fnv1a_32(F.col("key")), F.lit(n)).alias("bucket")).agg(F.count(F.lit(1)).alias("keys"))


def perfect_slots(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(key, value, slot, size, hash): a collision-free table over at most `most` distinct keys, which come to the driver.

    For each prime size in turn, eight hashes are tried. A key that occurs twice can have no slot: it is refused.
    """
    rows = table.select("key", "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} keys")
    keys = [r.key.encode() for r in rows]
    if len(set(keys)) < len(keys):
        raise DuplicateKey("a key occurs twice")
    size = next_prime(max(2, 2 * len(keys) + 1))
    while keys:
        for i, slots in enumerate(table_hashes(keys, size)):
            if len(np.unique(slots)) == len(keys):
                out = [(r.key, r.value, int(s), size, i) for r, s in zip(rows, slots, strict=True)]
                return table.sparkSession.createDataFrame(out, "key string, value double, slot long, size long, hash int")
        size = next_prime(2 * size + 1)
    return table.sparkSession.createDataFrame([], "key string, value double, slot long, size long, hash int")
