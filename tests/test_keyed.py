import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions.hashing import hash_key
from gleanery.operators import keyed, statistics
from gleanery.sources import generate

KV = "key long, value long"


def kv(spark, rows, schema=KV):
    return spark.createDataFrame(rows, schema)


def test_get(spark):
    t = kv(spark, [("a", 1.25), ("", 42.25)], "key string, value double")
    asked = kv(spark, [("a",), ("x",), ("",), (None,)], "key string")
    assert {tuple(r) for r in keyed.get(t, asked).collect()} == {("a", 1.25, True), ("x", None, False), ("", 42.25, True), (None, None, False)}


def test_strict_operations(spark):
    t = kv(spark, [(1, 10), (2, 20)])
    out, report = keyed.insert(t, kv(spark, [(2, 5), (3, 30), (3, 31)]))
    assert {tuple(r) for r in out.collect()} == {(1, 10), (2, 20), (3, 30)}
    assert sorted(tuple(r) for r in report.collect()) == [(2, 5, "exists"), (3, 30, "inserted"), (3, 31, "exists")]
    out, report = keyed.update(t, kv(spark, [(2, 5), (3, 30)]))
    assert {tuple(r) for r in out.collect()} == {(1, 10), (2, 5)}
    assert {tuple(r) for r in report.collect()} == {(2, 5, "updated"), (3, 30, "missing")}
    out, report = keyed.delete(t, kv(spark, [(2,), (9,), (2,)], "key long"))
    assert [tuple(r) for r in out.collect()] == [(1, 10)]
    assert {tuple(r) for r in report.collect()} == {(2, True), (9, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_dict(spark, seed):
    rng = random.Random(seed)
    log = [(i * 7, rng.choice(["insert", "update", "delete", "get"]), rng.randrange(60), rng.randrange(1000)) for i in range(4000)]
    mirror, counts = {}, {}
    for _, op, k, v in log:
        c = counts.setdefault(k, {"insert": 0, "update": 0, "delete": 0, "bad": 0})
        ok = (op == "insert") == (k not in mirror)
        if op == "get":
            continue
        c[op if ok else "bad"] += 1
        if ok and op == "delete":
            del mirror[k]
        elif ok:
            mirror[k] = v
    rng.shuffle(log)
    out = {r.key: r for r in keyed.replay(kv(spark, log, "seq long, op string, key long, value long")).collect()}
    assert {k: r.value for k, r in out.items() if r.alive} == mirror
    for k, c in counts.items():
        assert (out[k].inserts, out[k].updates, out[k].deletes, out[k].rejected) == tuple(c.values())


def directory(hashes, capacity):
    """Buckets of a trie over low bits that splits what is over capacity: (buckets, depth, largest)."""

    def walk(some, depth):
        if len(some) <= capacity:
            return 1, depth, len(some)
        halves = [walk([h for h in some if h >> depth & 1 == bit], depth + 1) for bit in (0, 1)]
        return sum(h[0] for h in halves), max(h[1] for h in halves), max(h[2] for h in halves)

    return walk(hashes, 0)


@pytest.mark.parametrize("n,capacity", [(0, 4), (3, 4), (5, 4), (512, 2), (3000, 8), (3000, 64)])
def test_directory(spark, n, capacity):
    h = spark.range(n).select(hash_key("id").alias("h"))
    row = keyed.directory_stats(h, capacity).first()
    assert (row.buckets, row.global_depth, row.max_load) == directory([r.h % 2**64 for r in h.collect()], capacity) and row["size"] == n


def test_directory_limits(spark):
    for bad in (0, (1 << 20) + 1):
        with pytest.raises(ValueError):
            keyed.directory_stats(spark.range(1).select(F.col("id").alias("h")), bad)
    same = spark.range(3).select((F.col("id") * (1 << 40)).alias("h"))
    with pytest.raises(Exception, match="hash space exhausted"):
        keyed.directory_stats(same, 2).collect()


def test_maps(spark):
    log = kv(spark, [(1, "k", "1"), (2, "k", "2"), (3, "j", "9")], "seq long, key string, value string")
    assert {tuple(r) for r in keyed.merge(log, lambda a, b: F.concat(a, b)).collect()} == {("k", "12"), ("j", "9")}
    assert {tuple(r) for r in keyed.merge(log, lambda a, b: F.concat(a, b), associative=True).collect()} == {("k", "12"), ("j", "9")}
    assert {tuple(r) for r in keyed.put_last(log).collect()} == {("k", "2"), ("j", "9")}
    hot = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("seq"), F.when(F.col("id") % 3 == 0, "h").otherwise("r").alias("key"), (F.col("id") * 7919 % 20_000 % 10).cast("string").alias("value"))
    want = {}
    for r in sorted(hot.collect(), key=lambda r: r.seq):
        want[r.key] = want.get(r.key, "") + r.value
    assert dict(map(tuple, keyed.merge(hot, lambda a, b: F.concat(a, b), associative=True).collect())) == want
    rows = keyed._stretches(hot, lambda a, b: F.concat(a, b)).select(F.length("value").alias("n")).collect()
    assert len(rows) == 10 and max(r.n for r in rows) <= keyed.STRETCH
    for n, buckets in ((0, 16), (12, 16), (13, 32), (24, 32), (25, 64), (1000, 2048)):
        row = keyed.map_buckets(spark.range(n).select(F.col("id").cast("string").alias("key"))).first()
        assert (row["size"], row.buckets) == (n, buckets)
    keys = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    assert sum(r["keys"] for r in keyed.bucket_histogram(keys, 0).collect()) == 1000


def test_perfect_slots(spark):
    t = generate.pairs(spark, 150)
    out = keyed.perfect_slots(t).collect()
    assert len({r.slot for r in out}) == 150 and all(0 <= r.slot < r.size for r in out)
    assert {(r.key, r.value) for r in out} == {tuple(r) for r in t.collect()}
    assert keyed.perfect_slots(t.filter("false")).count() == 0
    with pytest.raises(keyed.DuplicateKey):
        keyed.perfect_slots(t.limit(1).unionAll(t.limit(1)))
    with pytest.raises(ValueError):
        keyed.perfect_slots(t, most=10)


def test_confidence(spark):
    df = kv(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    a, b = (r.ci95 for r in statistics.mean_ci95(df, "g", "v").orderBy("g").collect())
    assert a == pytest.approx(1.96 * 2**0.5 / 2**0.5) and b == 0.0
    assert statistics.mean_ci95(df, "g", "v", sample=False).orderBy("g").first().ci95 == pytest.approx(1.96 / 2**0.5)
