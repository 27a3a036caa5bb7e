import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import geo, neardup, vectors
from gleanery.sources import generate

A, B = "Hello, quick brown fox of the north.", "A text about something else entirely, told at length."


def test_case_does_not_matter(spark):
    docs = spark.createDataFrame([("a", A), ("b", B)], "doc_id string, text string")
    asked = spark.createDataFrame([("q", A.upper()), ("e", "")], "item_id string, text string")
    got = neardup.find_duplicates(asked, docs).collect()
    assert [(r.item_id, r.doc_id) for r in got] == [("q", "a")] and got[0].score >= 0.99


def test_any_text_finds_itself_and_bands_are_a_subset(spark):
    docs = generate.documents(spark, 120).unionAll(spark.createDataFrame([(500, ""), (501, None), (502, "日本 語"), (503, "...")], "doc_id long, text string"))
    asked = docs.withColumnRenamed("doc_id", "item_id")
    found = {(r.item_id, r.doc_id): r.score for r in neardup.find_duplicates(asked, docs, threshold=0.3).collect()}
    scan = {(r.item_id, r.doc_id): r.score for r in neardup.full_scan(asked, docs, threshold=0.3).collect()}
    assert found.items() <= scan.items()
    assert all(found.get((r.doc_id, r.doc_id)) == 1.0 for r in docs.collect())
    assert scan[500, 503] == 1.0


def test_threshold_zero_scan(spark):
    docs = spark.createDataFrame([(1, A), (2, B)], "doc_id long, text string")
    asked = docs.withColumnRenamed("doc_id", "item_id")
    assert neardup.full_scan(asked, docs, threshold=-1).count() == 4


def test_signature_by_hand(spark):
    from gleanery.functions import hashing as h

    s = neardup.minhash(neardup.shingled(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))).first()
    mix = lambda x: int(h.xorshift_mix(np.array([x], np.uint64))[0])
    hashes = [int(x) for x in h.fnv1a_64([b"a b", b"b c"])]
    seeds = [mix(h.GOLDEN * (i + 2) % 2**64) for i in range(64)]
    sig = [min(mix(x ^ seed) for x in hashes) for seed in seeds]
    assert [v % 2**64 for v in s.signature] == sig
    key = h.FNV_OFFSET_SHORT
    for v in sig[:8]:
        key = (key ^ mix(v)) * h.FNV_PRIME % 2**64
    assert s["keys"][0] % 2**64 == key


def test_config_and_ids(spark):
    for bad in ({"bands": 7}, {"hashes": 0}, {"threshold": 1.5}, {"shingle": 0}):
        with pytest.raises(ValueError):
            neardup.Config(**bad)
    c = neardup.Config()
    assert (c.cut(None), c.cut(0), c.cut(-1), c.cut(2)) == (0.8, 0.8, 0.0, 1.0)
    with pytest.raises(ValueError):
        neardup.check_ids(spark.createDataFrame([(1,), (1,)], "doc_id long"))
    docs = generate.documents(spark, 10)
    s = neardup.stats(neardup.buckets(neardup.minhash(neardup.shingled(docs)))).first()
    assert s.documents == 10 and 8 <= s.buckets <= 80 and (s.bands, s.hashes, s.shingle) == (8, 64, 2)


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 600)] + 0.4 * rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).persist()


def test_knn_equals_numpy(base):
    asked = base.filter("vec_id % 20 = 0")
    rows = {r.vec_id: np.array(r.embedding) for r in base.collect()}
    got = {}
    for r in vectors.knn(base, asked, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, hits in got.items():
        want = sorted(rows, key=lambda i: (-float(rows[i] @ rows[q]), i))[:5]
        assert [i for _, i in sorted(hits)] == want and want[0] == q
    assert len(got) == 30


@pytest.mark.parametrize(
    "find,least",
    [
        (lambda b, q: vectors.knn_sign_lsh(b, q, 10, bits=1024, rerank=60), 0.9),
        (lambda b, q: vectors.ivf_pq(b, q, 10, lists=12, probes=10, m=8, codes=64, rerank=80), 0.9),
        (lambda b, q: vectors.ivf_pq(b, q, 10, lists=12, probes=6, m=8, codes=64, rerank=60), 0.9),
        (lambda b, q: vectors.knn_graph(b, q, 10, links=12, build=48, width=96), 0.95),
    ],
)
def test_recall(base, find, least):
    asked = base.filter("vec_id % 20 = 0")
    r = vectors.recall(vectors.knn(base, asked, 10), find(base, asked)).first()
    assert r.wanted == 300 and r.recall >= least


@pytest.fixture(scope="module")
def even(spark):
    """Vectors in all directions alike, without groups: the hardest for estimates."""
    x = np.random.default_rng(8).standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, r.astype(np.float32).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).persist()


def test_sign_lsh_without_groups_and_with_lengths(even):
    asked = even.filter("vec_id % 50 = 0")
    for b in (even, even.withColumn("embedding", F.transform("embedding", lambda v: (v * (1 + F.col("vec_id") % 3)).cast("float")))):
        assert vectors.recall(vectors.knn(b, asked, 30), vectors.knn_sign_lsh(b, asked, 30, bits=256, rerank=90)).first().recall >= 0.9
    zero = even.limit(0).sparkSession.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0])], even.schema)
    assert [(r.query_id, r.vec_id) for r in vectors.knn_sign_lsh(zero, zero, 1, bits=3).orderBy("query_id").collect()] == [(1, 1), (2, 2)]


def test_inverted_lists_of_whole_vectors_are_exact(even):
    asked = even.filter("vec_id % 50 = 0")
    want = [(r.query_id, r.vec_id, r["rank"]) for r in vectors.knn(even, asked, 20).orderBy("query_id", "rank").collect()]
    for b in (even, even.withColumn("embedding", F.col("embedding").cast("array<double>"))):
        assert [(r.query_id, r.vec_id, r["rank"]) for r in vectors.ivf(b, asked, 20, lists=6, probes=6).orderBy("query_id", "rank").collect()] == want
    assert vectors.ivf(even.filter("false"), asked, 20).count() == 0
    assert vectors.recall(vectors.knn(even, asked, 20), vectors.ivf(even, asked, 20, lists=16, probes=14)).first().recall >= 0.9


def test_coarse_codes_get_as_many_candidates_as_they_need(even):
    asked = even.filter("vec_id % 50 = 0")
    truth = vectors.knn(even, asked, 30)
    assert vectors.recall(truth, vectors.ivf_pq(even, asked, 30, lists=4, probes=4, m=4, codes=32, rerank=40)).first().recall >= 0.93
    same = even.sparkSession.createDataFrame([(i, [1.0, 0.0]) for i in range(400)] + [(400 + i, [0.0, 1.0]) for i in range(40)], even.schema)
    found = vectors.ivf_pq(same, same.filter("vec_id % 100 = 0"), 5, lists=2, probes=2, m=1, rerank=5)
    assert vectors.recall(vectors.knn(same, same.filter("vec_id % 100 = 0"), 5), found).first().recall == 1


def test_blocks_of_queries(base, monkeypatch):
    asked = base.filter("vec_id % 20 = 0")
    whole = vectors.knn(base, asked, 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert vectors.knn(base, asked, 3).orderBy("query_id", "rank").collect() == whole
    assert vectors.knn(base, asked.filter("false"), 3).count() == 0
    assert vectors.knn(base.filter("false"), asked, 3).count() == 0


def test_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.n for r in df.select(vectors.normalised(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(ValueError):
        vectors.ivf_pq(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"), df, m=2)


def test_best_by_family(spark):
    rows = spark.createDataFrame([("a", "1", 0.5, 1.0), ("a", "2", 0.9, 5.0), ("a", "3", 0.9, 2.0), ("b", "1", 0.1, 1.0)], "family string, config string, recall double, latency double")
    assert {(r.family, r.config) for r in vectors.best_by_family(rows).collect()} == {("a", "3"), ("b", "1")}


POINT, QUERY = "x double, y double", "query_id long, x double, y double"


def test_nearest_small_makes_no_rows_of_pairs(spark):
    nan = float("nan")
    p = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (nan, 1.0), (None, 1.0), (1.0, None)], POINT)
    q = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.5, 1.0), (3, None, 1.0)], QUERY)
    found = geo.nearest_small(p, q)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0.0, 0.0, 1.0), (2, 2.0, 0.0, 1.25), (3, 0.0, 0.0, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_nearest_example(spark):
    p = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (10.0, 10.0)], POINT)
    q = spark.createDataFrame([(1, 4.9, 4.9)], QUERY)
    for f in (geo.nearest, geo.nearest_small):
        assert tuple(f(p, q).first())[1:3] == (5.0, 5.0)
    again = geo.nearest(geo.insert(p, spark.createDataFrame([(1.0, 1.0)], POINT)), spark.createDataFrame([(1, 1.1, 0.9)], QUERY))
    assert tuple(again.first())[1:3] == (1.0, 1.0)
    with pytest.raises(geo.EmptyInput):
        geo.nearest(p.filter("false"), q)


@pytest.mark.parametrize("kind", ["spread", "clusters", "line", "one", "far"])
def test_grid_equals_direct(spark, kind):
    rng = np.random.default_rng(2)
    p = {
        "spread": rng.random((300, 2)) * 100,
        "clusters": np.concatenate([rng.random((150, 2)), rng.random((150, 2)) + 1000]),
        "line": np.stack([np.arange(100.0), np.zeros(100)], 1),
        "one": np.ones((20, 2)),
        "far": rng.integers(0, 6, (80, 2)).astype(float),
    }[kind]
    q = np.concatenate([rng.random((30, 2)) * 100, rng.random((10, 2)) * 4000 - 2000, p[:5]])
    points = spark.createDataFrame([tuple(map(float, r)) for r in p], POINT)
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], QUERY)
    grid = sorted(tuple(r) for r in geo.nearest(points, asked).collect())
    assert grid == sorted(tuple(r) for r in geo.nearest_small(points, asked).collect())
    assert len(grid) == len(q)


def test_box(spark):
    p = spark.createDataFrame([(0.5 * i, 0.3 * i) for i in range(100)], POINT)
    assert tuple(geo.bounding_box(p).first()) == (100, 0.0, 49.5, 0.0, pytest.approx(29.7))


def test_outliers_and_densities(spark):
    """A cluster, a line, single points very far off: equal to comparing all, with cells that stay small."""
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(0, 1, (3000, 2)), np.c_[np.linspace(0, 500, 300), np.zeros(300)], [[1e6, 1e6], [-1e5, 3.0]]])
    ask = np.concatenate([rng.normal(0, 2, (60, 2)), rng.uniform(-1e5, 1e6, (15, 2)), [[1e6, 1e6 - 1], [250.2, 40.0], [-3e7, 0.0]]])
    p = spark.createDataFrame([tuple(map(float, x)) for x in pts], POINT)
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(ask)], QUERY)
    got = {r.query_id: (r.x, r.y) for r in geo.nearest(p, q).collect()}
    for i, (x, y) in enumerate(ask):
        d = (pts[:, 0] - x) ** 2 + (pts[:, 1] - y) ** 2
        gx, gy = got[i]
        assert (gx - x) ** 2 + (gy - y) ** 2 == pytest.approx(d.min())
    box = geo.bounding_box(p).first()
    assert geo._side(p, box.points, box.max_x - box.min_x, box.max_y - box.min_y) < 1
