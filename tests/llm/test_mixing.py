from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from gleanery.llm import mixing
from gleanery.llm.mixing import fit, mix, targets
from tests.llm import data


def test_targets():
    sizes = {"b": 100, "a": 10, None: 40, "c": 0}
    t = targets(sizes)
    assert t["a"] == 20.0 and t["c"] == 0.0  # a, of weight 5, is full
    # 205 left for b (2) and null (5): null is full at 80, b takes the rest
    assert t[None] == 80.0 and t["b"] == 125.0
    assert sum(t.values()) == 225.0
    assert targets({}) == {}
    assert targets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_as_near_as_any(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.arange(1, 60), 6, replace=False)
    counts = rng.integers(1, 5, 6)
    total = int((lengths * counts).sum())
    reach = {0}
    for n, c in zip(lengths.tolist(), counts.tolist()):
        reach = {r + n * k for r in reach for k in range(c + 1)}
    for budget in (0, 1, total // 3, total // 2, total - 1, total, total + 5):
        take = fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        used = int((take * lengths).sum())
        best = min(abs(r - budget) for r in reach)
        assert abs(used - budget) <= max(best, lengths.min())


def test_large_fit_is_exact():
    rng = np.random.default_rng(9)
    lengths = np.arange(1, 3000)
    counts = rng.integers(1, 2000, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    assert int((fit(lengths, counts, budget) * lengths).sum()) == budget


def words(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("make", [data.documents, data.clashing])
@pytest.mark.parametrize("bucket", [32, 0.1])
def test_mix(spark, make, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = data.rows()
    out = mix(make(spark)).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((r[0], r[3], words(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    goal = targets(dict(sizes))
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == goal[r.source]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    for s in sizes:
        reach = 1  # bit n: n words can be taken, each document 0, 1 or 2 times
        for r in rows:
            if r[3] == s:
                reach |= reach << words(r[1]) | reach << 2 * words(r[1])
        best = min(abs(n - goal[s]) for n in range(reach.bit_length()) if reach >> n & 1)
        assert abs(taken[s] - goal[s]) <= best + 6
    assert sum(goal.values()) == float(Fraction(3, 2) * sum(sizes.values()))


def test_reruns_agree_and_buckets_are_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 0.5)
    rows = [(i, "a b c", "", "s" if i % 3 else "t", 1) for i in range(200)]
    docs = data.table(spark, rows)
    a, b = (sorted(tuple(r) for r in mix(docs).collect()) for _ in range(2))
    assert a == b
    again = sorted(tuple(r) for r in mix(data.table(spark, rows[::-1], parts=1)).collect())
    assert a == again


def test_empty(spark):
    assert mix(data.empty(spark)).count() == 0


@pytest.mark.parametrize("make", [data.documents, data.clashing])
def test_mixed_documents(spark, make):
    docs = make(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(docs.columns) + 5
    want = Counter((r.doc_id, r.source, r["size"], r.taken) for r in mix(docs).collect() if r.taken)
    rows = [tuple(r) for r in out.collect()]
    n = len(docs.columns)
    assert Counter((r[0], r[3], r[n], r[n + 3]) for r in rows) == want
    assert all(r[n] == words(r[1]) and r[n + 3] == r[n] * r[n + 4] and r[n + 4] in (1, 2) for r in rows)
    whole = Counter(tuple(r) for r in docs.collect())
    assert Counter(r[:n] for r in rows) <= whole


def test_one_length_of_most_documents(spark, monkeypatch):
    """Two thirds of all documents are of one source and length: no window or join holds them together."""
    monkeypatch.setattr(mixing, "BUCKET", 1)
    rows = [(i, "a b c" if i % 3 else data.prose(i, 5 + i % 7), "", "s", 1) for i in range(3000)]
    out = mix(data.table(spark, rows)).collect()
    assert abs(sum(r.taken for r in out) - out[0].target) <= 1 and len(out) == 3000


def test_more_sources_than_a_broadcast_takes(spark, monkeypatch):
    docs = data.documents(spark)
    want = Counter(tuple(r) for r in mix(docs).collect())
    monkeypatch.setattr(mixing, "FEW", 1)
    assert Counter(tuple(r) for r in mix(docs).collect()) == want
