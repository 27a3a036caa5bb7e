import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import ngram_join
from gleanery.llm.ngram_join import _pack, _unpack, near_duplicates, one_of_each, shingle_hashes, similar_pairs
from tests.llm import data


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """Sizes and components by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("make", [data.documents, data.clashing])
def test_equals_brute_force(spark, make):
    assert got(near_duplicates(make(spark))) == expected(data.rows())


def test_empty(spark):
    assert near_duplicates(data.empty(spark)).count() == 0
    assert one_of_each(data.empty(spark)).count() == 0


def chain(n=60, words=100, step=3, seed=4):
    """Texts of which neighbours link and distant ones don't, with random ids."""
    rng = random.Random(seed)
    fresh = [f"w{i}" for i in range(words + n * step)]
    ids = rng.sample(range(10_000), n)
    return [(ids[i], " ".join(fresh[i * step : i * step + words]), "en", "a", None) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_chain_and_hub_rounds(spark, rounds):
    rows = chain() + [(20_000 + i, data.prose(900 + i, 50), "en", "a", None) for i in range(5)]
    assert got(near_duplicates(data.table(spark, rows), hub_rounds=rounds)) == expected(rows)


def test_mutated_groups(spark):
    """Groups of edited copies around the threshold, some sharing common passages."""
    rng = random.Random(8)
    rows = []
    passage = data.prose(77, 30)
    for g in range(6):
        base = data.prose(100 + g, 70)
        for c in range(12):
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            rows.append((len(rows) * 7 % 997, " ".join(w) + (" " + passage if c % 3 == 0 else ""), "en", "a", None))
    assert got(near_duplicates(data.table(spark, rows))) == expected(rows)


def test_small_chunks_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_LEAST", 200)
    monkeypatch.setattr(ngram_join, "CHUNK_MOST", 6400)
    assert got(near_duplicates(data.documents(spark))) == expected(data.rows())


def test_all_pairs(spark):
    rows = [r for r in data.rows() if r[0] is not None]
    pairs, members = similar_pairs(data.table(spark, rows))
    by = {r.doc_id: r.representative for r in members.collect()}
    found = {(r.a, r.b): r.similarity for r in pairs.collect()}
    first = {}
    for r in rows:
        if s := frozenset(shingles(r[1])):
            first[s] = min(first.get(s, r[0]), r[0])
    want = {}
    for s, a in first.items():
        for t, b in first.items():
            common = len(s & t)
            if a < b and 100 * common >= 80 * (len(s) + len(t) - common):
                want[a, b] = common / len(s | t)
    assert found == pytest.approx(want)
    assert by == {r[0]: first[frozenset(shingles(r[1]))] for r in rows if shingles(r[1])}


def test_one_of_each(spark):
    rows = data.rows()
    kept = [tuple(r) for r in one_of_each(data.documents(spark)).collect()]
    ids = [r[0] for r in kept if r[0] is not None]
    assert len(ids) == len(set(ids))
    groups = {c for _, _, c in expected(rows) if c is not None}
    assert set(ids) == groups
    assert sum(r[0] is None for r in kept) == 1


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        cols = [rng.integers(0, 1 << b, n, dtype=np.uint64) for b in (3, 17, 55)]
        for a, b in zip(cols, _unpack(_pack(*cols), 3)):
            assert (a == b).all()


def test_hashes_follow_words():
    a = shingle_hashes(b"A b\tc\x0bd  e f", 5)
    assert len(a) == 2 and (a == shingle_hashes(b" a B C D E F ", 5)).all()
    assert len(shingle_hashes(b"a b", 5)) == 1 and shingle_hashes(b"a b", 5) != shingle_hashes(b"a c", 5)
    assert len(shingle_hashes(None, 5)) == len(shingle_hashes(b" \n", 5)) == 0


def template(n, words=96, own=12):
    """Texts with one long passage in common, just too little of each for a link."""
    passage = " ".join(f"t{i}" for i in range(words))
    return [(i, passage + " " + " ".join(f"x{i}y{j}" for j in range(own)), "en", "a", None) for i in range(n)]


@pytest.mark.parametrize("derive", ["repartition", "shuffled"])
def test_derived_tables(spark, derive):
    docs = data.documents(spark)
    docs = docs.repartition(5) if derive == "repartition" else docs.orderBy(F.rand())
    assert got(near_duplicates(docs)) == expected(data.rows())


def test_templates_under_the_threshold_meet_nobody(spark):
    rows = template(40) + [(100 + i, r[1].replace("t90", f"z{i}"), "en", "a", None) for i, r in enumerate(template(5))]
    assert got(near_duplicates(data.table(spark, rows))) == expected(rows)
    many = data.table(spark, template(1500))
    scratch = ngram_join.Scratch(spark)
    records = ngram_join._records(many, 5, 80, scratch)
    classes = records.groupBy("d0", "d1").agg(F.min("uid").alias("uid"))
    join = ngram_join._candidates(records, classes, 80, scratch)
    assert join.entries.count() >= 9 * 1500 and join.entries.filter("hi >= n").count() == 0
    assert join.all_pairs(None, None).count() == 0


def test_templates_of_many_lengths(spark):
    """Sets of different sizes around one passage: some link, most don't."""
    rng = random.Random(3)
    rows = [(i, template(i + 1, 96, rng.randrange(2, 34))[i][1], "en", "a", None) for i in range(60)]
    for rounds in (0, 4):
        assert got(near_duplicates(data.table(spark, rows), hub_rounds=rounds)) == expected(rows)


def test_a_hot_shingle_is_one_entry_of_a_chunk():
    plan = ngram_join._Plan(5, 80, 4, 1 << 20)
    texts = pa.record_batch({"doc_id": pa.array(range(300), pa.int64()), "text": pa.array([f"a b c d e u{i} v{i} w{i}".encode() for i in range(300)])})
    sent = [*ngram_join._send(plan, task=lambda: 0)(iter([texts]))]
    counts = Counter()
    for b in sent:
        for part, payload in zip(b["part"].to_pylist(), b["payload"].to_pylist()):
            if part >= 0:
                counts.update(_unpack(payload, 3)[2].tolist())
    assert counts == {1: 900, 300: 1}


def test_shingles_of_any_number_of_words(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(100)), "en", "a", None), (2, " ".join(f"w{i}" for i in range(100)) + " end", "en", "a", None), (3, "w1", "en", "a", None)]
    out = {r.doc_id: r for r in near_duplicates(data.table(spark, rows), shingle=90, percent=80).collect()}
    assert [out[i].n_shingles for i in (1, 2, 3)] == [11, 12, 1] and out[2].component_id == 1 and out[3].component_id == 3
    long = b" ".join(b"w%d" % (i % 5000) for i in range(400_000))
    assert len(long) > 2 * ngram_join.PIECE and len(shingle_hashes(long, 5)) == 5000
