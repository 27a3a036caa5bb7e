from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gleanery.llm import line_dedup
from gleanery.llm.line_dedup import LineArrays, PerfectHash, dedup_lines, line_counts
from tests.llm import data

UPPER = {c: c + 32 for c in range(65, 91)}


def expected(rows, chars=20, docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, r in enumerate(rows):
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            holders.setdefault(k, []).append(-1 if r[0] is None else r[0])
    out = Counter()
    for r in rows:
        lines, me = (r[1] or "").split("\n"), -1 if r[0] is None else r[0]
        kept = [x for x in lines if not (len(key(x)) >= chars and len(holders[key(x)]) >= docs and max(holders[key(x)]) != me)]
        out[r[0], None if r[1] is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect())


@pytest.mark.parametrize("make", [data.documents, data.clashing])
def test_equals_brute_force(spark, make):
    found = got(line_counts(make(spark)))
    assert found == expected(data.rows())
    assert sum(k[3] for k in found) > 5


@pytest.mark.parametrize("fanout", [1024, 2])
def test_small_chunks_and_regions(spark, fanout):
    """Chunks of one or two documents, sending to shards or, where these are too many, to regions of shards."""
    assert got(line_dedup._dedup(data.documents(spark), [], 20, 3, chunk=300, fanout=fanout)) == expected(data.rows())


@pytest.mark.parametrize("derive", ["repartition", "filter", "join", "shuffled"])
def test_derived_tables(spark, derive):
    """Rows that arrive in another order each time they are computed."""
    docs, rows = data.documents(spark), data.rows()
    if derive == "repartition":
        docs = docs.repartition(7)
    elif derive == "filter":
        docs, rows = docs.filter("coalesce(doc_id, 0) % 3 < 2"), [r for r in rows if (r[0] or 0) % 3 < 2]
    elif derive == "join":
        ids = spark.range(200).select(F.col("id").alias("doc_id"))
        docs, rows = docs.join(ids, "doc_id"), [r for r in rows if r[0] is not None]
    else:
        docs = docs.orderBy(F.rand())
    whole = line_dedup._dedup(docs, ["lang", "source", "n_chars"], 20, 3, chunk=700)
    assert got(whole) == expected(rows)
    assert Counter(r.text for r in dedup_lines(docs).collect()) == Counter(k[1] for k, n in expected(rows).items() for _ in range(n))


def test_edges(spark):
    """Nineteen code points, wide characters, carriage returns, ties of the largest id, lines of the same document."""
    n19, n20, wide = "x" * 19, "y" * 20, "é" * 20
    rows = [(i, f"{n19}\r\n{n20}\r\n{wide}\n{n20}", "", "", 1) for i in (5, 9, 2, 9)] + [(None, f" {n20.upper()} ", "", "", 1), (1, "É" * 20, "", "", 1)]
    assert got(line_counts(data.table(spark, rows))) == expected(rows)


def test_all_columns_stay(spark):
    docs = data.clashing(spark)
    out = dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.n_lines for r in out.collect()} == {"own n_lines"}


def test_empty(spark):
    assert line_counts(data.empty(spark)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    marks = keys ^ np.uint64(7)
    h = PerfectHash(keys, marks)
    assert sorted(h.at(keys, marks).tolist()) == list(range(len(keys)))
    arrays = LineArrays(keys, marks, np.arange(len(keys)), np.arange(len(keys)) * 3)
    at = arrays.probe(keys, marks)
    assert (arrays.keeper[at] == np.arange(len(keys)) * 3).all() and (arrays.count[at] == np.arange(len(keys))).all()
    assert (arrays.probe(keys, keys) == -1).all()
    few = PerfectHash(keys[:100], marks[:100], levels=1)
    assert sorted(few.at(keys[:100], marks[:100]).tolist()) == list(range(100))
    assert few.rest and (few.at(keys[100:], marks[100:])[:5] < 100).all()
    assert len(PerfectHash(keys[:0], keys[:0]).at(keys[:5], keys[:5])) == 5


def test_lines_that_agree_in_64_bits():
    """Common lines of one place differ by their marks alone."""
    place, mark = np.full(50, 12345, np.uint64), np.arange(50, dtype=np.uint64) * np.uint64(977)
    arrays = LineArrays(place, mark, np.full(50, 3), np.arange(50))
    assert (arrays.keeper[arrays.probe(place, mark)] == np.arange(50)).all()
    assert (arrays.probe(place, mark + np.uint64(1)) == -1).all()


def test_collisions_in_a_whole_table(spark, monkeypatch):
    """Hashes whose placing halves agree for all lines: the result is the same."""
    import xxhash

    real = xxhash.xxh3_128_intdigest
    monkeypatch.setattr(line_dedup, "_hash", lambda key: (real(key) >> 64) << 64)
    plan = line_dedup._Plan(3, 0, 1, 20, 3)
    rows = data.rows()
    batch = pa.record_batch({"chunk": pa.array([i // 4 for i in range(len(rows))], pa.int64()), "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([None if r[1] is None else r[1].encode() for r in rows], pa.binary())})
    sent = pa.Table.from_batches([*line_dedup._send(plan)(iter([batch]))])
    hits = [line_dedup._serve(plan)(sent.filter(pc.equal(sent["to"], t))) for t in {*sent["to"].to_pylist()}]
    hits = pa.concat_tables(hits)
    out = Counter()
    docs = pa.Table.from_batches([batch]).append_column("rest", pa.array([0] * len(rows)))
    for chunk in range(len(rows) // 4 + 1):
        part = line_dedup._strip(plan)(docs.filter(pc.equal(docs["chunk"], chunk)), hits.filter(pc.equal(hits["sender"], chunk)))
        for r in part.to_pylist():
            out[r["doc_id"], None if r["text"] is None else r["text"].decode(), r["n_lines"], r["n_dropped"]] += 1
    assert out == expected(rows)
