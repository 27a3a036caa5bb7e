import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import fingerprints as module
from gleanery.llm.fingerprints import containment, encode, fingerprints, jaccard, merge, sketch
from tests.llm import data


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def text_hash(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def expected(rows):
    """(doc_id, n_chars, edited_sha256); rows of one id go by text hash."""
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    out = Counter()
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        out[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("make", [data.documents, data.clashing])
@pytest.mark.parametrize("group", [512, 3])
def test_edits(spark, make, group, monkeypatch):
    monkeypatch.setattr(module, "GROUP_ROWS", group)
    out = fingerprints(make(spark)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == expected(data.rows())
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def plain_sketch(text, scale=module.SCALE):
    """A text's fingerprint by plain Python: chained hashes of words, those below the threshold or the least."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    hashes = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        hashes.add(signed(h))
    low = {h for h in hashes if h < -(1 << 63) + (1 << 64) // scale}
    return low or ({min(hashes)} if hashes else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("scale", [module.SCALE, 2])
def test_sketches_and_likeness_equal_brute_force(spark, scale):
    rows = data.rows()
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    want, hexed = Counter(), lambda s: "".join(f"{h & (1 << 64) - 1:016X}" for h in sorted(s))
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        edit = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = (plain_sketch(t, scale) for t in (text, edit, after))
        want[i, hexed(a), hexed(b), round(likeness(a, b), 9), round(likeness(a, c), 9)] += 1
    out = fingerprints(data.documents(spark), scale=scale).collect()
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == want


def test_an_id_of_many_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(module, "GROUP_ROWS", 20)
    rows = [(i, data.prose(i, 6), "", "", 1) for i in range(100)]
    rows += [(50, data.prose(1000 + i, 6), "", "", 1) for i in range(200)] + [(None, data.prose(2000 + i, 6), "", "", 1) for i in range(200)]
    docs = data.table(spark, rows)
    out = fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == expected(rows)


def test_equal_texts_equal_fingerprints(spark):
    texts = {}
    ids = {r[0]: r[1] for r in data.rows() if r[0] is not None}
    for r in fingerprints(data.documents(spark)).collect():
        if r.doc_id is not None:
            texts.setdefault((ids[r.doc_id] or "").lower(), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in texts.values())
    assert texts[""] == {""}


def test_one_row_and_none(spark):
    row = fingerprints(data.table(spark, [(4, "a b c d e f g", "", "", 1)])).first()
    assert row.near_next == 1.0 and row.n_chars == 13
    assert fingerprints(data.empty(spark)).count() == 0


def test_estimates(spark):
    """Likeness and containment of very unequal texts come near to the truth; merging is the sketch of both."""
    a, b = data.prose(11, 4000), data.prose(12, 400)
    df = spark.createDataFrame([(a, a + " " + b, b)], "a string, ab string, b string")
    s = df.select(*(sketch(F.col(c)).alias(c) for c in ("a", "ab", "b")))
    r = s.select(jaccard(F.col("a"), F.col("ab")).alias("j"), containment(F.col("b"), F.col("ab")).alias("c"), containment(F.col("b"), F.col("a")).alias("o"), encode(F.col("a")).alias("e"), "a").first()
    assert abs(r.j - 10 / 11) < 0.05 and r.c > 0.95 and r.o < 0.05
    assert len(r.e) == 16 * len(r.a)
    low = F.filter(F.col("ab"), lambda x: x < 0)
    both = s.select(F.size(F.array_except(merge(F.col("a"), F.col("b")), low)).alias("more")).first()
    assert both.more == 0


def test_plan_is_native(spark):
    plan = fingerprints(data.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_cells_count_bounds(spark):
    import bisect

    for n in (0, 1, 2, 5, 16, 17):
        bounds = [3 * i - 4 for i in range(n)]
        df = spark.range(-10, 60).select("id", module._cell(F.col("id"), bounds).alias("c"))
        assert all(r.c == bisect.bisect_right(bounds, r.id) for r in df.collect())
