import hashlib
import re
from collections import Counter

import pytest

from gleanery.llm import decontaminate as module
from gleanery.llm.decontaminate import clean_documents, decontaminate
from tests.llm import data

UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def items():
    passage = data.prose(2, 25)
    return [(1, passage), (2, data.prose(60, 30).upper()), (3, data.prose(3, 6)), (4, None), (5, "!!!"), (6, "straße"), (10, passage), (7, data.prose(999, 40)), (8, "one"), (8, "One"), (None, passage)]


def expected(rows, bench, size=10):
    wins = {}
    for item, text in bench:
        w = words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - size + 1)):
                wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = Counter()
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for win, ids in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= ids
        out[r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


@pytest.mark.parametrize("make", [data.documents, data.clashing])
@pytest.mark.parametrize("block", [400_000, 20])
def test_equals_brute_force(spark, make, block, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", block)
    bench = spark.createDataFrame(items(), ITEMS)
    assert got(decontaminate(make(spark), bench)) == expected(data.rows(), items())


def test_one_length(spark):
    bench = [i for i in items() if len(words(i[1])) >= 10]
    assert got(decontaminate(data.documents(spark), spark.createDataFrame(bench, ITEMS))) == expected(data.rows(), bench)


def test_repeated_words(spark):
    """Windows that overlap themselves, at both ends of a text."""
    rows = [(1, "a " * 30, "", "", 1), (2, "a " * 9, "", "", 1), (3, "b " + "a " * 10 + "b", "", "", 1)]
    bench = [(1, "a " * 12), (2, "b a a")]
    assert got(decontaminate(data.table(spark, rows), spark.createDataFrame(bench, ITEMS))) == expected(rows, bench)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], ITEMS)
    assert got(decontaminate(data.documents(spark), bench)) == expected(data.rows(), [])
    assert decontaminate(data.empty(spark), spark.createDataFrame(items(), ITEMS)).count() == 0


@pytest.mark.parametrize("make", [data.documents, data.clashing])
def test_clean_documents(spark, make):
    bench = spark.createDataFrame(items(), ITEMS)
    hit = {(k[0], k[1]) for k in expected(data.rows(), items()) if k[5]}
    docs = make(spark)
    out = clean_documents(docs, bench)
    assert out.columns == docs.columns
    kept = Counter(tuple(r)[:5] for r in out.collect())
    assert kept == Counter(r for r in data.rows() if (r[0], len(words(r[1]))) not in hit)
