import os
from collections import Counter

import pytest

from gleanery.llm.common import Scratch, shared_folder
from tests.llm import data
from tests.llm.test_decontaminate import ITEMS
from tests.llm.test_models import LABELS, corpus


def folder(spark, rows, labels, bench):
    s = Scratch(spark)
    s.table(spark.createDataFrame(rows, data.SCHEMA).coalesce(2), "documents.parquet")
    s.table(spark.createDataFrame(labels, LABELS), "labels.parquet")
    s.table(spark.createDataFrame(bench, ITEMS), "benchmark.parquet")
    return s.root


def test_stages_take_effect(spark):
    import corpus_pipeline as p

    rows, labels = corpus()
    line = "this very line of boilerplate is in many documents"
    rows = [(i, f"{t}\n{line}" if i % 7 == 0 else t, lang, "s" if i % 2 else "t", None) for i, t, lang, _, _ in rows]
    passage = data.prose(2, 25)
    rows += [(2000 + i, data.prose(3, 80), "en", "s", None) for i in range(2)]  # copies, too few for the line dedup
    rows += [(3000, f"{data.prose(4, 20)} {passage} {data.prose(6, 20)}", "en", "t", None), (4000, None, None, None, None)]
    sf = folder(spark, rows, labels, [(1, passage)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s, columns = Scratch(spark), docs.columns
    left = []
    for k, (name, stage) in enumerate(p.STAGES):
        docs = s.table(stage(spark, docs, sf), f"{k}")
        left.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == columns
    clean, lines, single, safe, mixed = left
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(clean)) <= 4 and {r[0] for r in rows} - toxic - set(clean) <= toxic | set(list({r[0] for r in rows} - toxic - set(clean))[:4])
    assert set(lines) == set(clean) and sum(line in (r.text or "") for r in lines.values()) == 1
    assert set(lines) - set(single) == {2001}
    assert set(single) - set(safe) == {3000}
    assert set(mixed) <= set(safe) and all(0 < r.taken <= 2 * r["size"] for r in mixed.values())
    assert Counter(r.source for r in mixed.values()).keys() == {"s", "t"}
    made = lambda: {*os.listdir(shared_folder(spark).removeprefix("file://"))}
    before = made()
    out = p.run(spark, sf)
    assert len(made() - before) == 1  # the result; what the stages wrote on their way is gone
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mixed.values()}
    assert all(r.text == safe[i].text and r.taken == r["size"] * r.repeats for i, r in mixed.items())


@pytest.mark.parametrize("stage", range(5))
def test_awkward_tables(spark, stage):
    """Clashing names change nothing, null texts alone and empty tables go through."""
    import corpus_pipeline as p

    passage = data.prose(60, 30)
    sf = folder(spark, data.rows(), [(37, 1, 1), (74, 1, 0), (None, 1, 1), (10, 0, None)], [(1, passage), (2, None), (None, "x")])
    f = p.STAGES[stage][1]
    plain, clash = data.documents(spark), data.clashing(spark)
    want = f(spark, plain, sf)
    got = f(spark, clash, sf)
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(tuple(r)[:5] for r in want.collect())
    assert got.columns[: len(clash.columns)] == clash.columns
    nulls = data.table(spark, [(i if i % 3 else None, None, None, None, None) for i in range(7)])
    for docs in (nulls, data.empty(spark)):
        left = f(spark, docs, sf).count()
        # rows without a text: repeated ones are one row after the join, the mix takes none
        assert left == {2: 5, 4: 0}.get(stage, 7) * (docs is nulls)


def test_names():
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "mixing"]
