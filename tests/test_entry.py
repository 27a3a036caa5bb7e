import __spark_entry__ as entry
from gleanery.plans.oracles import ORACLES
from gleanery.plans.queries import QUERIES


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert o.keys() <= q.keys() and ORACLES.keys() <= QUERIES.keys()
    assert len(QUERIES) > 60


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows == sorted(rows, key=lambda r: (-r.score, r.doc_id))
