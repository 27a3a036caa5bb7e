import bz2

import pytest
from pyspark.sql import functions as F

from gleanery import __main__ as cli
from gleanery.operators import geo, keyed, sets, tables
from gleanery.sources import files

LIST = "doc_id long, positions array<int>"


def plist(spark, rows):
    return spark.createDataFrame([(d, list(p)) for d, p in rows], LIST)


def got(df):
    return {r.doc_id: r.positions for r in df.collect()}


def test_set_operators(spark):
    a = plist(spark, [(1, [1, 5]), (3, [2]), (5, [7])])
    b = plist(spark, [(2, [1]), (3, [2, 9]), (5, [8])])
    assert got(sets.intersect(a, b)) == {3: [2, 9], 5: [7, 8]}
    assert got(sets.union(a, b)) == {1: [1, 5], 2: [1], 3: [2, 9], 5: [7, 8]}
    assert got(sets.difference(a, b)) == {1: [1, 5]}
    assert got(sets.adjacent(a, b)) == {5: [7, 8]} and got(sets.adjacent(b, a)) == {}
    assert got(sets.near(a, b, 1)) == {3: [2], 5: [7, 8]}
    assert sets.advance(a, 2).first().doc_id == 3 and sets.advance(a, 6).count() == 0
    assert sets.frequency_at(a, 1).first().tf == 2 and sets.frequency_at(a, 2).first().tf == 0


def test_chained_near_stays_in_order(spark):
    a = plist(spark, [(1, range(0, 500, 7))])
    b = plist(spark, [(1, range(3, 500, 11))])
    c = plist(spark, [(1, range(5, 500, 13))])
    found = got(sets.near(sets.near(a, b, 1000), c, 5))[1]
    assert found == sorted(set(found))


def test_near_duplicate_index(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "four five six")], "doc_id string, text string")
    index = tables.NearDuplicates(docs)
    index.add(spark.createDataFrame([("c", "One, two; three")], docs.schema))
    asked = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    for found in (index.find(asked), index.full_scan(asked)):
        assert {r.doc_id for r in found.collect()} == {"a", "c"}
    assert index.candidates(asked).count() == 2 and index.stats().first().documents == 3
    with pytest.raises(ValueError):
        index.add(docs)


def test_table(spark, tmp_path):
    t = tables.Table.create(spark, capacity=2)
    kv = lambda *r: spark.createDataFrame(r, "key long, value long")
    assert {r.status for r in t.insert(kv((1, 1), (2, 2), (3, 3))).collect()} == {"inserted"}
    assert t.update(kv((1, 9))).first().status == "updated" and t.delete(kv((2, 0))).first().existed
    t.sync(str(tmp_path / "t"))
    back = tables.Table.open(spark, str(tmp_path / "t"))
    assert len(back) == 2 and back.get(kv((1, 0))).first().value == 9 and back.capacity == 2
    assert back.stats().first()["size"] == 2
    back.clear()
    assert len(back) == 0
    with pytest.raises(files.BadInput):
        tables.Table.open(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        tables.Table.create(spark, capacity=0)


def test_map(spark):
    rows = lambda *r: spark.createDataFrame(r, "seq long, key string, value string")
    m = tables.Map(spark, 0)
    m.put(rows((1, "k", "1"), (2, "j", "x")))
    assert {tuple(r) for r in m.merge(rows((3, "k", "2")), lambda a, b: F.concat(a, b)).collect()} == {("k", "12")}
    assert dict(m) == {"k": "12", "j": "x"} and m.size() == 2 and m.buckets == 16
    m.put(rows((4, "k", "new")))
    assert m.get(spark.createDataFrame([("k",)], "key string")).first().value == "new"
    m.clear()
    assert m.size() == 0


def test_fixed_table_and_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("text,y\na,1.25\nb,2.5\n")
    t = tables.PerfectTable.from_csv(spark, str(tmp_path / "p.csv"))
    assert {tuple(r) for r in t.get(spark.createDataFrame([("a",), ("z",)], "key string")).collect()} == {("a", 1.25, True), ("z", None, False)}
    (tmp_path / "q.csv").write_text("1,2\n5,5\n")
    p = tables.Points.from_csv(spark, str(tmp_path / "q.csv"))
    p.insert(spark.createDataFrame([(9.0, 9.0)], "x double, y double"))
    assert tuple(p.nearest(spark.createDataFrame([(1, 8.0, 8.5)], "query_id long, x double, y double")).first())[1:3] == (9.0, 9.0)
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(geo.EmptyInput):
        tables.Points.from_csv(spark, str(tmp_path / "e.csv"))
    assert keyed.LOAD == 0.75


def test_command_line(spark, tmp_path, capsys):
    page = "<page><title>One</title><ns>0</ns><id>1</id><revision><text>hello hello world</text></revision></page>"
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(f"<m>{page}</m>".encode()))
    cli.main(["clean", "-input", str(tmp_path), "-output", str(tmp_path / "out")])
    assert files.read_jsonl(spark, str(tmp_path / "out")).first().text == "hello hello world"
    cli.main(["compression", "-data", str(tmp_path / "out"), "-sizes", "1", "-output", str(tmp_path / "s.csv")])
    assert (tmp_path / "s.csv").read_text().startswith("1,")
    cli.main(["profile", "-size", "50", "-rounds", "1"])
    assert "search:" in capsys.readouterr().out
