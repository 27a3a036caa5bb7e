import bz2

import pytest
from pyspark.sql import functions as F

from gleanery.sources import files, generate
from gleanery.streaming import upsert

WIKI = """<mediawiki><page><title>One</title><ns>0</ns><id>1</id><revision><text>'''Bold''' [[a|b]] &amp; x</text></revision></page>
<page><title>Talk</title><ns>1</ns><id>2</id><revision><text>no</text></revision></page>
<page><title>Gone</title><ns>0</ns><id>3</id><revision><text>#REDIRECT [[One]]</text></revision></page>
<page><title>Empty</title><ns>0</ns><id>4</id><revision><text>{{all gone}}</text></revision></page></mediawiki>"""


def test_wiki(spark, tmp_path):
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(WIKI.encode()))
    pages = files.read_wiki_xml(spark, str(tmp_path / "w.xml.bz2"))
    assert pages.count() == 4
    assert [tuple(r) for r in files.articles(pages).collect()] == [("1", "One", "Bold b & x")]


def test_jsonl(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"t{i}", "x") for i in range(10)], files.DOCUMENT).coalesce(1)
    path = str(tmp_path / "j")
    files.write_jsonl(docs, path)
    files.write_jsonl(docs.limit(1), path)  # exists: nothing happens
    assert sorted(tuple(r) for r in files.read_jsonl(spark, path).collect()) == sorted(tuple(r) for r in docs.collect())
    assert files.read_jsonl(spark, path, most=3).count() == 3
    files.write_jsonl(files.read_jsonl(spark, path), str(tmp_path / "k"), per_file=4)
    assert files.read_jsonl(spark, str(tmp_path / "k")).count() == 4
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "title": "a", "text": "b"}\nnot json\n')
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).count() == 1


def test_points(spark, tmp_path):
    good, bad = tmp_path / "g.csv", tmp_path / "b.csv"
    good.write_text("1,2\n3.5,-4\n1e3,0\n")
    bad.write_text("1,2\nbad_line\n\n3,x\n4,5\n")
    assert {tuple(r) for r in files.read_points(spark, str(good)).collect()} == {(1.0, 2.0), (3.5, -4.0), (1000.0, 0.0)}
    assert {tuple(r) for r in files.read_points_lenient(spark, str(bad)).collect()} == {(1.0, 2.0), (4.0, 5.0)}
    with pytest.raises(Exception, match="not a point"):
        files.read_points(spark, str(bad)).collect()


def test_pairs(spark, tmp_path):
    def read(text):
        p = tmp_path / f"p{abs(hash(text))}.csv"
        p.write_text(text)
        return {tuple(r) for r in files.read_pairs(spark, str(p)).collect()}

    assert read("text,y\na,1.25\nb,2.5\n,42.25\nx,y,3\n") == {("a", 1.25), ("b", 2.5), ("", 42.25), ("x,y", 3.0)}
    assert read("text,y\n") == set() and read("text,y") == set()
    for broken in ("text,y\nno comma\n", "text,y\na,b\n", "text,y\n\na,1\n", ""):
        with pytest.raises(Exception, match="not a pair|no header"):
            read(broken)


def test_vectors(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("3 2\nthe 1.0 2.0\nnew york 3 4\nshort 1\nx 5 6\n")
    assert sorted(r.embedding for r in files.read_vectors(spark, str(p)).collect())[:2] == [[1.0, 2.0], [3.0, 4.0]]
    assert files.read_vectors(spark, str(p), most=2).count() == 2
    (tmp_path / "w.txt").write_text("no header here\n")
    with pytest.raises(files.BadInput):
        files.read_vectors(spark, str(tmp_path / "w.txt"))


def test_listing(spark, tmp_path):
    for i in range(1, 5):
        (tmp_path / f"f{i}.jsonl").write_text("x\n" * i)
    rows = files.list_files(spark, str(tmp_path / "*.jsonl")).orderBy("path").collect()
    assert [(r.lines, r.bytes, r.preselected) for r in rows] == [(1, 2, True), (2, 4, True), (3, 6, False), (4, 8, False)]
    assert files.newest_first(files.list_files(spark, str(tmp_path / "*.jsonl"))).count() == 4


def test_generators_do_not_depend_on_partitions(spark):
    for make in (generate.points, generate.pairs, generate.documents, generate.modular_text):
        a = sorted(tuple(r) for r in make(spark, 50).collect())
        assert a == sorted(tuple(r) for r in make(spark, 50).repartition(7).collect()) and len(set(a)) == 50
    p = generate.points(spark, 500)
    assert p.filter("abs(x) > 180 or abs(y) > 90").count() == 0
    assert len(generate.documents(spark, 1).first().text.split()) == 24 and generate.documents(spark, 1, words=0).first().text == ""
    assert {len(r.key) for r in generate.pairs(spark, 5).collect()} == {32}


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "s")
    one = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 1, "p")], "key string, seq long, value string")
    two = spark.createDataFrame([("a", 2, "y"), ("b", 5, "q")], one.schema)
    one.coalesce(1).write.parquet(src)
    two.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = run(spark, upsert.latest(stream), "latest", "update")
    best = {r.key: r.value for r in rows.groupBy("key").agg(F.max_by("value", "seq").alias("value")).collect()}
    assert best == {"a": "z", "b": "q"}


def test_windows_and_duplicates(spark, tmp_path):
    events = spark.createDataFrame([(i % 5, f"2024-01-0{1 + i % 3} 10:00:00", "t", 1.0) for i in range(15)], "event_id long, at string, event_type string, value double")
    events = events.select("event_id", F.to_timestamp("at").alias("ts"), "event_type", "value")
    src = str(tmp_path / "e")
    events.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    rows = run(spark, upsert.windowed(stream), "windows", "complete")
    assert sorted(r.n for r in rows.collect()) == [5, 5, 5]
    assert run(spark, upsert.distinct_within(stream, "event_id", "10 days"), "distinct_ids", "append").count() == 5
