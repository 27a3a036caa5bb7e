import math

import pytest

from gleanery.operators import postings, search
from gleanery.sources.files import BadInput
from gleanery.operators.search import Engine, Not, Op, QueryError, Term, evaluated_terms, outside_not, parse

#: Texts, query, ids that match (the first text has id 1).
CASES = [
    ("hello world; world foo bar; hello foo baz", "hello AND world", [1]),
    ("hello world; foo bar; hello foo", "hello OR foo", [1, 2, 3]),
    ("hello world; hello foo; world foo", "hello AND NOT foo", [1]),
    ("hello world; hello foo; world foo; hello bar", "hello AND NOT (foo OR bar)", [1]),
    ("hello world; hello beautiful world; world hello", "hello ADJ world", [1]),
    ("hello world; hello beautiful world; hello very very far world; world hello", "hello NEAR/2 world", [1, 2, 4]),
    ("hello world; foo bar", "hello", [1]),
    ("cat dog pet; cat mouse; dog pet park; bird fish", "(cat OR dog) AND pet", [1, 3]),
    ("hello world; hello foo wow; world foo", "hello AND NOT (foo AND wow)", [1]),
    ("a b c; a d; e b; e d", "(a OR e) AND (b OR d)", [1, 2, 3, 4]),
    ("a b c; a d; b d; c d", "(a OR b) AND NOT d", [1]),
    ("hello world foo; world hello; hello beautiful world foo", "hello ADJ world AND foo", [1]),
    ("hello world foo; hello far world; hello very far world foo", "hello NEAR/2 world AND NOT foo", [2]),
    ("a b c d; a b e; f c d; a e d", "(a AND b) AND (c OR d) AND NOT e", [1]),
    ("a; b; c; d", "a OR b OR c", [1, 2, 3]),
    ("a b c; a b; a c; b c", "a AND b AND c", [1]),
    ("red big fast car; red small car; blue big car; red big truck", "(red OR blue) AND car AND NOT big", [2]),
    ("quick brown fox; brown quick rabbit; slow brown fox", "(quick ADJ rabbit OR brown ADJ fox) AND NOT rabbit", [1, 3]),
    ("quick brown fox; brown quick rabbit; slow brown fox", "quick ADJ rabbit OR brown ADJ fox AND NOT rabbit", [1, 2, 3]),
    # a bare NOT is empty and its words are not looked up
    ("a b; b; c", "NOT a AND b", []),
    ("a b; b; c", "a OR NOT b", [1]),
    ("a b; b; c", "b AND NOT (NOT a)", [1, 2]),
    ("a b; b; c", "a ADJ NOT b", []),
    # one level of AND and ADJ: the positions of both sides of AND reach ADJ
    ("x a z b; a q b; x b a", "x AND a ADJ b", [3]),
    ("x y", "zzz", []),
    ("x y", "x AND zzz", []),
    ("a a b", "a NEAR/0 a", [1]),
]


def engine(spark, texts):
    return Engine(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string"))


@pytest.mark.parametrize("texts,query,ids", CASES)
def test_matches(spark, texts, query, ids):
    e = engine(spark, texts.split("; "))
    assert sorted(r.doc_id for r in e.evaluate(query).collect()) == ids


def test_a_stored_index_agrees(spark, tmp_path):
    """Cases over one index each, written, opened and searched; scores as over the documents."""
    stored = {}
    for texts, query, ids in CASES[::3]:
        if texts not in stored:
            d = engine(spark, texts.split("; ")).docs
            stored[texts] = Engine.build(d, str(tmp_path / f"{len(stored)}"), buckets=4), Engine(d)
        e, plain = stored[texts]
        assert sorted(r.doc_id for r in e.evaluate(query).collect()) == ids
        a, b = ({r.doc_id: round(r.score, 9) for r in x.search(query).collect()} for x in (e, plain))
        assert a == b


def test_a_search_reads_its_buckets_alone(spark, tmp_path):
    e = Engine.build(engine(spark, [f"w{i} w{i + 1} common" for i in range(60)]).docs, str(tmp_path / "i"), buckets=16)
    plan = e.search("w7 AND common")._jdf.queryExecution().executedPlan().toString()
    at = {r.bucket for r in e.posts.filter("term in ('w7', 'common')").select("bucket").collect()}
    assert f"PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term" in plan
    files = {f.split("bucket=")[1].split("/")[0] for f in e._lists(["w7", "common"]).inputFiles()}
    assert len(at) <= 2 and files >= {str(b) for b in at}
    read = e._lists(["w7", "common"]).agg({"bucket": "count"})._jdf.queryExecution().executedPlan()
    read.execute().count()
    assert "xxhash64" not in plan.split("PartitionFilters")[1].split("]")[0]


def test_an_index_grows(spark, tmp_path):
    texts = ["hello world", "world foo bar", "hello foo baz", "hello hello"]
    d = engine(spark, texts).docs
    e = Engine.build(d.filter("doc_id <= 2"), str(tmp_path / "i"), buckets=3)
    e.add(d.filter("doc_id > 2"))
    memory = Engine(d.filter("doc_id <= 2"))
    memory.add(d.filter("doc_id > 2"))
    for x in (e, memory):
        assert {r.doc_id: round(r.score, 9) for r in x.search("hello OR foo").collect()} == {r.doc_id: round(r.score, 9) for r in Engine(d).search("hello OR foo").collect()}
    with pytest.raises(BadInput):
        e.add(d.filter("doc_id = 1"))
    with pytest.raises(BadInput):
        spark.createDataFrame([(9, 1)], "version int, buckets int").write.mode("overwrite").json(str(tmp_path / "i" / "meta"))
        Engine.open(spark, str(tmp_path / "i"))


def test_sized_postings(spark):
    d = engine(spark, ["b a b", "", None, "x", "a_1 B b b"]).docs
    want = {(r.term, r.doc_id, tuple(r.positions), r.tf) for r in postings.postings(d).collect()}
    rows = postings.sized_postings(d).collect()
    assert {(r.term, r.doc_id, tuple(r.positions), r.tf) for r in rows} == want and len(rows) == len(want)
    assert {r.doc_id: r.doc_len for r in rows} == {1: 3, 4: 1, 5: 4}


def test_parsing():
    t = Term
    assert parse("a and b OR c") == Op("or", Op("and", t("a"), t("b")), t("c"))
    assert parse("a ADJ b AND c") == Op("and", Op("adj", t("a"), t("b")), t("c"))
    assert parse("a NEAR/12 b") == Op("near", t("a"), t("b"), 12)
    assert parse("a NEAR/x b").k == 1
    assert parse("NOT (a)") == Not(t("a"))
    for word in ("andreu", "orthogneiss", "notable", "adjective", "nearby", "near", "android_1"):
        assert parse(word.upper()) == t(word)
    for bad in ("", "  ", "cat dog", "NOT NOT x", "a NEAR b", "a AND", "(a", "a)", "a & b", "a-b", "AND"):
        with pytest.raises(QueryError):
            parse(bad)


def test_terms():
    assert evaluated_terms(parse("a AND NOT (b AND NOT c)")) == ["a", "b", "c"]
    assert evaluated_terms(parse("a OR NOT b")) == ["a"]
    assert evaluated_terms(parse("b AND NOT (NOT a)")) == ["b"]
    assert outside_not(parse("a AND NOT b OR c")) == ["a", "c"]


def near(a, b, k):
    """Both ends of each p with the next q above, and of each q with the next p at or above."""
    out = set()
    for p in a:
        q = min((y for y in b if y > p), default=None)
        if q is not None and q - p <= k:
            out |= {p, q}
    for q in b:
        p = min((x for x in a if x >= q), default=None)
        if p is not None and p - q <= k:
            out |= {p, q}
    return sorted(out)


def test_near_positions(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcx") for _ in range(rng.randrange(2, 25))) for _ in range(40)]
    e = engine(spark, texts)
    for k in (0, 1, 3, 20):
        got = {r.doc_id: r.positions for r in e.positions(f"a NEAR/{k} b").collect()}
        for i, t in enumerate(texts):
            a, b = ([j for j, w in enumerate(t.split()) if w == c] for c in "ab")
            hit = any(abs(p - q) <= k for p in a for q in b)
            assert got.get(i + 1) == (near(a, b, k) if hit else None)


def test_scores(spark):
    e = engine(spark, ["hello hello hello world", "hello world", "world world world"])
    hits = [(r.doc_id, r.score) for r in e.top("hello").collect()]
    assert [i for i, _ in hits] == [1, 2]
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert hits[0][1] == pytest.approx(idf * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 4 / 3)))


def test_negated_group_scores(spark):
    e = engine(spark, ["a b", "a", "a b c"])
    s = {r.doc_id: r.score for r in e.search("a AND NOT (b AND c)").collect()}
    assert s.keys() == {1, 2} and s[1] > s[2]


def test_page_and_empty(spark):
    e = engine(spark, ["a"] * 3 + ["a a", None, ""])
    rows = e.page("a", 1, 2).collect()
    assert len(rows) == 2 and rows[0].bar <= 10
    assert engine(spark, []).search("a").count() == 0 and e.search("NOT a").count() == 0


def test_no_shuffle_over_documents(spark):
    plan = engine(spark, ["a b"]).evaluate("a ADJ b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_index_round_trip(spark, tmp_path):
    from gleanery.sources import files

    d = spark.createDataFrame([(1, "First Article", "hello world hello"), (2, "Second Article", "foo"), (3, "", "a b")], "doc_id long, title string, text string")
    files.write_index(d, str(tmp_path / "i"))
    p, n, docs = files.read_index(spark, str(tmp_path / "i"))
    assert [r.doc_id for r in Engine(docs, p, n).evaluate("hello ADJ world").collect()] == [1]
    assert n.first().n_docs == 3 and n.first().total_tokens == 6
    assert postings.term_frequency(p, "hello", 1).first().tf == 2 and postings.term_frequency(p, "hello", 9).first().tf == 0
    assert postings.lookup(docs, 2).first()[1:] == ("Second Article", "foo") and postings.lookup(docs, 9).count() == 0
    titles = docs.select("doc_id", postings.title_or_number(docs.title, docs.doc_id).alias("t")).collect()
    assert {r.doc_id: r.t for r in titles}[3] == "Document #3"
    assert p.filter("term = 'hello'").first().positions == [0, 2]
    assert search.K1 == 1.5
