import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import codec, hashing, text
from gleanery.operators import postings


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value,want", [("Wörld x_1", ["w", "rld", "x_1"]), ("Kelvin K", ["elvin", "k"]), (None, []), ("", []), ("--", [])])
def test_index_tokens(spark, value, want):
    assert one(spark, text.index_tokens, value) == want


@pytest.mark.parametrize("value,want", [("Wörld_x Привет ½", ["wörld", "x", "привет", "½"]), (None, []), (" ", [])])
def test_unicode_tokens(spark, value, want):
    assert one(spark, text.unicode_tokens, value) == want


@pytest.mark.parametrize("k,words,want", [(2, [], ["<empty>"]), (2, ["a"], ["a"]), (2, ["a", "b", "a", "b"], ["a b", "b a"]), (3, ["a", "b"], ["a b"])])
def test_shingles(spark, k, words, want):
    assert one(spark, lambda c: text.shingles(c, k), words, "array<string>") == want


def test_jaccard(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(text.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.5, 0.0]


def test_clean_markup(spark):
    raw = "<!-- c -->* '''Bold''' [[Category:X]] [[a|b]] [[c]] [http://x.y z] == H == <ref n=1>r</ref> {{a {{b}} }} {q} <b>t</b>\n\n end"
    assert one(spark, text.clean_markup, raw) == "Bold X b c z H }} t end"


@pytest.mark.parametrize("ns,t,want", [(0, "x", True), (1, "x", False), (0, "", False), (0, "#REDIRECT a", False), (0, "#redirect a", False), (0, "#Redirect a", True), (None, "x", False)])
def test_articles(spark, ns, t, want):
    df = spark.createDataFrame([(ns, t)], "ns int, t string")
    assert df.select(text.is_article(F.col("ns"), F.col("t")).alias("r")).first().r is want


def test_formats(spark):
    assert [one(spark, text.format_bytes, n, "long") for n in (0, 1023, 1024, 5 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KB", "5.0 MB", "3.0 GB"]
    assert one(spark, lambda c: text.format_bytes(c, 2), 3 << 30, "long") == "3.00 GB"
    assert [one(spark, text.format_count, n, "long") for n in (0, 999, 1000, 1234567)] == ["0", "999", "1 000", "1 234 567"]


def test_wrap(spark):
    got = one(spark, lambda c: text.wrap(c, 10), "aaa bbb ccc ddd\n\n  \nlongerthanten é éé")
    assert got == ["aaa bbb", "ccc ddd", "", "", "longerthanten", "é éé"]


def test_last_comma(spark):
    df = spark.createDataFrame([("a,b,1.5\r\n",), (",42",), ("none",)], "v string")
    a, b = text.last_comma(F.col("v"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("a,b", "1.5"), ("", "42"), (None, None)]


@pytest.mark.parametrize("values", [[1, 3, 10, 25, 100, 255], [], [i % 50 for i in range(1000)], [0], [2**32 - 1, 0, 1], [2**28] * 40, [127, 128, 16383, 16384]])
def test_codec(spark, values):
    data = codec.encode(np.array(values, np.int64))
    assert codec.decode(data).tolist() == values
    assert int(np.frombuffer(data, "<u4", 1)[0]) == len(data) == one(spark, codec.packed_size, values, "array<long>")
    d = one(spark, codec.deltas, values, "array<long>")
    assert d == [v - w for v, w in zip(values, [0, *values])]
    assert one(spark, codec.undelta, d, "array<long>") == values


def test_codec_of_many_lists_equals_that_of_each(spark):
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(0, 100))) for _ in range(400)] + [np.array([], np.int64), np.array([2**32 - 1] * 33), np.zeros(64, np.int64)]
    want = [codec.encode(x) for x in lists]
    data, size = codec.encode_all(np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]))
    assert data.tobytes() == b"".join(want) and size.tolist() == [len(x) for x in want]
    values, n = codec.decode_all(data, np.cumsum(size) - size)
    assert values.tolist() == [int(v) for x in lists for v in x] and n.tolist() == [len(x) for x in lists]
    rows = spark.createDataFrame([(i, [int(v) for v in x] if i % 7 else None) for i, x in enumerate(lists)], "i long, v array<long>").withColumn("b", codec.encoded("v"))
    for r in rows.select("i", "v", "b", codec.decoded("b").alias("d"), codec.decoded_sums("b").alias("s")).collect():
        assert r.d == r.v and r.s == (None if r.v is None else np.cumsum(r.v, dtype=np.int64).tolist())
        assert r.b is None if r.v is None else bytes(r.b) == want[r.i]


def test_decoded_sums_are_linear(spark):
    import time

    docs = spark.createDataFrame([(1, "a " * 60_000)], "doc_id long, text string")
    began = time.perf_counter()
    back = postings.coded(docs).select(codec.decoded_sums("data").alias("p")).collect()
    assert [r.p for r in back] == [list(range(60_000))]
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("texts", [1, 40, 2 << 20])
def test_coded_postings_equal_postings(spark, monkeypatch, texts):
    monkeypatch.setattr(postings, "TEXTS", texts)
    rows = [(i, ("ab_9 É Ab x\u00aay\u0131 \u212a the-THE " * (i % 40)) + f"t{i % 11}") for i in range(120)] + [(7, "the end"), (7, None), (8, ""), (None, "b a"), (None, "a b"), (500, None), (501, "--")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((r.term, r.doc_id or -1, r.positions) for r in postings.postings(docs).collect()))
    back = postings.coded(docs).select("term", "doc_id", codec.decoded_sums("data").alias("p")).collect()
    assert sorted((r.term, r.doc_id or -1, r.p) for r in back) == want
    assert postings.coded(docs.filter("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 1000])
def test_skips(spark, n):
    step, want = max(2, int(n**0.5)), []
    while n > 1 and step < n:
        want.append(list(range(step, n, step)))
        step *= 2
    assert (one(spark, codec.skip_steps, n, "int") or []) == want
    assert one(spark, codec.flat_skips, n, "int") == [len(want)] + [x for level in want for x in [len(level), *level]]


def test_hashes(spark):
    assert hashing.fnv1a_64([b"a", b""]).tolist() == [0xAF63DC4C8601EC8C, hashing.FNV_OFFSET]
    assert int(hashing.splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    assert int(hashing.fmix64(np.array([1], np.uint64))[0]) == 0xB456BCFC34C2CB2C
    assert one(spark, hashing.fnv1a_32, "a") == 3826002220 and one(spark, hashing.fnv1a_32, "") == 2166136261
    assert one(spark, hashing.fnv64, "a") == 0xAF63DC4C8601EC8C - 2**64 and one(spark, hashing.fnv64, None) is None
    assert one(spark, hashing.hash_key, 0, "long") == 0xE220A8397B1DCDAF - 2**64
    assert one(spark, hashing.hash_string, "a") == int(hashing.splitmix64(hashing.fnv1a_64([b"a"])).view(np.int64)[0])
    assert [hashing.next_prime(n) for n in (0, 1, 2, 3, 13, 14)] == [2, 2, 3, 5, 17, 17]
    h = 0
    for b in "é".encode():
        h = (h * hashing.KNUTH + (b - 256 if b > 127 else b)) % 2**64
    assert int(hashing.prehash(["é".encode()])[0]) == h
    for slots in hashing.table_hashes([b"x", b"yy"], 101):
        assert (slots < 101).all()


def test_statistics(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, "f g h i")], "doc_id long, text string")
    assert tuple(postings.corpus_stats(d).first()) == (3, 9, 3.0)
    assert tuple(postings.corpus_stats(d.filter("false")).first()) == (0, 0, 0.0)
    rows = {r.term: (r.df, r.cf) for r in postings.term_stats(spark.createDataFrame([(1, "x x y"), (2, "x"), (3, None)], d.schema)).collect()}
    assert rows == {"x": (2, 3), "y": (1, 1)}


@pytest.mark.parametrize("stretch", [3, 40, 4096])
def test_sizes_by_stretch_equal_those_of_whole_lists(spark, monkeypatch, stretch):
    import random

    from gleanery.functions import codec
    from gleanery.operators import postings

    monkeypatch.setattr(postings, "STRETCH", stretch)
    rng = random.Random(6)
    docs = spark.createDataFrame([(i * 37, " ".join(rng.choice("aaaabbcd") for _ in range(rng.randrange(0, 60))) + (" rare" if i == 50 else "")) for i in range(150)], "doc_id long, text string")
    p = postings.postings(docs)
    f = F.col("flat")
    whole = postings.flat_list(p).select("term", "df", F.size(f).alias("n"), codec.varint_size(f).alias("v"), codec.bitpack_size(f).alias("b"))
    want = {tuple(r) for r in whole.collect()}
    assert {(r.term, r.df, r.n_ints, r.varint_bytes, r.bitpack_bytes) for r in postings.list_sizes(p).collect()} == want and len(want) == 5
    ids = p.groupBy("term").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).select("term", codec.deltas(F.col("ids")).alias("d"))
    want = {tuple(r) for r in ids.select("term", codec.varint_size(F.col("d")), codec.bitpack_size(F.col("d"))).collect()}
    assert {(r.term, r.varint_bytes, r.bitpack_bytes) for r in postings.id_sizes(p).collect()} == want
