import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import urlfilter
from gleanery.llm.queries import RULES
from gleanery.llm.urlfilter import PATTERNS, HostRule, Index, PatternRule, filter_urls, literals, parse, split
from tests.llm import data

URLS = [
    None, "", "no scheme", "http://", "https://a.example.com", "https://A.Example.COM/en/7", "http://x.example.com/en/71?q=1", "http://com/en/", "http://welcome/en/",
    "http://notexample.com/en/7", "http://example.net/de/8", "http://m.example.net/de/9#a", "http://b.org/es/1", "http://b.org/fr/1", "http://b.org?/es/", "ftp://www.cheap-pills.example.org/fr",
    "x://spam-farm.example.org/es/1", "http://spamfarm.example.org/", "http://a.b//com/en/", "://com/en/x", "http://com/en", "http://a.com/EN/", "http://a.com\n/en/", "http://ex.org/wp-login.php?x",
    "http://a\nb.com/en/x", "http://a\n.spam-farm.org/", "http://pornhub.com/", "http://online-poker.biz/x", "http://poker-face.a.net", "http://xpoker.net", "http://myxxx.org", "http://xxx.org/\nwp-login.php",
]


def expected(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in map(parse, RULES) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    words = f"-{host.replace('.', '-')}-"
    bad = any(f"-{p}-" in words for p in ("spam-farm", "cheap-pills", "xxx")) or "-poker" in words or any(p in host for p in ("casino", "porn")) or path.startswith("/wp-login.php")
    return host, path, None, "block" if bad else "allow"


def pages(spark, urls, extra=False):
    df = data.table(spark, [(i if i != 3 else None, u) for i, u in enumerate(urls)] + [(1, urls[1])], "page_id long, url string")
    return df.select("*", *(F.lit(1).alias(c) for c in ("host", "path", "rule", "verdict", "j", "pattern"))) if extra else df


@pytest.mark.parametrize("extra", [False, True])
def test_equals_brute_force(spark, extra):
    out = filter_urls(pages(spark, URLS, extra), RULES).collect()
    want = [(i if i != 3 else None, *expected(u)) for i, u in enumerate(URLS)] + [(1, *expected(URLS[1]))]
    assert Counter(tuple(r)[:5] for r in out) == Counter(want)


def test_empty_and_no_rules(spark):
    assert filter_urls(data.table(spark, [], "page_id long, url string"), RULES).count() == 0
    out = filter_urls(pages(spark, URLS), [], ()).collect()
    assert {r.verdict for r in out} == {"allow"}


def test_rarest_token_files_the_rule():
    rule = parse("block shop.example.com/sale/")
    index = Index([rule], {"shop": 5, "example": 90, "com": 99, "sale": 2})
    assert list(index.by_token) == ["sale"]
    assert index.judge("a.shop.example.com", "/sale/1")[:2] == ("shop.example.com/sale/", "block")
    assert index.candidates("a.shop.example.com", "/other") == []


def test_open_token_is_no_key():
    assert parse("block example.com/en/7").tokens == ["example", "com", "en"]


def test_rule_without_tokens_is_always_tried():
    index = Index([PatternRule("long", ".*", ".{50,}"), *PATTERNS], {})
    assert index.judge("a.b", "/" + "x" * 60) == (None, "block", "long")


def test_bad_rules():
    for line in ("deny a.com/", "block", "block /x"):
        with pytest.raises(ValueError):
            parse(line)
    assert parse("allow NET/de/") == HostRule("net", "/de/", "allow")
    assert split("a://B.c/d?e") == ("b.c", "/d")


def test_large_lists_are_joined(spark, monkeypatch):
    want = Counter(tuple(r) for r in filter_urls(pages(spark, URLS), RULES).collect())
    monkeypatch.setattr(urlfilter, "MOST", 2)
    assert Counter(tuple(r) for r in filter_urls(pages(spark, URLS, True), [*RULES, "block .../x", "allow com/en/"]).collect()) == want


@pytest.mark.parametrize("most", [urlfilter.MOST, 1_000])
def test_many_rules_equal_brute_force(spark, monkeypatch, most):
    """50,000 rules over hosts and paths of few labels, so that many nest."""
    monkeypatch.setattr(urlfilter, "MOST", most)
    rng = random.Random(5)
    label = lambda: f"n{rng.randrange(60)}"
    rules = [f"{rng.choice(['allow', 'block'])} {'.'.join(label() for _ in range(rng.randrange(1, 4)))}/{'/'.join(label() for _ in range(rng.randrange(0, 3)))}" for _ in range(50_000)]
    urls = [f"http://{'.'.join(label() for _ in range(rng.randrange(2, 5)))}/{'/'.join(label() for _ in range(rng.randrange(0, 4)))}" for _ in range(400)]
    by_host = {}
    for r in map(parse, rules):
        by_host.setdefault(r.host, {}).setdefault(r.path, r)
    want = []
    for i, u in enumerate(urls):
        host, path = split(u)
        labels = host.split(".")
        fits = [r for k in range(len(labels)) for p, r in by_host.get(".".join(labels[k:]), {}).items() if path.startswith(p)]
        best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
        want.append((i, best.name if best else None, best.verdict if best else "allow"))
    out = filter_urls(data.table(spark, list(enumerate(urls)), "page_id long, url string"), rules, ())
    assert sorted((r.page_id, r.rule, r.verdict) for r in out.collect()) == want


def test_literals():
    assert literals(r"(?:.*[.-])?spam-farm(?:[.-].*)?", True) == ["spam", "farm"]
    assert literals(".*casino.*", True) == ["~casi", "~asin", "~sino"]
    assert literals(r"/wp-login\.php", False) == ["wp", "login"] and literals("ab+cd", True) == [] and literals("(?i)abcd", True) == []
    assert literals("(?i:abcd)-x", True) == ["x"] and literals("(?:x-)?abcd", True) == ["abcd"] and literals("(?:x)?abcd", True) == ["~abcd"]
    assert literals("abcd(?:ef|-g)", True) == ["~abcd"] and literals("abcd(?:-ef|[.]g)", True) == ["abcd"]


def test_index_finds_all_that_fits():
    """Patterns tried on every URL, against those that the index fetches."""
    rng = random.Random(11)
    bits = ["spam", "farm", "casino", "poker", "online", "porn", "xxx", "cheap", "pills", "meds", "doubleclick", "a", "7", "-", ".", "-", ".", "/", "/wp-login.php"]
    index = Index(list(PATTERNS), {})
    hits = 0
    for _ in range(4_000):
        host, path = split("x://" + "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))))
        want = [i for i, p in enumerate(PATTERNS) if re.fullmatch(p.host, host, re.S) and re.match(p.path, path, re.S)]
        assert set(want) <= set(index.candidates(host, path))
        hits += len(want)
    assert hits > 500
