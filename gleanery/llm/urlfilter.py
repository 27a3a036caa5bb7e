"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host suffix with a path prefix, or a pair of regular expressions, one for the whole host and one for where the
path begins. Each rule is filed under one literal that no URL fits without: a whole token, or four letters in a row for
a pattern whose literals may stand inside a token. Which literals those are is read off the parsed expressions. Of a rule's
literals the one counts that fewest URLs have (counted over the whole table, in one pass that only looks for them). A
URL's tokens fetch the few rules filed under them, and only those are matched; of the host rules that fit the longest
decides, else of the patterns the first.

The patterns and up to MOST host rules go to the executors, URLs are not shuffled. More host rules than that are a table of
their own, joined with the URLs' tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import missing

#: Host rules in one broadcast at most: about 60 MB in a worker.
MOST = 100_000
TOKEN = re.compile(r"[a-z0-9]+")
GRAM = 4
UPPER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    return text.translate(UPPER)


@dataclass(frozen=True)
class HostRule:
    """Fits host and all subdomains, for paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has whole: of the host, and of the path but for what the prefix leaves open."""
        closed = [m[0] for m in TOKEN.finditer(lowered(self.path)) if m.end() < len(self.path)]
        return TOKEN.findall(lowered(self.host)) + closed

    def fits(self, host: str, path: str) -> bool:
        return path.startswith(self.path) and (host == self.host or host.endswith(self.host) and host[-len(self.host) - 1] == ".")


@dataclass(frozen=True)
class PatternRule:
    """Fits if host matches the whole host and path the beginning of the path; the host is lower-cased, the path is not."""

    name: str
    host: str
    path: str = ""
    verdict: str = "block"

    @cached_property
    def tokens(self) -> list[str]:
        return [*dict.fromkeys(literals(self.host, True) + literals(self.path, False))]

    @cached_property
    def _compiled(self) -> tuple[re.Pattern, re.Pattern]:
        return re.compile(self.host, re.S), re.compile(self.path, re.S)

    def fits(self, host: str, path: str) -> bool:
        whole, begin = self._compiled
        return whole.fullmatch(host) is not None and begin.match(path) is not None


def _alnum(code: int) -> bool:
    return TOKEN.fullmatch(lowered(chr(code))) is not None


def _flat(parsed) -> list[tuple[str, object]]:
    """Items in a row, groups that always take part opened; what may be absent or is open is one item."""
    out = []
    for op, value in parsed:
        name = str(op)
        if name == "SUBPATTERN":
            out += [("OTHER", None)] if value[1] & re.I else _flat(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] == value[1] == 1:
            out += _flat(value[2])
        else:
            out.append((name, value))
    return out


def _closed(items: list[tuple[str, object]], edge: bool) -> bool:
    """Whether what stands at the end of these items is surely no token character; edge: whether that holds for what is before them."""
    for name, value in items:
        if name == "LITERAL":
            edge = not _alnum(value)
        elif name == "IN":
            edge = all(str(op) == "LITERAL" and not _alnum(x) for op, x in value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = _flat(value[2])
            edge = _closed(inner, _closed(inner, edge)) and (edge or value[0] > 0)
        elif name == "BRANCH":
            edge = all(_closed(_flat(x), edge) for x in value[1])
        elif name != "AT":
            edge = False
    return edge


def _mirrored(items: list[tuple[str, object]]) -> list[tuple[str, object]]:
    out = []
    for name, value in reversed(items):
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            value = (*value[:2], _Mirror(_flat(value[2])))
        elif name == "BRANCH":
            value = (value[0], [_Mirror(_flat(x)) for x in value[1]])
        out.append((name, value))
    return out


class _Mirror(list):
    """Items back to front, in the form that a parsed expression has."""

    def __init__(self, items: list[tuple[str, object]]):
        super().__init__(_mirrored(items))


def literals(regex: str, whole: bool) -> list[str]:
    """What every match has: whole tokens, and ~abcd for four letters or digits in a row inside a token that may go on.

    whole: the expression must reach the end of the string; its beginning is always the string's.
    """
    from re import _parser

    parsed = _parser.parse(regex, re.S)
    if parsed.state.flags & re.I:
        return []  # only literals in their own case are read
    items, out, at = _flat(parsed), [], 0
    while at < len(items):
        end = at
        while end < len(items) and items[end][0] == "LITERAL":
            end += 1
        if end == at:
            at += 1
            continue
        run = lowered("".join(chr(v) for _, v in items[at:end]))
        left, right = _closed(items[:at], True), _closed(_mirrored(items[end:]), whole)
        for m in TOKEN.finditer(run):
            if (m.start() > 0 or left) and (m.end() < len(run) or right):
                out.append(m[0])
            else:
                out += grams(m[0])
        at = end
    return out


def grams(token: str) -> list[str]:
    return [f"~{token[i : i + GRAM]}" for i in range(len(token) - GRAM + 1)]


_WORD = r"(?:.*[.-])?{}(?:[.-].*)?"
#: The method's own verdicts, where no host rule fits: spam farms, drug shops, casinos, adult and tracking hosts.
PATTERNS = (
    PatternRule("spam-farm", _WORD.format("spam-farm")),
    PatternRule("link-farm", _WORD.format("link-farm")),
    PatternRule("cheap-pills", _WORD.format("cheap-(?:pills|meds|drugs)")),
    PatternRule("casino", ".*casino.*"),
    PatternRule("poker", r"(?:.*[.-])?(?:online-)?poker.*"),
    PatternRule("porn", ".*porn.*"),
    PatternRule("xxx", _WORD.format("xxx")),
    PatternRule("doubleclick", _WORD.format("doubleclick")),
    PatternRule("wp-login", ".*", r"/wp-login\.php"),
)


def parse(line: str) -> HostRule:
    """`block example.net/de/8`: a verdict, and host and path."""
    verdict, _, where = line.partition(" ")
    host, slash, path = where.strip().partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return HostRule(lowered(host), slash + path, verdict)


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty if url is null or has no `://`."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return lowered(host), re.split(r"[?#]", tail, maxsplit=1)[0]


def tokens_of(host: str, path: str, with_grams: bool) -> set[str]:
    found = {*TOKEN.findall(lowered(host)), *TOKEN.findall(lowered(path))}
    return found.union(*map(grams, found)) if with_grams else found


class Index:
    """Rules by their rarest literal; rules without one are tried on every URL."""

    def __init__(self, rules: list[HostRule | PatternRule], seen: dict[str, int]):
        self.always: list[int] = []
        self.by_token: dict[str, list[int]] = {}
        self.rules = rules
        for i, rule in enumerate(rules):
            if rule.tokens:
                token = min(rule.tokens, key=lambda t: (seen.get(t, 0), -len(t), t))
                self.by_token.setdefault(token, []).append(i)
            else:
                self.always.append(i)
        self.with_grams = any(t[0] == "~" for t in self.by_token)

    def candidates(self, host: str, path: str) -> list[int]:
        found = set(self.always)
        for t in tokens_of(host, path, self.with_grams) & self.by_token.keys():
            found.update(self.by_token[t])
        return sorted(found)

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """The host rule that decides or None, the verdict, and the name of the pattern that decided, if one did."""
        fits = [self.rules[i] for i in self.candidates(host, path) if self.rules[i].fits(host, path)]
        own = [r for r in fits if isinstance(r, HostRule)]
        if own:
            best = max(own, key=lambda r: (len(r.name), len(r.host)))
            return best.name, best.verdict, None
        if fits:
            return None, fits[0].verdict, fits[0].name
        return None, "allow", None


def _seen(urls: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(token, n): in how many of the URLs each wanted literal is; a row for each of them at most."""
    with_grams = any(t[0] == "~" for t in wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                found.update(wanted & tokens_of(*split(url), with_grams))
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    return urls.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _by_join(urls: DataFrame, rules: list[HostRule]) -> DataFrame:
    """(u, own_rule, own_verdict) of the distinct URLs that a host rule fits, from any number of host rules."""
    spark = urls.sparkSession
    kinds = "i long, rule string, rh string, rp string, own_verdict string, tokens array<string>"
    table = spark.createDataFrame([(i, r.name, r.host, r.path, r.verdict, r.tokens) for i, r in enumerate(rules)], kinds)
    parts = urls.select(F.col("url").alias("u"), "host", "path").distinct()
    lower = lambda c: F.translate(c, "".join(map(chr, UPPER)), "".join(map(chr, UPPER.values())))
    found = parts.select("u", "host", "path", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "host", lower(F.col("path"))), F.lit("([a-z0-9]+)")))).alias("token"))
    asked = table.select("i", F.explode_outer("tokens").alias("token"))
    counts = found.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = asked.join(counts, "token", "left").groupBy("i").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")).alias("token"))
    filed = table.drop("tokens").join(filed, "i")
    fits = F.col("path").startswith(F.col("rp")) & ((F.col("host") == F.col("rh")) | F.col("host").endswith(F.concat(F.lit("."), "rh")))
    met = found.join(filed.filter("token is not null"), "token").filter(fits).select("u", "rule", "rh", "own_verdict")
    bare = filed.filter("token is null").select("rule", "rh", "rp", "own_verdict")  # hosts without a letter or digit: none but in odd lists
    met = met.unionByName(parts.join(bare, fits).select("u", "rule", "rh", "own_verdict"))
    best = met.groupBy("u").agg(F.max(F.struct(F.length("rule").alias("a"), F.length("rh").alias("b"), "rule", "own_verdict")).alias("m"))
    return best.select("u", F.col("m.rule").alias("own_rule"), "m.own_verdict")


def filter_urls(pages: DataFrame, rules: list[str], patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, pattern.

    rules are lines as in parse(); of equal rules the first counts. rule is the longest host rule that fits, pattern the
    first of the patterns that fits if no host rule does; without either the verdict is allow. A null url, or one without
    `://`, has an empty host and path, which no host rule fits. Rows that repeat are judged alike; no rows give no
    rows; other columns are ignored.
    """
    missing(pages, ("page_id", "url"))
    own = [*{(r.host, r.path): r for r in map(parse, reversed(rules))}.values()][::-1]
    few = len(own) <= MOST
    every = [*(own if few else ()), *patterns]
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    seen = _seen(urls, frozenset(t for r in every for t in r.tokens))
    index = pages.sparkSession.sparkContext.broadcast(Index(every, {r.token: r.n for r in seen.collect()}))

    @F.pandas_udf("host string, path string, rule string, verdict string, pattern string")
    def judged(url):
        import pandas as pd

        found = index.value
        parts = [split(u) for u in url]
        told = [found.judge(*p) for p in parts]
        return pd.DataFrame({"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": pd.Series([t[0] for t in told], dtype=object), "verdict": [t[1] for t in told], "pattern": pd.Series([t[2] for t in told], dtype=object)})

    out = urls.withColumn("j", judged("url")).select("page_id", "url", "j.host", "j.path", "j.rule", "j.verdict", "j.pattern")
    if not few:
        out = out.join(_by_join(out, own), F.col("url") == F.col("u"), "left")
        hit: Column = F.col("own_rule").isNotNull()
        out = out.withColumns({"rule": F.col("own_rule"), "verdict": F.coalesce("own_verdict", "verdict"), "pattern": F.when(~hit, F.col("pattern"))})
    return out.select("page_id", "host", "path", "rule", "verdict", "pattern")
