"""Boolean and positional search with BM25.

The query language has words, AND, OR, NOT, ADJ, NEAR/k and parentheses. A query is parsed on the driver and compiled to
one predicate over a row that holds, for each document, the positions of each query term. No operator becomes a
join: from documents that row needs no shuffle at all, from postings one grouping by document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.plan import computed
from gleanery.functions.text import index_tokens
from gleanery.operators.postings import sized_postings
from gleanery.sources import files

K1, B = 1.5, 0.75
#: NEAR distances up to which a probe of all offsets is cheaper than a comparison of all pairs.
SMALL_NEAR = 16


class QueryError(ValueError):
    """The query does not parse."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class Op:
    """kind is and, or, adj or near; k is the distance of near."""

    kind: str
    left: Node
    right: Node
    k: int = 1


Node = Term | Not | Op
_LEX = re.compile(r"\s*(?:(?P<near>NEAR/(?P<k>[A-Z0-9_]*))|(?P<word>[A-Z0-9_]+)|(?P<sign>[()]))")


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.upper().rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"unexpected character at {at}: {text[at:].strip()[:1]!r}")
        if m["near"]:
            out.append(("near", m["k"]))
        elif m["sign"]:
            out.append((m["sign"], ""))
        else:
            out.append((m["word"].lower(), "") if m["word"] in ("AND", "OR", "NOT", "ADJ") else ("word", m["word"]))
        at = m.end()
    return [*out, ("end", "")]


def parse(text: str) -> Node:
    """OR binds loosest; AND, ADJ and NEAR share one level and group from the left; NOT takes a word or a group."""
    tokens, at = _lex(text), 0

    def primary() -> Node:
        nonlocal at
        kind, value = tokens[at]
        at += 1
        if kind == "word":
            return Term(value.lower())
        if kind == "(":
            inside = either()
            if tokens[at][0] != ")":
                raise QueryError("a parenthesis is not closed")
            at += 1
            return inside
        raise QueryError(f"a word or a parenthesis is expected, not {kind!r}")

    def unary() -> Node:
        nonlocal at
        if tokens[at][0] == "not":
            at += 1
            return Not(primary())
        return primary()

    def chain() -> Node:
        nonlocal at
        left = unary()
        while tokens[at][0] in ("and", "adj", "near"):
            kind, value = tokens[at]
            at += 1
            k = int(value) if value.isdigit() else 1
            left = Op(kind, left, unary(), k)
        return left

    def either() -> Node:
        nonlocal at
        left = chain()
        while tokens[at][0] == "or":
            at += 1
            left = Op("or", left, chain())
        return left

    found = either()
    if tokens[at][0] != "end":
        raise QueryError(f"an operator is expected, not {tokens[at][0]!r}")
    return found


def evaluated_terms(node: Node) -> list[str]:
    """Distinct words that evaluation looks up: all but those under a NOT that is not the right side of an AND."""
    if isinstance(node, Term):
        return [node.word]
    if isinstance(node, Not):
        return []
    right = node.right.child if node.kind == "and" and isinstance(node.right, Not) else node.right
    return list(dict.fromkeys(evaluated_terms(node.left) + evaluated_terms(right)))


def outside_not(node: Node) -> list[str]:
    """Distinct words that stand under no NOT at all."""
    if isinstance(node, Term):
        return [node.word]
    if isinstance(node, Not):
        return []
    return list(dict.fromkeys(outside_not(node.left) + outside_not(node.right)))


def _sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def _near_positions(a: Column, b: Column, k: int) -> Column:
    """Both ends of each p in a with the next q in b above it, and of each q in b with the next p in a at or above it."""
    up = F.flatten(F.transform(a, lambda p: F.transform(F.array(F.array_min(F.filter(b, lambda q: q > p))), lambda q: F.when(q - p <= k, F.array(p, q)).otherwise(F.array().cast("array<int>")))[0]))
    down = F.flatten(F.transform(b, lambda q: F.transform(F.array(F.array_min(F.filter(a, lambda p: p >= q))), lambda p: F.when(p - q <= k, F.array(p, q)).otherwise(F.array().cast("array<int>")))[0]))
    return F.array_sort(F.array_distinct(F.concat(up, down)))


class Compiled:
    """A query over rows with p0, p1, ...: the positions of each term, null where a document lacks it.

    Positions and matches of composed nodes become columns of `rows` as they are needed, each computed once.
    """

    def __init__(self, node: Node, rows: DataFrame):
        self.terms = evaluated_terms(node)
        self.rows = rows
        self._matches: dict[Node, Column] = {}
        self._places: dict[Node, Column] = {}
        self.match = F.coalesce(self._match(node), F.lit(False))
        self.node = node

    def _bind(self, column: Column) -> Column:
        name = f"q{len(self.rows.columns)}"
        self.rows = computed(self.rows, self.rows.columns, **{name: column})
        return F.col(name)

    def _p(self, word: str) -> Column:
        return F.col(f"p{self.terms.index(word)}")

    def _match(self, node: Node) -> Column:
        if node not in self._matches:
            self._matches[node] = self._find_match(node)
        return self._matches[node]

    def _find_match(self, node: Node) -> Column:
        if isinstance(node, Term):
            return self._p(node.word).isNotNull()
        if isinstance(node, Not):
            return F.lit(False)
        if node.kind == "and" and isinstance(node.right, Not):
            return self._match(node.left) & ~self._match(node.right.child)
        left, right = self._match(node.left), self._match(node.right)
        if node.kind == "or":
            return left | right
        if node.kind == "and":
            return left & right
        a, b = self.positions(node.left), self.positions(node.right)
        if node.kind == "adj":
            meets = F.arrays_overlap(F.transform(a, lambda x: x + 1), b)
        elif node.k <= SMALL_NEAR:
            meets = F.arrays_overlap(F.flatten(F.transform(a, lambda x: F.sequence(x - node.k, x + node.k))), b)
        else:
            meets = F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= node.k))
        return self._bind(left & right & F.coalesce(meets, F.lit(False)))

    def positions(self, node: Node) -> Column:
        """Sorted distinct positions that an enclosing operator sees; only read where the node matches."""
        if isinstance(node, Term):
            return self._p(node.word)
        if isinstance(node, Not):
            return F.lit(None).cast("array<int>")
        if node.kind == "and" and isinstance(node.right, Not):
            return self.positions(node.left)
        if node not in self._places:
            self._places[node] = self._bind(self._find_positions(node))
        return self._places[node]

    def _find_positions(self, node: Op) -> Column:
        a, b = self.positions(node.left), self.positions(node.right)
        if node.kind == "and":
            return _sorted_union(a, b)
        if node.kind == "or":
            ma, mb = self._match(node.left), self._match(node.right)
            return F.when(ma & mb, _sorted_union(a, b)).when(ma, a).otherwise(b)
        if node.kind == "adj":
            first = F.array_intersect(a, F.transform(b, lambda y: y - 1))
            return _sorted_union(first, F.transform(first, lambda x: x + 1))
        if self._right_leads(node):
            a, b = b, a
        return _near_positions(a, b, node.k)

    def _right_leads(self, node: Op) -> bool:
        """NEAR walks the operand with fewer documents; which one it is shows only where both share a position."""
        if not set(evaluated_terms(node.left)) & set(evaluated_terms(node.right)):
            return False
        counts = [self.rows.filter(F.coalesce(m, F.lit(False))).count() for m in (self._match(node.left), self._match(node.right))]
        return counts[1] < counts[0]


def _term_row(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, doc_len, p0, p1, ...) from documents, without a shuffle."""
    rows = computed(docs, ["doc_id"], t=index_tokens(F.col("text")))

    def at(word: str) -> Column:
        where = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i) == word)
        return F.when(F.array_contains("t", word), where)

    return computed(rows, ["doc_id"], doc_len=F.size("t").cast("long"), **{f"p{i}": at(w) for i, w in enumerate(terms)})


def _posting_row(posts: DataFrame, terms: list[str]) -> DataFrame:
    """The same from postings with document lengths: only the terms' lists are read, one grouping by document."""
    rows = posts.filter(F.col("term").isin(terms))
    if len(terms) == 1:
        return rows.select("doc_id", "doc_len", F.col("positions").alias("p0"))
    lists = (F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(terms))
    return rows.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), *lists)


class Engine:
    """Search over documents (doc_id, text, maybe title), or over stored postings and totals; see open()."""

    def __init__(self, docs: DataFrame, posts: DataFrame | None = None, totals: DataFrame | None = None, path: str | None = None):
        self.docs, self.posts, self.totals, self.path = docs, posts, totals, path
        self.buckets: int | None = None

    @classmethod
    def build(cls, docs: DataFrame, path: str, buckets: int = 16) -> Engine:
        """Writes an index of docs to path and opens it."""
        files.write_index(docs, path, buckets)
        return cls.open(docs.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        """An index that was written; a query reads only the folders of its terms' buckets."""
        posts, totals, docs = files.read_index(spark, path)
        out = cls(docs, posts, totals, path)
        out.buckets = files.index_buckets(spark, path)
        return out

    def add(self, docs: DataFrame) -> None:
        """Adds documents with new ids: to the stored index, or to the documents that are searched."""
        if self.path is not None:
            files.append_index(docs, self.path)
            new = Engine.open(docs.sparkSession, self.path)
            self.docs, self.posts, self.totals = new.docs, new.posts, new.totals
            return
        if self.posts is not None:
            raise ValueError("postings that are not stored can't grow")
        self.docs = self.docs.unionByName(docs, allowMissingColumns=True)

    def _lists(self, terms: list[str]) -> DataFrame:
        """The postings where the terms' lists are: their buckets are constants, so only their folders are read."""
        if self.buckets is None:
            return self.posts
        return self.posts.filter(F.col("bucket").isin(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(self.buckets)).cast("int") for w in terms)))

    def postings(self, term: str) -> DataFrame:
        """(term, doc_id, positions, tf, doc_len) of one term."""
        posts = self._lists([term]) if self.posts is not None else sized_postings(self.docs)
        return posts.filter(F.col("term") == term).select("term", "doc_id", "positions", "tf", "doc_len")

    def _rows(self, terms: list[str]) -> DataFrame:
        if not terms:
            return self.docs.select("doc_id", F.lit(0).cast("long").alias("doc_len")).filter(F.lit(False))
        if self.posts is not None:
            return _posting_row(self._lists(terms), terms)
        return _term_row(self.docs, terms)

    def _compiled(self, query: str) -> Compiled:
        node = parse(query)
        return Compiled(node, self._rows(evaluated_terms(node)))

    def evaluate(self, query: str) -> DataFrame:
        """(doc_id) of the matching documents, unranked."""
        q = self._compiled(query)
        return q.rows.filter(q.match).select("doc_id")

    def positions(self, query: str) -> DataFrame:
        """(doc_id, positions) of the matching documents."""
        q = self._compiled(query)
        found = q.positions(q.node)  # may add columns to the rows
        return q.rows.filter(q.match).select("doc_id", found.alias("positions"))

    def _stats(self, terms: list[str]) -> DataFrame:
        """One row: n, avg and the document frequency of each term, over the whole corpus."""
        if self.posts is not None and self.totals is not None:
            n = self.totals.agg(F.sum("n_docs").alias("n"), (F.sum("total_tokens") / F.sum("n_docs")).alias("avg"))
            df = self._lists(terms).filter(F.col("term").isin(terms)).agg(*(F.count(F.when(F.col("term") == w, 1)).alias(f"df{i}") for i, w in enumerate(terms)))
            return n.crossJoin(df)  # one row by one row
        rows = computed(self.docs, [], t=index_tokens(F.col("text")))
        return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avg"), *(F.count(F.when(F.array_contains("t", w), 1)).alias(f"df{i}") for i, w in enumerate(terms)))

    def search(self, query: str) -> DataFrame:
        """(doc_id, score) of the matching documents; order by score descending, then doc_id, for ranks.

        The score sums over all evaluated terms, also those that only the right side of an AND NOT has.
        """
        q = self._compiled(query)
        hits = q.rows.filter(q.match)
        if not q.terms:
            return hits.select("doc_id", F.lit(0.0).alias("score"))
        hits = hits.crossJoin(F.broadcast(self._stats(q.terms)))  # one row
        rel = F.when(F.col("avg") > 0, F.col("doc_len") / F.col("avg")).otherwise(F.col("doc_len"))
        score = F.lit(0.0)
        for i in range(len(q.terms)):
            tf, df = F.coalesce(F.size(F.col(f"p{i}")), F.lit(0)), F.col(f"df{i}")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * rel))
            score = score + F.when((tf > 0) & (df > 0), part).otherwise(F.lit(0.0))
        return hits.select("doc_id", score.alias("score"))

    def top(self, query: str, k: int = 10) -> DataFrame:
        return self.search(query).orderBy(F.desc("score"), "doc_id").limit(k)

    def page(self, query: str, offset: int = 0, limit: int = 10) -> DataFrame:
        """A slice of the ranking with bar, the tenths of the best score."""
        hits = self.search(query)
        best = hits.agg(F.max("score").alias("best"))
        out = hits.crossJoin(F.broadcast(best)).withColumn("bar", F.floor(10 * F.col("score") / F.col("best")))
        return out.select("doc_id", "score", "bar").orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
