"""Secret scans: patterns find candidates, a random forest removes the false ones.

The forest sees a candidate's length, how usual its character transitions are in words, how much of it dictionary words
cover, its alphabet, the path it lies under and the four words to either side. It is fitted on labelled findings: a
DataFrame (text, path, start, end, label) that callers bring, of which about `most` rows are drawn by hash; without one,
findings are made from seeded templates of real formats and of what is mistaken for them (references to variables, digests,
ids, slugs, placeholders, code).

The dictionary is the DICTIONARY most frequent words of all documents, counted within a task first; it and the
transition table come to the driver. The scan is a second pass over whole texts, with no shuffle: a filter in the JVM, which
every pattern implies, leaves out the texts without any candidate.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import drawn, free_name, missing
from gleanery.llm.trees import Forest

DICTIONARY, FINDINGS, FILLER = 30_000, 50_000, 2_000
#: Columns of labelled findings; start and end are code points of text.
LABELLED = "text string, path string, start long, end long, label int"
#: Words a task holds before it hands their counts on.
HELD = 200_000
#: Partitions that the most frequent words are taken from.
MERGED = 16
#: Characters of a text whose words are counted at once.
SPAN, GAP = 1 << 18, re.compile(r"[\W\d_]")
#: Formats of well-known credentials, then assignments to telling names, then any long token. Only formats
#: of one fixed length have an upper one; open quantifiers give nothing back, so matching stays linear.
KNOWN = (
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[0-9A-Za-z]{36}\b"),
    ("slack_token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+\b"),
    ("jwt", r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z]+ )?PRIVATE KEY-----|(?:\s*+[0-9A-Za-z+/=]{20,}+)*+)"),
    ("url_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:([^\s:/@]{3,}+)@"),
    ("assignment", r"(?i)(?:\b|_)(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|auth|credentials?)[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?([^\s\"'`,;<>]{6,}+)"),
    ("long_token", r"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[0-9A-Za-z+/_=-]{20,}+"),
)
#: What every match of a pattern has; for the JVM, where it needs no word borders.
CUES = r"[0-9A-Za-z+/_=-]{20}|xox[abprs]-|eyJ|PRIVATE KEY|://|(?iu:key|secret|token|passw|pwd|auth|credential)"
PATTERNS = tuple((name, re.compile(p)) for name, p in KNOWN)
TELLING = ("key", "secret", "token", "pass", "pwd", "auth", "credential", "bearer", "login", "private")
HARMLESS = ("commit", "sha", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "example", "sample", "dummy", "version", "revision", "etag", "page", "order", "mail")
LETTERS = string.ascii_lowercase
N_FEATURES = 22
WORD = re.compile(r"[^\W\d_]+")
COUNTED = re.compile(r"(?<![^\W\d_])[^\W\d_]{3,24}+(?![^\W\d_])")
PIECE = re.compile(r"[A-Za-z]{3,}")
CLASS = str.maketrans({**dict.fromkeys(string.ascii_lowercase, "a"), **dict.fromkeys(string.ascii_uppercase, "A"), **dict.fromkeys(string.digits, "0")})


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int


def candidates(text: str) -> list[Candidate]:
    """Spans by pattern, in order; of overlapping ones the earlier pattern's stays.

    What a long token has beside them is a candidate too if it is a long token by itself, as a key's body on its header's line.
    """
    found: list[Candidate] = []
    for kind, (_, pattern) in enumerate(PATTERNS):
        starts, ends = [c.start for c in found], [c.end for c in found]  # in order and apart
        new = []
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            i = bisect_right(starts, a)
            if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b):
                new.append(Candidate(kind, a, b))
            elif kind == len(PATTERNS) - 1:
                i -= i > 0 and ends[i - 1] > a
                while a < b:
                    upto, then = (min(b, max(a, starts[i])), ends[i]) if i < len(starts) else (b, b)
                    if upto - a >= 20 and any(ch in string.digits for ch in text[a:upto]):
                        new.append(Candidate(kind, a, upto))
                    a, i = then, i + 1
        if new:
            found = sorted(found + new, key=lambda c: c.start)
    return found


class Words:
    """A dictionary and the log frequencies of character pairs in it."""

    def __init__(self, counts: dict[str, int]):
        self.words = frozenset(counts)
        pairs = np.full((27, 27), 1.0)
        for w, n in counts.items():
            codes = [LETTERS.find(c) for c in w]
            for a, b in zip([-1, *codes], [*codes, -1], strict=True):
                pairs[a, b] += math.log1p(n)
        self.pairs = np.log(pairs / pairs.sum(1, keepdims=True))

    def usual(self, s: str) -> float:
        """Mean log frequency of the pairs, letters and all other characters as one."""
        codes = [LETTERS.find(c) for c in s.lower()]
        return float(np.mean(self.pairs[codes[:-1], codes[1:]])) if len(codes) > 1 else 0.0

    def covered(self, s: str) -> float:
        """Share of characters inside dictionary words, longest first from the left."""
        done = 0
        for m in PIECE.finditer(s):
            piece, i = m[0].lower(), 0
            while i < len(piece):
                n = next((n for n in range(min(24, len(piece) - i), 2, -1) if piece[i : i + n] in self.words), 0)
                done += n
                i += n or 1
        return done / max(1, len(s))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def beside(text: str, start: int, end: int, n: int = 4) -> tuple[list[str], list[str]]:
    """The n words before and the n words after a span, lower-cased, however far they are; nearest to the span last and first."""
    out = []
    for forward in (False, True):
        reach = 64
        while True:
            a, b = (end, min(len(text), end + reach)) if forward else (max(0, start - reach), start)
            found = WORD.findall(text[a:b])
            done = b == len(text) if forward else a == 0
            if done or len(found) > n:  # the outermost may be cut
                break
            reach *= 4
        out.append([w.lower() for w in (found[:n] if forward else found[-n:])])
    return out[0], out[1]


def features(text: str, c: Candidate, path: str | None, words: Words) -> list[float]:
    s = text[c.start : c.end]
    n = max(1, len(s))
    shape = s.translate(CLASS)
    changes = sum(a != b for a, b in zip(shape, shape[1:], strict=False)) / n
    before, after = beside(text, c.start, c.end)
    near = before + after
    last = text[max(0, c.start - 4) : c.start]
    place = (path or "").lower()
    return [
        float(n),
        _entropy(s),
        changes,
        words.usual(s),
        words.covered(s),
        shape.count("0") / n,
        shape.count("A") / n,
        shape.count("a") / n,
        float(all(ch in "0123456789abcdefABCDEF" for ch in s)),
        float(n in (32, 40, 64) and all(ch in "0123456789abcdef" for ch in s)),
        float(s.count("-") == 4 and n == 36),
        float(len(set(s)) / n),
        float(c.kind < 8),
        float(c.kind == 8),
        float(any(t in w for w in before for t in TELLING)),
        float(any(w in HARMLESS for w in near)),
        float("=" in last or ":" in last),
        float('"' in last or "'" in last),
        float(any(t in s.lower() for t in ("example", "xxxx", "your", "changeme", "placeholder", "dummy", "test", "redacted", "...", "****"))),
        sum(w in words.words for w in near) / max(1, len(near)),
        float(any(t in place for t in ("test", "example", "doc", "sample", "fixture", "mock"))),
        float(any(t in place for t in (".env", "config", "secret", "credential", ".pem", ".key"))),
    ]


def made_findings(n: int = 4_000, seed: int = 23, filler: list[str] | None = None) -> list[tuple[str, str, int, int, int]]:
    """Labelled findings (text, path, start, end, label) from seeded templates: half of them secrets."""
    rng = np.random.default_rng(seed)
    words = filler or ["the", "value", "of", "this", "service", "is", "read", "from", "file", "and", "used", "when", "set", "build", "page", "order"]
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def some(chars: str, least: int, most: int | None = None) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), least if most is None else int(rng.integers(least, most))))

    def one(*choices):
        return choices[rng.integers(len(choices))]

    def talk(k: int) -> str:
        return " ".join(words[i] for i in rng.integers(0, len(words), k))

    def joined(sep: str = "", k: int = 0) -> str:
        return sep.join(words[i] for i in rng.integers(0, len(words), k or int(rng.integers(2, 6))))

    def name() -> str:
        base = one("token", "api_key", "API_KEY", "secret", "password", "auth", "access_key", "client_secret", "pwd", "AUTH_TOKEN", "db_password", "credentials", "apiKey", "passwd")
        return one("", "", joined() + "_") + base

    def given() -> tuple[str, str]:
        """What stands before and after a value that is assigned."""
        return one((f'{name()} = "', '"'), (f"{name()}: ", ""), (f"{name()}='", "'"), (f'"{name()}": "', '",'), (f"{name()}=", ""), (f"{name()} := ", ""))

    def camel() -> str:
        return "".join(w.capitalize() for w in joined(" ").split())

    def assigned(make):
        return lambda: (lambda g: (g[0], make(), g[1]))(given())

    good = [
        assigned(lambda: some(hexa, int(one(32, 40, 64)))),
        assigned(lambda: some(b64, 16, 90) + one("", "=", "==")),
        assigned(lambda: some(alnum + "!@#$%^&*", 8, 24)),
        assigned(lambda: one("sk-", "pk_", "glpat-", "") + some(alnum + "_-", 20, 60)),
        assigned(lambda: joined("", 1).capitalize() + some(string.digits + "!@#", 3, 6) + one("", joined("", 1))),
        lambda: ("", one("AKIA", "ASIA") + some(string.ascii_uppercase + string.digits, 16), ""),
        lambda: ("", one("ghp_", "gho_", "ghs_") + some(alnum, 36), ""),
        lambda: ("", one("xoxb-", "xoxp-") + some(string.digits, 11) + "-" + some(alnum, 24), ""),
        lambda: ("", "AIza" + some(alnum + "_-", 35), ""),
        lambda: ("", one("sk_live_", "rk_live_") + some(alnum, 24, 60), ""),
        lambda: ("", "eyJ" + some(alnum, 20, 60) + ".eyJ" + some(alnum, 40, 120) + "." + some(alnum + "_-", 43), ""),
        lambda: (one("Authorization: Bearer ", "curl -H 'X-Key: ", "login with "), some(alnum, 32, 64), ""),
        lambda: (one("postgres", "https", "redis", "amqp") + "://" + one("admin", "root", joined("", 1)) + ":", some(alnum + "%!", 8, 24), "@db.host/main"),
        lambda: ("", "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(b64, 64) for _ in range(int(rng.integers(1, 8)))) + "\n-----END RSA PRIVATE KEY-----", ""),
        lambda: ("", some(b64, 60, 200) + one("", "=", "=="), ""),
    ]
    bad = [
        lambda: (one("commit ", "sha ", "revision ", "checksum: ", "md5 ", "digest ", "etag ", "sha256:", "Merge "), some(hexa, int(one(32, 40, 64))), ""),
        lambda: ('"integrity": "', one("sha512-", "sha256-") + some(b64, 86) + "==", '"'),
        lambda: (one("id ", "uuid=", "request ", "guid: "), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        assigned(lambda: one("your_api_key_here", "changeme", "x" * int(rng.integers(8, 40)), "<redacted>", "example_token_1234", "placeholder", "********", "REPLACE_ME_NOW", "your-secret", "...redacted...", "dummy-password", "test1234test")),
        assigned(lambda: one("${", "$", "{{ ", "%(", "#{", "<") + name().upper() + one("}", "", " }}", ")s", ">")),
        assigned(lambda: one("os.environ[", "process.env.", "config.get(", "getenv(", "settings.", "self.", "this.", "request.headers.", "vault.read(", "secrets.") + one(name(), joined("_")) + one("", ")", "]", ";", "()")),
        assigned(lambda: one("string;", "String,", "required", "Optional[str]", "undefined", "None,", "null,", "bool", "PasswordField()", "authenticated", "disabled", "invalid_grant", "refresh_token", "client_credentials")),
        assigned(lambda: joined(one("_", "-", ".", " ").strip() or "_") + one("", "_" + some(string.digits, 1, 3))),
        assigned(lambda: words[rng.integers(len(words))].ljust(6, "e")),
        assigned(lambda: camel() + one("", "Factory", "Service()", "Error")),
        assigned(lambda: one("/", "./", "~/") + joined("/") + one(".json", ".pem", "", "/")),
        assigned(lambda: one("https://", "http://") + joined("-") + ".com/" + joined("/")),
        lambda: (one("order ", "phone ", "isbn ", "total ", ""), some(string.digits, 20, 28), ""),
        lambda: (one("page ", "see ", "/blog/", ""), joined("-", 6) + one("-2024", "-" + some(string.digits, 1, 4)), ""),
        lambda: (one("see ", "in ", ""), "/" + joined("/") + "/" + joined("_", 4) + one(".py", ".html", "2"), ""),
        lambda: (one("import ", "class ", ""), camel() + camel() + camel() + one("2", "V1", "64"), ""),
        lambda: ("background: url(data:image/png;base64,", one("iVBORw0KGgo", "R0lGODlh") + some(b64, 60, 200), ")"),
        lambda: ("", one("-", "=", "_", "+") * int(rng.integers(20, 60)) + some(string.digits, 1), ""),
        lambda: (one("2024-01-", "at ", "log "), "2024-05-" + some(string.digits, 2) + "T10-" + some(string.digits, 2) + "-" + some(string.digits, 6), ""),
        lambda: (one("https", "http") + "://" + joined("-", 2) + ":", str(int(rng.integers(1000, 65535))) + "/" + joined("/"), "@" + joined("", 1)),
    ]
    out = []
    for i in range(n):
        label = i % 2
        kinds = good if label else bad
        lead, s, tail = kinds[rng.integers(len(kinds))]()
        head = talk(int(rng.integers(0, 9))) + one(" ", "\n", ". ") + lead
        path = one("src/app.py", "config/prod.env", "web", "docs/readme.md", "tests/data.txt", "src0", "")
        out.append((head + s + tail + one(" ", "\n") + talk(int(rng.integers(0, 9))), path, len(head), len(head) + len(s), label))
    return out


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that end between words."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + SPAN) if at + SPAN < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> dict[str, int]:
    """The most frequent lower-cased words of 3 to 24 letters in all documents, and how often they occur: more than twice.

    Null texts have none; rows that repeat count again; ties go by the word; no rows give an empty dictionary.
    """

    def told(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for piece in pieces(text.as_py()):
                    found.update(COUNTED.findall(piece.lower()))
                    if len(found) > HELD:
                        yield told(found)
                        found.clear()
        yield told(found)

    each = docs.select("text").filter("text is not null").mapInArrow(count, "word string, n long")
    top = each.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 2")
    top = top.repartition(MERGED).orderBy(F.desc("n"), "word").limit(most)  # each partition sends up to `most` rows to the driver
    return {r.word: r.n for r in top.collect()}


def filler(counts: dict[str, int], most: int = FILLER) -> list[str]:
    """Words of the dictionary for made findings, drawn by hash."""
    return sorted(counts, key=lambda w: (zlib.crc32(w.encode()), w))[:most]


def _described(text: str, path: str | None, start: int, end: int, words: Words) -> list[float]:
    """Features of a labelled span; its kind is that of the candidate at its place, if there is one."""
    here = next((c for c in candidates(text) if c.start < end and start < c.end), Candidate(len(PATTERNS) - 1, start, end))
    return features(text, here, path, words)


def train(words: Words, findings: list[tuple[str, str, int, int, int]]) -> Forest:
    """Fits on labelled findings that are few enough for the driver."""
    x, y = [_described(*f[:4], words) for f in findings], [f[4] for f in findings]
    return Forest.fit(np.array(x, float).reshape(-1, N_FEATURES), np.array(y, float))


def train_on(words: Words, findings: DataFrame, most: int = FINDINGS) -> Forest:
    """Fits on about `most` rows of labelled findings, drawn by hash; their features come to the driver, texts do not.

    Rows with a null text, start, end or label are left out; a null path is none; rows that repeat count again; columns but
    those of LABELLED are ignored. Without any row every candidate is half likely.
    """
    missing(findings, ("text", "path", "start", "end", "label"))
    rows = findings.select("text", "path", F.col("start").cast("long"), F.col("end").cast("long"), F.col("label").cast("int").alias("label")).dropna(subset=["text", "start", "end", "label"])
    rows = rows.withColumn("key", F.xxhash64("text", "start", "end"))
    rows = drawn(rows, "key", most)
    shared = findings.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_described(t, p, a, b, shared.value) for t, p, a, b in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)]
            yield pa.record_batch([batch.column(5), batch.column(4), pa.array(x, pa.list_(pa.float64()))], ["key", "label", "x"])

    got = rows.mapInArrow(run, "key long, label int, x array<double>").toPandas().sort_values(["key", "label"])
    return Forest.fit(np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES), got["label"].to_numpy(float))


def scan(docs: DataFrame, findings: DataFrame | None = None, cut: float = 0.5, path: str | None = "source", most: int = FINDINGS) -> DataFrame:
    """One row for each candidate: doc_id, start, end (code points), kind, score, secret (score >= cut).

    findings are labelled ones (see LABELLED), of which about `most` are used; None means made ones. Rows of docs that repeat
    give their candidates again; null and empty texts have none; a null id stays null. path names the column that holds
    a document's path, if docs has it; other columns are ignored.
    """
    missing(docs, ("doc_id", "text"))
    place = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("path"))
    counts = dictionary(rows)
    words = Words(counts)
    forest = train(words, made_findings(filler=filler(counts) or None)) if findings is None else train_on(words, findings, most)
    shared = docs.sparkSession.sparkContext.broadcast((words, forest))
    names = [n for n, _ in PATTERNS]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        for batch in batches:
            ids, spans, x = [], [], []
            for doc_id, text, where in zip(*batch.columns, strict=True):
                text = text.as_py()
                for c in candidates(text):
                    ids.append(doc_id.as_py())
                    spans.append(c)
                    x.append(features(text, c, where.as_py(), known))
            score = model(np.array(x, float).reshape(-1, N_FEATURES))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([c.start for c in spans], pa.int64()), pa.array([c.end for c in spans], pa.int64()), pa.array([names[c.kind] for c in spans], pa.string()), pa.array(score, pa.float64())], schema=schema)

    out = rows.filter(F.col("text").rlike(CUES)).mapInArrow(run, "doc_id long, start long, end long, kind string, score double")
    return out.withColumn("secret", F.col("score") >= cut)


def without_secrets(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with the spans of found (a scan of docs) that are secrets replaced by mark; ids must be unique and not null."""
    span, name = free_name(docs, "spans"), free_name(docs, "of")
    spans = found.filter("secret").groupBy(F.col("doc_id").alias(name)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(span))

    @F.arrow_udf("string")
    def masked(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py(), [(s["start"], s["end"]) for s in x.as_py()]) if x.is_valid else t.as_py() for t, x in zip(text, spans, strict=True)], pa.string())

    both = docs.join(spans, docs["doc_id"] == spans[name], "left")
    return both.withColumn("text", F.when(F.col(span).isNotNull(), masked("text", span)).otherwise(F.col("text"))).select(*docs.columns)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """text with each span, in order and without overlap, replaced by mark."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
