"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicon words, their nearness to a second person, capitals, punctuation and obfuscation. The
lexicon has a fixed part and one learned from labelled documents: words and word beginnings whose share of toxic
documents is far above their share of the others. Trees see features that were made with a lexicon of other
documents (four folds), so that they learn how far to trust it.

About `sample` labelled documents are used at most, by hash of their id; the terms and the feature rows of these come to the
driver (at most TERMS terms and about `sample` rows), texts never do. Scoring is one pass over the documents with no shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, drawn, missing
from gleanery.llm.trees import Boosted

#: Common abuse in the four languages that the corpus has.
SEED_LEXICON = """
bastard clown creep disgusting dumb filth freak garbage idiot idiotic idiots imbecile loser losers moron morons
pathetic scum stupid trash ugly vermin worthless
abschaum arschloch dumm dummkopf idioten widerlich wertlos
abruti connard crétin débile dégoûtant minable ordure pathétique stupide
asqueroso basura despreciable escoria estúpido idiota imbécil inútil patético
"""
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti vosotros usted ustedes"
#: Digits and signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")

SEED = frozenset(SEED_LEXICON.split())
PERSON = frozenset(SECOND_PERSON.split())
WORD = re.compile(r"[^\W\d_]+")
#: Letters broken by a digit or sign, as in id1ot or st*pid, and letters set apart, as in m.o.r.o.n.
BROKEN = re.compile(r"[^\W\d_][\d@$!|*]+[^\W\d_]")
APART = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\S)")
TAIL = re.compile(r"\S*+")
GAP = re.compile(r"[\W\d_]")
#: Words that a worker remembers, characters of a text that are split at once.
MEMO, PIECE = 300_000, 1 << 18
BEGIN = (4, 5, 6, 7)
FOLDS, TERMS = 4, 40_000
SAMPLE = 20_000
N_FEATURES = 20


def terms(text: str) -> set[str]:
    """Distinct words, and beginnings of longer words, these marked by a final *."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGIN if len(w) > n}


class Lexicon:
    """Words and word beginnings with weights (log odds)."""

    def __init__(self, weights: dict[str, float]):
        self.words = {w: x for w, x in weights.items() if w[-1] != "*"}
        self.begins: dict[int, dict[str, float]] = defaultdict(dict)
        for w, x in weights.items():
            if w[-1] == "*":
                self.begins[len(w) - 1][w[:-1]] = x

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n, some in self.begins.items():
            x = some.get(word[:n])
            if x is not None and x > best:
                best = x
        return best


#: Toxic documents a term needs, and the log of the ratio of its rates, to be learned.
LEAST, ODDS = 3, 2.0


def learn(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: int = LEAST, odds: float = ODDS) -> dict[str, float]:
    """Weights of the terms that toxic documents have far more often: (term, in toxic, in clean) counts of documents."""
    out = {}
    for term, a, b in counts:
        if a < least:
            continue
        p, q = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
        # a lower bound of the log odds: two standard errors
        low = np.log(p / q) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) * 0.75
        if p / q >= np.exp(odds) and low > 0.3:
            out[term] = float(np.log(p / q))
    return out


def broken_words(text: str) -> Iterator[str]:
    """Runs without white space that have a broken word, and words whose letters are set apart."""
    upto = 0
    for m in BROKEN.finditer(text):
        if m.start() < upto:
            continue
        start = m.start()
        while start > upto and not text[start - 1].isspace():
            start -= 1
        upto = TAIL.match(text, m.end()).end()
        yield text[start:upto]
    yield from APART.findall(text)


class Words(dict):
    """Numbers of the words that a worker has met, and arrays of what the features need of each; see fresh()."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.weight, self.marks, self.length = np.zeros(1 << 12), np.zeros(1 << 12, np.uint8), np.zeros(1 << 12, np.int32)

    def __missing__(self, raw: str) -> int:
        i, low = len(self), raw.lower()
        if i == len(self.weight):
            self.weight, self.marks, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.weight, self.marks, self.length))
        seed = low in SEED
        self.weight[i] = max(self.lexicon.weight(low), 3.0 * seed)
        self.marks[i] = seed | (low in PERSON) << 1 | (len(raw) > 2 and raw.isupper()) << 2 | raw[0].isupper() << 3
        self.length[i] = len(raw)
        self[raw] = i
        return i

    def fresh(self) -> Words:
        """These, or none again if they are more than MEMO: what a worker holds stays bounded, but for one text's own words."""
        return self if len(self) <= MEMO else Words(self.lexicon)

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's words in order, taken in pieces that end between words."""
        at, out = 0, []
        while at < len(text):
            cut = GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = cut.start() if cut else len(text)
            found = WORD.findall(text[at:end])
            out.append(np.fromiter(map(self.__getitem__, found), np.int32, len(found)))
            at = end
        return np.concatenate(out)


def features(text: str | None, words: Words) -> list[float]:
    """N_FEATURES dense numbers; null, empty and wordless texts give mostly zeros."""
    out = [0.0] * N_FEATURES
    if not text:
        return out
    every = words.numbers(text)
    n = max(1, len(every))
    marks = words.marks[every]
    letters = int(words.length[every].sum())
    hits = np.flatnonzero(words.weight[every] > 0)
    person = np.flatnonzero(marks & 2)
    hidden, broken = 0, 0
    for m in broken_words(text):
        broken += 1
        plain = "".join(WORD.findall(m.lower().translate(LOOKALIKE)))
        bare = "".join(WORD.findall(m.lower()))
        hidden += any(x in SEED or words.lexicon.weight(x) > 0 for x in (plain, bare) if len(x) > 3)
    others = len(text) - letters - text.count(" ") - text.count("\n")
    out[0] = np.log1p(len(every))
    if len(hits):
        weights = words.weight[every[hits]]
        out[1] = len(hits) / n
        out[2] = int((marks & 1).sum()) / n
        out[3] = weights.sum() / n
        out[4] = weights.max()
        out[5] = float(len(np.unique(every[hits])))
        out[6] = float(np.log1p(len(hits)))
        within = np.searchsorted(hits, hits + 50) - np.arange(len(hits))
        out[7] = float(within.max()) / min(n, 50)
        out[8] = np.sort(weights)[-5:].sum()
        if len(person):
            at = np.searchsorted(person, hits)
            gap = np.minimum(np.abs(hits - person[np.minimum(at, len(person) - 1)]), np.abs(hits - person[np.maximum(at - 1, 0)]))
            out[9] = float((gap <= 5).mean())
    out[10] = len(person) / n
    out[11] = int((marks >> 2 & 1).sum()) / n
    out[12] = int((marks >> 3 & 1).sum()) / n
    out[13] = text.count("!") / n
    out[14] = others / max(1, len(text))
    out[15] = broken / n
    out[16] = float(np.log1p(hidden))
    out[17] = text.count("?") / n
    out[18] = letters / n
    out[19] = sum(map(text.count, "*#$%&@")) / n
    return out


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


class Model:
    def __init__(self, lexicon: Lexicon, trees: Boosted):
        self.lexicon, self.trees = lexicon, trees


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, fold: int = 1, most: int = TERMS) -> Model:
    """Fits on labelled documents whose crc32(doc_id) mod folds is not fold; see held_out.

    About `sample` labelled documents are drawn; the lexicon is learned from the `most` terms at most that most toxic ones
    have. labels needs doc_id and toxic (0 or 1). Rows with a null in either are left out; of several labels of one id the
    largest counts, of several texts that of the least hash. Without both classes, all documents get the smoothed rate of the labels.
    """
    missing(docs, ("doc_id", "text"))
    missing(labels, ("doc_id", "toxic"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    scratch = Scratch(docs.sparkSession)
    known = scratch.table(drawn(scratch.table(known, "all"), "id", sample), "known")  # about `sample` rows of 12 bytes
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))  # of several texts of one id always the same
    chosen = scratch.table(chosen.groupBy("id", "y").agg(one.alias("text")).select("id", "text", "y", part), "train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, y, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for t in terms(text):
                    found[t, k][1 - y] += 1
        yield pa.record_batch([pa.array([t for t, _ in found]), pa.array([k for _, k in found], pa.int32()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["term", "fold", "a", "b"])

    per = chosen.select("text", "y", "fold").mapInArrow(count, "term string, fold int, a long, b long")
    per = per.groupBy("term").agg(*(F.sum(F.when(F.col("fold") == k, F.col(c))).alias(f"{c}{k}") for k in range(FOLDS) for c in "ab"))
    sizes = {(r.fold, r.y): r.n for r in chosen.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def rates(without: int | None) -> tuple[list[int], int, int]:
        use = [k for k in range(FOLDS) if k != without]
        return use, *(sum(sizes.get((k, y), 0) for k in use) for y in (1, 0))

    def may_count(without: int | None) -> Column:
        use, toxic, clean = rates(without)
        a, b = (sum((F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for k in use), F.lit(0)) for c in "ab")
        return (a >= LEAST) & ((a + 0.5) / (toxic + 1) >= (b + 0.5) / (clean + 1) * float(np.exp(ODDS) * (1 - 1e-9)))

    total = sum((F.coalesce(F.col(f"a{k}"), F.lit(0)) for k in range(FOLDS)), F.lit(0))
    any_of = reduce(or_, map(may_count, [None, *range(FOLDS)]))  # what no lexicon below would learn stays out
    table = per.filter(any_of).withColumn("a", total).orderBy(F.desc("a"), "term").limit(most).na.fill(0).collect()

    def lexicon(without: int | None) -> Lexicon:
        use, toxic, clean = rates(without)
        return Lexicon(learn([(r.term, sum(r[f"a{k}"] for k in use), sum(r[f"b{k}"] for k in use)) for r in table], toxic, clean))

    by_fold, whole = [lexicon(k) for k in range(FOLDS)], lexicon(None)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(x) for x in by_fold]
        for batch in batches:
            ids, ys, ks = (batch.column(i).to_pylist() for i in (0, 2, 3))
            x = []
            for text, k in zip(batch.column(1), ks, strict=True):
                words[k] = words[k].fresh()
                x.append(features(text.as_py(), words[k]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = chosen.select("id", "text", "y", "fold").mapInArrow(describe, "id long, y int, x array<double>").toPandas().sort_values("id")
    scratch.keep()
    x = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES)
    return Model(whole, Boosted.fit(x, rows["y"].to_numpy()))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of scores, 0 to 1; null and empty texts are scored as any other. No shuffle.

    A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = shared.value
        words, x = held.get("words") or Words(m.lexicon), np.zeros((len(texts), N_FEATURES))
        for i, text in enumerate(texts):
            words = words.fresh()
            x[i] = features(text.as_py(), words)
        held["words"] = words
        return pa.array(m.trees(x), pa.float64())

    return docs.withColumn(column, scored(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= cut).

    Documents whose crc32(doc_id) mod 3 is 1 are held out: nothing is learned from their labels. Nulls in text count
    as empty; a null id is not held out; rows that repeat get equal scores; other columns are ignored.
    """
    model = train(docs, labels, sample)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that score cut or more; a column called score, if docs has one, is kept as it is."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels, sample), name).filter(F.col(name) < cut).drop(name)
