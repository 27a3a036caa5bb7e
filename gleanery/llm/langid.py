"""Language ID by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its character n-grams, the longest
length of which any is known: five characters, then four, down to one. Word ends count as characters.

The model is fitted on about PER_LANG labelled documents of each language, chosen by hash of their id, and holds the WORDS
most frequent words and the GRAMS most frequent n-grams of each length of each language. These come to the driver, texts
don't. Scoring is one pass, no shuffle: a text's words become row numbers of one matrix, and the rows are added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import Scratch, free_name, missing
from gleanery.llm.toxicity import held_out

WORD = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")
LENGTHS = (5, 4, 3, 2, 1)
#: Parameters of the model: labelled documents of each language, words and n-grams (of each length) of each language.
PER_LANG, WORDS, GRAMS = 3_000, 40_000, 10_000
#: Bytes of unseen words that a worker remembers, characters of the longest such word, characters of a text taken at once.
MEMO_BYTES, LONG, PIECE = 32 << 20, 40, 1 << 18
UNKNOWN = "und"


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-cased runs of letters, in lists for pieces of a text that end between words."""
    at, n = 0, len(text or "")
    while at < n:
        cut = GAP.search(text, at + PIECE) if at + PIECE < n else None
        end = cut.start() if cut else n
        yield WORD.findall(text[at:end].lower())
        at = end


def grams_of(word: str, n: int) -> Iterator[str]:
    padded = f" {word} " if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


class Model:
    """Rows of centred log frequencies, one column for each language; words first, then n-grams by length."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[int, dict[str, np.ndarray]]):
        self.langs = langs
        self.words = {w: i for i, w in enumerate(words)}
        self.rows = self._log(words)
        # all n-grams are rows of one matrix
        self.grams: dict[int, dict[str, int]] = {}
        parts, at = [np.zeros((0, len(langs)), np.float32)], 0
        for n, some in grams.items():
            self.grams[n] = {g: at + i for i, g in enumerate(some)}
            parts.append(self._log(some))
            at += len(some)
        self.gram_rows = np.concatenate(parts)

    def _log(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        if not counts:
            return np.zeros((0, len(self.langs)), np.float32)
        c = np.array(list(counts.values()), float) + 0.5
        logs = np.log(c / c.sum(0))
        return (logs - logs.mean(1, keepdims=True)).astype(np.float32)

    def backoff(self, word: str) -> list[int]:
        """Rows of the word's known n-grams of the longest length that has any."""
        for n in LENGTHS:
            known = self.grams.get(n, {})
            padded = f" {word} " if n > 1 else word
            if at := [i for j in range(len(padded) - n + 1) if (i := known.get(padded[j : j + n])) is not None]:
                return at
        return []

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row for each word that is not known: the mean of its n-grams, times their number up to three."""
        out = np.zeros((len(words), len(self.langs)))
        found = [self.backoff(w) for w in words]
        some = [i for i, f in enumerate(found) if f]
        if some:
            counts = np.array([len(found[i]) for i in some])
            flat = np.fromiter((x for i in some for x in found[i]), np.intp, int(counts.sum()))
            sums = np.add.reduceat(self.gram_rows.take(flat, 0), np.r_[0, np.cumsum(counts)[:-1]], dtype=float)
            out[some] = sums * (np.minimum(counts, 3) / counts)[:, None]
        return out


class Scorer(dict):
    """One worker's view of a model: a row number for each word, and rows of unseen words within a bound of bytes."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.fixed = model, len(model.rows)
        # a row of zeros stands for words that are added up apart
        self.rows = np.vstack([model.rows, np.zeros((max(1, MEMO_BYTES // (200 + 4 * len(model.langs))), len(model.langs)), np.float32)])
        self.apart: list[str] = []
        self.memo: list[str] = []
        self.done = 0  # words of memo whose rows are known

    def __missing__(self, word: str) -> int:
        at = self.fixed + 1 + len(self.memo)
        if len(word) > LONG or at >= len(self.rows):
            self.apart.append(word)
            return self.fixed
        self.memo.append(word)
        self[word] = at
        return at

    def _resolved(self, words: list[str]) -> np.ndarray:
        """The sum of the rows of words; those met for the first time get theirs now."""
        at = np.fromiter(map(self.__getitem__, words), np.intp, len(words))
        if len(self.memo) > self.done:
            first = self.fixed + 1 + self.done
            self.rows[first : self.fixed + 1 + len(self.memo)] = self.model.unseen(self.memo[self.done :])
            self.done = len(self.memo)
        total = self.rows.take(at, 0).sum(0, dtype=float)
        if self.apart:
            total += self.model.unseen(self.apart).sum(0)
            self.apart.clear()
        return total

    def __call__(self, text: str | None) -> tuple[str, float]:
        total, n, letters, m = np.zeros(len(self.model.langs)), 0, False, self.model
        if self.fixed + 1 + len(self.memo) >= len(self.rows):
            for w in self.memo:
                del self[w]
            self.memo.clear()
            self.done = 0
        for words in words_of(text):
            if words:
                total += self._resolved(words)
                n += len(words)
                letters = letters or any(c.isalpha() for w in words for c in w)
        if not letters or not m.langs:
            return UNKNOWN, 0.0
        z = total / np.sqrt(n)
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return m.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, folds: int = 4, fold: int = 2, per_lang: int = PER_LANG, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learns from text and lang of documents with a lang, but for those whose crc32(doc_id) mod folds is fold.

    Rows that repeat are learned from again, null ids are never held out, rows without a text or lang are left out. Without
    any row the model has no language. Words and n-grams that occur once in all are left out.
    """
    missing(docs, ("doc_id", "text", "lang"))
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], {}, {})
    rates = spark.createDataFrame([(x, min(1.0, per_lang / counts[x])) for x in langs], "name string, rate double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    chosen = known.select("doc_id", "text", "lang").join(F.broadcast(rates), F.col("lang") == F.col("name")).filter(drawn).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for some in words_of(text.as_py()):
                    found.setdefault(lang, Counter()).update(some)
        for lang, seen in found.items():
            for n in (0, *LENGTHS):
                terms: Counter = Counter()
                for w, k in seen.items():
                    for g in grams_of(w, n) if n else (w,):
                        terms[g] += k
                yield pa.record_batch([pa.array([n] * len(terms), pa.int32()), pa.array(list(terms)), pa.array([lang] * len(terms)), pa.array(list(terms.values()), pa.int64())], ["kind", "term", "lang", "n"])

    scratch = Scratch(spark)
    sums = chosen.mapInArrow(count, "kind int, term string, lang string, n long").groupBy("kind", "term", "lang").agg(F.sum("n").alias("n"))
    sums = scratch.table(sums, "terms")
    rank = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "term"))
    most = F.when(F.col("kind") == 0, words).otherwise(grams)
    top = sums.withColumn("r", rank).filter(F.col("r") <= max(words, grams)).filter(F.col("r") <= most).select("kind", "term").distinct()
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)]
    table = sums.join(top, ["kind", "term"], "left_semi").groupBy("kind", "term").agg(F.sum("n").alias("all"), *each).filter("all > 1").drop("all")

    def best(kind: int) -> dict[str, np.ndarray]:
        of = rows[rows["kind"] == kind].sort_values("term")
        return dict(zip(of["term"], of[[f"l{i}" for i in range(len(langs))]].to_numpy(), strict=True))

    rows = table.toPandas()  # at most len(langs) * (words + 5 * grams) rows
    scratch.keep()
    return Model(langs, best(0), {n: best(n) for n in LENGTHS})


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, replacing columns of these names, all others kept; see identify."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    @F.arrow_udf("lang_pred string, score double")
    def told(texts: pa.Array) -> pa.Array:
        if "scorer" not in held:
            held["scorer"] = Scorer(shared.value)
        out = [held["scorer"](t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["lang_pred", "score"])

    name = free_name(docs, "told")
    out = docs.withColumn(name, told(F.col("text")))
    return out.withColumns({"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Documents whose crc32(doc_id) mod 4 is 2 are held out: nothing is learned from them. lang_pred is a lang value
    that was learned; texts that are null or have no letter, and all texts if nothing could be learned, are `und` with
    score 0. score is the share of the best language, at a temperature of the root of the number of words. A null
    id is not held out; rows that repeat get equal results; other columns are ignored.
    """
    out = detect(docs.select("doc_id", "text"), train(docs, per_lang=per_lang))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
