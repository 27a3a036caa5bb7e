"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is a list of windows of `window` consecutive words (one shorter window if it has fewer). A window
counts as the set of its shingles, and a document contains the window only if it has all of them; at containment 1
one shingle is a sufficient prefix, so every window is joined on its rarest shingle alone. Rarity is counted over the
whole corpus. Length and positional bounds say where a window would have to start; the words there are then compared.

Documents are tokenised once and are not shuffled: the benchmark's distinct shingles are broadcast, and only
positions that carry one of them leave the scan, with `2 * window` words of context. A benchmark with more shingles
than BLOCK goes through in blocks of that many, so the broadcast has a fixed bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, free_name, lower_ascii, missing, split_words

#: Everything but digits, a-z and what lies beyond ASCII, on lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles in one broadcast: about 48 MB.
BLOCK = 1_500_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(n)))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(words, k, items): distinct windows with the ids, as strings, of the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    items = items.filter((F.size("w") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    wins = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, window).alias("words"))
    wins = wins.groupBy("words").agg(F.collect_set("item").alias("items"))
    k = F.size("words")
    return wins.withColumn("k", k).withColumn("s", F.least(k, F.lit(shingle)))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (doc_id, text_hash, n_words) and the occurrences (doc_id, text_hash, start, k, items).

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. Null and wordless texts have
    no words and no windows. Rows that repeat keep their own row; occurrences belong to (doc_id, text_hash).
    """
    missing(docs, ("doc_id", "text"))
    missing(benchmark, ("item_id", "text"))
    scratch = Scratch(docs.sparkSession)
    wins = scratch.table(item_windows(benchmark, window, shingle), "windows")
    lengths = sorted(r.s for r in wins.select("s").distinct().collect())  # at most `shingle` values

    offsets = F.sequence(F.lit(0), F.col("k") - F.col("s"))
    hashed = F.coalesce(*(F.when(F.col("s") == n, _hash(F.col("words"), F.col("o"), n)) for n in lengths)) if lengths else F.lit(None).cast("long")
    grams = wins.select("words", "k", "s", "items", F.explode(offsets).alias("o")).withColumn("h", hashed)
    keys = grams.select("h").distinct()
    n_keys = keys.count()

    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    at = base.select("doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word")).drop("word")
    fits = [F.when(F.col("pos") + n <= F.col("n_words"), _hash(F.col("w"), F.col("pos"), n)) for n in lengths or [shingle]]
    one = at.withColumns({"l": F.lit(0), "h": fits[0]})
    at = one if len(fits) == 1 else at.select("*", F.posexplode(F.array(*fits)).alias("l", "h"))
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    blocks = max(1, -(-n_keys // BLOCK))
    parts = []
    for b in range(blocks):
        block = keys.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).withColumnRenamed("h", "key")
        found = at.join(F.broadcast(block), F.col("h") == F.col("key"), "left")
        match = F.col("key").isNotNull()
        # the first position also stands for the document itself, once
        own = F.coalesce(F.col("pos") == 0, F.lit(True)) & (F.col("l") == 0) & F.lit(b == 0)
        ctx = F.when(match, F.slice("w", first + 1, 2 * window))
        parts.append(found.filter(match | own).select("doc_id", "text_hash", "n_words", "pos", F.col("key").alias("h"), first.alias("ctx_from"), ctx.alias("ctx"), own.alias("own")))
    seen = scratch.table(reduce(DataFrame.unionAll, parts), "seen")
    rows = seen.filter("own").select("doc_id", "text_hash", "n_words")

    df = seen.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(df, "h")  # a window with a shingle that no document has can't occur
    per_window = ranked.groupBy("words", "k", "s", "items").agg(F.count(F.lit(1)).alias("present"), F.min(F.struct("df", "h", "o")).alias("rarest"))
    prefix = per_window.filter(F.col("present") == F.col("k") - F.col("s") + 1).select("words", "k", "items", "rarest.h", "rarest.o")
    start = F.col("pos") - F.col("o")
    hits = (
        seen.filter("h is not null")
        .join(prefix, "h")
        .filter((start >= 0) & (start + F.col("k") <= F.col("n_words")))
        .filter(F.slice("ctx", F.greatest(start - F.col("ctx_from"), F.lit(0)) + 1, F.col("k")) == F.col("words"))
        .select("doc_id", "text_hash", start.alias("start"), "k", "items")
    )
    return rows, hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, text_hash.

    n_hit counts words inside any occurrence; items lists the ids (strings, sorted) of items with an occurrence;
    items_sha256 digests them joined by commas (the empty string's digest if there are none). An empty docs table
    gives no rows, an empty benchmark no hits.
    """
    rows, hits = find_windows(docs, benchmark, window, shingle)
    spans = F.sort_array(F.collect_set(F.struct("start", "k")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["start"] + x["k"]).alias("upto"),
            (a["n"] + F.greatest(x["start"] + x["k"] - F.greatest(a["upto"], x["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    per_doc = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_doc = per_doc.select("d", "t", "items", covered.cast("long").alias("n_hit"))
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        items.alias("items"),
        "text_hash",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """docs without the rows that hold an occurrence of a benchmark window."""
    d, t = free_name(docs, "d"), free_name(docs, "t")
    found = decontaminate(docs.select("doc_id", "text"), benchmark, window, shingle)
    hit = found.filter("contaminated").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[d]) & (F.xxhash64(docs["text"]) == hit[t]), "left_anti")
