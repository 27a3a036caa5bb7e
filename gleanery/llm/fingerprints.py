"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space. The fraction is the same for all
documents, so sketches of very unequal documents can be compared and merged: the sketch of a union is the union of the
sketches. So that a short text is not left without a sketch, the smallest hash is kept as well; a merge then drops
all but the smallest of the hashes above the threshold.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import drawn, lower_ascii, missing, split_words

#: Everything that ends a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Kept share of the hash space: 1 of SCALE hashes.
SCALE = 8
#: Documents in one neighbour group at about, and groups at most.
GROUP_ROWS, GROUPS = 512, 65_536
#: Ids that the bounds of one group rest on.
SAMPLED = 20


def below(scale: int) -> int:
    """Hashes are signed longs; this is the first one that is not kept."""
    return -(1 << 63) + (1 << 64) // scale


def sketch(text: Column, scale: int = SCALE, shingle: int = 5) -> Column:
    """Sorted distinct hashes of a text's word shingles below the threshold, or its smallest hash if none is.

    Words are lower-cased (A-Z) and end at white space. A text with fewer than `shingle` words is one shingle; a text
    without words, or null, has an empty sketch.
    """
    words = split_words(lower_ascii(text), SPACE)
    top = F.lit(below(scale))

    def of(w: Column) -> Column:
        last = F.greatest(F.size(w) - shingle, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(shingle))))
        return F.transform(F.array(hashes), lambda h: _kept(h, top))[0]

    # transform over one element binds the words, so that they are not split once for each use
    found = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(of(w)))
    return found[0]


def _kept(hashes: Column, top: Column) -> Column:
    low = F.filter(hashes, lambda x: x < top)
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(hashes)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the two texts' shingles together."""
    both = F.array_sort(F.array_distinct(F.concat(a, b)))
    return F.transform(F.array(both), lambda x: F.when(F.size(x) == 0, x).otherwise(_kept(x, F.lit(below(scale)))))[0]


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sketches, 0 to 1; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; an empty a is contained in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def encode(hashes: Column) -> Column:
    """Sixteen hex digits for each hash, in order, with no separators."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _cell(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below an id, 0 for null: first by every side-th bound, then inside."""
    if not bounds:
        return F.lit(0)
    side = max(1, int(len(bounds) ** 0.5))
    # split of a literal folds to one constant array, however long
    array = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast("array<bigint>")
    upto = F.size(F.filter(array(bounds[::side]), lambda x: x <= doc_id))
    inside = F.size(F.filter(F.slice(array(bounds), (upto - 1) * side + 1, F.lit(side)), lambda x: x <= doc_id))
    return F.when(doc_id.isNull() | (upto == 0), F.lit(0)).otherwise((upto - 1) * side + inside)


def _share(h: Column, parts: Column) -> Column:
    """Which of `parts` equal ranges of the hash space h is in."""
    return F.least(F.floor((h / F.lit(2.0**64) + 0.5) * parts), parts - 1).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the following row by ascending doc_id, the first row's after the last.

    Null ids come first; rows of one id are ordered by text hash. Texts are shuffled once, into groups of consecutive
    ids; the first row of each group also goes to the group before it. Where groups end does not change the result:
    bounds are quantiles of ids drawn by hash, at most GROUPS longs on the driver. An id, or null, that has very many rows
    is dealt over groups by ranges of the text hash.
    """
    spark = docs.sparkSession
    counts = docs.agg(F.count("doc_id").alias("known"), F.count(F.lit(1)).alias("rows")).first()
    n = max(1, min(GROUPS, counts.known // GROUP_ROWS))
    null_parts = max(1, min(GROUPS, (counts.rows - counts.known) // GROUP_ROWS))
    bounds: list[int] = []
    spans: dict[int, int] = {}
    if n > 1:
        # quantiles of about SAMPLED ids for each group: a task's share of these is small, however many tasks there are
        picked = drawn(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).filter("doc_id is not null"), "k", SAMPLED * n)
        got = picked.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or []
        spans = {v: k for v, k in Counter(got).items() if k > 1}  # an id that is several quantiles has about so many groups of rows
        bounds = sorted({*got, *(v + 1 for v in spans if v < (1 << 63) - 1)})
    cell = _cell(F.col("doc_id"), bounds)
    parts = F.lit(1)
    if spans:
        each = [1, *(spans.get(v, 1) for v in bounds)]
        parts = F.get(F.split(F.lit(",".join(map(str, each))), ",").cast("array<int>"), cell.cast("int"))
    null = F.col("doc_id").isNull()
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.when(null, -1).otherwise(cell).cast("int").alias("cell"), F.when(null, null_parts).otherwise(parts).alias("parts"))
    base = base.select("doc_id", "text", "h", "cell", _share(F.col("h"), F.col("parts")).alias("sub"))
    order = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "h")
    firsts = base.groupBy("cell", "sub").agg(F.min(order).alias("m")).orderBy("cell", "sub").collect()  # at most about 3 * GROUPS rows
    starts = spark.createDataFrame([(r.cell, r.sub, r.m.doc_id, r.m.h, i, (i - 1) % len(firsts)) for i, r in enumerate(firsts)], "c int, s int, least bigint, least_h bigint, g int, before int")
    base = base.join(F.broadcast(starts), (F.col("cell") == F.col("c")) & (F.col("sub") == F.col("s")))
    is_first = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("h") == F.col("least_h"))
    copy = F.struct(F.col("before").alias("g"), F.lit(1).alias("copy"))
    own = F.struct("g", F.lit(0).alias("copy"))
    spread = base.select("doc_id", "text", "h", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("x"))
    w = Window.partitionBy("x.g").orderBy("x.copy", F.col("doc_id").asc_nulls_first(), "h")
    return spread.withColumn("next_text", F.lead("text").over(w)).filter("x.copy = 0").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of other."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, scale: int = SCALE, shingle: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. A table of one row is its own next document. Equal texts have equal fingerprints; a
    text without words has an empty one. Other columns of docs are ignored.
    """
    missing(docs, ("doc_id", "text"))
    both = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    both = both.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    made = both.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        sketch(F.col("text"), scale, shingle).alias("own"),
        sketch(F.col("edit"), scale, shingle).alias("edit"),
        sketch(F.col("next_text"), scale, shingle).alias("next"),
    )
    # one element to explode: a border that keeps the sketches from being computed again for each use
    made = made.select("doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct("own", "edit", "next"))).alias("s"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encode(F.col("s.own")).alias("fingerprint"),
        encode(F.col("s.edit")).alias("edited_fingerprint"),
        jaccard(F.col("s.own"), F.col("s.edit")).alias("near_edited"),
        jaccard(F.col("s.own"), F.col("s.next")).alias("near_next"),
    )
