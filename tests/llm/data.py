"""Small awkward tables, stored, so that rows keep their order when a task runs again."""

from __future__ import annotations

import random
import uuid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan spruce teak umbrella viburnum willow yew zelkova".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "er", "s"]) for _ in range(n))


def texts() -> list[str | None]:
    """Nulls, empty and odd white space, near and exact copies, shared lines and passages, one long text."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(0, 120, 8):
        far[i] = "other"
    line = "a line of boilerplate that many documents share"
    out: list[str | None] = [None, "", "  \n\t ", "one", "One", base, base.upper(), "  " + base.replace(" ", "\n"), " ".join(near), " ".join(far)]
    out += [prose(i, 40) for i in range(20, 34)]
    out += [f"{prose(i, 15)}\n  {line.upper() if i % 2 else line}\t\n{prose(i + 50, 9)}\n{line}" for i in range(40, 46)]
    out += [prose(60, 30) + " " + prose(2, 25) + " " + prose(61, 30), prose(3, 6), "x " + prose(3, 6) + " y"]
    out += [prose(70, 6000), "ünïcödé straße Ünïcödé ÉCOLE ", "a b c d", "a b c d e", "A B C D E F"]
    return out


def table(spark, rows, schema: str = SCHEMA, parts: int = 3):
    """A stored table of the rows."""
    from gleanery.llm.common import shared_folder

    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).coalesce(parts).write.parquet(path)
    return spark.read.parquet(path)


def rows():
    """Ids out of order, a null id, a row that occurs twice."""
    made = [((i * 37) % 101, t, ["en", "fr", None][i % 3], ["a", "b", None, "c"][i % 4], None) for i, t in enumerate(texts())]
    return [*made, (None, prose(5, 30), "en", None, 3), made[5], made[5]]


def documents(spark):
    return table(spark, rows())


def empty(spark):
    return table(spark, [])


def clashing(spark):
    """The same with columns named like what operators add."""
    from pyspark.sql import functions as F

    extra = ["h", "t", "w", "pos", "n", "chunk", "rest", "size", "score", "text_hash", "start", "k", "items", "root", "key", "cell", "x", "_told", "lang_pred", "_toxicity", "n_lines", "component_id", "contaminated", "target", "name", "_d", "_t", "own", "to", "sender", "taken", "repeat", "bucket", "l"]
    return documents(spark).select("*", *(F.lit(f"own {c}").alias(c) for c in extra))
