"""Shared pieces: scratch tables in the cluster's shared folder, ASCII text normalisation, sizing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of one broadcast at most; what is larger goes through in blocks of this size.
BROADCAST_BYTES = 64 << 20


#: Folders of sessions that name none: a local session's own temporary one.
_OWN: dict[str, str] = {}
_OPEN: list[list[Scratch]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a session on one machine without it gets a temporary folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    app = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", app.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app.applicationId not in _OWN:
        _OWN[app.applicationId] = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    return _OWN[app.applicationId]


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs a reread and no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: set[str] = set()
        self.root = f"{shared_folder(spark).rstrip('/')}/gleanery-{uuid.uuid4().hex}"
        for some in _OPEN:
            some.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing lazy reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        """Deletes all tables and their folder."""
        self._delete(self.root)
        self.names.clear()


@contextmanager
def temporary() -> Iterator[None]:
    """All scratch tables that operators make inside go at the end: what is to stay must be written elsewhere by then."""
    made: list[Scratch] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for scratch in made:
            scratch.close()


def settled(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """df if a task that runs again is sure to see the same rows in the same order: a scan; all else is stored first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if re.search(r"Exchange|ExistingRDD|AdaptiveSparkPlan|ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython|Window|Sample|Coalesce\b|rand", plan):
        return scratch.table(df, name)
    return df


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else untouched; lower() alone serves texts without a multi-byte character."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of separators (a regular expression); null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, from file sizes: no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """At least the session's shuffle partitions, more if a part would hold over bytes_each of the input."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, min(1_000_000, input_bytes(df) // bytes_each + 1))


def missing(df: DataFrame, names: Iterable[str]) -> None:
    if gone := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(gone)}")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drawn(df: DataFrame, key: str, n: int, seed: int = 29) -> DataFrame:
    """All rows if they are n at most, else about n of them (each with the same chance) by hash of the key."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(n / total * (1 << 30)))
