"""Objects over DataFrames for callers that hold an index or a table: each change gives a new DataFrame inside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.hashing import hash_key, hash_string
from gleanery.operators import geo, keyed, neardup
from gleanery.sources import files


class NearDuplicates:
    """An index of texts (doc_id, text) by bands of their MinHash signatures."""

    def __init__(self, docs: DataFrame, config: neardup.Config = neardup.Config()):
        self.config = config
        self.docs = neardup.check_ids(docs.select("doc_id", "text"))

    def add(self, docs: DataFrame) -> None:
        self.docs = neardup.check_ids(self.docs.unionByName(docs.select("doc_id", "text")))

    def _buckets(self, texts: DataFrame, name: str) -> DataFrame:
        return neardup.buckets(neardup.minhash(neardup.shingled(texts, self.config.shingle, name), self.config, name), name)

    def candidates(self, queries: DataFrame, query: str = "item_id") -> DataFrame:
        return neardup.candidates(self._buckets(queries, query), self._buckets(self.docs, "doc_id"), query)

    def find(self, queries: DataFrame, threshold: float | None = None, query: str = "item_id") -> DataFrame:
        return neardup.find_duplicates(queries, self.docs, self.config, threshold, query)

    def full_scan(self, queries: DataFrame, threshold: float | None = None, query: str = "item_id") -> DataFrame:
        return neardup.full_scan(queries, self.docs, self.config, threshold, query)

    def stats(self) -> DataFrame:
        return neardup.stats(self._buckets(self.docs, "doc_id"), self.config)


class Table:
    """Unique keys with values, stored as Parquet beside its capacity; requests report their status."""

    VERSION = 1

    def __init__(self, rows: DataFrame, capacity: int = 64):
        if not 0 < capacity <= keyed.MAX_CAPACITY:
            raise ValueError(f"capacity is between 1 and {keyed.MAX_CAPACITY}")
        self.rows, self.capacity = rows.select("key", "value"), capacity

    @classmethod
    def create(cls, spark: SparkSession, schema: str = "key long, value long", capacity: int = 64) -> Table:
        return cls(spark.createDataFrame([], schema), capacity)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Table:
        """What sync() wrote; anything else is bad input."""
        try:
            meta = spark.read.json(f"{path}/meta").first()
            if meta is None or meta.version != cls.VERSION:
                raise files.BadInput(f"{path} is of another version")
            return cls(spark.read.parquet(f"{path}/rows"), meta.capacity)
        except files.BadInput:
            raise
        except Exception as e:
            raise files.BadInput(f"{path} holds no table") from e

    def sync(self, path: str) -> None:
        """path must not be where this table was opened: a table is not written over while it is read."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.rows.sparkSession.createDataFrame([(self.VERSION, self.capacity)], "version int, capacity int").write.mode("overwrite").json(f"{path}/meta")

    def insert(self, new: DataFrame) -> DataFrame:
        self.rows, report = keyed.insert(self.rows, new)
        return report

    def update(self, new: DataFrame) -> DataFrame:
        self.rows, report = keyed.update(self.rows, new)
        return report

    def delete(self, keys: DataFrame) -> DataFrame:
        self.rows, report = keyed.delete(self.rows, keys)
        return report

    def get(self, keys: DataFrame) -> DataFrame:
        return keyed.get(self.rows, keys)

    def clear(self) -> None:
        self.rows = self.rows.limit(0)

    def __len__(self) -> int:
        return self.rows.count()

    def stats(self) -> DataFrame:
        """As of an insert-only load of the present keys; see keyed.directory_stats."""
        hashed = hash_string("key") if dict(self.rows.dtypes)["key"] == "string" else hash_key("key")
        return keyed.directory_stats(self.rows.select(hashed.alias("h")).distinct(), self.capacity)


class Map:
    """String keys and values with put and merge in the order of a sequence number."""

    def __init__(self, spark: SparkSession, buckets: int = keyed.FIRST_BUCKETS):
        self.buckets = buckets if buckets >= 1 else keyed.FIRST_BUCKETS
        self._none = spark.createDataFrame([], "seq long, key string, value string")
        self.log = self._none

    def put(self, rows: DataFrame) -> None:
        """(seq, key, value): later numbers win."""
        self.log = self._values().unionByName(rows.select("seq", "key", "value"))

    def merge(self, rows: DataFrame, merger: Callable[[Column, Column], Column]) -> DataFrame:
        """Folds rows into what is there; gives the merged pairs."""
        all_ = self._values().unionByName(rows.select("seq", "key", "value"))
        merged = keyed.merge(all_, merger)
        last = all_.groupBy("key").agg(F.max("seq").alias("seq"))
        self.log = merged.join(last, "key").select("seq", "key", "value")
        return merged.join(rows.select("key").distinct(), "key", "left_semi")

    def _values(self) -> DataFrame:
        return self.log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value")).select("seq", "key", "value")

    def get(self, keys: DataFrame) -> DataFrame:
        return keyed.get(self._values(), keys)

    def clear(self) -> None:
        self.log = self._none

    def size(self) -> int:
        return self._values().count()

    def __iter__(self) -> Iterator[tuple[str, str]]:
        """Pairs of the map as it is now, one partition at a time."""
        return ((r.key, r.value) for r in self._values().select("key", "value").toLocalIterator())


class PerfectTable:
    """Fixed pairs of a string and a number, looked up by one equi-join."""

    def __init__(self, pairs: DataFrame):
        self.slots = keyed.perfect_slots(pairs)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> PerfectTable:
        return cls(files.read_pairs(spark, path))

    def get(self, keys: DataFrame) -> DataFrame:
        return keyed.get(self.slots, keys)


class Points:
    """Planar points that can grow."""

    def __init__(self, points: DataFrame):
        self.points = points.select("x", "y")

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> Points:
        points = files.read_points(spark, path)
        if points.isEmpty():
            raise geo.EmptyInput("no points")
        return cls(points)

    def insert(self, new: DataFrame) -> None:
        self.points = geo.insert(self.points, new)

    def nearest(self, queries: DataFrame) -> DataFrame:
        return geo.nearest(self.points, queries)
