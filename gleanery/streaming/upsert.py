"""Streams: last write by key, windowed counts with late data, and duplicates within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(events: DataFrame) -> DataFrame:
    """(key, seq, value) after each batch for keys it touched: a write with a smaller seq than one seen is ignored.

    events has key, seq and value (string); use update mode.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, value = state.get if state.exists else (-(1 << 62), None)
        for rows in batches:
            best = rows.sort_values("seq").iloc[-1]
            if best["seq"] >= seq:
                seq, value = int(best["seq"]), best["value"]
        state.update((seq, value))
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "value": [value]})

    out = "key string, seq long, value string"
    return events.select("key", "seq", "value").groupBy("key").applyInPandasWithState(fold, out, "seq long, value string", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows of ts; rows later than the watermark are dropped."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct_within(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
