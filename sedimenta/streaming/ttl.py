"""A cache with a time to live over a stream of lookups, in event time: state by key, and timers that let entries go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cache(StatefulProcessor):
    """Per key when its entry was made. A lookup before made + ttl is a hit; any other makes a new entry, which a timer removes."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "made long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get()[0] if self.entry.exists() else None
        made = held
        frame = pd.concat(list(rows)).sort_values(["at", "id"])  # a key's rows of one micro-batch
        hits = []
        for at in frame["at"]:
            hit = made is not None and at < made + self.ttl
            hits.append(hit)
            if not hit:
                made = int(at)
        if made != held:
            self.entry.update((made,))
            self.handle.registerTimer((made + self.ttl) // 1000 + 1)
        yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def lookups(stream: DataFrame, ttl_seconds: int, *, late: str = "1 hour") -> DataFrame:
    """(key, id, hit) of each lookup (key, id, ts), a stream. Lookups of a key are taken by (ts, id) within a micro-batch; those later than
    `late` behind the newest one are dropped. What the state holds is one number for each key whose entry has not run out."""
    rows = stream.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    kind = stream.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(Cache(ttl_seconds * 1_000_000), f"key {kind}, id long, hit boolean", "append", "EventTime")


def run(stream: DataFrame, folder: str, checkpoint: str, ttl_seconds: int, **options) -> None:
    """Appends the outcome of all lookups that are there now to a folder; called again with the same checkpoint it goes on from its state."""
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = lookups(stream, ttl_seconds, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
        query.awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)
