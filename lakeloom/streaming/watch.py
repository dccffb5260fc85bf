"""Watch state over a stream of captures: each new document is held against the last one of its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lakeloom.operators.snapshot_diff import fingerprint

EVENT = "watch_key string, kind string, received_at timestamp_ntz"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Held(StatefulProcessor):
    """Keeps each key's last fingerprint; only keys that a batch has are touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "print string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(((m, p) for b in rows for m, p in zip(b["micros"], b["print"])), default=None)
        if newest is None:
            return
        was = self.last.get()[0] if self.last.exists() else None
        if was != newest[1]:
            self.last.update((newest[1],))
            yield pd.DataFrame({"watch_key": [key[0]], "kind": ["baseline" if was is None else "changed"], "micros": [newest[0]]})

    def close(self) -> None:
        pass


def changes_of(captures: DataFrame) -> DataFrame:
    """(watch_key, kind, received_at): a ``baseline`` for the first document of a key, ``changed`` for each different one; a stream of a stream.

    captures: received_at, watch_key, document. Keys are compared in lower case; of several captures of a key in a batch the latest counts
    (of equally late ones the larger fingerprint). Documents that cannot be read or have no nodes leave the state as it is, rows without
    a key or time too. The state lives in the state store of the query, one fingerprint for each key.
    """
    captures.sparkSession.conf.set(_PROVIDER, _ROCKS)
    rows = captures.where("watch_key is not null and received_at is not null").select(F.lower("watch_key").alias("watch_key"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("micros"), fingerprint("document").alias("print"))
    out = rows.where("print is not null").groupBy("watch_key").transformWithStateInPandas(_Held(), "watch_key string, kind string, micros long", "Append", "None")
    return out.select("watch_key", "kind", F.timestamp_micros("micros").cast("timestamp_ntz").alias("received_at"))


def watch(captures: DataFrame, folder: str) -> StreamingQuery:
    """Start a query over what has come in so far that appends ``changes_of`` to ``folder/events`` (Parquet); ``folder/checkpoint`` holds its state."""
    return changes_of(captures).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
