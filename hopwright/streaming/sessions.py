"""Sessions of a stream: windows by gap, closed when the watermark has passed them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

GAP = "30 minutes"
#: How late a record may be: the margin for clocks that differ.
MARGIN = "5 seconds"


def stream_sessions(events: DataFrame, keys: list[str], at: str = "ts", gap: str = GAP, margin: str = MARGIN) -> DataFrame:
    """One row per key and session with its start, last event and number of events, once it can no longer grow.

    A session ends after a pause longer than the gap, as in the batch operator, whose runs these equal; state holds the open
    sessions of each key alone.
    """
    # A window takes in what comes just at its end, so a pause of the gap itself doesn't close it. The watermark, in whole milliseconds,
    # gives out a session when it reaches that end: a millisecond more leaves it open for a record that is late by the whole margin.
    session = F.session_window(F.col(at), gap)
    grouped = events.withWatermark(at, f"{margin} 1 millisecond").groupBy(*keys, session.alias("session"))
    return grouped.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("session")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, as Parquet; a rerun goes on from the checkpoint. The last open sessions wait for later records, or for
    ``close_source``. Records that come later than the margin are dropped, where the batch operator drops none: ``dropped_rows`` tells
    how many, and a margin above the clocks' difference leaves none."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def close_source(events: DataFrame, folder: str, at: str = "ts") -> None:
    """Ends a source of Parquet files: a record with no keys and a time beyond all others moves the watermark past every open session, so
    the next run gives them out. The record's own session never closes, so it never comes out. ``events``: any frame of the source's
    schema."""
    spark = events.sparkSession
    row = [None if f.name != at else datetime(9999, 1, 1) for f in events.schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in events.schema.fields])
    spark.createDataFrame([tuple(row)], schema).write.mode("append").parquet(folder)


def dropped_rows(query: StreamingQuery) -> int:
    """Records that came too late, over the query's recent progress."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in dict(p).get("stateOperators", []))


def run_complete_groups(stream: DataFrame, keys: list[str], path: str, checkpoint: str, at: str = "ts") -> StreamingQuery:
    """One row per group whose records all come in one batch, as those of a session id within its shard do: no state is kept. A batch
    that is repeated after a failure replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(*keys).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
