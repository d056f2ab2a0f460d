"""Ledger and quality streams. Event time must be TIMESTAMP; NTZ columns are cast under the session's time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_ledger(events: DataFrame, key: str = "candidate", ts: str = "ts", event_id: str = "event_id", delay: str = "1 day", slice_of: str = "1 day") -> DataFrame:
    """Latest state of each key in every slice of time, from a change feed, repeated events dropped; for update mode.

    The latest is that of the greatest event time, source priority (smaller wins)
    and event id, however events arrive.  The state holds the slices that the watermark
    has not passed, not all keys for ever; ``latest_of_slices`` makes the latest state
    of each key from what the stream has written.
    """
    d = event_time(events, ts, delay).dropDuplicatesWithinWatermark([event_id])
    order = F.struct(F.col(ts).alias("ts"), (-F.col("source_priority")).alias("priority"), F.col(event_id).alias("id"))
    g = d.groupBy(F.window(ts, slice_of), key).agg(F.max_by("status", order).alias("status"), F.max(order).alias("at"), F.count("*").alias("n_records"))
    return g.select(F.col("window.start").alias("slice_start"), key, "status", "at", "n_records")


def latest_of_slices(slices: DataFrame, key: str = "candidate") -> DataFrame:
    """``key, status, last_ts, n_records`` over all slices."""
    return slices.groupBy(key).agg(F.max_by("status", "at").alias("status"), F.max("at.ts").alias("last_ts"), F.sum("n_records").alias("n_records"))


def stream_qc(items: DataFrame, size: str, slide: str | None = None, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Failed and warning rows in tumbling or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = event_time(items, ts, delay).groupBy(w).agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.count_if("has_warning").alias("n_warning"))
    return g.select(F.col("window.start").alias("window_start"), "n_rows", "n_failed", "n_warning")


def stream_sessions(events: DataFrame, gap: str, key: str = "candidate", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Sessions of activity of each key, split by a gap."""
    g = event_time(events, ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n_events"))
    return g.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run a stream in update mode over all that is there now; each batch's changed rows go to Parquet files, and the last row of each key is returned.

    Nothing is held by the driver.  The table's ``late_rows`` says how many rows came
    after their watermark, ``state_rows`` how many rows the state held after each batch.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/b{batch}")

    query = finished(stream.writeStream.foreachBatch(put).outputMode("update"), checkpoint)
    rows = stream.sparkSession.read.schema(stream.withColumn("_batch", F.lit(0)).schema).option("recursiveFileLookup", True).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select(*keys, "_s.*").select(*stream.columns)
    return noted(out, query)


def finished(writer, checkpoint: str):
    """The query of a writer, run over all that is there now."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return query


def noted(out: DataFrame, query) -> DataFrame:
    out.late_rows = late_rows(query)
    out.state_rows = [max((int(s["numRowsTotal"]) for s in p["stateOperators"]), default=0) for p in query.recentProgress]
    return out


def late_rows(query) -> int:
    """Rows that a query dropped because its watermark had passed them."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, in append mode, to Parquet files, and return them.

    The table's ``late_rows`` says how many (pre-aggregated) rows came after their watermark.
    """
    query = finished(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)
    return noted(stream.sparkSession.read.schema(stream.schema).parquet(path), query)


def run_sessions(events: DataFrame, gap: str, path: str, checkpoint: str, key: str = "candidate", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """All sessions, with ``closed``: those that the watermark has passed, written once each, and those that are still in the state.

    A session is written when it closes and never again, so a batch costs its own
    sessions and not all there ever were; the open ones are read from the state of the
    last batch.
    """
    sessions = stream_sessions(events, gap, key, ts, delay)
    closed = run_to_parquet(sessions, path, checkpoint)
    state = events.sparkSession.read.format("statestore").load(checkpoint)
    left = state.select(F.col(f"value.{key}").alias(key), F.col("value.session_window.start").alias("session_start"), F.col("value.session_window.end").alias("session_end"), F.col("value.count").alias("n_events"))
    out = closed.withColumn("closed", F.lit(True)).unionByName(left.withColumn("closed", F.lit(False)))
    out.late_rows, out.state_rows = closed.late_rows, closed.state_rows
    return out
