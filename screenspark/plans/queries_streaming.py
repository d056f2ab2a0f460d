"""Queries: streams over the events, and their batch equivalents as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.plans.registry import register
from screenspark.plans.staging import new_path, stage
from screenspark.plans.tables import table
from screenspark.streaming import ledger as s


def _stream(spark, sf_dir):
    """The events as a stream of a folder of files."""
    t = F.col("event_type")
    status = F.when(t == "signup", "planned").when(t == "view", "in_progress").when(t == "click", "completed").when(t == "error", "blocked").otherwise("positive")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("candidate"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("source_priority"), (t == "error").alias("has_warning"))
    files = stage(e, "events")
    return spark.readStream.schema(files.schema).parquet(files.staged_path)


@register("sm1_stream_ledger", "SELECT candidate, status, n_records FROM (SELECT user_id AS candidate, CASE event_type WHEN 'signup' THEN 'planned' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'blocked' ELSE 'positive' END AS status, count(*) OVER (PARTITION BY user_id) AS n_records, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3, event_id DESC) AS r FROM events) WHERE r = 1")
def sm1_stream_ledger(spark, sf_dir):
    slices = s.run_updates(s.stream_ledger(_stream(spark, sf_dir)), new_path(spark, "out"), new_path(spark, "stream"), ["slice_start", "candidate"])
    return s.latest_of_slices(slices).select("candidate", "status", "n_records")


@register("sm2_stream_qc", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n_rows, count_if(event_type = 'error') AS n_warning FROM events GROUP BY 1")
def sm2_stream_qc(spark, sf_dir):
    d = _stream(spark, sf_dir).withColumn("status", F.lit("ok"))
    out = s.run_updates(s.stream_qc(d, "1 day"), new_path(spark, "out"), new_path(spark, "stream"), ["window_start"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_rows", "n_warning")


@register("sm2_stream_qc_sliding", "SELECT CAST(w AS TIMESTAMP) AS window_start, count(*) AS n_rows FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1")
def sm2_stream_qc_sliding(spark, sf_dir):
    d = _stream(spark, sf_dir).withColumn("status", F.lit("ok"))
    out = s.run_updates(s.stream_qc(d, "2 days", "1 day"), new_path(spark, "out"), new_path(spark, "stream"), ["window_start"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_rows")


@register("sm3_stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id AS candidate, CAST(min(ts) AS TIMESTAMP) AS session_start, count(*) AS n_events FROM n GROUP BY user_id, s")
def sm3_stream_sessions(spark, sf_dir):
    out = s.run_sessions(_stream(spark, sf_dir), "6 hours", new_path(spark, "out"), new_path(spark, "stream"))
    return out.select("candidate", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n_events")


@register("sm4_late_events", "SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n_rows, count_if(event_type = 'view') AS n_failed, count_if(event_type = 'error') AS n_warning FROM events GROUP BY 1) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def sm4_late_events(spark, sf_dir):
    """Daily windows in append mode: those that the watermark has passed."""
    d = _stream(spark, sf_dir).withColumn("status", F.when(F.col("status") == "in_progress", "failed").otherwise("ok"))
    out = s.run_to_parquet(s.stream_qc(d, "1 day", delay="1 hour"), new_path(spark, "out"), new_path(spark, "stream"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
