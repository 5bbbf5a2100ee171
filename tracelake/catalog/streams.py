"""Streaming jobs, run over everything available and checked on their final tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracelake.catalog.limits import _TURNS
import tracelake.catalog.analytics  # noqa: F401  its SQL also checks the streams
from tracelake.catalog.sql import on_traces, with_tables
from tracelake.functions.pricing import estimate_cost
from tracelake.operators import analytics
from tracelake.registry import ORACLES, query
from tracelake.schema import conform, normalize
from tracelake.session import new_folder, pin_utc
from tracelake.sources import derived, export
from tracelake.streaming import jobs, ordered


# What one micro-batch of an ordered stream reads.
BATCH = 16 << 30


def stream_of(spark, sf, name, batch=None):
    """A table as a stream: the folder of its part files, or the one file of its name; ``batch`` bounds the bytes of a micro-batch."""
    schema = derived.table(spark, sf, name).schema
    reader = pin_utc(spark).readStream.schema(schema)
    if batch:
        reader = reader.option("maxBytesPerTrigger", batch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf}/{name}.parquet")
    # Streams start from folders; the option matches names of files only.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _build(events):
    t = normalize(conform(derived.raw_traces_from(events)))
    return t.withColumn("estimated_cost_usd", estimate_cost(F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens")))


@query(
    "t1_ingest_stream",
    on_traces(
        """SELECT 'trace' AS kind, id, org_id, workspace_id, total_tokens, round(estimated_cost_usd, 8) AS cost FROM traces
        UNION ALL SELECT DISTINCT 'tenant', '', org_id, workspace_id, 0, 0 FROM traces"""
    ),
)
def ingest_stream(spark, sf):
    traces_path, tenants_path, _ = jobs.ingest_stream(stream_of(spark, sf, "events"), _build, new_folder(spark, "ingest"))
    rows = spark.read.parquet(traces_path).select(F.lit("trace").alias("kind"), "id", "org_id", "workspace_id", "total_tokens", F.round("estimated_cost_usd", 8).alias("cost"))
    tenants = spark.read.parquet(tenants_path).select(
        F.lit("tenant").alias("kind"), F.lit("").alias("id"), "org_id", "workspace_id", F.lit(0).alias("total_tokens"), F.lit(0.0).alias("cost")
    )
    return rows.unionByName(tenants)


@query(
    "t2_enrich_stream",
    """SELECT conv_id || '_' || turn AS id, CASE WHEN role = 'user' THEN trim(text) END AS prompt, CASE WHEN role = 'assistant' THEN text END AS content FROM conversations""",
)
def enrich_stream(spark, sf):
    text = F.col("text")
    ask = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages")))
    got = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    rows = stream_of(spark, sf, "conversations").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("role") == "user", ask).alias("request_body"),
        F.when(F.col("role") == "assistant", got).alias("response_body"),
        F.lit("").alias("llm_request_prompt"),
        F.lit("").alias("llm_response_content"),
        F.lit('{"streaming":false}').alias("metadata"),
    )
    out = jobs.enrich_stream(rows, new_folder(spark, "enrich"))
    return out.select(
        "id", F.nullif("llm_request_prompt", F.lit("")).alias("prompt"), F.get_json_object("llm_response_content", "$.parts[0].text").alias("content")
    )


@query(
    "t3_ws_turns_stream",
    with_tables(
        f"""{_TURNS} SELECT connection_id, CAST(turn_index AS BIGINT) AS turn_index, start_type, coalesce(end_type, CASE WHEN next_ts IS NOT NULL THEN 'next_turn_start' ELSE 'connection_closed' END) AS terminal_type,
        epoch_us(started_at) AS started_us, epoch_us(coalesce(end_ts, next_ts, last_ts)) AS ended_us, request_messages, response_messages,
        CASE WHEN end_ts IS NOT NULL THEN end_code WHEN next_ts IS NOT NULL THEN next_code ELSE last_code END AS close_code FROM h""",
        "ws_messages",
    ),
)
def ws_turns_stream(spark, sf):
    events = stream_of(spark, sf, "events", BATCH)
    out = ordered.all_turns(derived.ws_messages_from(events), new_folder(spark, "turns"))
    return out.select(
        "connection_id", "turn_index", "start_type", "terminal_type", "started_us", "ended_us", "request_messages", "response_messages", "close_code"
    )


@query(
    "t6_rate_limit_stream",
    on_traces(
        """WITH RECURSIVE k AS (SELECT id, org_id || '|' || workspace_id AS ws, timestamp AS ts FROM traces),
        wa AS (SELECT ws, min(ts) AS ts FROM k GROUP BY ws UNION ALL
          SELECT a.ws, min(k.ts) FROM wa a JOIN k ON k.ws = a.ws AND k.ts > a.ts + INTERVAL 3600 SECOND GROUP BY a.ws)
        SELECT k.id, wa.ts IS NOT NULL AS admitted FROM k LEFT JOIN wa USING (ws, ts)"""
    ),
)
def rate_limit_stream(spark, sf):
    requests = derived.raw_traces_from(stream_of(spark, sf, "events", BATCH))
    decided = ordered.all_admissions(requests, ["org_id", "workspace_id"], 1, new_folder(spark, "rate"), 3600)
    return decided.select("id", "admitted")


@query(
    "t7_quota_stream",
    on_traces(
        """SELECT CAST(timestamp AS DATE) AS day, org_id, workspace_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost_usd), 8) AS total_cost_usd FROM traces GROUP BY ALL"""
    ),
)
def quota_stream(spark, sf):
    out = jobs.quota_stream(_build(stream_of(spark, sf, "events", BATCH)), ["org_id", "workspace_id"], new_folder(spark, "quota-stream"), jobs.NEVER_LATE)
    return out.withColumn("total_cost_usd", F.round("total_cost_usd", 8))


@query(
    "t8_metrics_stream",
    on_traces(
        """WITH w AS (SELECT date_trunc('minute', timestamp) - unnest([0, 1, 2, 3, 4]) * INTERVAL 1 MINUTE AS window_start, provider, response_status, latency_ms FROM traces)
        SELECT window_start, provider, count(*) AS request_count, count(*) FILTER (WHERE response_status >= 500) AS error_count, max(latency_ms) AS max_latency_ms FROM w
        WHERE window_start + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(timestamp)) - INTERVAL 10 MINUTE FROM traces) GROUP BY ALL"""
    ),
)
def metrics_stream(spark, sf):
    rows = jobs.metrics_stream(derived.raw_traces_from(stream_of(spark, sf, "events")))
    return jobs.stream_to_files(rows, new_folder(spark, "metrics")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _counts(spark, sf, label):
    return jobs.counts_stream(_build(stream_of(spark, sf, "events", BATCH)), new_folder(spark, label), lateness=jobs.NEVER_LATE)


@query("t8_request_counter_stream", ORACLES["a14_request_counter"])
def request_counter_stream(spark, sf):
    return analytics.counter_of(_counts(spark, sf, "counter-stream"))


@query("t8_duration_histogram_stream", ORACLES["a15_duration_histogram"])
def duration_histogram_stream(spark, sf):
    return analytics.histogram_of(_counts(spark, sf, "duration-stream")).withColumn("duration_sum", F.round("duration_sum", 8))


@query("t8_quantile_alert_stream", ORACLES["a16_histogram_quantile"])
def quantile_alert_stream(spark, sf):
    return analytics.quantile_alert_of(_counts(spark, sf, "quantile-stream"), threshold=1.0).withColumn("quantile_seconds", F.round("quantile_seconds", 8))


@query("t8_ratio_alert_stream", ORACLES["a17_error_ratio_alert"])
def ratio_alert_stream(spark, sf):
    return analytics.ratio_alert_of(_counts(spark, sf, "ratio-stream")).withColumn("error_ratio", F.round("error_ratio", 8))


@query("t8_increase_alert_stream", ORACLES["a18_increase_alert"])
def increase_alert_stream(spark, sf):
    log = derived.write_log_from(stream_of(spark, sf, "events", BATCH))
    classed = log.withColumn("error_class", analytics.write_error_class(F.col("message")))
    counts = jobs.failures_stream(classed, "ts", ["error_class"], new_folder(spark, "increase-stream"), lateness=jobs.NEVER_LATE)
    return analytics.increase_of(counts, ["error_class"])


@query(
    "t9_export_daily",
    on_traces(
        """SELECT count(*) AS total_records, min(timestamp) AS first_at, max(timestamp) AS last_at FROM traces
        WHERE timestamp >= TIMESTAMP '2024-01-11 15:00:00' AND timestamp < TIMESTAMP '2024-01-12 15:00:00'"""
    ),
)
def export_daily(spark, sf):
    zone = "Asia/Tokyo"
    day = export.previous_day(dt.datetime(2024, 1, 12, 18, 0), zone)
    parts = export.export_day(derived.traces(spark, sf), day, zone, new_folder(spark, "daily"))
    return parts.agg(F.sum("records").alias("total_records"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
