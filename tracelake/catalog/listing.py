"""Ordered lists, cursors, pages and top rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracelake.catalog.filters import SHOWN
from tracelake.catalog.sql import on_traces
from tracelake.operators import analytics, paging
from tracelake.operators.filters import TraceFilter, apply_filter
from tracelake.registry import query
from tracelake.sources import derived

_SHOWN_SQL = ", ".join(SHOWN)


@query(
    "k1_list_traces_page",
    on_traces(
        f"""SELECT {_SHOWN_SQL} FROM traces WHERE provider = 'openai' AND
        (created_at < TIMESTAMP '2024-01-25' OR (created_at = TIMESTAMP '2024-01-25' AND id < 'tr_9'))
        ORDER BY created_at DESC, id DESC LIMIT 50"""
    ),
)
def list_traces_page(spark, sf):
    # Cursor text of '2024-01-25T00:00:00Z|tr_9'.
    cursor = "MjAyNC0wMS0yNVQwMDowMDowMFp8dHJfOQ"
    return paging.list_page(derived.traces(spark, sf), TraceFilter(provider="openai"), cursor=cursor).select(*SHOWN)


@query("k2_list_total_count", on_traces("SELECT count(*) AS total_count FROM traces WHERE provider = 'openai' AND response_status = 500"))
def list_total_count(spark, sf):
    return paging.list_total(derived.traces(spark, sf), TraceFilter(provider="openai", status=500))


@query(
    "k3_next_cursor",
    on_traces(
        r"""SELECT id, created_at AS cursor_time, id AS cursor_id,
        rtrim(translate(base64(encode(regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z|' || id)), '+/', '-_'), '=') AS cursor
        FROM traces"""
    ),
)
def next_cursor(spark, sf):
    t = derived.traces(spark, sf).select("id", paging.cursor_of(F.col("created_at"), F.col("id")).alias("cursor"))
    at, row_id = paging.cursor_fields(F.col("cursor"))
    return t.select("id", at.cast("timestamp_ntz").alias("cursor_time"), row_id.alias("cursor_id"), "cursor")


@query(
    "k4_assign_pages",
    on_traces(
        """SELECT id, org_id, workspace_id, row_no, (row_no - 1) // 50 AS page_no FROM (
        SELECT id, org_id, workspace_id, row_number() OVER (PARTITION BY org_id, workspace_id ORDER BY created_at DESC, id DESC) AS row_no
        FROM traces)"""
    ),
)
def assign_pages(spark, sf):
    t = derived.traces(spark, sf).select("id", "org_id", "workspace_id", "created_at")
    # A day per slice suits this table's density; a busy table takes a shorter one.
    return paging.assign_pages(t, ["org_id", "workspace_id"], 50).drop("created_at")


@query("k5_latest_trace", on_traces(f"SELECT {_SHOWN_SQL} FROM traces ORDER BY created_at DESC, id DESC LIMIT 1"))
def latest_trace(spark, sf):
    return paging.latest(derived.traces(spark, sf)).select(*SHOWN)


@query(
    "k5_latest_in_chain",
    on_traces(
        """SELECT trace_group_id, id, created_at FROM traces
        QUALIFY row_number() OVER (PARTITION BY trace_group_id ORDER BY created_at DESC, id DESC) = 1"""
    ),
)
def latest_in_chain(spark, sf):
    return paging.latest_per(derived.traces(spark, sf), ["trace_group_id"])


@query(
    "k6_recent_traces",
    on_traces(
        """SELECT id, timestamp, provider, model, response_status, total_tokens, round(estimated_cost_usd, 8) AS estimated_cost_usd, latency_ms, request_path
        FROM traces ORDER BY timestamp DESC, id DESC LIMIT 10"""
    ),
)
def recent_traces(spark, sf):
    return paging.recent(derived.traces(spark, sf)).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 8))


@query(
    "k7_top_model",
    on_traces("SELECT model AS top_model, count(*) AS request_count FROM traces GROUP BY model ORDER BY count(*) DESC, trim(model) LIMIT 1"),
)
def top_model(spark, sf):
    return analytics.top_model(derived.traces(spark, sf))


@query(
    "k8_report_orderings",
    on_traces(
        """SELECT 'model' AS list, model AS name, row_number() OVER (ORDER BY count(*) DESC, model) AS place FROM traces GROUP BY model
        UNION ALL SELECT 'key', api_key_hash, row_number() OVER (ORDER BY count(*) DESC, api_key_hash) FROM traces WHERE api_key_hash <> '' GROUP BY api_key_hash
        UNION ALL SELECT 'provider', provider, row_number() OVER (ORDER BY sum(total_tokens) DESC, provider) FROM traces GROUP BY provider"""
    ),
)
def report_orderings(spark, sf):
    return analytics.report_places(derived.traces(spark, sf))


@query(
    "s17_export_page",
    on_traces(
        f"""SELECT {_SHOWN_SQL} FROM traces WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-04'
        ORDER BY timestamp, id LIMIT 100"""
    ),
)
def export_page(spark, sf):
    return paging.export_page(derived.traces(spark, sf), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4)).select(*SHOWN)
