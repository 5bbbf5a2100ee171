"""Row filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracelake.catalog.sql import on_traces, with_tables
from tracelake.operators import filters as ops
from tracelake.operators.filters import TraceFilter, apply_filter
from tracelake.registry import query
from tracelake.sources import derived

SHOWN = ["id", "org_id", "workspace_id", "timestamp", "provider", "model", "request_path", "response_status", "total_tokens"]
_SHOWN_SQL = ", ".join(SHOWN)
PREFIXES = ("/openai", "/anthropic", "/llm")
FROM, TO = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 12, 30)


def _register(name: str, f: TraceFilter, where: str) -> None:
    @query(name, on_traces(f"SELECT {_SHOWN_SQL} FROM traces WHERE {where}"))
    def run(spark, sf, f=f):
        return apply_filter(derived.traces(spark, sf), f).select(*SHOWN)


_register("f1_tenant_filter", TraceFilter(org_id="org-1", workspace_id="ws-2"), "org_id = 'org-1' AND workspace_id = 'ws-2'")
_register("f4_group_filter", TraceFilter(trace_group_id="grp-7"), "trace_group_id = 'grp-7'")
_register(
    "f5_thread_run_filter",
    TraceFilter(thread_id="th-7", run_id="run-1"),
    "json_extract_string(metadata, '$.lineage_thread_id') = 'th-7' AND json_extract_string(metadata, '$.lineage_run_id') = 'run-1'",
)
_register("f6_provider_model_filter", TraceFilter(provider="openai", model="gpt-4o"), "provider = 'openai' AND model = 'gpt-4o'")
_register(
    "f7_path_prefix_filter", TraceFilter(path_prefix=" llm/ "), "(request_path = '/llm' OR starts_with(request_path, '/llm/'))"
)
_register(
    "f8_endpoint_filter",
    TraceFilter(endpoint="v1/responses/", prefixes=PREFIXES),
    "request_path IN ('/v1/responses', '/openai/v1/responses', '/anthropic/v1/responses', '/llm/v1/responses')",
)
_register(
    "f9_key_filter", TraceFilter(api_key_hash="kh-3", access_key_id="gk-3"), "api_key_hash = 'kh-3' AND access_key_id = 'gk-3'"
)
_register("f10_status_filter", TraceFilter(status=429), "response_status = 429")
_register("f11_token_range_filter", TraceFilter(min_tokens=200, max_tokens=400), "total_tokens BETWEEN 200 AND 400")
_register(
    "f12_time_range_filter",
    TraceFilter(since=FROM, until=TO),
    "timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20 12:30:00'",
)
_register(
    "f21_combined_filter",
    TraceFilter(org_id="org-1", provider="anthropic", path_prefix="/anthropic", min_tokens=100, since=FROM, until=TO),
    "org_id = 'org-1' AND provider = 'anthropic' AND starts_with(request_path, '/anthropic/') AND total_tokens >= 100"
    " AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:30:00'",
)


@query("f2_tenant_visibility", on_traces(f"SELECT {_SHOWN_SQL} FROM traces WHERE org_id = 'org-2' AND workspace_id = 'ws-4'"))
def tenant_visibility(spark, sf):
    return ops.visible_to(derived.traces(spark, sf), "org-2", " ws-4 ").select(*SHOWN)


@query(
    "f3_row_level_scope",
    on_traces(
        "SELECT id AS trace_id, octet_length(encode(metadata)) AS size_bytes FROM traces WHERE org_id = 'org-0' AND workspace_id = 'ws-3'"
    ),
)
def row_level_scope(spark, sf):
    t = derived.traces(spark, sf)
    bodies = derived.raw_traces(spark, sf).select(F.col("id").alias("trace_id"), F.octet_length("metadata").alias("size_bytes"))
    return ops.tenant_bound(t, bodies, "org-0", "ws-3")[1]


@query(
    "f13_export_range_filter",
    on_traces(
        f"SELECT {_SHOWN_SQL} FROM traces WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20 12:30:00'"
    ),
)
def export_range_filter(spark, sf):
    return ops.export_range(derived.traces(spark, sf), FROM, TO).select(*SHOWN)


@query(
    "f14_parse_time_bound",
    """
    SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS since,
      CASE event_id % 4 WHEN 3 THEN NULL WHEN 0 THEN date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
           ELSE date_trunc('second', ts) END AS until
    FROM events
    """,
)
def parse_time_bound(spark, sf):
    text = (
        F.when(F.col("event_id") % 4 == 3, F.lit("not a time"))
        .when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    )
    return derived.table(spark, sf, "events").select(
        "event_id",
        ops.parse_bound_column(text).cast("timestamp_ntz").alias("since"),
        ops.parse_bound_column(text, end=True).cast("timestamp_ntz").alias("until"),
    )


@query(
    "f15_after_cursor_desc",
    on_traces(
        f"""SELECT {_SHOWN_SQL} FROM traces WHERE created_at < TIMESTAMP '2024-01-10'
        OR (created_at = TIMESTAMP '2024-01-10' AND id < 'tr_000000000500')"""
    ),
)
def after_cursor_desc(spark, sf):
    return ops.after_cursor_desc(derived.traces(spark, sf), dt.datetime(2024, 1, 10), "tr_000000000500").select(*SHOWN)


@query(
    "f16_after_cursor_asc",
    on_traces(
        f"""SELECT {_SHOWN_SQL} FROM traces WHERE timestamp > TIMESTAMP '2024-01-10'
        OR (timestamp = TIMESTAMP '2024-01-10' AND id > 'tr_000000000500')"""
    ),
)
def after_cursor_asc(spark, sf):
    return ops.after_cursor_asc(derived.traces(spark, sf), dt.datetime(2024, 1, 10), "tr_000000000500").select(*SHOWN)


@query(
    "f17_point_lookup",
    on_traces(
        f"SELECT {_SHOWN_SQL} FROM traces WHERE id IN (SELECT 'tr_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') FROM labels WHERE toxic = 1)"
    ),
)
def point_lookup(spark, sf):
    wanted = (
        derived.table(spark, sf, "labels")
        .filter("toxic = 1")
        .select(F.concat(F.lit("tr_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"))
    )
    return ops.lookup(derived.traces(spark, sf), wanted).select(*SHOWN)


@query(
    "f18_capture_filter",
    """
    SELECT page_id, path FROM (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/api/' || page_id WHEN 1 THEN '/dashboard' WHEN 2 THEN '/apis/' || page_id
        ELSE regexp_replace(url, '^https?://[^/]*', '') END AS path FROM pages)
    WHERE NOT (path = '/api' OR starts_with(path, '/api/') OR path = '/dashboard' OR starts_with(path, '/dashboard/'))
    """,
)
def capture_filter(spark, sf):
    page = F.col("page_id")
    path = (
        F.when(page % 4 == 0, F.concat(F.lit("/api/"), page.cast("string")))
        .when(page % 4 == 1, F.lit("/dashboard"))
        .when(page % 4 == 2, F.concat(F.lit("/apis/"), page.cast("string")))
        .otherwise(F.regexp_replace("url", "^https?://[^/]*", ""))
    )
    return ops.capturable(derived.table(spark, sf, "pages").select("page_id", path.alias("path")))


@query(
    "f19_enrich_eligible",
    """
    SELECT doc_id AS id FROM documents
    WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND doc_id % 5 NOT IN (0, 1, 2)
    """,
)
def enrich_eligible(spark, sf):
    skip = F.element_at(
        F.array(
            F.lit('{"body_pii_status":"skipped_large_body"}'),
            F.lit('{"redaction_storage_drop":"True"}'),
            F.lit('{"redaction_storage_skipped":true}'),
            F.lit('{"redaction_storage_drop":1,"body_pii_status":"clean"}'),
            F.lit("not json"),
        ),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    docs = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("response_body"), F.lit(" ").alias("llm_response_content"), skip.alias("metadata")
    )
    return ops.enrich_eligible(docs, "response_body", "llm_response_content").select("id")


@query(
    "f20_active_keys_filter",
    with_tables("SELECT id, org_id, workspace_id, role FROM access_keys WHERE revoked_at IS NULL AND org_id = 'org-1'", "access_keys"),
)
def active_keys(spark, sf):
    return ops.active_keys(derived.access_keys(spark, sf), "org-1").select("id", "org_id", "workspace_id", "role")
