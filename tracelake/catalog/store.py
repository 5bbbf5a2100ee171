"""Table maintenance and export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracelake.catalog.analytics import rounded
from tracelake.catalog.sql import on_traces, with_tables
from tracelake.operators.filters import moment
from tracelake.registry import query
from tracelake.schema import conform, normalize, scan_defaults
from tracelake.session import new_folder
from tracelake.sources import derived, export, store

_NULLABLE = ("request_headers", "request_body", "response_headers", "response_body", "llm_request_prompt", "llm_response_content")


@query(
    "s1_scan_traces",
    with_tables(
        "SELECT *, " + ", ".join(f"'' AS {c}" for c in _NULLABLE) + ", 0::DOUBLE AS estimated_cost_usd, json_extract_string(metadata, '$.access_key_id') AS access_key_id FROM raw_traces",
        "raw_traces",
    ),
)
def scan_traces(spark, sf):
    return scan_defaults(conform(derived.raw_traces(spark, sf)))


_COLUMNS = """id, trace_group_id, org_id, workspace_id, timestamp, provider, model, request_method, request_path, response_status, input_tokens,
  output_tokens, total_tokens, latency_ms, time_to_first_token_ms, time_to_first_token_us, api_key_hash, access_key_id,
  round(estimated_cost_usd, 8) AS estimated_cost_usd, metadata, created_at"""


@query("s2_detail_projection", on_traces(f"SELECT {_COLUMNS}, " + ", ".join(f"NULL AS {c}" for c in _NULLABLE) + " FROM traces"))
def detail_projection(spark, sf):
    return rounded(store.detail(derived.traces(spark, sf)), "estimated_cost_usd")


@query(
    "s3_summary_projection",
    on_traces(
        f"SELECT {_COLUMNS}, NULL AS request_headers, NULL AS response_headers, '' AS request_body, '' AS response_body, '' AS llm_request_prompt, '' AS llm_response_content FROM traces"
    ),
)
def summary_projection(spark, sf):
    return rounded(store.summaries(derived.traces(spark, sf)), "estimated_cost_usd")


@query(
    "s4_normalize_traces",
    on_traces(
        """SELECT id, timestamp, CASE WHEN input_tokens % 4 = 0 THEN 'unknown' ELSE model END AS model, CASE WHEN input_tokens % 4 = 1 THEN 'default' ELSE org_id END AS org_id,
        CASE WHEN input_tokens % 4 = 2 THEN '/' ELSE request_path END AS request_path, CASE WHEN input_tokens % 4 = 3 THEN 'UNKNOWN' ELSE request_method END AS request_method,
        total_tokens, access_key_id, time_to_first_token_ms, time_to_first_token_us FROM traces"""
    ),
)
def normalize_traces(spark, sf):
    gap = F.col("input_tokens") % 4
    holes = derived.raw_traces(spark, sf).withColumns(
        {
            "model": F.when(gap == 0, F.lit("")).otherwise(F.col("model")),
            "org_id": F.when(gap == 1, F.lit(None)).otherwise(F.col("org_id")),
            "request_path": F.when(gap == 2, F.lit("")).otherwise(F.col("request_path")),
            "request_method": F.when(gap == 3, F.lit(None)).otherwise(F.col("request_method")),
            "access_key_id": F.lit(""),
        }
    )
    return normalize(holes).select(
        "id", "timestamp", "model", "org_id", "request_path", "request_method", "total_tokens", "access_key_id", "time_to_first_token_ms", "time_to_first_token_us"
    )


@query(
    "s5_append_batch",
    on_traces(
        """SELECT 'accepted' AS outcome, id, '' AS reason, 1 AS rows FROM traces WHERE timestamp >= TIMESTAMP '2024-01-12'
        UNION ALL SELECT 'rejected', id, 'already_stored', 1 + CASE WHEN response_status >= 500 THEN 1 ELSE 0 END FROM traces WHERE timestamp < TIMESTAMP '2024-01-12'
        UNION ALL SELECT 'rejected', id, 'repeated_in_batch', 1 FROM traces WHERE timestamp >= TIMESTAMP '2024-01-12' AND response_status >= 500"""
    ),
)
def append_batch(spark, sf):
    # The whole table is delivered again, failed calls twice; rows before the 12th are stored already.
    t = derived.traces(spark, sf).select("id", "timestamp", "created_at", "response_status")
    stored = t.filter(F.col("timestamp") < moment(t, "timestamp", dt.datetime(2024, 1, 12)))
    result = store.append_batch(t.unionByName(t.filter("response_status >= 500")), stored)
    accepted = result.accepted.select(F.lit("accepted").alias("outcome"), "id", F.lit("").alias("reason"), F.lit(1).cast("bigint").alias("rows"))
    return accepted.unionByName(result.rejected.select(F.lit("rejected").alias("outcome"), "id", "reason", "rows"))


@query(
    "s6_conform_legacy_schema",
    with_tables(
        "SELECT id, org_id, workspace_id, json_extract_string(metadata, '$.access_key_id') AS access_key_id, NULL AS llm_request_prompt, NULL AS llm_response_content FROM raw_traces",
        "raw_traces",
    ),
)
def conform_legacy(spark, sf):
    return conform(derived.raw_traces(spark, sf)).select("id", "org_id", "workspace_id", "access_key_id", "llm_request_prompt", "llm_response_content")


def _known_workspaces(spark, sf):
    """Workspaces that hold keys of owners."""
    keys = derived.access_keys(spark, sf).filter("role = 'owner' AND org_id <> 'org-2'")
    return keys.select("org_id", "workspace_id").distinct()


_KNOWN = "SELECT DISTINCT org_id, workspace_id FROM access_keys WHERE role = 'owner' AND org_id <> 'org-2'"


@query(
    "s7_backfill_tenants",
    with_tables(
        f"""WITH known AS ({_KNOWN}), seen AS (SELECT DISTINCT org_id, workspace_id FROM traces UNION SELECT 'default', 'default')
        SELECT 'organization' AS kind, org_id, '' AS workspace_id FROM (SELECT org_id FROM seen EXCEPT SELECT org_id FROM known)
        UNION ALL SELECT 'workspace', org_id, workspace_id FROM (SELECT * FROM seen EXCEPT SELECT * FROM known)""",
        "traces",
        "access_keys",
    ),
)
def backfill_tenants(spark, sf):
    known = _known_workspaces(spark, sf)
    orgs, spaces = store.backfill_tenants(derived.traces(spark, sf), known.select("org_id").distinct(), known)
    return orgs.select(F.lit("organization").alias("kind"), "org_id", F.lit("").alias("workspace_id")).unionByName(
        spaces.select(F.lit("workspace").alias("kind"), "org_id", "workspace_id")
    )


@query(
    "s8_ensure_tenant_scope",
    with_tables(
        f"""SELECT * FROM (SELECT DISTINCT CASE WHEN org_id = 'org-0' THEN 'default' ELSE org_id END AS org_id, workspace_id FROM traces
        EXCEPT ({_KNOWN}))""",
        "traces",
        "access_keys",
    ),
)
def ensure_tenant_scope(spark, sf):
    batch = derived.traces(spark, sf).withColumn("org_id", F.when(F.col("org_id") == "org-0", F.lit("  ")).otherwise(F.col("org_id")))
    return store.ensure_tenants(batch, _known_workspaces(spark, sf))


@query("u3_distinct_tenants", on_traces("SELECT DISTINCT org_id, workspace_id FROM traces"))
def distinct_tenants(spark, sf):
    return store.tenants_of(derived.traces(spark, sf))


@query(
    "s9_upsert_bodies",
    on_traces(
        """SELECT id AS trace_id, CASE WHEN response_status >= 500 THEN 'again-' || id WHEN response_status >= 400 THEN 'once-' || id ELSE metadata END AS body, created_at FROM traces"""
    ),
)
def upsert_bodies(spark, sf):
    t = derived.traces(spark, sf)
    stored = t.select(F.col("id").alias("trace_id"), F.col("metadata").alias("body"), "created_at")
    failed = t.filter("response_status >= 400")

    def wave(rows, word, minutes):
        return rows.select(
            F.col("id").alias("trace_id"), F.concat(F.lit(word), F.col("id")).alias("body"), (F.col("created_at") + F.make_dt_interval(mins=F.lit(minutes))).alias("created_at")
        )

    return store.upsert_bodies(stored, wave(failed, "once-", 5).unionByName(wave(failed.filter("response_status >= 500"), "again-", 9)))


@query(
    "s10_body_stats",
    """SELECT doc_id, octet_length(encode(text)) AS request_body_size_bytes, sha256(text) AS request_body_sha256, 0 AS response_body_size_bytes,
       NULL AS response_body_sha256, CASE WHEN lang = 'de' THEN 'clean' ELSE 'unknown' END AS pii_status FROM documents""",
)
def body_stats(spark, sf):
    docs = derived.table(spark, sf, "documents")
    metadata = F.when(F.col("lang") == "de", F.lit('{"body_pii_status":" clean "}')).otherwise(F.lit("{}"))
    zero, none = F.lit(0).cast("bigint"), F.lit("")
    return docs.select(
        "doc_id",
        *[c.alias(n) for n, c in store.body_columns("request_body", F.col("text"), zero, none).items()],
        *[c.alias(n) for n, c in store.body_columns("response_body", F.lit(""), zero, none).items()],
        store.pii_status(metadata).alias("pii_status"),
    )


def _captured(spark, sf):
    docs = derived.table(spark, sf, "documents")
    zero = F.lit(0).cast("bigint")
    return docs.select(
        F.col("doc_id").cast("string").alias("trace_id"),
        F.col("text").alias("request_body"),
        F.when(F.col("lang") == "en", F.col("source")).alias("response_body"),
        zero.alias("request_body_bytes"),
        zero.alias("response_body_bytes"),
        F.lit("").alias("request_body_sha"),
        F.lit("").alias("response_body_sha"),
        F.lit("{}").alias("metadata"),
    )


@query(
    "s11_hydrate_bodies",
    """SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS request_sha, CASE WHEN lang = 'en' THEN source ELSE 'inline' END AS response_body FROM documents""",
)
def hydrate_bodies(spark, sf):
    bodies = store.pack_bodies(_captured(spark, sf))
    inline = derived.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("inline").alias("request_body"), F.lit("inline").alias("response_body")
    )
    return store.hydrate(inline, bodies).select("id", F.sha2("request_body", 256).alias("request_sha"), "response_body")


@query(
    "s12_update_columns",
    """WITH last AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
    t AS (SELECT DISTINCT doc_id AS id FROM documents)
    SELECT 'row' AS kind, CAST(t.id AS VARCHAR) AS id, coalesce(sha256(nullif(l.text, '')), sha256('old')) AS prompt FROM t LEFT JOIN last l ON l.conv_id = t.id
    UNION ALL SELECT 'unknown', CAST(conv_id AS VARCHAR), '' FROM last WHERE conv_id NOT IN (SELECT id FROM t)""",
)
def update_columns(spark, sf):
    last = (
        derived.table(spark, sf, "conversations")
        .filter("role = 'user'")
        .groupBy("conv_id")
        .agg(F.max_by("text", "turn").alias("value"))
        .select(F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias("id"), "value")
    )
    rows = derived.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("old").alias("llm_request_prompt"))
    updated, unknown = store.update_column(rows, last, "llm_request_prompt")
    return updated.select(F.lit("row").alias("kind"), "id", F.sha2("llm_request_prompt", 256).alias("prompt")).unionByName(
        unknown.select(F.lit("unknown").alias("kind"), "id", F.lit("").alias("prompt"))
    )


@query(
    "s13_retention_delete",
    on_traces(
        """SELECT 'kept' AS kind, id, 0 AS deleted FROM traces WHERE timestamp >= TIMESTAMP '2024-01-16 08:00:00'
        UNION ALL SELECT 'body', id, 0 FROM traces WHERE timestamp >= TIMESTAMP '2024-01-16 08:00:00'
        UNION ALL SELECT 'total', '', count(*) FROM traces WHERE timestamp < TIMESTAMP '2024-01-16 08:00:00'"""
    ),
)
def retention_delete(spark, sf):
    t = derived.traces(spark, sf)
    bodies = derived.raw_traces(spark, sf).select(F.col("id").alias("trace_id"), "metadata")
    kept, kept_bodies, total = store.retain(t, bodies, moment(t, "timestamp", dt.datetime(2024, 1, 16, 8)))
    none = F.lit(0).cast("bigint").alias("deleted")
    return (
        kept.select(F.lit("kept").alias("kind"), "id", none)
        .unionByName(kept_bodies.select(F.lit("body").alias("kind"), F.col("trace_id").alias("id"), none))
        .unionByName(total.select(F.lit("total").alias("kind"), F.lit("").alias("id"), "deleted"))
    )


@query(
    "s14_retention_cutoff",
    """SELECT event_id, ((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') - INTERVAL 14 DAY) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS cutoff_ny,
       ((ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo') - INTERVAL 30 DAY) AT TIME ZONE 'Asia/Tokyo' AT TIME ZONE 'UTC' AS cutoff_tokyo FROM events""",
)
def retention_cutoff(spark, sf):
    return derived.table(spark, sf, "events").select(
        "event_id",
        store.retention_cutoff(F.col("ts"), "America/New_York").cast("timestamp_ntz").alias("cutoff_ny"),
        store.retention_cutoff(F.col("ts"), "Asia/Tokyo", 30).cast("timestamp_ntz").alias("cutoff_tokyo"),
    )


@query(
    "s15_export_window",
    on_traces(
        """SELECT count(*) AS records, min(timestamp) AS first_at, max(timestamp) AS last_at, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM traces
        WHERE timestamp >= TIMESTAMP '2024-01-10 05:00:00' AND timestamp < TIMESTAMP '2024-01-11 05:00:00'"""
    ),
)
def export_window(spark, sf):
    t = derived.traces(spark, sf)
    folder = new_folder(spark, "export")
    start, end = export.local_day(dt.date(2024, 1, 10), "America/New_York")
    export.export_window(t, start, end, folder, part_bytes=64 * 1024)
    return export.read_export(spark, folder, t.schema).agg(
        F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.sum("total_tokens").alias("total_tokens")
    )


@query(
    "s16_export_manifest",
    on_traces(
        """SELECT count(*) AS total_records, min(timestamp) AS first_at, max(timestamp) AS last_at FROM traces
        WHERE timestamp >= TIMESTAMP '2024-01-11 15:00:00' AND timestamp < TIMESTAMP '2024-01-12 15:00:00'"""
    ),
)
def export_manifest(spark, sf):
    parts = export.export_day(derived.traces(spark, sf), dt.date(2024, 1, 12), "Asia/Tokyo", new_folder(spark, "export"), part_bytes=64 * 1024)
    return parts.agg(F.sum("records").alias("total_records"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


@query(
    "s18_part_naming",
    on_traces(
        """WITH d AS (SELECT timestamp AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS local, org_id FROM traces),
        p AS (SELECT strftime(local, '%y%m%d') AS day_dir, CAST(replace(org_id, 'org-', '') AS INT) + 1 AS part, strftime(min(local), '%H%M') AS first, strftime(max(local), '%H%M') AS last, count(*) AS records FROM d GROUP BY ALL)
        SELECT day_dir, 'request_details_' || day_dir || '_part_' || lpad(CAST(part AS VARCHAR), 6, '0') || '_' || first || '_' || last || '.ndjson.gz' AS part_name, records FROM p"""
    ),
)
def part_naming(spark, sf):
    zone = "America/New_York"
    grouped = (
        derived.traces(spark, sf)
        .groupBy(export.day_dir(F.col("timestamp"), zone).alias("day_dir"), "org_id")
        .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("records"))
    )
    number = F.regexp_replace("org_id", "org-", "").cast("int") + 1
    return grouped.select("day_dir", export.part_name(F.col("first"), number, F.col("first"), F.col("last"), zone).alias("part_name"), "records")


@query("s19_count_traces", on_traces("SELECT count(*) AS trace_count FROM traces"))
def count_traces(spark, sf):
    return store.count_traces(derived.traces(spark, sf))


@query(
    "s20_fk_check",
    with_tables(
        f"""WITH known AS ({_KNOWN})
        SELECT 'trace_without_workspace' AS problem, id FROM traces t WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.org_id = t.org_id AND k.workspace_id = t.workspace_id)
        UNION ALL SELECT 'workspace_without_org', org_id || '/' || workspace_id FROM known WHERE org_id <> 'org-0'
        UNION ALL SELECT 'body_without_trace', CAST(doc_id AS VARCHAR) FROM documents""",
        "traces",
        "access_keys",
    ),
)
def fk_check(spark, sf):
    known = _known_workspaces(spark, sf)
    bodies = derived.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("trace_id"))
    return store.integrity_report(derived.traces(spark, sf), bodies, known.select("org_id").distinct().filter("org_id = 'org-0'"), known)
