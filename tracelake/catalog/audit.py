"""Access and key audits, and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.catalog.sql import on_traces, with_tables
from tracelake.operators import audit as ops
from tracelake.plans.report import report_rows
from tracelake.registry import query
from tracelake.sources import derived

ROUTES = (("openai", "/openai"), ("anthropic", "anthropic/"), ("llm", "/llm"))

# (method, path, mode, resource, permission) — what the rules must say.
_CASES = (
    ("GET", "/api/health", "bypass", "", ""),
    ("POST", "/api/health", "deny", "api", ""),
    ("get", "/api/traces", "require", "traces", "analytics:read"),
    ("GET", "/api/traces/t1/", "require", "traces", "analytics:read"),
    ("HEAD", "/api/traces/t1/replay", "require", "traces", "analytics:read"),
    ("POST", "/api/traces/t1/replay", "deny", "api", ""),
    ("POST", "/api/traces/t1/fork", "require", "traces", "analytics:read"),
    ("GET", "/api/traces/t1/x/y", "deny", "api", ""),
    ("GET", "/api/analytics/summary", "require", "analytics", "analytics:read"),
    ("GET", "/api/analytics/latency", "deny", "api", ""),
    ("GET", "/api/diagnostics/trace-pipeline", "require", "diagnostics", "analytics:read"),
    ("POST", "/api/access-keys", "require", "access_keys", "keys:manage"),
    ("HEAD", "/api/access-keys", "deny", "api", ""),
    ("DELETE", "/api/access-keys/k1", "require", "access_keys", "keys:manage"),
    ("POST", "/api/access-keys/k1/rotate", "require", "access_keys", "keys:manage"),
    ("OPTIONS", "/llm/v1", "bypass", "", ""),
    ("PUT", "/llm", "require", "proxy", "proxy:write"),
    ("GET", "/dashboard", "require", "dashboard", "analytics:read"),
    ("GET", "/dashboards", "bypass", "", ""),
)


def _case(col: int) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c[col]}'" for i, c in enumerate(_CASES))
    return f"CASE event_id % {len(_CASES)} {whens} END"


@query(
    "q1_access_requirement",
    f"""SELECT event_id, {_case(2)} AS mode, {_case(3)} AS resource, {_case(4)} AS permission, CASE event_id % {len(_CASES)} WHEN 16 THEN 'llm' ELSE '' END AS provider,
        CASE WHEN {_case(2)} = 'deny' THEN 'action_unmapped' ELSE '' END AS deny_reason FROM events""",
)
def access_requirement(spark, sf):
    spot = (F.col("event_id") % len(_CASES) + 1).cast("int")
    method, path = (F.element_at(F.array(*[F.lit(c[i]) for c in _CASES]), spot) for i in (0, 1))
    need = ops.access_requirement(method, path, ROUTES)
    e = derived.table(spark, sf, "events").select("event_id", need.alias("n"))
    return e.select("event_id", "n.mode", "n.resource", "n.permission", "n.provider", "n.deny_reason")


def _keys(spark, sf):
    k = derived.access_keys(spark, sf)
    return k.withColumn("permissions", F.array(F.col("extra_permission"), F.lit(" "))).drop("extra_permission")


_PERMISSIONS = """CASE role WHEN 'owner' THEN 'analytics:read,keys:manage,proxy:write' WHEN 'developer' THEN 'analytics:read,proxy:write' WHEN 'viewer' THEN 'analytics:read' ELSE 'analytics:read' END"""


@query("q2_effective_permissions", with_tables(f"SELECT id, {_PERMISSIONS} AS permissions FROM access_keys", "access_keys"))
def effective_permissions(spark, sf):
    granted = ops.effective_permissions(F.col("role"), F.col("permissions"))
    return _keys(spark, sf).select("id", F.array_join(F.array_sort(granted), ",").alias("permissions"))


def _log(spark, sf):
    t = derived.traces(spark, sf)
    token = F.when(F.col("input_tokens") % 13 == 0, F.lit("")).otherwise(F.get_json_object("metadata", "$.lineage_thread_id"))
    return t.select(
        F.col("id").alias("request_id"),
        F.col("request_method").alias("method"),
        F.when(F.col("latency_ms") % 11 == 0, F.lit("/api/access-keys")).when(F.col("latency_ms") % 11 == 1, F.lit("/api/nope")).otherwise(F.col("request_path")).alias("path"),
        token.alias("token_hash"),
        (F.col("api_key_hash") != "").alias("has_credential"),
        F.when(F.col("total_tokens") > 900, F.lit("KEY_DAILY_TOKENS_EXCEEDED")).otherwise(F.lit("")).alias("limit_code"),
    )


_DECISIONS = f"""SELECT t.id AS request_id, path, k.org_id, k.workspace_id, CASE
    WHEN path = '/api/nope' THEN 'action_unmapped' WHEN starts_with(path, '/llmish') THEN ''
    WHEN input_tokens % 13 = 0 THEN 'missing_access_key' WHEN k.id IS NULL THEN 'invalid_access_key'
    WHEN path = '/api/access-keys' THEN CASE WHEN role = 'owner' THEN '' ELSE 'permission_denied' END
    WHEN role IN ('viewer', 'custom') THEN 'permission_denied' WHEN api_key_hash = '' THEN 'missing_provider_credential'
    WHEN total_tokens > 900 THEN 'usage_limit_exceeded' ELSE '' END AS reason
  FROM (SELECT *, CASE latency_ms % 11 WHEN 0 THEN '/api/access-keys' WHEN 1 THEN '/api/nope' ELSE request_path END AS path FROM traces) t
  LEFT JOIN (SELECT * FROM access_keys WHERE revoked_at IS NULL) k ON k.token_hash = json_extract_string(t.metadata, '$.lineage_thread_id') AND input_tokens % 13 <> 0"""
_STATUS = "CASE WHEN reason = '' THEN 200 WHEN reason = 'usage_limit_exceeded' THEN 429 WHEN reason IN ('missing_access_key', 'invalid_access_key') THEN 401 ELSE 403 END"


@query(
    "q3_access_decision_audit",
    with_tables(f"SELECT request_id, CASE WHEN reason = '' THEN 'allow' ELSE 'deny' END AS outcome, reason, {_STATUS} AS status_code FROM ({_DECISIONS})", "traces", "access_keys"),
)
def access_decisions(spark, sf):
    return ops.access_decisions(_log(spark, sf), _keys(spark, sf), ROUTES).select("request_id", "outcome", "reason", "status_code")


_NAMED = "path <> '/api/nope' AND NOT starts_with(path, '/llmish') AND org_id IS NOT NULL"


@query(
    "q4_deny_rollup",
    with_tables(
        f"""SELECT reason, {_STATUS} AS status_code, CASE WHEN {_NAMED} THEN org_id ELSE '' END AS org_id, CASE WHEN {_NAMED} THEN workspace_id ELSE '' END AS workspace_id, path, count(*) AS denies
        FROM ({_DECISIONS}) WHERE reason <> '' GROUP BY ALL""",
        "traces",
        "access_keys",
    ),
)
def deny_rollup(spark, sf):
    return ops.deny_rollup(ops.access_decisions(_log(spark, sf), _keys(spark, sf), ROUTES))


@query(
    "q5_active_key_inventory",
    with_tables("SELECT org_id, workspace_id, id, role, created_at FROM access_keys WHERE revoked_at IS NULL", "access_keys"),
)
def active_inventory(spark, sf):
    return ops.active_inventory(derived.access_keys(spark, sf)).select("org_id", "workspace_id", "id", "role", "created_at")


@query(
    "q6_workspace_list",
    on_traces("SELECT org_id, workspace_id, min(created_at) AS created_at FROM traces WHERE org_id <> 'org-2' GROUP BY ALL"),
)
def workspace_list(spark, sf):
    t = derived.traces(spark, sf)
    spaces = t.groupBy("org_id", "workspace_id").agg(F.min("created_at").alias("created_at"))
    return ops.workspaces_of(t.filter("org_id <> 'org-2'").select("org_id").distinct(), spaces)


def _key_events(spark, sf):
    e = derived.table(spark, sf, "events").filter(F.col("event_type").isin("signup", "click", "purchase"))
    failed = F.col("event_id") % 4 == 0
    return e.select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "signup", F.lit("create")).when(F.col("event_type") == "click", F.lit("rotate")).otherwise(F.lit("revoke")).alias("action"),
        F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("outcome"),
        F.when(failed, F.lit("not_found")).otherwise(F.lit("")).alias("reason"),
        F.concat(F.lit("gk-"), F.col("user_id").cast("string")).alias("target_key_id"),
        F.concat(F.lit("org-"), (F.col("user_id") % 3).cast("string")).alias("org_id"),
        F.concat(F.lit("ws-"), (F.col("user_id") % 5).cast("string")).alias("workspace_id"),
    )


_EVENTS = """SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'rotate' ELSE 'revoke' END AS action, event_id % 4 = 0 AS failed,
  'gk-' || user_id AS target_key_id, 'org-' || (user_id % 3) AS org_id, 'ws-' || (user_id % 5) AS workspace_id FROM events WHERE event_type IN ('signup', 'click', 'purchase')"""


@query(
    "q7_key_lifecycle_audit",
    f"""SELECT action, CASE WHEN failed THEN 'error' ELSE 'success' END AS outcome, CASE WHEN failed THEN 'not_found' ELSE '' END AS reason, org_id, workspace_id, count(*) AS events FROM ({_EVENTS}) GROUP BY ALL""",
)
def key_lifecycle(spark, sf):
    return ops.lifecycle_counts(_key_events(spark, sf))


@query(
    "q7_key_states",
    f"""SELECT target_key_id, CASE arg_max(action, (ts, event_id)) WHEN 'revoke' THEN 'revoked' ELSE 'active' END AS state, arg_max(action, (ts, event_id)) AS last_action, max(ts) AS changed_at,
        count(*) FILTER (WHERE action = 'rotate') AS rotations FROM ({_EVENTS}) WHERE NOT failed GROUP BY target_key_id""",
)
def key_states(spark, sf):
    return ops.key_states(_key_events(spark, sf))


@query(
    "q8_normalize_keys",
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 3 WHEN 0 THEN 'abc' || doc_id WHEN 1 THEN sha256('tok' || doc_id) ELSE '' END AS token_hash, CASE WHEN doc_id % 2 = 0 THEN 'default' ELSE lang END AS org_id,
       'default' AS workspace_id, CASE WHEN lang = 'en' THEN 'developer' ELSE lang END AS role, 'a:read,' || lang AS permissions FROM documents""",
)
def normalize_keys(spark, sf):
    doc = F.col("doc_id").cast("string")
    raw = derived.table(spark, sf, "documents").select(
        F.concat(F.lit(" "), doc).alias("id"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ABC"), doc)).alias("token_hash"),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("tok"), doc, F.lit(" "))).alias("token"),
        F.when(F.col("doc_id") % 2 == 1, F.col("lang")).otherwise(F.lit(" ")).alias("org_id"),
        F.lit(None).cast("string").alias("workspace_id"),
        F.when(F.col("lang") != "en", F.upper("lang")).otherwise(F.lit("")).alias("role"),
        F.array(F.lit(" A:read"), F.lit(""), F.col("lang"), F.lit("a:READ ")).alias("permissions"),
    )
    return ops.normalize_keys(raw).withColumn("permissions", F.array_join("permissions", ","))


@query(
    "t10_touch_last_used",
    with_tables(
        "SELECT k.id, max(t.timestamp) AS last_used_at FROM access_keys k LEFT JOIN traces t ON t.access_key_id = k.id AND t.response_status = 200 WHERE k.revoked_at IS NULL GROUP BY k.id",
        "traces",
        "access_keys",
    ),
)
def touch_last_used(spark, sf):
    used = derived.traces(spark, sf).filter("response_status = 200")
    return ops.touch_last_used(derived.access_keys(spark, sf), used).select("id", "last_used_at")


def _num(e: str) -> str:
    return f"format('{{:.8f}}', round({e}, 8))"


def _when(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S.%f')"


def _long(section: str, name: str, metrics: dict[str, str], tail: str) -> str:
    listed = ", ".join(f"{{'metric': '{m}', 'value': CAST({e} AS VARCHAR)}}" for m, e in metrics.items())
    return f"SELECT '{section}' AS section, name, r.metric, r.value FROM (SELECT {name} AS name, unnest([{listed}]) AS r FROM traces {tail})"


_SUM = {c: f"sum({c})" for c in ("input_tokens", "output_tokens", "total_tokens")}


@query(
    "a13_report_document",
    on_traces(
        " UNION ALL ".join(
            [
                _long(
                    "summary",
                    "''",
                    {
                        "total_requests": "count(*)",
                        "total_input_tokens": "sum(input_tokens)",
                        "total_output_tokens": "sum(output_tokens)",
                        "total_tokens": "sum(total_tokens)",
                        "total_cost_usd": _num("sum(estimated_cost_usd)"),
                        "top_model": "(SELECT model FROM traces GROUP BY model ORDER BY count(*) DESC, model LIMIT 1)",
                        "active_keys": "count(DISTINCT nullif(api_key_hash, ''))",
                    },
                    "",
                ),
                _long("providers", "provider", {"provider": "provider", **_SUM, "total_cost_usd": _num("sum(estimated_cost_usd)")}, "GROUP BY provider"),
                _long(
                    "models",
                    "model",
                    {
                        "model": "model",
                        "request_count": "count(*)",
                        "avg_latency_ms": _num("avg(latency_ms)"),
                        "avg_ttft_ms": _num("avg(time_to_first_token_ms)"),
                        "total_tokens": "sum(total_tokens)",
                        "total_cost_usd": _num("sum(estimated_cost_usd)"),
                    },
                    "GROUP BY model",
                ),
                _long(
                    "keys",
                    "api_key_hash",
                    {
                        "api_key_hash": "api_key_hash",
                        "request_count": "count(*)",
                        "total_tokens": "sum(total_tokens)",
                        "total_cost_usd": _num("sum(estimated_cost_usd)"),
                        "last_active_at": _when("max(timestamp)"),
                    },
                    "WHERE api_key_hash <> '' GROUP BY api_key_hash",
                ),
                _long(
                    "recent",
                    "id",
                    {
                        "id": "id",
                        "timestamp": _when("timestamp"),
                        "provider": "provider",
                        "model": "model",
                        "response_status": "response_status",
                        "total_tokens": "total_tokens",
                        "estimated_cost_usd": _num("estimated_cost_usd"),
                        "latency_ms": "latency_ms",
                        "request_path": "request_path",
                    },
                    "WHERE id IN (SELECT id FROM traces ORDER BY timestamp DESC, id DESC LIMIT 10)",
                ),
            ]
        )
    ),
)
def report_document(spark, sf):
    return report_rows(derived.traces(spark, sf))
