"""Joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracelake.catalog.sql import on_traces, with_tables
from tracelake.functions.pricing import cost_of, price_join
from tracelake.functions.text import provider_of_path
from tracelake.operators import filters, joins, paging
from tracelake.operators.joins import PolicyRule
from tracelake.registry import query
from tracelake.sources import derived


@query(
    "j1_export_with_bodies",
    on_traces(
        """SELECT p.id, p.timestamp, CASE WHEN p.response_status >= 400 THEN sha256(p.metadata) END AS body_sha FROM
        (SELECT * FROM traces WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-09' ORDER BY timestamp, id LIMIT 1000) p"""
    ),
)
def export_with_bodies(spark, sf):
    t = derived.traces(spark, sf)
    bodies = t.filter("response_status >= 400").select(F.col("id").alias("trace_id"), F.sha2("metadata", 256).alias("body_sha"))
    page = paging.export_page(t, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9), 1000).select("id", "timestamp")
    return joins.export_with_bodies(page, bodies)


@query("j2_bodies_visible", on_traces("SELECT id AS trace_id, length(metadata) AS size FROM traces WHERE org_id = 'org-2'"))
def bodies_visible(spark, sf):
    bodies = derived.raw_traces(spark, sf).select(F.col("id").alias("trace_id"), F.length("metadata").alias("size"))
    return filters.bodies_of(bodies, filters.visible_to(derived.traces(spark, sf), "org-2"))


@query(
    "j3_orphans",
    """SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)""",
)
def orphans(spark, sf):
    known = derived.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"))
    return derived.table(spark, sf, "labels").select("doc_id").join(known, "doc_id", "left_anti")


def prices(spark, sf):
    """Price table with exact names and prefixes of the models in the traces."""
    rows = [
        ("openai", 0, True, "gpt-4o", 0.005, 0.015),
        ("openai", 1, True, "gpt-4o-mini", 0.00015, 0.0006),
        ("anthropic", 2, True, "claude-opus-4-1", 0.015, 0.075),
        ("anthropic", 3, True, "claude-sonnet-4-20250514", 0.003, 0.015),
        ("anthropic", 4, False, "claude-opus-4-", 0.015, 0.075),
        ("anthropic", 5, False, "claude-3-opus-", 0.015, 0.075),
        ("anthropic", 6, False, "claude-3-haiku-", 0.00025, 0.00125),
    ]
    return spark.createDataFrame(rows, "provider string, pos int, exact boolean, pattern string, input_per_1k double, output_per_1k double")


@query(
    "j4_price_join",
    with_tables(
        """SELECT t.id, p.pattern AS price_pattern, round(coalesce(t.input_tokens / 1000.0::DOUBLE * p.input_per_1k + t.output_tokens / 1000.0::DOUBLE * p.output_per_1k, 0), 8) AS cost
        FROM traces t LEFT JOIN prices p ON p.provider = t.provider AND CASE WHEN p.provider = 'openai' THEN p.pattern = t.model
          WHEN p.exact THEN p.pattern = lower(trim(t.model)) ELSE starts_with(lower(trim(t.model)), p.pattern) END
        QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY p.exact DESC, p.pos) = 1""",
        "traces",
        "prices",
    ),
)
def price_join_query(spark, sf):
    t = derived.raw_traces(spark, sf).select("id", "provider", "model", "input_tokens", "output_tokens")
    priced = price_join(t, prices(spark, sf))
    cost = cost_of(F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_1k"), F.col("output_per_1k"))
    return priced.select("id", "price_pattern", F.round(cost, 8).alias("cost"))


_ROUTED = "CASE WHEN starts_with(request_path, '/openai/') THEN 'openai' WHEN starts_with(request_path, '/anthropic/') THEN 'anthropic' WHEN request_path = '/llm' OR starts_with(request_path, '/llm/') THEN 'aaa' ELSE 'unknown' END"


@query("j5_route_join", on_traces(f"SELECT id, {_ROUTED} AS route_provider FROM traces"))
def route_join(spark, sf):
    routes = spark.createDataFrame([("openai", "openai/"), ("anthropic", "/anthropic"), ("llm", "/llm"), ("aaa", " /llm/ ")], "name string, prefix string")
    return joins.route_join(derived.traces(spark, sf).select("id", "request_path"), routes).select("id", "route_provider")


@query("j5_route_case", on_traces(f"SELECT id, {_ROUTED} AS route_provider FROM traces"))
def route_case(spark, sf):
    routes = {"openai": "openai/", "anthropic": "/anthropic", "llm": "/llm", "aaa": " /llm/ "}
    return derived.traces(spark, sf).select("id", provider_of_path(F.col("request_path"), routes).alias("route_provider"))


@query(
    "j7_key_identity_join",
    with_tables(
        """SELECT t.id, k.id AS key_id, k.org_id AS key_org_id, k.workspace_id AS key_workspace_id, k.role AS key_role FROM traces t
        LEFT JOIN (SELECT * FROM access_keys WHERE revoked_at IS NULL) k ON k.token_hash = json_extract_string(t.metadata, '$.lineage_thread_id')""",
        "traces",
        "access_keys",
    ),
)
def key_identity(spark, sf):
    requests = derived.traces(spark, sf).select("id", F.get_json_object("metadata", "$.lineage_thread_id").alias("token_hash"))
    return joins.key_identity(requests, derived.access_keys(spark, sf)).drop("token_hash")


POLICIES = (
    PolicyRule("by-provider/v1", "block", provider="openai", route_prefix="/openai"),
    PolicyRule("strict/v1", "redact_upstream", org_id="org-1", workspace_id="ws-2", provider="openai", route_prefix="/openai/v1/chat"),
    PolicyRule("org/v1", "off", org_id="org-1"),
    PolicyRule("llm/v1", "redact_storage", route_prefix="/llm"),
    PolicyRule("llm-responses/v1", "block", route_prefix="/llm/v1/"),
)
FALLBACK = PolicyRule("global/v1", "redact_storage")
POLICY_SQL = """CASE WHEN provider = 'openai' AND org_id = 'org-1' AND workspace_id = 'ws-2' THEN 'redact_upstream|strict/v1'
  WHEN provider = 'openai' THEN 'block|by-provider/v1' WHEN starts_with(request_path, '/llm/v1/') THEN 'block|llm-responses/v1'
  WHEN request_path = '/llm' THEN 'redact_storage|llm/v1' WHEN org_id = 'org-1' THEN 'off|org/v1' ELSE 'redact_storage|global/v1' END"""


@query("j8_pii_policy_match", on_traces(f"SELECT id, split_part({POLICY_SQL}, '|', 1) AS pii_mode, split_part({POLICY_SQL}, '|', 2) AS pii_policy_id FROM traces"))
def pii_policy_match(spark, sf):
    t = derived.traces(spark, sf)
    found = joins.policy_columns(POLICIES, FALLBACK, F.col("org_id"), F.col("workspace_id"), F.col("access_key_id"), F.col("provider"), F.col("request_path"))
    return t.select("id", *[c.alias(n) for n, c in found.items()])


# One rule a customer: which selectors it names, and their values, follow from its key.
_RULES = """rules AS (SELECT c_custkey AS pos, 'rule-' || c_custkey AS policy_id, 'mode-' || c_custkey % 3 AS mode, CASE WHEN c_custkey % 2 = 0 THEN 'org-' || c_custkey % 5 END AS org_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'ws-' || c_custkey % 7 END AS workspace_id, CASE WHEN c_custkey % 5 = 0 THEN 'gk-' || c_custkey % 40 END AS key_id,
  CASE WHEN c_custkey % 7 = 0 THEN ['azure', 'openai', 'anthropic', 'llm'][CAST(c_custkey % 4 AS INT) + 1] END AS provider,
  CASE c_custkey % 4 WHEN 1 THEN '/llm' WHEN 2 THEN '/openai/v1' WHEN 3 THEN '/anthropic/v1/messages' END AS prefix FROM customer),
  asked AS (SELECT DISTINCT org_id, workspace_id, access_key_id, provider, request_path FROM traces),
  best AS (SELECT a.*, r.policy_id, r.mode FROM asked a JOIN rules r ON (r.org_id IS NULL OR r.org_id = a.org_id) AND (r.workspace_id IS NULL OR r.workspace_id = a.workspace_id)
      AND (r.key_id IS NULL OR r.key_id = a.access_key_id) AND (r.provider IS NULL OR r.provider = a.provider) AND (r.prefix IS NULL OR a.request_path = r.prefix OR starts_with(a.request_path, r.prefix || '/'))
    QUALIFY row_number() OVER (PARTITION BY a.org_id, a.workspace_id, a.access_key_id, a.provider, a.request_path
      ORDER BY (r.org_id IS NULL)::INT + (r.workspace_id IS NULL)::INT + (r.key_id IS NULL)::INT + (r.provider IS NULL)::INT + (r.prefix IS NULL)::INT, length(coalesce(r.prefix, '')) DESC, r.pos) = 1)"""


def rule_table(customers):
    k = F.col("c_custkey")

    def named(every, name, values):
        return F.when(k % every == 0, F.concat(F.lit(name), (k % values).cast("string")))

    providers = F.element_at(F.array(*map(F.lit, ("azure", "openai", "anthropic", "llm"))), (k % 4).cast("int") + 1)
    prefixes = F.element_at(F.array(*map(F.lit, (" ", "/llm/", "openai/v1", "/anthropic/v1/messages"))), (k % 4).cast("int") + 1)
    return customers.select(
        k.alias("pos"), F.concat(F.lit("rule-"), k.cast("string")).alias("policy_id"), F.concat(F.lit("mode-"), (k % 3).cast("string")).alias("mode"),
        named(2, "org-", 5).alias("org_id"), named(3, " ws-", 7).alias("workspace_id"), named(5, "gk-", 40).alias("key_id"), F.when(k % 7 == 0, providers).alias("provider"), prefixes.alias("route_prefix"),
    )


@query(
    "j8_policy_join",
    on_traces(
        f"""WITH {_RULES} SELECT t.id, coalesce(b.mode, 'redact_storage') AS pii_mode, coalesce(b.policy_id, 'global/v1') AS pii_policy_id
        FROM traces t LEFT JOIN best b USING (org_id, workspace_id, access_key_id, provider, request_path)"""
    ),
)
def policy_join_query(spark, sf):
    """As many rules as there are customers."""
    found = joins.policy_join(derived.traces(spark, sf), rule_table(derived.table(spark, sf, "customer")), FALLBACK)
    return found.select("id", "pii_mode", "pii_policy_id")


@query(
    "j10_correlation_join",
    """SELECT 'tr_' || e.event_id AS id, p.page_id AS log_line FROM events e JOIN pages p ON p.page_id % 400 = e.user_id
    WHERE e.event_type IN ('error', 'purchase')""",
)
def correlation_join(spark, sf):
    note = F.when(
        F.col("event_type").isin("error", "purchase"), F.to_json(F.struct(F.concat(F.lit(" corr-"), F.col("user_id").cast("string")).alias("correlation_id")))
    ).otherwise(F.lit("{}"))
    t = derived.table(spark, sf, "events").select(F.concat(F.lit("tr_"), F.col("event_id").cast("string")).alias("id"), note.alias("metadata"))
    logs = derived.table(spark, sf, "pages").select(
        F.concat(F.lit("corr-"), (F.col("page_id") % 400).cast("string")).alias("correlation_id"), F.col("page_id").alias("log_line")
    )
    return joins.correlate(t, logs).select("id", "log_line")
