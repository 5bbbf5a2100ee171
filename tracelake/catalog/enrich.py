"""Column jobs over paths, headers, metadata and bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.catalog.sql import on_traces, with_tables
from tracelake.functions import content, http, metadata, payloads, text
from tracelake.functions.pricing import estimate_cost
from tracelake.functions.privacy import telemetry_label
from tracelake.operators.lineage import lineage_columns
from tracelake.plans.build_trace import build_traces, metadata_document
from tracelake.registry import query
from tracelake.schema import ttft_ms, ttft_us
from tracelake.sources import derived

PREFIXES = ("/openai", "anthropic/", "/llm", "/", "/llm")
ROUTES = {"openai": "/openai", "anthropic": "/anthropic", "llm": "/llm"}


@query(
    "e1_normalize_path_prefix",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '/p' || page_id WHEN 2 THEN '/p' || page_id WHEN 3 THEN '/p/' || page_id ELSE '' END AS prefix FROM pages""",
)
def normalize_prefix(spark, sf):
    page = F.col("page_id").cast("string")
    raw = (
        F.when(F.col("page_id") % 5 == 0, F.lit(" \t"))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("p"), page, F.lit("//")))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit(" /p"), page, F.lit("\n")))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("/p/"), page, F.lit("/")))
        .otherwise(F.lit("//"))
    )
    return derived.table(spark, sf, "pages").select("page_id", text.normalize_prefix(raw).alias("prefix"))


@query(
    "e2_split_route",
    on_traces(
        """SELECT id, CASE WHEN starts_with(request_path, '/openai/') THEN '/openai' WHEN starts_with(request_path, '/anthropic/') THEN '/anthropic'
        WHEN request_path = '/llm' OR starts_with(request_path, '/llm/') THEN '/llm' ELSE '' END AS provider_prefix,
        CASE WHEN request_path = '/llm' THEN '/' WHEN starts_with(request_path, '/llmish') THEN request_path ELSE regexp_replace(request_path, '^/(openai|anthropic|llm)', '') END AS endpoint FROM traces"""
    ),
)
def split_route(spark, sf):
    path = F.col("request_path")
    return derived.traces(spark, sf).select(
        "id", text.matched_prefix(path, PREFIXES).alias("provider_prefix"), text.endpoint_of(path, PREFIXES).alias("endpoint")
    )


@query(
    "e3_distinct_prefixes",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/a|/p' || page_id ELSE '/p' || page_id || '|/a' END AS prefixes FROM pages""",
)
def distinct_prefixes(spark, sf):
    own = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    listed = F.when(
        F.col("page_id") % 3 == 0, F.array(F.lit("a/"), F.lit(""), own, F.lit("/a"))
    ).otherwise(F.array(own, F.lit(" /"), F.concat(F.lit("/"), own, F.lit("/")), F.lit("a")))
    return derived.table(spark, sf, "pages").select("page_id", F.array_join(text.distinct_prefixes(listed), "|").alias("prefixes"))


@query(
    "e4_route_pattern",
    on_traces(
        """SELECT id, CASE WHEN request_path = '/llm' OR starts_with(request_path, '/llm/') THEN '/llm/*' WHEN starts_with(request_path, '/openai/') THEN '/openai/*'
        WHEN starts_with(request_path, '/anthropic/') THEN '/anthropic/*' ELSE '/other' END AS route FROM traces"""
    ),
)
def route_pattern(spark, sf):
    return derived.traces(spark, sf).select("id", text.route_pattern(F.col("request_path")).alias("route"))


def on_exchanges(sql: str) -> str:
    return with_tables(sql, "exchanges")


@query("e5_user_agent", on_exchanges("SELECT exchange_id, 'agent/' || conv_id || ', sdk' AS user_agent FROM exchanges"))
def user_agent(spark, sf):
    x = derived.exchanges(spark, sf).select("exchange_id", F.to_json("request_headers").alias("raw"))
    return x.select("exchange_id", http.user_agent("raw").alias("user_agent"))


@query(
    "e6_redact_headers",
    on_exchanges(
        """SELECT exchange_id, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS redacted,
        'corr.' || conv_id AS kept FROM exchanges"""
    ),
)
def redact_headers(spark, sf):
    x = derived.exchanges(spark, sf).select("exchange_id", http.redact_headers().alias("h"))
    hidden = F.size(F.filter(F.map_values("h"), lambda v: v[0] == http.REDACTED))
    return x.select("exchange_id", hidden.alias("redacted"), F.col("h")["X-Correlation-ID"][0].alias("kept"))


@query(
    "e7_api_key_identity",
    on_exchanges(
        """WITH k AS (SELECT exchange_id, CASE conv_id % 4 WHEN 0 THEN 'sk-test-' || conv_id WHEN 1 THEN 'key-' || conv_id WHEN 2 THEN 'Basic ' || conv_id ELSE '' END AS key FROM exchanges)
        SELECT exchange_id, CASE WHEN key = '' THEN '' ELSE sha256(key) END AS api_key_hash, right(key, 4) AS api_key_last4 FROM k"""
    ),
)
def api_key_identity(spark, sf):
    x = derived.exchanges(spark, sf).select("exchange_id", http.api_key().alias("key"))
    return x.select("exchange_id", http.key_hash(F.col("key")).alias("api_key_hash"), http.last4(F.col("key")).alias("api_key_last4"))


@query(
    "e8_ttft_units",
    on_traces("SELECT id, time_to_first_token_ms AS ms, time_to_first_token_us AS us FROM traces"),
)
def ttft_units(spark, sf):
    us, ms = F.col("time_to_first_token_us"), F.col("time_to_first_token_ms")
    return derived.raw_traces(spark, sf).select("id", ttft_ms(us, ms).alias("ms"), ttft_us(us, ms).alias("us"))


@query("e9_order_time", on_traces("SELECT id, CASE WHEN response_status >= 400 THEN timestamp ELSE created_at END AS order_time FROM traces"))
def order_time(spark, sf):
    created = F.when(F.col("response_status") < 400, F.col("created_at"))
    return derived.traces(spark, sf).select("id", F.coalesce(created, "timestamp").alias("order_time"))


_METADATA_CASES = {
    0: '{"s":" a b ","n":12.9,"b":true}',
    1: '{"s":5,"n":" 7 ","b":"FALSE"}',
    2: '{"s":null,"n":"1.5","b":1}',
    3: "not json",
    4: '{"n":-3,"b":" true "}',
}


@query(
    "e10_metadata_fields",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a b' ELSE '' END AS s, CASE event_id % 5 WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 4 THEN -3 END AS n,
       CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true END AS b FROM events""",
)
def metadata_fields(spark, sf):
    raw = F.element_at(F.array(*[F.lit(v) for v in _METADATA_CASES.values()]), (F.col("event_id") % 5 + 1).cast("int"))
    doc = metadata.parse(raw)
    return derived.table(spark, sf, "events").select(
        "event_id", metadata.doc_string(doc, "s").alias("s"), metadata.doc_long(doc, "n").alias("n"), metadata.doc_bool(doc, "b").alias("b")
    )


@query(
    "e11_lineage_columns",
    on_traces(
        """SELECT id, trace_group_id AS group_id, json_extract_string(metadata, '$.lineage_thread_id') AS thread_id, json_extract_string(metadata, '$.lineage_run_id') AS run_id,
        id AS checkpoint_id, '' AS parent_checkpoint_id, CAST(coalesce(json_extract_string(metadata, '$.lineage_checkpoint_seq'), '0') AS BIGINT) AS checkpoint_seq, true AS immutable FROM traces"""
    ),
)
def lineage_fields(spark, sf):
    t = derived.traces(spark, sf)
    return t.select("id", *[c.alias(n) for n, c in lineage_columns().items()])


@query(
    "e12_lineage_from_headers",
    on_exchanges(
        """SELECT exchange_id, 'conv-' || conv_id AS lineage_group_id, 'th-' || conv_id AS lineage_thread_id, '' AS lineage_run_id,
        CASE WHEN turn > 1 THEN 'ex_' || conv_id || '_' || (turn - 2) ELSE '' END AS lineage_parent_checkpoint_id,
        CASE WHEN conv_id % 6 = 5 OR turn < 2 THEN NULL ELSE turn - 2 END AS lineage_checkpoint_seq FROM exchanges"""
    ),
)
def lineage_from_headers(spark, sf):
    return derived.exchanges(spark, sf).select("exchange_id", *[c.alias(n) for n, c in http.lineage_columns().items()])


@query(
    "e13_correlation_id",
    on_exchanges("SELECT exchange_id, CASE WHEN conv_id % 3 = 2 THEN 'req:' || conv_id ELSE 'corr.' || conv_id END AS correlation_id FROM exchanges"),
)
def correlation_id(spark, sf):
    return derived.exchanges(spark, sf).select("exchange_id", http.correlation_id().alias("correlation_id"))


@query(
    "e14_build_metadata",
    """SELECT event_id, event_type = 'view' AS streaming, CASE WHEN user_id % 2 = 0 THEN 'th-' || user_id END AS thread, CASE WHEN event_id % 3 = 0 THEN event_id % 11 END AS seq,
       CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + 1 AS keys FROM events""",
)
def build_metadata(spark, sf):
    built = metadata_document(
        {
            "streaming": F.col("event_type") == "view",
            "lineage_thread_id": F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("th-"), F.col("user_id").cast("string"))),
            "lineage_checkpoint_seq": F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 11),
        }
    )
    m = derived.table(spark, sf, "events").select("event_id", built.alias("m"))
    return m.select(
        "event_id",
        (F.get_json_object("m", "$.streaming") == "true").alias("streaming"),
        F.get_json_object("m", "$.lineage_thread_id").alias("thread"),
        F.get_json_object("m", "$.lineage_checkpoint_seq").cast("bigint").alias("seq"),
        F.size(F.json_object_keys("m")).alias("keys"),
    )


@query(
    "e15_extract_model",
    on_exchanges(
        """SELECT exchange_id, CASE fam WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3-haiku-20240307' ELSE '' END AS asked,
        CASE fam WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3-haiku-20240307' ELSE CASE WHEN streaming THEN 'local-model' ELSE 'local-model' END END AS answered FROM exchanges"""
    ),
)
def extract_model(spark, sf):
    x = derived.exchanges(spark, sf).select("exchange_id", "request_body", "response_body", "streaming")
    x = payloads.body_facts(x, "request_body", "false", "ask")
    x = payloads.body_facts(x, "response_body", "streaming", "got")
    return x.select("exchange_id", F.col("ask_model").alias("asked"), F.col("got_model").alias("answered"))


@query(
    "e16_extract_usage",
    on_exchanges("SELECT exchange_id, n_in AS tokens_in, n_out AS tokens_out, n_in + n_out AS tokens_total FROM exchanges WHERE NOT streaming"),
)
def extract_usage(spark, sf):
    x = derived.exchanges(spark, sf).filter("NOT streaming").select("exchange_id", "response_body", "streaming")
    return payloads.body_facts(x, "response_body", "streaming", "tokens").select("exchange_id", "tokens_in", "tokens_out", "tokens_total")


@query(
    "e17_merge_stream_usage",
    on_exchanges("SELECT exchange_id, n_in AS tokens_in, n_out AS tokens_out, n_in + n_out AS tokens_total FROM exchanges WHERE streaming"),
)
def merge_stream_usage(spark, sf):
    x = derived.exchanges(spark, sf).filter("streaming").select("exchange_id", "response_body", "streaming")
    return payloads.body_facts(x, "response_body", "streaming", "tokens").select("exchange_id", "tokens_in", "tokens_out", "tokens_total")


_PIECES = "len(string_split(answer, chr(10)))"


@query(
    "e18_sse_payloads",
    on_exchanges(
        f"SELECT exchange_id, {_PIECES} + CASE fam WHEN 1 THEN 2 ELSE 1 END AS payloads FROM exchanges WHERE streaming"
    ),
)
def sse_payloads(spark, sf):
    return derived.exchanges(spark, sf).filter("streaming").select("exchange_id", F.size(payloads.sse_payloads("response_body")).alias("payloads"))


@query(
    "e19_sse_events",
    on_exchanges(
        f"""SELECT exchange_id, CASE fam WHEN 0 THEN '' WHEN 1 THEN 'content_block_delta' ELSE 'response.output_text.delta' END AS event,
        {_PIECES} + CASE fam WHEN 0 THEN 1 ELSE 0 END AS events FROM exchanges WHERE streaming
        UNION ALL SELECT exchange_id, unnest(CASE fam WHEN 1 THEN ['message_start', 'message_delta'] ELSE ['response.completed'] END), 1 FROM exchanges WHERE streaming AND fam <> 0"""
    ),
)
def sse_events(spark, sf):
    x = derived.exchanges(spark, sf).filter("streaming").select("exchange_id", F.explode(payloads.sse_events("response_body")).alias("e"))
    return x.groupBy("exchange_id", F.col("e.event").alias("event")).agg(F.count(F.lit(1)).cast("bigint").alias("events"))


@query(
    "e20_stream_delta_tokens",
    on_exchanges("SELECT exchange_id, CASE WHEN streaming THEN CASE fam WHEN 2 THEN 0 ELSE n_out END ELSE CASE fam WHEN 2 THEN 0 ELSE n_out END END AS delta_tokens FROM exchanges"),
)
def stream_delta_tokens(spark, sf):
    return derived.exchanges(spark, sf).select("exchange_id", payloads.chunk_delta_tokens("response_body").alias("delta_tokens"))


@query("e21_estimate_cost", on_traces("SELECT id, round(estimated_cost_usd, 8) AS cost FROM traces"))
def estimate_cost_query(spark, sf):
    cost = estimate_cost(F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return derived.raw_traces(spark, sf).select("id", F.round(cost, 8).alias("cost"))


@query("e22_request_prompt", on_exchanges("SELECT exchange_id, nullif(trim(question), '') AS prompt FROM exchanges"))
def request_prompt(spark, sf):
    return derived.exchanges(spark, sf).select("exchange_id", payloads.request_prompt("request_body").alias("prompt"))


@query(
    "e22_prompt_per_conversation",
    "SELECT conv_id, max_by(text, turn) AS llm_request_prompt, max(turn) AS last_user_turn FROM conversations WHERE role = 'user' GROUP BY conv_id",
)
def prompt_per_conversation(spark, sf):
    return (
        derived.table(spark, sf, "conversations")
        .filter("role = 'user'")
        .groupBy("conv_id")
        .agg(F.max_by("text", "turn").alias("llm_request_prompt"), F.max("turn").alias("last_user_turn"))
    )


def _socket_body(x):
    """The same exchange as captured socket messages: the question goes up in one of four shapes."""
    ask = F.col("question")
    item = F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), ask.alias("text"))).alias("content"))
    shapes = [
        F.to_json(F.struct(F.lit("conversation.item.create").alias("type"), item.alias("item"))),
        F.to_json(F.struct(F.lit("turn/start").alias("method"), F.struct(F.array(F.struct(ask.alias("text"))).alias("input")).alias("params"))),
        F.to_json(F.struct(F.lit("response.create").alias("type"), F.struct(ask.alias("input")).alias("response"))),
        F.to_json(F.struct(ask.alias("input"))),
    ]
    sent = F.element_at(F.array(*shapes), (F.col("turn") % 4 + 1).cast("int"))
    noise = F.lit('{"direction":"upstream_to_client","opcode":"text","payload":{"input":"not mine"}}')
    end = F.lit(',{"direction":"client_to_upstream","opcode":"text","payload":"{\\"type\\":\\"response.create\\"}"}')
    return F.concat(F.lit('[{"direction":"client_to_upstream","opcode":"text","payload":'), sent, F.lit("},"), noise, end, F.lit("]"))


@query("e23_request_prompt_ws", on_exchanges("SELECT exchange_id, nullif(trim(question), '') AS prompt FROM exchanges"))
def request_prompt_ws(spark, sf):
    x = derived.exchanges(spark, sf)
    return x.withColumn("b", _socket_body(x)).select("exchange_id", payloads.request_prompt("b").alias("prompt"))


@query(
    "e24_response_content",
    on_exchanges(
        """SELECT exchange_id, 1 AS parts, 'text' AS type, CASE fam WHEN 0 THEN 'openai_chat' WHEN 1 THEN 'anthropic' ELSE 'openai_response' END AS source, answer AS text FROM exchanges"""
    ),
)
def response_content(spark, sf):
    x = derived.exchanges(spark, sf).select("exchange_id", "response_body", "streaming")
    p = content.add_response_parts(x, "response_body", "streaming", "p")
    return p.select("exchange_id", F.size("p").alias("parts"), F.col("p")[0]["type"].alias("type"), F.col("p")[0]["source"].alias("source"), F.col("p")[0]["text"].alias("text"))


@query(
    "e25_response_event_category",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'output_text' WHEN 'click' THEN 'thinking' WHEN 'signup' THEN 'tool_call_arguments' WHEN 'purchase' THEN 'mcp_call_arguments' ELSE 'response.error' END AS category FROM events""",
)
def response_event_category(spark, sf):
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", F.lit("response.output_text.delta"))
        .when(kind == "click", F.lit("response.reasoning_summary_text.delta"))
        .when(kind == "signup", F.lit("response.function_call_arguments.done"))
        .when(kind == "purchase", F.lit("response.mcp_call_arguments.delta"))
        .otherwise(F.lit("response.error"))
    )
    return derived.table(spark, sf, "events").select("event_id", name.alias("e")).select("event_id", content.event_category("e").alias("category"))


@query(
    "e26_sanitize_label",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN lang WHEN 2 THEN '[CREDENTIAL_REDACTED]' ELSE 'm [CREDENTIAL_REDACTED]' END AS label FROM documents""",
)
def sanitize_label(spark, sf):
    doc = F.col("doc_id")
    raw = (
        F.when(doc % 4 == 0, F.lit(" \n"))
        .when(doc % 4 == 1, F.concat(F.lit(" "), F.col("lang")))
        .when(doc % 4 == 2, F.concat(F.lit("sk_live-"), F.lpad(doc.cast("string"), 12, "0")))
        .otherwise(F.concat(F.lit("m Bearer abcdefgh"), doc.cast("string")))
    )
    return derived.table(spark, sf, "documents").select("doc_id", telemetry_label(raw).alias("label"))


@query(
    "e27_truncate_body",
    """WITH b AS (SELECT doc_id, encode(text) AS data FROM documents)
    SELECT doc_id, octet_length(data) AS size_bytes, octet_length(data) > 2048 AS truncated, sha256(data[1:2048]) AS sha256 FROM b""",
)
def truncate_body(spark, sf):
    from tracelake.functions.bodies import truncated

    cut = truncated(F.col("text").cast("binary"), 2048)
    return derived.table(spark, sf, "documents").select("doc_id", *[cut[n].alias(n) for n in ("size_bytes", "truncated", "sha256")])


@query(
    "e28_queue_pressure_state",
    """WITH g AS (SELECT 'gw-' || (user_id % 4) AS instance, least(CAST(floor(value * 20) AS INT), 1024) AS depth, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS dropped FROM events)
    SELECT instance, max(depth) AS high_watermark, CASE WHEN max(depth) >= 1024 THEN 100 ELSE max(depth) * 100 // 1024 END AS utilization_pct,
      CASE WHEN max(depth) >= 1024 THEN 'saturated' WHEN max(depth) * 100 // 1024 >= 80 THEN 'high' WHEN max(depth) * 100 // 1024 >= 50 THEN 'elevated' ELSE 'ok' END AS state,
      CAST(sum(dropped) AS BIGINT) AS dropped_total FROM g GROUP BY instance""",
)
def queue_pressure(spark, sf):
    g = derived.queue_gauges(spark, sf)
    per = g.groupBy("instance").agg(F.max("depth").alias("high_watermark"), F.max("capacity").alias("capacity"), F.sum("dropped").alias("dropped_total"))
    share = text.queue_utilization(F.col("high_watermark"), F.col("capacity"))
    return per.select("instance", "high_watermark", share.alias("utilization_pct"), text.pressure_state(share).alias("state"), "dropped_total")


@query("e29_detect_streaming", on_exchanges("SELECT exchange_id, streaming FROM exchanges"))
def detect_streaming(spark, sf):
    return derived.exchanges(spark, sf).select("exchange_id", http.is_event_stream().alias("streaming"))


@query(
    "e30_build_trace",
    on_exchanges(
        """SELECT exchange_id AS id, 'conv-' || conv_id AS trace_group_id, 'default' AS org_id, started_at AS timestamp,
        CASE fam WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'llm' END AS provider,
        CASE fam WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3-haiku-20240307' ELSE 'local-model' END AS model,
        n_in AS input_tokens, n_out AS output_tokens, n_in + n_out AS total_tokens, n_out * 3 AS latency_ms,
        CASE WHEN streaming THEN (n_out * 7 + 999) // 1000 ELSE 0 END AS time_to_first_token_ms,
        round(CASE fam WHEN 0 THEN n_in / 1000.0::DOUBLE * 0.005 + n_out / 1000.0::DOUBLE * 0.015 WHEN 1 THEN n_in / 1000.0::DOUBLE * 0.00025 + n_out / 1000.0::DOUBLE * 0.00125 ELSE 0 END, 8) AS estimated_cost_usd,
        CASE conv_id % 4 WHEN 0 THEN sha256('sk-test-' || conv_id) WHEN 1 THEN sha256('key-' || conv_id) WHEN 2 THEN sha256('Basic ' || conv_id) ELSE '' END AS api_key_hash,
        CASE WHEN turn > 1 THEN 'ex_' || conv_id || '_' || (turn - 2) END AS parent FROM exchanges"""
    ),
)
def build_trace(spark, sf):
    t = build_traces(derived.exchanges(spark, sf), ROUTES)
    return t.select(
        "id", "trace_group_id", "org_id", "timestamp", "provider", "model", "input_tokens", "output_tokens", "total_tokens", "latency_ms",
        "time_to_first_token_ms", F.round("estimated_cost_usd", 8).alias("estimated_cost_usd"), "api_key_hash",
        F.get_json_object("metadata", "$.lineage_parent_checkpoint_id").alias("parent"),
    )


@query(
    "e31_json_or_raw",
    """SELECT event_id, CASE event_id % 5 WHEN 3 THEN 'STRING' ELSE 'OBJECT' END AS kind, CASE WHEN event_id % 5 = 3 THEN 'not json' END AS raw_view FROM events""",
)
def json_or_raw(spark, sf):
    raw = F.element_at(F.array(*[F.lit(v) for v in _METADATA_CASES.values()]), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.regexp_extract(F.schema_of_variant(metadata.json_or_raw(raw)), "^[A-Z]+", 0)
    view = F.try_variant_get(metadata.metadata_view(raw), "$.raw", "string")
    return derived.table(spark, sf, "events").select("event_id", kind.alias("kind"), view.alias("raw_view"))
