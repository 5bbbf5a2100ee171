"""Captured exchange -> trace row, and the derived columns filled in later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import http
from tracelake.functions.content import add_response_parts, response_content
from tracelake.functions.payloads import body_facts, request_prompt
from tracelake.functions.pricing import estimate_cost
from tracelake.functions.text import blank_to_null, provider_of_path
from tracelake.operators.filters import redaction_skipped
from tracelake.functions.text import squeeze
from tracelake.schema import ttft_ms, ttft_us

# Default route when nothing is configured.
DEFAULT_ROUTES = {"llm": "/llm"}


def metadata_document(fields: dict[str, Column]) -> Column:
    """Metadata JSON; NULL fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def build_traces(exchanges: DataFrame, routes: dict[str, str] | None = None, capture_bodies: bool = True, header_prefix: str = http.HEADER_PREFIX) -> DataFrame:
    """One projection per exchange: nothing is joined or shuffled.

    Tenant and key are taken from the exchange when it has them. Extra columns are passed through.
    """
    routes = DEFAULT_ROUTES if routes is None else routes
    x = body_facts(exchanges, "request_body", "false", "_ask")
    x = body_facts(x, "response_body", "streaming", "_got")
    lineage = http.lineage_columns("request_headers", header_prefix)
    x = x.withColumns(
        {
            "_key": http.api_key("request_headers"),
            "_provider": provider_of_path(F.col("path"), routes),
            "_model": F.coalesce(F.nullif(F.col("_ask_model"), F.lit("")), F.nullif(F.col("_got_model"), F.lit("")), F.lit("unknown")),
            **{f"_{n}": c for n, c in lineage.items()},
        }
    )
    us = F.coalesce(F.col("time_to_first_token_us"), F.lit(0)).cast("bigint")
    ms = F.coalesce(F.col("time_to_first_token_ms"), F.lit(0)).cast("bigint")

    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name)) if name in exchanges.columns else F.lit(None).cast("int")

    def filled(name: str) -> Column:
        return blank_to_null(F.col(name)) if name in exchanges.columns else F.lit(None).cast("string")

    given = filled("correlation_id")
    metadata = metadata_document(
        {
            "streaming": F.col("streaming"),
            "stream_chunks": F.col("stream_chunks"),
            "lineage_checkpoint_id": F.col("exchange_id"),
            "lineage_immutable": F.lit(True),
            "transport": filled("transport"),
            "websocket_connection_id": filled("websocket_connection_id"),
            "websocket_turn_index": positive("websocket_turn_index"),
            "websocket_turn_start_type": filled("websocket_turn_start_type"),
            "websocket_turn_terminal_type": filled("websocket_turn_terminal_type"),
            "websocket_request_messages": positive("websocket_request_messages"),
            "websocket_response_messages": positive("websocket_response_messages"),
            "websocket_turn_incomplete": F.when(F.col("websocket_turn_incomplete"), F.lit(True))
            if "websocket_turn_incomplete" in exchanges.columns
            else F.lit(None).cast("boolean"),
            "websocket_close_code": positive("websocket_close_code"),
            **{n: F.nullif(F.col(f"_{n}"), F.lit("")) for n in lineage if n != "lineage_checkpoint_seq"},
            "lineage_checkpoint_seq": F.col("_lineage_checkpoint_seq"),
            "api_key_last4": F.nullif(http.last4(F.col("_key")), F.lit("")),
            "correlation_id": F.coalesce(given, F.nullif(http.correlation_id("request_headers", header_prefix), F.lit(""))),
        }
    )
    kept = F.lit(capture_bodies)
    built = {
        "id": F.col("exchange_id"),
        "trace_group_id": F.col("_lineage_group_id"),
        "org_id": F.coalesce(filled("access_org_id"), F.lit("default")),
        "workspace_id": F.coalesce(filled("access_workspace_id"), F.lit("default")),
        "timestamp": F.coalesce(F.col("started_at"), F.current_timestamp().cast(exchanges.schema["started_at"].dataType)),
        "provider": F.col("_provider"),
        "model": F.col("_model"),
        "request_method": F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("UNKNOWN")),
        "request_path": F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("/")),
        "request_headers": http.headers_json(http.redact_headers("request_headers", header_prefix)),
        "request_body": F.when(kept, F.col("request_body")).otherwise(F.lit("")),
        "response_status": F.col("status_code"),
        "response_headers": http.headers_json(http.redact_headers("response_headers", header_prefix)),
        "response_body": F.when(kept, F.col("response_body")).otherwise(F.lit("")),
        "llm_request_prompt": F.lit(None).cast("string"),
        "llm_response_content": F.lit(None).cast("string"),
        "input_tokens": F.col("_got_in").cast("int"),
        "output_tokens": F.col("_got_out").cast("int"),
        "total_tokens": F.col("_got_total").cast("int"),
        "latency_ms": F.col("duration_ms"),
        "time_to_first_token_ms": ttft_ms(us, ms),
        "time_to_first_token_us": ttft_us(us, ms),
        "api_key_hash": http.key_hash(F.col("_key")),
        "access_key_id": F.coalesce(filled("access_key_id"), F.lit("")),
        "estimated_cost_usd": estimate_cost(F.col("_provider"), F.col("_model"), F.col("_got_in"), F.col("_got_out")),
        "metadata": metadata,
        "created_at": F.coalesce(F.col("started_at"), F.current_timestamp().cast(exchanges.schema["started_at"].dataType)),
    }
    return x.select(*[c.alias(n) for n, c in built.items()])


def enrich(traces: DataFrame) -> DataFrame:
    """Fill prompt and response content where a body is there and nothing was derived yet."""
    open_prompt = (squeeze(F.coalesce("request_body", F.lit(""))) != "") & (squeeze(F.coalesce("llm_request_prompt", F.lit(""))) == "")
    open_content = (squeeze(F.coalesce("response_body", F.lit(""))) != "") & (squeeze(F.coalesce("llm_response_content", F.lit(""))) == "")
    usable = ~redaction_skipped(F.col("metadata"))
    streaming = "coalesce(get_json_object(metadata, '$.streaming') = 'true', false)"
    marked = traces.withColumns(
        {"_ask": F.when(open_prompt & usable, F.col("request_body")), "_got": F.when(open_content & usable, F.col("response_body"))}
    )
    found = add_response_parts(marked, "_got", streaming, "_parts")
    return found.withColumns(
        {
            "llm_request_prompt": F.coalesce(request_prompt("_ask"), "llm_request_prompt"),
            "llm_response_content": F.coalesce(response_content(F.col("_parts")), "llm_response_content"),
        }
    ).select(*traces.columns)
