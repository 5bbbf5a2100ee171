"""The trace table's columns, ingest defaults and upgrades of older layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.metadata import meta_string
from tracelake.functions.text import blank_to_null

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("trace_group_id", T.StringType()),
        T.StructField("org_id", T.StringType()),
        T.StructField("workspace_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("request_method", T.StringType()),
        T.StructField("request_path", T.StringType()),
        T.StructField("request_headers", T.StringType()),
        T.StructField("request_body", T.StringType()),
        T.StructField("response_status", T.IntegerType()),
        T.StructField("response_headers", T.StringType()),
        T.StructField("response_body", T.StringType()),
        T.StructField("llm_request_prompt", T.StringType()),
        T.StructField("llm_response_content", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("total_tokens", T.IntegerType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("time_to_first_token_ms", T.LongType()),
        T.StructField("time_to_first_token_us", T.LongType()),
        T.StructField("api_key_hash", T.StringType()),
        T.StructField("access_key_id", T.StringType()),
        T.StructField("estimated_cost_usd", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Names of the key id, as a column and in metadata; a caller with an older store passes its names after this one.
KEY_NAMES = ("access_key_id",)

# Heavy text columns that a listing leaves out.
BODY_COLUMNS = ("request_body", "response_body", "llm_request_prompt", "llm_response_content")

TRACE_BODY_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("request_body_gzip", T.BinaryType()),
        T.StructField("response_body_gzip", T.BinaryType()),
        T.StructField("request_body_size_bytes", T.LongType()),
        T.StructField("response_body_size_bytes", T.LongType()),
        T.StructField("request_body_compressed_size_bytes", T.LongType()),
        T.StructField("response_body_compressed_size_bytes", T.LongType()),
        T.StructField("request_body_sha256", T.StringType()),
        T.StructField("response_body_sha256", T.StringType()),
        T.StructField("request_body_truncated", T.BooleanType()),
        T.StructField("response_body_truncated", T.BooleanType()),
        T.StructField("pii_status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

EXCHANGE_SCHEMA = T.StructType(
    [
        T.StructField("exchange_id", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("request_headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("response_headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("request_body", T.StringType()),
        T.StructField("response_body", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("streaming", T.BooleanType()),
        T.StructField("stream_chunks", T.IntegerType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("time_to_first_token_ms", T.LongType()),
        T.StructField("time_to_first_token_us", T.LongType()),
        T.StructField("correlation_id", T.StringType()),
    ]
)


def _default_for(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.lit("")
    if isinstance(field.dataType, T.DoubleType):
        return F.lit(0.0)
    return F.lit(0).cast(field.dataType)


def scan_defaults(df: DataFrame) -> DataFrame:
    """Readers never see NULL text or numbers: text becomes '' and numbers 0."""
    known = {f.name: f for f in TRACE_SCHEMA.fields if not isinstance(f.dataType, T.TimestampType)}
    return df.select(
        *[F.coalesce(F.col(c), _default_for(known[c])).alias(c) if c in known else F.col(c) for c in df.columns]
    )


def conform(df: DataFrame, key_names: Sequence[str] = KEY_NAMES) -> DataFrame:
    """Bring an older layout to the full column list, in order.

    Missing columns appear as NULL; a missing or NULL ``access_key_id`` is filled from the
    metadata document. ``key_names`` are the names under which a store may hold it, preferred ones first.
    """
    have = set(df.columns)
    columns: list[Column] = []
    for field in TRACE_SCHEMA.fields:
        if field.name == "access_key_id":
            from_meta = F.coalesce(*[blank_to_null(meta_string(F.col("metadata"), n)) for n in key_names])
            current = next((F.col(n) for n in key_names if n in have), F.lit(None).cast("string"))
            columns.append(F.coalesce(current, from_meta if "metadata" in have else F.lit(None)).alias("access_key_id"))
        elif field.name in have:
            columns.append(F.col(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in (*TRACE_SCHEMA.fieldNames(), *key_names)]
    return df.select(*columns, *extra)


def ttft_ms(us: Column, ms: Column) -> Column:
    """Milliseconds to first token, rounded up from microseconds where only those are known."""
    rounded = F.floor((us + F.lit(999)) / F.lit(1000)).cast("bigint")
    return F.when((us > 0) & (ms <= 0), rounded).when(ms > 0, ms).otherwise(F.lit(0).cast("bigint"))


def ttft_us(us: Column, ms: Column) -> Column:
    return F.when(us > 0, us).when(ms > 0, ms * 1000).otherwise(F.lit(0).cast("bigint"))


def normalize(df: DataFrame, key_names: Sequence[str] = KEY_NAMES) -> DataFrame:
    """Ingest defaults. Blank text gets its fallback, a zero total is derived, TTFT units are filled."""

    def fallback(name: str, value: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))

    now = F.current_timestamp()
    us = F.coalesce(F.col("time_to_first_token_us"), F.lit(0).cast("bigint"))
    ms = F.coalesce(F.col("time_to_first_token_ms"), F.lit(0).cast("bigint"))
    tokens_in = F.coalesce(F.col("input_tokens"), F.lit(0))
    tokens_out = F.coalesce(F.col("output_tokens"), F.lit(0))
    changes = {
        "timestamp": F.coalesce(F.col("timestamp"), now.cast(df.schema["timestamp"].dataType)),
        "created_at": F.coalesce(F.col("created_at"), now.cast(df.schema["created_at"].dataType)),
        "model": fallback("model", "unknown"),
        "provider": fallback("provider", "unknown"),
        "org_id": fallback("org_id", "default"),
        "workspace_id": fallback("workspace_id", "default"),
        "request_method": fallback("request_method", "UNKNOWN"),
        "request_path": fallback("request_path", "/"),
        "total_tokens": F.when(F.coalesce(F.col("total_tokens"), F.lit(0)) == 0, tokens_in + tokens_out).otherwise(
            F.col("total_tokens")
        ),
        "time_to_first_token_us": ttft_us(us, ms),
        "time_to_first_token_ms": ttft_ms(us, ms),
    }
    if "access_key_id" in df.columns:
        changes["access_key_id"] = F.coalesce(
            F.nullif(F.col("access_key_id"), F.lit("")), *[meta_string(F.col("metadata"), n) for n in key_names], F.lit("")
        )
    return df.withColumns(changes)
