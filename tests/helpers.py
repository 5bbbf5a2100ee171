"""Small trace rows for tests."""

import datetime as dt
import json

from tracelake.schema import TRACE_SCHEMA

BASE = dt.datetime(2026, 2, 12, 2, 0, 0)


def at(seconds: float) -> dt.datetime:
    return BASE + dt.timedelta(seconds=seconds)


def trace(row_id: str, seconds: float = 0, **fields) -> dict:
    row = {f.name: None for f in TRACE_SCHEMA.fields}
    row.update(id=row_id, org_id="default", workspace_id="default", timestamp=at(seconds), created_at=at(seconds), metadata="{}")
    row.update(provider="openai", model="m", request_method="POST", request_path="/llm", response_status=200, api_key_hash="", access_key_id="")
    row.update(input_tokens=0, output_tokens=0, total_tokens=0, latency_ms=0, time_to_first_token_ms=0, time_to_first_token_us=0, estimated_cost_usd=0.0, trace_group_id="")
    meta = fields.pop("meta", None)
    if meta is not None:
        row["metadata"] = json.dumps(meta)
    row.update(fields)
    return row


def traces(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(r[n] for n in TRACE_SCHEMA.fieldNames()) for r in rows], TRACE_SCHEMA)


def dicts(df, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
