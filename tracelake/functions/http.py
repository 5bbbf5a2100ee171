"""Header maps of captured exchanges. Names are compared without regard to case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import sqltext as q
from tracelake.functions.text import squeeze

HEADER_PREFIX = "X-Trace"

# Headers whose values are never stored.
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key")
REDACTED = "[REDACTED]"

# Longest correlation id, allowed characters, and the headers after the own ones.
CORRELATION_LENGTH = 128
CORRELATION_PATTERN = "^[A-Za-z0-9_.:-]+$"
CORRELATION_HEADERS = ("X-Request-ID", "X-Correlation-ID")

# Suffixes of the lineage headers.
LINEAGE_HEADERS = {
    "lineage_group_id": "Trace-Group-ID",
    "lineage_thread_id": "Thread-ID",
    "lineage_run_id": "Run-ID",
    "lineage_parent_checkpoint_id": "Parent-Checkpoint-ID",
    "lineage_checkpoint_seq": "Checkpoint-Seq",
}


def header(name: str, headers: str = "request_headers") -> Column:
    """First value of a header, '' if it is not there."""
    e = q.fresh("e")
    return F.expr(
        f"coalesce(get(get(filter(map_entries({headers}), {e} -> lower({e}.key) = '{name.lower()}'), 0).value, 0), '')"
    )


def redact_headers(headers: str = "request_headers", prefix: str = HEADER_PREFIX) -> Column:
    names = ", ".join(f"'{n}'" for n in (*SECRET_HEADERS, f"{prefix.lower()}-access-key"))
    return F.expr(f"transform_values({headers}, (k, v) -> if(lower(k) IN ({names}), array('{REDACTED}'), v))")


def headers_json(headers: Column) -> Column:
    return F.coalesce(F.to_json(headers), F.lit("{}"))


def user_agent(raw: str) -> Column:
    """The User-Agent of headers stored as JSON: list values are joined by ', '."""
    listed = q.let(
        q.member("h", "x").replace("try_variant_get(h, '$.x', 'variant')", "h"),
        lambda v: f"""CASE WHEN {q.is_array(v)} THEN array_join(filter(transform({q.items(v)}, x -> {q.filled(q.as_text('x'))}), y -> y IS NOT NULL), ', ')
            ELSE {q.trim(f"try_variant_get({v}, '$', 'string')")} END""",
    )
    entries = f"map_entries(try_variant_get(try_parse_json({raw}), '$', 'map<string,variant>'))"
    return F.expr(f"coalesce(get(transform(filter({entries}, e -> lower(e.key) = 'user-agent'), e -> {listed.replace('array(h)', 'array(e.value)')}), 0), '')")


def api_key(headers: str = "request_headers") -> Column:
    """Provider key of a request: Authorization without 'Bearer ', else X-API-Key."""
    auth = squeeze(header("Authorization", headers))
    bare = F.when(F.lower(auth).startswith("bearer "), squeeze(F.substring(auth, 8, 2**31 - 1))).otherwise(auth)
    return F.when(auth != "", bare).otherwise(squeeze(header("X-API-Key", headers)))


def key_hash(key: Column) -> Column:
    return F.when(key != "", F.sha2(key, 256)).otherwise(F.lit(""))


def last4(key: Column) -> Column:
    """Last four bytes, not characters."""
    data = key.cast("binary")
    size = F.octet_length(key)
    return F.when(size <= 4, key).otherwise(F.substring(data, size - 3, F.lit(4)).cast("string"))


def correlation_id(headers: str = "request_headers", prefix: str = HEADER_PREFIX) -> Column:
    """First usable id of the known headers, cut to length; '' if none is valid."""
    found = []
    for name in (f"{prefix}-Correlation-ID", *CORRELATION_HEADERS):
        value = F.left(squeeze(header(name, headers)), F.lit(CORRELATION_LENGTH))
        found.append(F.when(value.rlike(CORRELATION_PATTERN), value))
    return F.coalesce(*found, F.lit(""))


def checkpoint_seq(text: Column) -> Column:
    """Whole number of at least 0, else NULL."""
    value = squeeze(text)
    parsed = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))
    return F.when(parsed >= 0, parsed)


def lineage_columns(headers: str = "request_headers", prefix: str = HEADER_PREFIX) -> dict[str, Column]:
    out = {n: squeeze(header(f"{prefix}-{h}", headers)) for n, h in LINEAGE_HEADERS.items()}
    out["lineage_checkpoint_seq"] = checkpoint_seq(out["lineage_checkpoint_seq"])
    return out


def is_event_stream(headers: str = "response_headers") -> Column:
    return F.lower(header("Content-Type", headers)).contains("text/event-stream")
