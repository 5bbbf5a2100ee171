"""Row predicates over traces. Every filter is optional: a blank or zero value means 'not set'."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.metadata import meta_bool, meta_string
from tracelake.functions.text import clean_prefix, endpoint_candidates, squeeze, tenant_or_default, under_prefix


@dataclass(frozen=True)
class TraceFilter:
    org_id: str = ""
    workspace_id: str = ""
    trace_group_id: str = ""
    thread_id: str = ""
    run_id: str = ""
    provider: str = ""
    model: str = ""
    path_prefix: str = ""
    endpoint: str = ""
    prefixes: tuple[str, ...] = field(default=())
    api_key_hash: str = ""
    access_key_id: str = ""
    status: int = 0
    min_tokens: int = 0
    max_tokens: int = 0
    since: dt.datetime | None = None
    until: dt.datetime | None = None


def moment(df: DataFrame, column: str, value: dt.datetime) -> Column:
    """A literal of the column's own type, so the comparison reaches the file scan uncast."""
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast(df.schema[column].dataType)


def conditions(df: DataFrame, f: TraceFilter) -> list[Column]:
    if f.min_tokens and f.max_tokens and f.max_tokens < f.min_tokens:
        raise ValueError("max_tokens must not be below min_tokens")
    if f.since and f.until and f.until < f.since:
        raise ValueError("until must not be before since")
    out: list[Column] = []
    for name in ("org_id", "workspace_id", "trace_group_id", "provider", "model", "api_key_hash", "access_key_id"):
        if value := getattr(f, name).strip():
            out.append(F.col(name) == value)
    if f.thread_id:
        out.append(F.get_json_object("metadata", "$.lineage_thread_id") == f.thread_id)
    if f.run_id:
        out.append(F.get_json_object("metadata", "$.lineage_run_id") == f.run_id)
    if f.path_prefix.strip() and clean_prefix(f.path_prefix) != "/":
        out.append(under_prefix(F.col("request_path"), f.path_prefix))
    if paths := endpoint_candidates(f.endpoint, f.prefixes):
        out.append(F.col("request_path").isin(*paths))
    if f.status:
        out.append(F.col("response_status") == f.status)
    if f.min_tokens:
        out.append(F.col("total_tokens") >= f.min_tokens)
    if f.max_tokens:
        out.append(F.col("total_tokens") <= f.max_tokens)
    if f.since:
        out.append(F.col("timestamp") >= moment(df, "timestamp", f.since))
    if f.until:
        out.append(F.col("timestamp") <= moment(df, "timestamp", f.until))
    return out


def apply_filter(df: DataFrame, f: TraceFilter) -> DataFrame:
    wanted = conditions(df, f)
    return df.filter(reduce(lambda a, b: a & b, wanted)) if wanted else df


def export_range(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Half open: the end is left out."""
    return df.filter((F.col("timestamp") >= moment(df, "timestamp", start)) & (F.col("timestamp") < moment(df, "timestamp", end)))


def visible_to(df: DataFrame, org_id: str = "", workspace_id: str = "") -> DataFrame:
    """Rows a tenant may see; rows without tenant belong to 'default'."""
    out = df
    if org_id.strip():
        out = out.filter(tenant_or_default(F.col("org_id")) == org_id.strip())
    if workspace_id.strip():
        out = out.filter(tenant_or_default(F.col("workspace_id")) == workspace_id.strip())
    return out


def tenant_bound(traces: DataFrame, bodies: DataFrame, org_id: str = "", workspace_id: str = "") -> tuple[DataFrame, DataFrame]:
    """Traces of the session's tenant and the bodies of those traces; unset means everything."""
    seen = traces
    if org_id:
        seen = seen.filter(F.col("org_id") == org_id)
    if workspace_id:
        seen = seen.filter(F.col("workspace_id") == workspace_id)
    return seen, bodies_of(bodies, seen)


def bodies_of(bodies: DataFrame, traces: DataFrame) -> DataFrame:
    return bodies.join(traces.select(F.col("id").alias("trace_id")), "trace_id", "left_semi")


def after_cursor_desc(df: DataFrame, created_at: dt.datetime, row_id: str) -> DataFrame:
    """Rows after the cursor in a newest-first listing."""
    at = moment(df, "created_at", created_at)
    return df.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < row_id)))


def after_cursor_asc(df: DataFrame, timestamp: dt.datetime, row_id: str) -> DataFrame:
    """Rows after the cursor in an oldest-first export."""
    at = moment(df, "timestamp", timestamp)
    return df.filter((F.col("timestamp") > at) | ((F.col("timestamp") == at) & (F.col("id") > row_id)))


def lookup(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose id is listed in ``wanted`` (a table with an ``id`` column)."""
    return df.join(wanted.select("id"), "id", "left_semi")


def capturable(df: DataFrame, path: str = "path") -> DataFrame:
    """The own API and dashboard calls are not traced."""
    return df.filter(~under_prefix(F.col(path), "/api") & ~under_prefix(F.col(path), "/dashboard"))


def redaction_skipped(metadata: Column) -> Column:
    """The stored body is not the real one, so nothing may be derived from it."""
    flags = [F.coalesce(meta_bool(metadata, k), F.lit(False)) for k in ("redaction_storage_skipped", "redaction_storage_drop")]
    return (meta_string(metadata, "body_pii_status") == "skipped_large_body") | flags[0] | flags[1]


def enrich_eligible(df: DataFrame, body: str, derived: str) -> DataFrame:
    filled = squeeze(F.coalesce(F.col(body), F.lit(""))) != ""
    empty = squeeze(F.coalesce(F.col(derived), F.lit(""))) == ""
    return df.filter(filled & empty & ~redaction_skipped(F.col("metadata")))


def active_keys(keys: DataFrame, org_id: str = "", workspace_id: str = "") -> DataFrame:
    out = keys.filter(F.col("revoked_at").isNull())
    if org_id:
        out = out.filter(F.col("org_id") == org_id)
    if workspace_id:
        out = out.filter(F.col("workspace_id") == workspace_id)
    return out


def parse_bound(text: str, *, end: bool = False) -> dt.datetime | None:
    """RFC 3339 time or a UTC date; a date used as an end covers its whole day."""
    value = text.strip()
    if not value:
        return None
    if len(value) == 10:
        day = dt.datetime.strptime(value, "%Y-%m-%d")
        return day + dt.timedelta(days=1) - dt.timedelta(microseconds=1) if end else day
    at = dt.datetime.fromisoformat(value)
    if at.tzinfo is None:
        raise ValueError(f"time without zone: {text!r}")
    return at.astimezone(dt.timezone.utc).replace(tzinfo=None)


def parse_bound_column(text: Column, *, end: bool = False) -> Column:
    """Column form of :func:`parse_bound`; unreadable text gives NULL."""
    value = squeeze(text)
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
    if end:
        day = day + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.000001 SECOND")
    full = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(value))
    return F.coalesce(day, full)
