"""Ordered listings, cursors and report orders."""

from __future__ import annotations

import base64
import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import squeeze
from tracelake.operators.filters import TraceFilter, after_cursor_asc, after_cursor_desc, apply_filter, export_range
from tracelake.operators.sliced import running_sums


def clamp(limit: int, default: int, most: int) -> int:
    return default if limit <= 0 else min(limit, most)


def rfc3339(ts: Column) -> Column:
    """UTC time text without trailing zeros in the fraction."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(full, r"\.?0+$", ""), F.lit("Z"))


def cursor_of(at: Column, row_id: Column) -> Column:
    """URL-safe base64 of 'time|id' without padding."""
    plain = F.base64(F.concat(rfc3339(at), F.lit("|"), row_id).cast("binary"))
    one_line = F.regexp_replace(plain, r"[\r\n]", "")
    return F.rtrim(F.translate(one_line, "+/", "-_"), F.lit("="))


def cursor_fields(cursor: Column) -> tuple[Column, Column]:
    """Time and id of a cursor; NULL when it cannot be read."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    at = F.try_to_timestamp(F.split_part(text, F.lit("|"), F.lit(1)))
    row_id = F.nullif(squeeze(F.regexp_extract(text, r"(?s)^[^|]*\|(.*)$", 1)), F.lit(""))
    good = F.instr(text, "|") > 0
    return F.when(good & row_id.isNotNull(), at), F.when(good & at.isNotNull(), row_id)


def decode_cursor(cursor: str) -> tuple[dt.datetime, str]:
    """Driver-side form for a cursor given by a caller."""
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
        at, row_id = text.split("|", 1)
        when = dt.datetime.fromisoformat(at.strip())
    except ValueError as err:
        raise ValueError("invalid cursor") from err
    if not row_id.strip():
        raise ValueError("invalid cursor")
    return when.astimezone(dt.timezone.utc).replace(tzinfo=None), row_id.strip()


def _page(ordered: DataFrame, limit: int, order: list[Column], cursor_time: Column) -> DataFrame:
    # One row more than asked for tells whether a next page exists. The window covers limit + 1 rows.
    probe = ordered.limit(limit + 1)
    spot = Window.orderBy(*order)
    marked = probe.withColumns({"_n": F.row_number().over(spot), "_all": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    last = (F.col("_n") == limit) & (F.col("_all") > limit)
    return (
        marked.filter(F.col("_n") <= limit)
        .withColumn("next_cursor", F.when(last, cursor_of(cursor_time, F.col("id"))))
        .drop("_n", "_all")
    )


def list_page(df: DataFrame, f: TraceFilter = TraceFilter(), limit: int = 0, cursor: str = "") -> DataFrame:
    """Newest first. The last row carries the cursor of the next page, if there is one."""
    limit = clamp(limit, 50, 200)
    rows = apply_filter(df, f)
    if cursor:
        rows = after_cursor_desc(rows, *decode_cursor(cursor))
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return _page(rows.orderBy(*order), limit, order, F.coalesce("created_at", "timestamp"))


def list_total(df: DataFrame, f: TraceFilter = TraceFilter()) -> DataFrame:
    """Number of rows of the whole listing, whatever the page."""
    return apply_filter(df, f).agg(F.count(F.lit(1)).alias("total_count"))


def export_page(df: DataFrame, start: dt.datetime, end: dt.datetime, limit: int = 0, cursor: str = "", f: TraceFilter = TraceFilter()) -> DataFrame:
    """Oldest first within a half-open time range."""
    limit = clamp(limit, 100, 1000)
    rows = export_range(apply_filter(df, f), start, end)
    if cursor:
        rows = after_cursor_asc(rows, *decode_cursor(cursor))
    order = [F.col("timestamp").asc(), F.col("id").asc()]
    return _page(rows.orderBy(*order), limit, order, F.col("timestamp"))


def assign_pages(df: DataFrame, keys: list[str], page_size: int, slice_seconds: int | None = None) -> DataFrame:
    """Page number of every row in its tenant's newest-first listing."""
    numbered = running_sums(
        df, keys, "created_at", ["created_at", "id"], {"row_no": F.lit(1)}, slice_seconds=slice_seconds, descending=True
    )
    return numbered.withColumn("page_no", F.floor((F.col("row_no") - 1) / page_size).cast("bigint"))


def latest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def latest_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """Id and time of each key's newest trace; partial aggregation keeps one row per key and task."""
    newest = F.max(F.struct("created_at", "id"))
    return df.groupBy(*keys).agg(newest.alias("n")).select(*keys, F.col("n.id").alias("id"), F.col("n.created_at").alias("created_at"))


def recent(df: DataFrame, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    at = F.coalesce("timestamp", "created_at")
    return (
        df.withColumn("timestamp", at)
        .orderBy(F.col("timestamp").desc(), squeeze(F.col("id")).desc())
        .limit(limit)
        .select("id", "timestamp", "provider", "model", "response_status", "total_tokens", "estimated_cost_usd", "latency_ms", "request_path")
    )


def by_requests(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(F.col("request_count").desc(), squeeze(F.col(name)).asc())


def by_usage(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("total_tokens").desc(), F.col("total_cost_usd").desc(), squeeze(F.col("provider")).asc())
