"""The trace table on disk: reading, appending, rewriting, checking."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.metadata import meta_string
from tracelake.functions.text import blank_to_null, squeeze, tenant_or_default
from tracelake.schema import BODY_COLUMNS, TRACE_SCHEMA, conform, scan_defaults
from tracelake.session import persist_table


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    """Stored traces with a fixed schema; NULL text and numbers read as '' and 0."""
    return scan_defaults(spark.read.schema(TRACE_SCHEMA).parquet(path))


def scan_jdbc(spark: SparkSession, url: str, table: str, days: Sequence[dt.date], **options: str) -> DataFrame:
    """Traces of an existing database, one read task per UTC day."""
    per_day = [
        f"timestamp >= '{d:%Y-%m-%d} 00:00:00+00' AND timestamp < '{d + dt.timedelta(days=1):%Y-%m-%d} 00:00:00+00'" for d in days
    ]
    raw = spark.read.jdbc(url, table, predicates=per_day, properties=options)
    return scan_defaults(conform(raw))


def detail(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in TRACE_SCHEMA.fieldNames() if c in df.columns])


def summaries(df: DataFrame) -> DataFrame:
    """Same rows, heavy text blank. The text columns are never read."""
    return df.select(*[F.lit("").alias(c) if c in BODY_COLUMNS else F.col(c) for c in TRACE_SCHEMA.fieldNames() if c in df.columns])


def write_traces(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per day; inside a file rows are ordered by tenant, so min/max skipping works.

    Rows are rebalanced by day: AQE merges small days and splits busy ones, so neither tiny files nor
    one task per busy day result.
    """
    (
        df.withColumn("day", F.to_date("timestamp"))
        .hint("rebalance", "day")
        .sortWithinPartitions("day", "org_id", "workspace_id", "timestamp")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


@dataclass(frozen=True)
class Batch:
    accepted: DataFrame
    rejected: DataFrame


def append_batch(batch: DataFrame, target: DataFrame) -> Batch:
    """Split a batch into rows to append and rows to set aside; one bad row never sinks the rest.

    Ids are unique: the earliest copy in the batch wins (ties by content), an id already stored is rejected. Copies
    are reduced by partial aggregation, so an id repeated very often stays cheap.
    """
    usable = blank_to_null(F.col("id")).isNotNull()
    row = F.struct(*batch.columns)
    first = (
        batch.filter(usable)
        .groupBy("id")
        .agg(F.min_by(row, F.struct("created_at", "timestamp", F.xxhash64(*batch.columns))).alias("r"), F.count(F.lit(1)).alias("copies"))
    )
    stored = target.select("id").withColumn("stored", F.lit(True))
    checked = first.join(stored.distinct(), "id", "left")
    accepted = checked.filter(F.col("stored").isNull()).select("r.*")
    known = F.col("stored").isNotNull()
    repeated = checked.select(
        "id",
        F.when(known, F.lit("already_stored")).otherwise(F.lit("repeated_in_batch")).alias("reason"),
        F.when(known, F.col("copies")).otherwise(F.col("copies") - 1).alias("rows"),
    ).filter(F.col("rows") > 0)
    nameless = (
        batch.filter(~F.coalesce(usable, F.lit(False)))
        .groupBy()
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 0)
        .select(F.lit("").alias("id"), F.lit("missing_id").alias("reason"), "rows")
    )
    return Batch(accepted, repeated.unionByName(nameless))


DEFAULT_TENANT = "default"


def tenants_of(traces: DataFrame) -> DataFrame:
    """Distinct (org, workspace) pairs, blanks skipped."""
    return traces.select(blank_to_null(F.col("org_id")).alias("org_id"), blank_to_null(F.col("workspace_id")).alias("workspace_id")).distinct()


def backfill_tenants(traces: DataFrame, orgs: DataFrame, workspaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Organizations and workspaces to add so that every trace has its tenant; existing ones are kept."""
    spark = traces.sparkSession
    fallback = spark.range(1).select(F.lit(DEFAULT_TENANT).alias("org_id"), F.lit(DEFAULT_TENANT).alias("workspace_id"))
    pairs = tenants_of(traces).unionByName(fallback).filter(F.col("org_id").isNotNull())
    new_orgs = pairs.select("org_id").distinct().join(orgs.select("org_id"), "org_id", "left_anti")
    new_workspaces = (
        pairs.filter(F.col("workspace_id").isNotNull())
        .distinct()
        .join(workspaces.select("org_id", "workspace_id"), ["org_id", "workspace_id"], "left_anti")
    )
    return new_orgs, new_workspaces


def ensure_tenants(batch: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspaces missing for an incoming batch; blank tenants count as 'default'."""
    wanted = batch.select(
        tenant_or_default(F.col("org_id")).alias("org_id"), tenant_or_default(F.col("workspace_id")).alias("workspace_id")
    ).distinct()
    return wanted.join(workspaces.select("org_id", "workspace_id"), ["org_id", "workspace_id"], "left_anti")


def upsert_bodies(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New state of the body table: the newest incoming row replaces the stored one, its age kept."""
    newest = (
        incoming.groupBy("trace_id")
        .agg(F.max_by(F.struct(*incoming.columns), F.struct("created_at", F.xxhash64(*incoming.columns))).alias("r"))
        .select("r.*")
        .join(stored.select("trace_id", F.col("created_at").alias("_first")), "trace_id", "left")
        .withColumn("created_at", F.coalesce("_first", "created_at"))
        .select(*stored.columns)
    )
    return stored.join(newest.select("trace_id"), "trace_id", "left_anti").unionByName(newest)


@F.pandas_udf(T.BinaryType())
def gzip_text(texts: pd.Series) -> pd.Series:
    def pack(text: str) -> bytes:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        return c.compress(text.encode()) + c.flush()

    return texts.map(lambda t: None if not t else pack(t))


@F.pandas_udf(T.StringType())
def gunzip_text(data: pd.Series) -> pd.Series:
    """Text of stored bodies; one that cannot be unpacked is NULL, like a missing one."""

    def unpack(packed) -> str | None:
        if packed is None or not len(packed):
            return None
        try:
            return zlib.decompress(packed, 31).decode("utf-8", "replace")
        except zlib.error:
            return None

    return data.map(unpack)


def body_columns(side: str, body: Column, given_bytes: Column, given_sha: Column) -> dict[str, Column]:
    """Size and hash of one body; values measured at capture win over computed ones."""
    size = F.when(given_bytes > 0, given_bytes).otherwise(F.octet_length(body)).cast("bigint")
    filled = F.when(F.octet_length(body) > 0, F.sha2(body.cast("binary"), 256))
    return {f"{side}_size_bytes": size, f"{side}_sha256": F.coalesce(F.when(squeeze(given_sha) != "", given_sha), filled)}


def pii_status(metadata: Column) -> Column:
    return F.coalesce(F.nullif(meta_string(metadata, "body_pii_status"), F.lit("")), F.lit("unknown"))


def pack_bodies(captured: DataFrame) -> DataFrame:
    """Body rows (gzip, sizes, hashes) from captured bodies, one per trace."""
    out = captured
    for side in ("request_body", "response_body"):
        stats = body_columns(side, F.coalesce(F.col(side), F.lit("")), F.col(f"{side}_bytes"), F.coalesce(f"{side}_sha", F.lit("")))
        out = out.withColumns({**stats, f"{side}_gzip": gzip_text(F.col(side))})
        out = out.withColumn(f"{side}_compressed_size_bytes", F.coalesce(F.octet_length(f"{side}_gzip"), F.lit(0)).cast("bigint"))
    return out.withColumn("pii_status", pii_status(F.col("metadata"))).drop(
        "request_body", "response_body", "request_body_bytes", "response_body_bytes", "request_body_sha", "response_body_sha", "metadata"
    )


def hydrate(traces: DataFrame, bodies: DataFrame) -> DataFrame:
    """Traces with their stored bodies; a trace without one keeps its inline text."""
    unpacked = bodies.select(
        F.col("trace_id").alias("id"),
        gunzip_text("request_body_gzip").alias("_request"),
        gunzip_text("response_body_gzip").alias("_response"),
    )
    return (
        traces.join(unpacked, "id", "left")
        .withColumns({"request_body": F.coalesce("_request", "request_body"), "response_body": F.coalesce("_response", "response_body")})
        .drop("_request", "_response")
    )


def update_column(traces: DataFrame, changes: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Set ``column`` from (id, value); empty text clears it, of several values the largest counts. Also returns the ids nobody knows."""
    wanted = changes.select(squeeze(F.col("id")).alias("id"), "value").filter(F.col("id") != "").groupBy("id").agg(F.max("value").alias("value"))
    marked = wanted.withColumn("_hit", F.lit(True))
    new = F.when(F.col("_hit"), F.nullif(F.col("value"), F.lit(""))).otherwise(F.col(column))
    updated = traces.join(marked, "id", "left").withColumn(column, new).select(*traces.columns)
    unknown = wanted.select("id").join(traces.select("id"), "id", "left_anti")
    return updated, unknown


def retention_cutoff(now: Column, zone: str, days: int = 14) -> Column:
    """The same local time ``days`` calendar days ago."""
    local = F.from_utc_timestamp(now.cast("timestamp"), zone)
    return F.to_utc_timestamp(local - F.make_interval(days=F.lit(days)), zone)


def retain(traces: DataFrame, bodies: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traces and bodies to keep (a row at the cutoff stays), and the number of deleted traces."""
    kept = traces.filter(F.col("timestamp") >= cutoff)
    deleted = traces.filter(F.col("timestamp") < cutoff)
    kept_bodies = bodies.join(deleted.select(F.col("id").alias("trace_id")), "trace_id", "left_anti")
    return kept, kept_bodies, deleted.agg(F.count(F.lit(1)).alias("deleted"))


def apply_retention(spark: SparkSession, path: str, cutoff: dt.datetime) -> int:
    """Delete old traces of a day-partitioned table in place; returns how many.

    Only the day of the cutoff is rewritten; earlier days are dropped as whole folders.
    """
    schema = T.StructType([*TRACE_SCHEMA.fields, T.StructField("day", T.DateType())])
    stored = spark.read.schema(schema).parquet(path)
    deleted = stored.filter((F.col("day") <= F.lit(cutoff.date())) & (F.col("timestamp") < F.lit(cutoff))).count()
    edge = stored.filter((F.col("day") == F.lit(cutoff.date())) & (F.col("timestamp") >= F.lit(cutoff)))
    # First the cutoff's day is replaced by what stays of it, then whole older days go: a crash between the two
    # leaves rows that the next run deletes, and never takes one that should stay.
    saved = persist_table(edge, "retention-edge")
    saved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    left = not saved.isEmpty()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        day = name[4:] if name.startswith("day=") else None
        if day and (day < f"{cutoff:%Y-%m-%d}" or (day == f"{cutoff:%Y-%m-%d}" and not left)):
            fs.delete(status.getPath(), True)
    return deleted


def count_traces(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("trace_count"))


def integrity_report(traces: DataFrame, bodies: DataFrame, orgs: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Traces without workspace, workspaces without organization, bodies without trace."""
    pair = ["org_id", "workspace_id"]
    # Tenants are checked once each; traces are only joined with the (normally empty) list of unknown ones.
    unknown = traces.select(*pair).distinct().join(workspaces.select(*pair), pair, "left_anti")
    lost = traces.join(unknown, pair, "left_semi").select(F.lit("trace_without_workspace").alias("problem"), "id")
    stray = workspaces.join(orgs.select("org_id"), "org_id", "left_anti").select(
        F.lit("workspace_without_org").alias("problem"), F.concat_ws("/", "org_id", "workspace_id").alias("id")
    )
    orphan = bodies.join(traces.select(F.col("id").alias("trace_id")), "trace_id", "left_anti").select(
        F.lit("body_without_trace").alias("problem"), F.col("trace_id").alias("id")
    )
    return lost.unionByName(stray).unionByName(orphan)
