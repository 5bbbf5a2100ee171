"""Changes of a stored table: written to real folders, committed, read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.catalog.sql import on_traces
from tracelake.catalog.streams import stream_of
from tracelake.registry import ORACLES, query
from tracelake.session import new_folder
from tracelake.sources import derived
from tracelake.sources.versioned import VersionedStore
from tracelake.streaming import jobs

_BODY = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("body", T.StringType()), T.StructField("created_at", T.TimestampNTZType())])


def _slim(spark, sf):
    return derived.traces(spark, sf).select("id", "timestamp", "created_at", "response_status")


def _bodies(rows, text, minutes=0):
    later = F.col("created_at") + F.make_dt_interval(mins=F.lit(minutes))
    return rows.select(F.col("id").alias("trace_id"), text.alias("body"), later.cast("timestamp_ntz").alias("created_at"))


def _store(spark, traces, buckets=16):
    return VersionedStore(spark, new_folder(spark, "store"), {"traces": traces.schema, "bodies": _BODY}, buckets)


@query("s5_append_batch_stored", ORACLES["s5_append_batch"])
def append_batch_stored(spark, sf):
    """The table up to the 12th is stored; then all of it is delivered again, failed calls twice."""
    t = _slim(spark, sf)
    store = _store(spark, t)
    store.ingest(t.filter(F.col("timestamp") < F.lit(dt.datetime(2024, 1, 12)).cast("timestamp_ntz")), ("first", 0))
    old = store.version()
    rejected = store.ingest(t.unionByName(t.filter("response_status >= 500")), ("second", 0))
    new = store.read("traces").join(store.read("traces", old).select("id"), "id", "left_anti")
    accepted = new.select(F.lit("accepted").alias("outcome"), "id", F.lit("").alias("reason"), F.lit(1).cast("bigint").alias("rows"))
    return accepted.unionByName(rejected.select(F.lit("rejected").alias("outcome"), "id", "reason", "rows"))


@query(
    "s9_upsert_bodies_stored",
    on_traces("SELECT id AS trace_id, CASE WHEN response_status >= 500 THEN 'again-' || id WHEN response_status >= 400 THEN 'once-' || id ELSE metadata END AS body FROM traces"),
)
def upsert_bodies_stored(spark, sf):
    """Three commits of bodies; only the buckets of each wave are written."""
    t = derived.traces(spark, sf)
    store = _store(spark, _slim(spark, sf))
    failed = t.filter("response_status >= 400")
    store.upsert_bodies(_bodies(t, F.col("metadata")))
    store.upsert_bodies(_bodies(failed, F.concat(F.lit("once-"), F.col("id")), 5))
    store.upsert_bodies(_bodies(failed.filter("response_status >= 500"), F.concat(F.lit("again-"), F.col("id")), 9))
    return store.read("bodies").select("trace_id", "body")


@query("s13_retention_stored", ORACLES["s13_retention_delete"])
def retention_stored(spark, sf):
    """Traces, bodies and ids in one commit."""
    t = _slim(spark, sf)
    store = _store(spark, t)
    store.ingest(t)
    store.upsert_bodies(_bodies(derived.traces(spark, sf), F.col("metadata")))
    deleted = store.retain(dt.datetime(2024, 1, 16, 8))
    none = F.lit(0).cast("bigint").alias("deleted")
    kept = store.read("traces").join(store.read("ids").select("id"), "id", "left_semi")
    return (
        kept.select(F.lit("kept").alias("kind"), "id", none)
        .unionByName(store.read("bodies").select(F.lit("body").alias("kind"), F.col("trace_id").alias("id"), none))
        .unionByName(spark.range(1).select(F.lit("total").alias("kind"), F.lit("").alias("id"), F.lit(deleted).cast("bigint").alias("deleted")))
    )


@query("t2_enrich_merged", ORACLES["t2_enrich_stream"])
def enrich_merged(spark, sf):
    """Derived prompts and answers of the change stream, merged into the stored traces; the second run changes nothing."""
    text = F.col("text")
    ask = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages")))
    got = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))

    def rows(table):
        when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("conv_id"))
        return table.select(
            F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            when.alias("timestamp"),
            when.alias("created_at"),
            F.when(F.col("role") == "user", ask).alias("request_body"),
            F.when(F.col("role") == "assistant", got).alias("response_body"),
            F.lit("").alias("llm_request_prompt"),
            F.lit("").alias("llm_response_content"),
            F.lit('{"streaming":false}').alias("metadata"),
        )

    stored = rows(derived.table(spark, sf, "conversations"))
    store = _store(spark, stored)
    store.ingest(stored)
    found = jobs.enrich_stream(rows(stream_of(spark, sf, "conversations")), new_folder(spark, "enrich"))
    for _ in range(2):
        store.fill_columns(found, ["llm_request_prompt", "llm_response_content"])
    return store.read("traces").select(
        "id", F.nullif("llm_request_prompt", F.lit("")).alias("prompt"), F.get_json_object("llm_response_content", "$.parts[0].text").alias("content")
    )
