import datetime as dt
import gzip
import json
import os

from helpers import at, dicts, trace, traces
from pyspark.sql import functions as F

from tracelake.plans.build_trace import build_traces, enrich
from tracelake.schema import EXCHANGE_SCHEMA
from tracelake.sources import export, store
from tracelake.streaming import jobs


def test_append_rejects_without_losing_rows(spark):
    stored = traces(spark, [trace("old")])
    batch = traces(spark, [trace("old", 1), trace("new", 2, model="first"), trace("new", 3, model="second"), trace(" ", 4), trace("fine", 5)])
    result = store.append_batch(batch, stored)
    assert [(r["id"], r["model"]) for r in dicts(result.accepted, "id")] == [("fine", "m"), ("new", "first")]
    assert {(r["id"], r["reason"], r["rows"]) for r in dicts(result.rejected)} == {("old", "already_stored", 1), ("new", "repeated_in_batch", 1), ("", "missing_id", 1)}


def test_retention_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    day = 86_400
    rows = [trace("a", 0), trace("b", day), trace("at", day + 100), trace("c", day + 200), trace("d", 3 * day)]
    store.write_traces(traces(spark, rows), path)
    assert store.apply_retention(spark, path, at(day + 100)) == 2
    assert {r["id"] for r in dicts(store.scan_traces(spark, path))} == {"at", "c", "d"}


def test_bodies_round_trip(spark):
    captured = spark.createDataFrame(
        [("a", "ask ü", "", 0, 0, "", "", "{}"), ("b", "x", "answer", 99, 0, "given", "", '{"body_pii_status":"clean"}')],
        "trace_id string, request_body string, response_body string, request_body_bytes bigint, response_body_bytes bigint, request_body_sha string, response_body_sha string, metadata string",
    )
    bodies = store.pack_bodies(captured)
    a, b = dicts(bodies, "trace_id")
    assert gzip.decompress(a["request_body_gzip"]).decode() == "ask ü" and a["request_body_size_bytes"] == 6
    assert (a["pii_status"], a["response_body_gzip"], a["response_body_sha256"]) == ("unknown", None, None)
    assert (b["request_body_size_bytes"], b["request_body_sha256"], b["pii_status"]) == (99, "given", "clean")
    t = traces(spark, [trace("a", request_body="inline", response_body="inline"), trace("z", request_body="own")])
    got = dicts(store.hydrate(t, bodies), "id")
    assert (got[0]["request_body"], got[0]["response_body"], got[1]["request_body"]) == ("ask ü", "inline", "own")


def test_daily_export(spark, tmp_path):
    rows = [trace(f"e{i:03d}", i * 300, request_body="x" * 50) for i in range(300)]
    parts = dicts(export.export_day(traces(spark, rows), dt.date(2026, 2, 12), "UTC", str(tmp_path), part_bytes=20_000), "part_number")
    folder = tmp_path / "260212" / "parts"
    lines = []
    for p in parts:
        data = (folder / p["file"]).read_bytes()
        assert len(data) == p["compressed_bytes"]
        lines += [json.loads(line)["id"] for line in gzip.decompress(data).splitlines()]
    want = [r["id"] for r in rows if r["timestamp"].date() == dt.date(2026, 2, 12)]
    assert lines == want and sum(p["records"] for p in parts) == len(want) and len(parts) > 1
    assert parts[0]["part_name"].startswith("request_details_260212_part_000001_0200_")
    assert os.path.exists(tmp_path / "260212" / "manifest")


def exchange(n: int, **fields):
    body = json.dumps({"model": "gpt-4o", "messages": [{"role": "user", "content": "hi"}]})
    answer = json.dumps({"choices": [{"message": {"content": "yo"}}], "usage": {"prompt_tokens": 100, "completion_tokens": 10}})
    row = dict(exchange_id=f"x{n}", started_at=at(n), method="POST", path="/openai/v1/chat/completions", request_headers={"Authorization": ["Bearer sk-abcdef"]},
               response_headers={}, request_body=body, response_body=answer, status_code=200, streaming=False, stream_chunks=0, duration_ms=5,
               time_to_first_token_ms=0, time_to_first_token_us=0, correlation_id=None)
    row.update(fields)
    return tuple(row[f.name] for f in EXCHANGE_SCHEMA.fields)


def test_build_and_enrich(spark):
    headers = {"X-Trace-Thread-Id": [" th "], "X-Trace-Checkpoint-Seq": ["3"], "x-api-key": ["äöüß"], "X-Request-Id": ["bad id"], "X-Correlation-Id": ["ok-1"], "Set-Cookie": ["s"]}
    df = spark.createDataFrame([exchange(1), exchange(2, request_headers=headers, path="", method=None, time_to_first_token_us=1001)], EXCHANGE_SCHEMA)
    one, two = dicts(build_traces(df, {"openai": "/openai"}), "id")
    assert (one["provider"], one["model"], one["total_tokens"]) == ("openai", "gpt-4o", 110)
    assert abs(one["estimated_cost_usd"] - (0.1 * 0.005 + 0.01 * 0.015)) < 1e-12
    assert "sk-abcdef" not in one["request_headers"] and json.loads(one["metadata"])["api_key_last4"] == "cdef"
    meta = json.loads(two["metadata"])
    assert (meta["lineage_thread_id"], meta["lineage_checkpoint_seq"], meta["correlation_id"], meta["api_key_last4"]) == ("th", 3, "ok-1", "üß")
    assert (two["provider"], two["request_path"], two["request_method"], two["time_to_first_token_ms"]) == ("unknown", "/", "UNKNOWN", 2)
    assert "lineage_run_id" not in meta and json.loads(two["request_headers"])["Set-Cookie"] == ["[REDACTED]"]
    rich = dicts(enrich(build_traces(df)), "id")[0]
    assert rich["llm_request_prompt"] == "hi" and json.loads(rich["llm_response_content"])["parts"][0]["text"] == "yo"
    marked = build_traces(df).withColumns({"metadata": F.lit('{"redaction_storage_drop":true}'), "llm_request_prompt": F.lit("kept")})
    kept = dicts(enrich(marked), "id")[0]
    assert kept["llm_request_prompt"] == "kept" and kept["llm_response_content"] is None


def test_ingest_is_idempotent_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([exchange(i) for i in range(4)], EXCHANGE_SCHEMA).coalesce(1).write.parquet(source)
    folder = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(EXCHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return jobs.ingest_stream(stream, build_traces, folder)

    path, tenants, rejects = run()
    spark.createDataFrame([exchange(i) for i in range(2, 6)], EXCHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(path).select("id").collect()) == [f"x{i}" for i in range(6)]
    assert spark.read.parquet(tenants).count() == 1
    assert sorted(r["id"] for r in spark.read.parquet(rejects).filter("reason = 'already_stored'").collect()) == ["x2", "x3"]


def test_turn_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "connection_id string, msg_id int, ts timestamp, direction string, opcode string, msg_type string, bytes bigint, close_code int"
    sent = [("c", 1, at(0), "client_to_upstream", "text", "turn/start", 5, 0), ("c", 2, at(1), "upstream_to_client", "text", "", 7, 0)]
    done = [("c", 3, at(2), "upstream_to_client", "text", "turn/completed", 1, 0), ("c", 4, at(3), "client_to_upstream", "text", "turn/steer", 1, 0)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (sent, done):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        out = jobs.stream_to_files(jobs.turn_stream(spark.readStream.schema(schema).parquet(source)), folder)
    (turn,) = dicts(out)
    assert (turn["start_type"], turn["terminal_type"], turn["request_messages"], turn["response_messages"], turn["first_response_us"]) == ("turn/start", "turn/completed", 1, 2, 1_000_000)
