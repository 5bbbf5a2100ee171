"""Ordered streams: rows in any file order and in several micro-batches give what the batch operators give."""

import os
import random

import pytest

from helpers import at, dicts
from tracelake.operators.limits import admit
from tracelake.operators.turns import ITEM, RESPONSE, START, STEER, turn_table
from tracelake.streaming import ordered
from tracelake.streaming.jobs import stream_to_files

MESSAGE = "connection_id string, msg_id int, ts timestamp, direction string, opcode string, msg_type string, bytes bigint, close_code int"
REQUEST = "id string, org_id string, workspace_id string, timestamp timestamp"


def files(spark, rows, schema, folder, parts):
    """The rows in shuffled files, one after the other."""
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def batches(folder):
    return len([n for n in os.listdir(os.path.join(folder, "checkpoint", "offsets")) if n.isdigit()])


def requests(seed, n):
    rng = random.Random(seed)
    scopes = [("o", "w"), ("o", None), (None, None)]
    rows = [(rng.choice([None, "again", f"r{i}"]), *rng.choice(scopes), at(rng.choice([rng.randrange(40), rng.random() * 4000]))) for i in range(n)]
    rows += [("timeless", "o", "w", None), (None, None, None, None), ("early", "o", "w", at(-3_000_000_000)), ("early", "o", "w", at(-3_000_000_000))]
    rng.shuffle(rows)
    return rows


def decisions(df):
    return sorted(map(str, df.select("org_id", "workspace_id", "id", "admitted", "retry_after").collect()))


@pytest.mark.parametrize("most_rows", [3, 200_000])
def test_limiter_in_any_order_equals_batch(spark, tmp_path, most_rows):
    rows = requests(most_rows, 240)
    folder = str(tmp_path / "out")
    got = ordered.all_admissions(files(spark, rows, REQUEST, str(tmp_path / "in"), 3), ["org_id", "workspace_id"], 2, folder, 30, most_rows)
    want = admit(spark.createDataFrame(rows, REQUEST), ["org_id", "workspace_id"], 2, seconds=30)
    assert batches(folder) >= 5  # three files, the end, what the end sets free
    assert decisions(got) == decisions(want)
    assert 0 < got.filter("NOT admitted AND org_id IS NULL").count() and got.count() == len(rows)


def messages(seed, n):
    rng = random.Random(seed)
    kinds = [("client_to_upstream", "text", w) for w in (ITEM, RESPONSE, START, STEER, "")] + [("upstream_to_client", "text", w) for w in ("", "response.done", "turn/completed")]
    rows = []
    for i in range(n):
        way, code, word = rng.choice(kinds) if rng.random() < 0.95 else ("upstream_to_client", "close", "")
        rows.append((rng.choice(["a", "a", "b"]), i, at(i * 0.7), way, code, word, rng.randrange(9), 1000 if code == "close" else 0))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_rows", [4, 200_000])
def test_turns_in_any_order_equal_batch(spark, tmp_path, most_rows):
    rows = messages(most_rows, 300)
    got = ordered.all_turns(files(spark, rows, MESSAGE, str(tmp_path / "in"), 3), str(tmp_path / "out"), most_rows)
    want = turn_table(spark.createDataFrame(rows, MESSAGE), slice_seconds=60)
    columns = ["connection_id", "turn_index", "start_type", "terminal_type", "incomplete", "request_messages", "response_messages", "request_bytes", "response_bytes", "first_response_us", "close_code"]
    assert dicts(got.select(*columns), "connection_id", "turn_index") == dicts(want.select(*columns), "connection_id", "turn_index")
    assert got.filter("terminal_type = 'connection_closed'").count() > 0


def test_an_ended_run_repeats_nothing(spark, tmp_path):
    rows = messages(1, 40)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    first = ordered.all_turns(files(spark, rows, MESSAGE, source, 2), folder).count()
    stream = spark.readStream.schema(MESSAGE).parquet(source)
    assert ordered.all_turns(stream, folder).count() == first > 0


def test_empty_source(spark, tmp_path):
    stream = files(spark, [], REQUEST, str(tmp_path / "in"), 1)
    out = ordered.all_admissions(stream, ["org_id", "workspace_id"], 1, str(tmp_path / "out"))
    assert out.columns == ["org_id", "workspace_id", "id", "admitted", "retry_after"] and out.count() == 0


def test_live_stream_waits_for_the_watermark(spark, tmp_path):
    """The second file holds an earlier request: it gets in, and the later one of the first file does not."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    ordered._state_on_disk(spark)

    def run(*rows):
        spark.createDataFrame([(i, "o", "w", at(s)) for i, s in rows], REQUEST).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUEST).parquet(source)
        out = stream_to_files(ordered.limit_in_order(stream, ["org_id", "workspace_id"], 1, 60), folder)
        return {r["id"]: (r["admitted"], r["retry_after"]) for r in out.collect()}

    assert run(("later", 30)) == {}
    assert run(("sooner", 10)) == {}
    assert run(("clock", 3000)) == {"sooner": (True, 0), "later": (False, 40)}
    assert run(("clock 2", 9000))["clock"] == (True, 0)


def test_live_stream_closes_silent_connections(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    ordered._state_on_disk(spark)

    def run(*rows):
        spark.createDataFrame([(c, i, at(s), "client_to_upstream", "text", START, 1, 0) for i, (c, s) in enumerate(rows)], MESSAGE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MESSAGE).parquet(source)
        return dicts(stream_to_files(ordered.turns_in_order(stream, idle_seconds=600), folder), "connection_id", "turn_index")

    assert run(("a", 0), ("b", 0), ("b", 400)) == []
    turns = run(("clock", 1300))  # passes 700 s: a has been silent since 0, b since 400
    assert [(t["connection_id"], t["turn_index"], t["terminal_type"]) for t in turns] == [("a", 1, "connection_closed"), ("b", 1, "next_turn_start")]
    turns = run(("clock", 3000))
    assert [(t["connection_id"], t["turn_index"], t["terminal_type"]) for t in turns[:3]] == [("a", 1, "connection_closed"), ("b", 1, "next_turn_start"), ("b", 2, "connection_closed")]


def test_idle_must_span_a_stretch(spark, tmp_path):
    with pytest.raises(ValueError):
        ordered.turns_in_order(spark.createDataFrame([], MESSAGE), idle_seconds=5)
