"""Sliced windows, limiter, turns and lineage order against plain Python."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from helpers import at, dicts, trace, traces
from pyspark.sql import functions as F

from tracelake.operators import lineage
from tracelake.operators.limits import Policy, admit, limit_decisions, quota_codes, replay_limit
from tracelake.operators.sliced import running_max, running_sums, top_rows, trailing_count
from tracelake.operators.turns import ITEM, OPENERS, RESPONSE, START, TERMINALS, message_type, turn_table
from tracelake.streaming.jobs import _FRESH, _left_open, turns_of

HOT = 0.4


def timeline(seed: int, rows: int, span: float, keys: int = 5):
    """Rows of several keys; one key holds more than a third of them."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        key = "hot" if rng.random() < HOT else f"k{rng.randrange(keys)}"
        out.append((key, f"id{i:05d}", at(round(rng.random() * span, 1)), rng.randrange(10)))
    return out


@pytest.fixture(scope="module")
def rows():
    return timeline(1, 600, 900)


def test_running_values_equal_plain_ones(spark, rows):
    df = spark.createDataFrame(rows, "k string, id string, ts timestamp, v int")
    out = running_sums(df, ["k"], "ts", ["ts", "id"], {"upto": F.col("v")}, slice_seconds=7)
    out = running_sums(out, ["k"], "ts", ["ts", "id"], {"before": F.col("v")}, slice_seconds=50, include_current=False)
    out = running_sums(out, ["k"], "ts", ["ts", "id"], {"back": F.lit(1)}, slice_seconds=11, descending=True)
    out = running_max(out, ["k"], "ts", ["ts", "id"], "top", F.when(F.col("v") > 3, F.col("v")), slice_seconds=13)
    got = {r["id"]: r for r in out.collect()}
    by_key: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by_key.setdefault(r[0], []).append(r)
    for listed in by_key.values():
        total, top = 0, None
        for n, (_, row_id, _, v) in enumerate(listed):
            assert got[row_id]["before"] == total
            total += v
            top = max(top or 0, v) if v > 3 else top
            assert (got[row_id]["upto"], got[row_id]["back"], got[row_id]["top"]) == (total, len(listed) - n, top)


def test_trailing_count_includes_both_ends(spark, rows):
    df = spark.createDataFrame([*rows, ("edge", "e1", at(0), 0), ("edge", "e2", at(60), 0), ("edge", "e3", at(60.1), 0)], "k string, id string, ts timestamp, v int")
    got = {r["id"]: r["n"] for r in trailing_count(df, ["k"], "ts", 60, "n").collect()}
    for key, row_id, when, _ in rows:
        assert got[row_id] == sum(1 for k, _, t, _ in rows if k == key and 0 <= (when - t).total_seconds() <= 60)
    assert (got["e2"], got["e3"]) == (2, 2)
    ranks = {r["id"]: r["n"] for r in trailing_count(df, ["k"], "ts", 60, "n", span_rows=0).collect()}
    assert ranks == got


def test_top_rows_of_a_hot_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, id string, ts timestamp, v int")
    got = top_rows(df, ["k"], [F.col("ts").desc(), F.col("id").desc()], 20, salts=4, rank="n")
    hot = [r["id"] for r in got.filter("k = 'hot'").orderBy("n").collect()]
    assert hot == [r[1] for r in sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[1]), reverse=True)][:20]


def naive_limiter(times, limit, span):
    admitted, out = [], []
    for t in times:
        window = [a for a in admitted if a >= t - span]
        ok = len(window) < limit
        out.append((ok, 0 if ok else max(1, -((t - window[0] - span) // 1_000_000))))
        if ok:
            admitted.append(t)
    return out


def test_replay_limit_equals_the_simple_rule():
    rng = random.Random(2)
    for limit in (1, 2, 5):
        times = sorted(rng.randrange(0, 400_000_000) for _ in range(300))
        yes, wait = replay_limit(np.array(times), np.zeros(300, dtype=bool), limit, 60_000_000)
        assert list(zip(yes.tolist(), wait.tolist())) == naive_limiter(times, limit, 60_000_000)
    yes, wait = replay_limit(np.array([0, 0, 0, 60_000_000, 60_000_001]), np.zeros(5, dtype=bool), 2, 60_000_000)
    assert yes.tolist() == [True, True, False, False, True] and wait.tolist() == [0, 0, 60, 1, 0]


def test_null_keys_and_times_keep_their_rows(spark):
    df = spark.createDataFrame([(None, "a", at(0), 1), ("k", "b", None, 2), ("k", "c", at(5), 3), ("k", "d", None, 4), (None, "e", at(700), 5)], "k string, id string, ts timestamp, v int")
    got = {r["id"]: r["n"] for r in running_sums(df, ["k"], "ts", ["ts", "id"], {"n": F.col("v")}).collect()}
    assert got == {"a": 1, "e": 6, "b": 2, "d": 6, "c": 9}
    assert {r["id"]: r["n"] for r in trailing_count(df, ["k"], "ts", 60, "n").collect()} == {"a": 1, "e": 1, "b": 2, "d": 2, "c": 1}


@pytest.mark.parametrize("chunk_rows", [25, 500_000])
@pytest.mark.parametrize("limit", [1, 4])
def test_admission_of_busy_and_quiet_scopes(spark, rows, limit, chunk_rows):
    df = spark.createDataFrame(rows, "k string, id string, timestamp timestamp, v int")
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in admit(df, ["k"], limit, chunk_rows=chunk_rows).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        times = [(r[2] - at(0)) // dt.timedelta(microseconds=1) for r in mine]
        assert [got[r[1]] for r in mine] == naive_limiter(times, limit, 60_000_000)


def test_quota_counts_earlier_rows_of_the_day(spark):
    rows = [trace(f"q{i}", i * 60, access_key_id="k" if i != 2 else "other", total_tokens=50, estimated_cost_usd=1.0) for i in range(5)]
    rows.append(trace("next-day", 23 * 3600, access_key_id="k", total_tokens=50))
    got = {r["id"]: r["quota_code"] for r in dicts(quota_codes(traces(spark, rows), Policy(0, 100), Policy(0, 0, 4.0)))}
    assert got == {"q0": "", "q1": "", "q2": "", "q3": "KEY_DAILY_TOKENS_EXCEEDED", "q4": "KEY_DAILY_TOKENS_EXCEEDED", "next-day": ""}
    only_workspace = {r["id"]: r["quota_code"] for r in dicts(quota_codes(traces(spark, rows), Policy(), Policy(0, 0, 4.0)))}
    assert only_workspace["q4"] == "WORKSPACE_DAILY_COST_EXCEEDED" and only_workspace["q3"] == ""


def test_quota_denials_do_not_use_rate_slots(spark):
    rows = [trace(f"d{i}", i, access_key_id="k", total_tokens=60) for i in range(4)]
    got = {r["id"]: r["limit_code"] for r in dicts(limit_decisions(traces(spark, rows), Policy(1, 100), Policy()))}
    assert got == {"d0": "", "d1": "KEY_RATE_LIMIT_EXCEEDED", "d2": "KEY_DAILY_TOKENS_EXCEEDED", "d3": "KEY_DAILY_TOKENS_EXCEEDED"}


WORDS = ["conversation.item.create", "response.create", "turn/start", "turn/steer", "response.done", "turn/completed", "", "x"]


def kind_open_after(messages):
    """Kind of the turn that is open after the messages, found by looking back anew from the last forcing one."""
    kind = None
    for i in range(len(messages) - 1, -1, -1):
        _, _, _, direction, opcode, word, _, _ = messages[i]
        client = direction == "client_to_upstream"
        if client and opcode == "text" and word == START:
            kind, rest = START, messages[i + 1 :]
            break
        if opcode == "close" or (not client and opcode == "text" and word in TERMINALS):
            kind, rest = None, messages[i + 1 :]
            break
    else:
        rest = messages
    asked = [m[5] for m in rest if m[3] == "client_to_upstream" and m[4] == "text"]
    if kind is None:
        asked = asked[next((n for n, w in enumerate(asked) if w in OPENERS), len(asked)) :]
        kind = asked[0] if asked else None
    return RESPONSE if kind not in (None, ITEM) and RESPONSE in asked else kind


def plain_turns(conn, messages):
    """All turns of one connection: each message's turn follows from what was open before and after it."""
    turns, code = [], 0
    us = lambda m: (m[2] - at(0)) // dt.timedelta(microseconds=1)
    for i, m in enumerate(messages):
        before, after = kind_open_after(messages[:i]), kind_open_after(messages[: i + 1])
        client, text = m[3] == "client_to_upstream", m[4] == "text"
        code = m[7] if m[4] == "close" else code
        fresh = after is not None and (before is None or (client and text and (m[5] == START or (m[5] == RESPONSE and before != ITEM))))
        if fresh:
            if before is not None:
                turns[-1].update(why="next_turn_start", ended=us(m), incomplete=True, code=code)
            turns.append({"kind": m[5], "started": us(m), "req": 0, "res": 0, "req_bytes": 0, "res_bytes": 0, "waits": []})
        if (before is not None or fresh) and m[4] != "close":
            side = "req" if client else "res"
            turns[-1][side] += 1
            turns[-1][f"{side}_bytes"] += m[6]
            turns[-1]["waits"] += [] if client else [us(m) - turns[-1]["started"]]
        if before is not None and after is None:
            closed = m[4] == "close"
            turns[-1].update(why="websocket_close" if closed else m[5], ended=us(m), incomplete=closed, code=code)
    for t in turns:
        if "why" not in t:
            t.update(why="connection_closed", ended=us(messages[-1]), incomplete=True, code=code)
    return [
        (n, t["kind"], t["why"], t["incomplete"], t["started"], t["ended"], t["req"], t["res"], t["req_bytes"], t["res_bytes"], next((w for w in t["waits"] if w), 0), t["code"]) for n, t in enumerate(turns, 1)
    ]


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    messages = []
    for i in range(500):
        conn = "hot" if rng.random() < HOT else f"c{rng.randrange(6)}"
        opcode = rng.choice(["text"] * 12 + ["binary", "close"])
        messages.append((conn, i, at(i + rng.randrange(1, 900) / 1000), rng.choice(["client_to_upstream", "upstream_to_client"]), opcode,
                         rng.choice(WORDS) if opcode == "text" else "", rng.randrange(100), 1000 + i if opcode == "close" else 0))
    return messages


def test_turns_equal_plain_ones(spark, talk):
    df = spark.createDataFrame(talk, "connection_id string, msg_id int, ts timestamp, direction string, opcode string, msg_type string, bytes bigint, close_code int")
    got = {(r["connection_id"], r["turn_index"]): r for r in turn_table(df, slice_seconds=30).collect()}
    want = {(c, t[0]): t for c in {m[0] for m in talk} for t in plain_turns(c, [m for m in talk if m[0] == c])}
    assert got.keys() == want.keys()
    for key, o in want.items():
        r = got[key]
        assert (r["start_type"], r["terminal_type"], r["incomplete"]) == o[1:4]
        assert (r["request_messages"], r["response_messages"], r["request_bytes"], r["response_bytes"]) == o[6:10]
        assert (r["first_response_us"], r["close_code"]) == o[10:12]


@pytest.mark.parametrize("batch", [1, 3, 17, 1000])
def test_turns_of_any_batches_equal_plain_ones(talk, batch):
    for conn in {m[0] for m in talk}:
        messages = [m for m in talk if m[0] == conn]
        frame = pd.DataFrame([((m[2] - at(0)) // dt.timedelta(microseconds=1), *m[3:]) for m in messages], columns=["us", "direction", "opcode", "msg_type", "bytes", "close_code"])
        out, saved = [], _FRESH
        for i in range(0, len(frame), batch):
            ended, saved = turns_of(frame.iloc[i : i + batch], saved)
            out += ended
        assert out + ([_left_open(saved)] if saved[1] is not None else []) == plain_turns(conn, messages)


def test_a_turn_from_payloads(spark):
    sent = [("c", '{"id":7,"method":"session/open"}'), ("s", '{"method":"session/ready"}'), ("c", '{"type":"conversation.item.create"}'), ("c", '{"type":"response.create"}'),
            ("s", '{"type":"response.output_text.delta"}'), ("s", "no json"), ("s", '{"type":"response.completed"}'), ("c", '{"method":"session/list"}')]
    df = spark.createDataFrame(
        [("ws", i, at(i), "client_to_upstream" if d == "c" else "upstream_to_client", "text", p, len(p), 0) for i, (d, p) in enumerate(sent)],
        "connection_id string, msg_id int, ts timestamp, direction string, opcode string, payload string, bytes bigint, close_code int",
    ).withColumn("msg_type", message_type("payload"))
    (turn,) = turn_table(df).collect()
    assert (turn["start_type"], turn["terminal_type"], turn["request_messages"], turn["response_messages"], turn["incomplete"]) == (ITEM, "response.completed", 2, 3, False)


def naive_order(names, parents, seqs, ties):
    """Topological order that looks for the best ready node anew in every step."""
    first = {}
    for n, name in enumerate(names):
        first.setdefault(name, n)
    parent = [first.get(p) if p and first.get(p) != n else None for n, p in enumerate(parents)]

    def circles(n):
        seen = set()
        at = parent[n]
        while at is not None and at not in seen:
            seen.add(at)
            at = parent[at]
        return n in seen

    def follows(n):
        return seqs[n] or (seqs[parent[n]] + 1 if parent[n] is not None and seqs[parent[n]] else 0)

    def leaves_room(n):
        below = [] if circles(n) else [leaves_room(c) for c, p in enumerate(parent) if p == n]
        return follows(n) or min((v - 1 for v in below if v > 1), default=0)

    def counted_on(n):
        return leaves_room(n) or (0 if circles(n) or parent[n] is None or not counted_on(parent[n]) else counted_on(parent[n]) + 1)

    seq = [counted_on(n) for n in range(len(seqs))]
    rank = lambda n: (seq[n] == 0, seq[n], ties[n])
    order: list[int] = []
    while True:
        ready = [n for n in range(len(seq)) if n not in order and (parent[n] is None or parent[n] in order)]
        if not ready:
            break
        order.append(min(ready, key=rank))
    order += sorted((n for n in range(len(seq)) if n not in order), key=rank)
    return [(order.index(n) + 1, seq[n]) for n in range(len(seq))]


def test_order_nodes_on_random_graphs():
    rng = random.Random(9)
    for _ in range(200):
        size = rng.randrange(1, 14)
        names = [f"n{rng.randrange(size) if rng.random() < 0.1 else i}" for i in range(size)]
        parents = [rng.choice(["", "gone", f"n{rng.randrange(size)}"]) for _ in range(size)]
        seqs = [rng.choice([0, 0, rng.randrange(1, 8)]) for _ in range(size)]
        ties = rng.sample(range(size), size)
        assert lineage.order_nodes(names, parents, seqs, ties) == naive_order(names, parents, seqs, ties)


def test_lineage_with_and_without_seq(spark):
    full = [trace(f"a{s}", t, trace_group_id="g", meta={"lineage_checkpoint_seq": s}) for s, t in ((3, 0), (1, 120), (2, 60))]
    partial = [
        trace("b3", 0, trace_group_id="h", meta={"lineage_parent_checkpoint_id": "b2"}),
        trace("b2", 180, trace_group_id="h", meta={"lineage_parent_checkpoint_id": "b1", "lineage_checkpoint_seq": 2}),
        trace("b1", 240, trace_group_id="h"),
    ]
    got = dicts(lineage.ordered_chains(traces(spark, full + partial)), "group_id", "step")
    assert [r["id"] for r in got] == ["a1", "a2", "a3", "b1", "b2", "b3"]
    assert [r["resolved_seq"] for r in got] == [1, 2, 3, 1, 2, 3]


def test_replay_adds_a_source_outside_the_cut(spark):
    t = traces(spark, [trace(f"r{i}", i, trace_group_id="g", meta={"lineage_checkpoint_seq": i + 1}) for i in range(6)])
    asked = spark.createDataFrame([("r0", "r4"), ("r5", ""), ("r5", "missing")], "source_id string, target_id string")
    out = lineage.replay(t, asked, 3)
    got = {}
    for r in out.orderBy("step").collect():
        got.setdefault((r["source_id"], r["target_id"]), []).append((r["id"], r["truncated"]))
    assert got == {("r0", "r4"): [("r0", False), ("r3", False), ("r4", False)], ("r5", "r5"): [("r3", True), ("r4", True), ("r5", True)]}


def test_replay_override_and_blank_thread(spark):
    rows = [trace(f"t{i}", i, trace_group_id="g", meta={"lineage_thread_id": f"th{i % 2}"}) for i in range(4)]
    rows.append(trace("plain", 9, trace_group_id="g"))
    t = traces(spark, rows)
    asked = spark.createDataFrame([("plain", "", ""), ("t0", "t3", "th1")], "source_id string, target_id string, thread_id string")
    got = {}
    for r in lineage.replay(t, asked).orderBy("step").collect():
        got.setdefault(r["source_id"], []).append(r["id"])
    assert got == {"plain": ["t0", "t1", "t2", "t3", "plain"], "t0": ["t0", "t1", "t3"]}


def test_fork_plan(spark):
    t = traces(spark, [trace("a", trace_group_id="g", meta={"lineage_checkpoint_seq": 4}), trace("b", trace_group_id="h"), trace("c")])
    asked = spark.createDataFrame([("a", ""), ("a", "b"), ("c", ""), ("a", "c")], "source_id string, checkpoint_id string")
    got = {(r["source_id"], r["source_checkpoint_id"]): r for r in lineage.fork_plan(t, asked).collect()}
    assert (got["a", "a"]["group_id"], got["a", "a"]["checkpoint_seq"], got["a", "a"]["thread_id"]) == ("g", 5, "thread_a")
    assert got["a", "b"]["rejected"] == "different_group" and got["a", "b"]["group_id"] is None
    assert (got["c", "c"]["group_id"], got["c", "c"]["checkpoint_seq"]) == ("c", 1)
    assert got["a", "c"]["group_id"] == "g" and got["a", "c"]["run_id"].startswith("run_")


def test_long_chains_are_not_cut(spark):
    """260 checkpoints in one chain: every link, every number and one root."""
    rows = [trace(f"t{n:03d}", n, meta={"lineage_group_id": "g", "lineage_checkpoint_id": f"c{n}", "lineage_checkpoint_seq": 1 if n == 0 else 0, **({"lineage_parent_checkpoint_id": f"c{n - 1}"} if n else {})}) for n in range(260)]
    t = traces(spark, rows)
    forest = lineage.forest(t).collect()
    assert [r["id"] for r in forest if r["is_root"]] == ["t000"] and sum(r["in_degree"] for r in forest) == 259
    ordered = {r["id"]: (r["step"], r["resolved_seq"], r["chain_size"], r["truncated"]) for r in lineage.ordered_chains(t).collect()}
    assert ordered == {f"t{n:03d}": (n + 1, n + 1, 260, False) for n in range(260)}
    cut = lineage.ordered_chains(t, 200).collect()
    assert len(cut) == 200 and all(r["truncated"] for r in cut)


def test_ids_are_unique_over_all_days(spark):
    from tracelake.session import new_folder
    from tracelake.streaming import jobs

    schema = "id string, org_id string, workspace_id string, timestamp timestamp, created_at timestamp"
    source, folder = new_folder(spark, "test-source"), new_folder(spark, "test-ingest")
    for day in range(3):
        row = lambda i, d: (i, "o", "w", at(86_400 * d), at(86_400 * d))
        spark.createDataFrame([row("a", day), row(f"b{day}", day), row(f"b{day}", day)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        traces_path, _, rejects_path = jobs.ingest_stream(stream, lambda batch: batch, folder)
    assert sorted(r["id"] for r in spark.read.parquet(traces_path).collect()) == ["a", "b0", "b1", "b2"]
    rejects = sorted((r["id"], r["reason"], r["rows"]) for r in spark.read.parquet(rejects_path).collect())
    assert rejects == [("a", "already_stored", 1)] * 2 + [(f"b{d}", "repeated_in_batch", 1) for d in range(3)]
