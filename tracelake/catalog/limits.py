"""Rates, quotas and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.catalog.sql import on_traces, with_tables
from tracelake.operators import limits as ops
from tracelake.operators import turns
from tracelake.operators.limits import Policy
from tracelake.registry import query
from tracelake.session import persist_table
from tracelake.sources import derived


@query(
    "w4_trailing_rate",
    on_traces(
        """SELECT id, count(*) OVER (PARTITION BY org_id, workspace_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS workspace_requests,
        count(*) OVER (PARTITION BY org_id, workspace_id, access_key_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW) AS key_requests FROM traces"""
    ),
)
def trailing_rate(spark, sf):
    t = persist_table(derived.traces(spark, sf).select("id", *ops.KEY_SCOPE, "timestamp"), "rate-requests")
    per_key = ops.trailing_rate(t, ops.KEY_SCOPE, name="key_requests")
    return ops.trailing_rate(per_key, ops.WORKSPACE_SCOPE, 3600, "workspace_requests").select("id", "workspace_requests", "key_requests")


_ADMITTED_ONE = """WITH RECURSIVE k AS (SELECT id, org_id || '|' || workspace_id || '|' || access_key_id AS key, org_id || '|' || workspace_id AS ws, timestamp AS ts FROM traces),
  ka AS (SELECT key, min(ts) AS ts FROM k GROUP BY key UNION ALL
    SELECT a.key, min(k.ts) FROM ka a JOIN k ON k.key = a.key AND k.ts > a.ts + INTERVAL {seconds} SECOND GROUP BY a.key),
  kp AS (SELECT k.* FROM k JOIN ka USING (key, ts)),
  wa AS (SELECT ws, min(ts) AS ts FROM kp GROUP BY ws UNION ALL
    SELECT a.ws, min(kp.ts) FROM wa a JOIN kp ON kp.ws = a.ws AND kp.ts > a.ts + INTERVAL {seconds} SECOND GROUP BY a.ws)
  SELECT k.id, CASE WHEN ka.ts IS NULL THEN 'KEY_RATE_LIMIT_EXCEEDED' WHEN wa.ts IS NULL THEN 'WORKSPACE_RATE_LIMIT_EXCEEDED' ELSE '' END AS rate_code
  FROM k LEFT JOIN ka USING (key, ts) LEFT JOIN wa USING (ws, ts)"""

for _seconds in (60, 3600):

    @query(f"w5_rate_limit_audit_{_seconds}s", on_traces(_ADMITTED_ONE.format(seconds=_seconds)))
    def rate_limit_audit(spark, sf, seconds=_seconds):
        t = derived.traces(spark, sf).select("id", *ops.KEY_SCOPE, "timestamp")
        return ops.rate_limit_audit(t, Policy(1), Policy(1), seconds=seconds).select("id", "rate_code")


# The limiter as it runs: row by row with the log of the last admissions.
_ADMITTED_SOME = """WITH RECURSIVE k AS (SELECT id, org_id || '|' || workspace_id || '|' || access_key_id AS key, org_id || '|' || workspace_id AS ws, timestamp AS ts FROM traces),
  kn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM k),
  kr AS (SELECT id, key, ts, n, [ts] AS log, CAST(NULL AS BIGINT) AS wait FROM kn WHERE n = 1 UNION ALL
    SELECT id, key, ts, n, CASE WHEN len(live) < {key} THEN list_append(live, ts) ELSE live END,
      CASE WHEN len(live) < {key} THEN NULL ELSE greatest(1, ceil(epoch(live[1] + INTERVAL {seconds} SECOND - ts))) END
    FROM (SELECT kn.*, list_filter(kr.log, lambda a: a >= kn.ts - INTERVAL {seconds} SECOND) AS live FROM kr JOIN kn ON kn.key = kr.key AND kn.n = kr.n + 1)),
  wn AS (SELECT k.*, row_number() OVER (PARTITION BY ws ORDER BY k.ts, k.id) AS n FROM k JOIN kr ON k.id = kr.id WHERE kr.wait IS NULL),
  wr AS (SELECT id, ws, ts, n, [ts] AS log, CAST(NULL AS BIGINT) AS wait FROM wn WHERE n = 1 UNION ALL
    SELECT id, ws, ts, n, CASE WHEN len(live) < {workspace} THEN list_append(live, ts) ELSE live END,
      CASE WHEN len(live) < {workspace} THEN NULL ELSE greatest(1, ceil(epoch(live[1] + INTERVAL {seconds} SECOND - ts))) END
    FROM (SELECT wn.*, list_filter(wr.log, lambda a: a >= wn.ts - INTERVAL {seconds} SECOND) AS live FROM wr JOIN wn ON wn.ws = wr.ws AND wn.n = wr.n + 1))
  SELECT kr.id, CASE WHEN kr.wait IS NOT NULL THEN 'KEY_RATE_LIMIT_EXCEEDED' WHEN wr.wait IS NOT NULL THEN 'WORKSPACE_RATE_LIMIT_EXCEEDED' ELSE '' END AS rate_code,
    CAST(coalesce(kr.wait, wr.wait, 0) AS BIGINT) AS retry_after FROM kr LEFT JOIN wr ON kr.id = wr.id"""


@query("w5_rate_limit_audit_burst", on_traces(_ADMITTED_SOME.format(key=2, workspace=4, seconds=4 * 3600)))
def rate_limit_burst(spark, sf):
    t = derived.traces(spark, sf).select("id", *ops.KEY_SCOPE, "timestamp")
    return ops.rate_limit_audit(t, Policy(2), Policy(4), seconds=4 * 3600).select("id", "rate_code", "retry_after")


PER_KEY = Policy(1, 1500, 0.013000001)
PER_WORKSPACE = Policy(1, 12000, 0.110000001)
_QUOTA = """SELECT *, CASE WHEN kt >= 1500 THEN 'KEY_DAILY_TOKENS_EXCEEDED' WHEN kc >= 0.013000001 THEN 'KEY_DAILY_COST_EXCEEDED'
    WHEN wt >= 12000 THEN 'WORKSPACE_DAILY_TOKENS_EXCEEDED' WHEN wc >= 0.110000001 THEN 'WORKSPACE_DAILY_COST_EXCEEDED' ELSE '' END AS quota_code FROM (
  SELECT *, coalesce(sum(total_tokens) OVER k, 0) AS kt, coalesce(sum(estimated_cost_usd) OVER k, 0) AS kc, coalesce(sum(total_tokens) OVER w, 0) AS wt, coalesce(sum(estimated_cost_usd) OVER w, 0) AS wc FROM traces
  WINDOW k AS (PARTITION BY org_id, workspace_id, access_key_id, CAST(timestamp AS DATE) ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w AS (PARTITION BY org_id, workspace_id, CAST(timestamp AS DATE) ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "w6_daily_quota_audit",
    on_traces(f"SELECT id, CAST(kt AS BIGINT) AS key_tokens, round(kc, 8) AS key_cost, CAST(wt AS BIGINT) AS workspace_tokens, round(wc, 8) AS workspace_cost, quota_code FROM ({_QUOTA})"),
)
def daily_quota_audit(spark, sf):
    t = derived.traces(spark, sf).select("id", *ops.KEY_SCOPE, "timestamp", "total_tokens", "estimated_cost_usd")
    out = ops.quota_codes(t, PER_KEY, PER_WORKSPACE)
    return out.select(
        "id", "key_tokens", F.round("key_cost", 8).alias("key_cost"), "workspace_tokens", F.round("workspace_cost", 8).alias("workspace_cost"), "quota_code"
    )


@query(
    "w7_limit_decision_order",
    on_traces(
        _ADMITTED_ONE.format(seconds=60)
        .replace("FROM traces)", f"FROM ({_QUOTA}) WHERE quota_code = '')", 1)
        .replace("AS rate_code", "AS limit_code")
        + f" UNION ALL SELECT id, quota_code FROM ({_QUOTA}) WHERE quota_code <> ''"
    ),
)
def limit_decision_order(spark, sf):
    return ops.limit_decisions(derived.traces(spark, sf), PER_KEY, PER_WORKSPACE).select("id", "limit_code")


# Replays the open turn with a running state, written with ordered windows instead of slices.
_TURN_ROWS = """WITH a AS (SELECT *, direction = 'client_to_upstream' AS cl, opcode = 'text' AS tx FROM ws_messages),
  b AS (SELECT *, cl AND tx AND msg_type = 'turn/start' AS beg,
      (NOT cl AND tx AND msg_type = 'turn/completed') OR opcode = 'close' AS fin,
      CASE WHEN cl AND tx AND msg_type IN ('conversation.item.create', 'response.create', 'turn/steer') THEN msg_type END AS op FROM a),
  c AS (SELECT *, sum(CASE WHEN beg OR fin THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id ORDER BY ts, msg_id) AS seg FROM b),
  d AS (SELECT *, bool_or(beg) OVER s AS seg_open, first_value(op IGNORE NULLS) OVER p AS first_op, count(op) OVER p AS ops_so_far FROM c
    WINDOW s AS (PARTITION BY connection_id, seg), p AS (PARTITION BY connection_id, seg ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  e AS (SELECT *, beg OR (op IS NOT NULL AND NOT seg_open AND ops_so_far = 1) OR (coalesce(op = 'response.create', false) AND (seg_open OR first_op <> 'conversation.item.create')) AS st,
    lag(seg_open OR ops_so_far > 0) OVER (PARTITION BY connection_id ORDER BY ts, msg_id) AS was_open FROM d),
  f AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id ORDER BY ts, msg_id) AS turn_index,
    coalesce(CASE WHEN fin THEN was_open AND opcode <> 'close' ELSE seg_open OR ops_so_far > 0 END, false) AS in_turn, fin AND coalesce(was_open, false) AS ends_turn,
    coalesce(last_value(CASE WHEN opcode = 'close' THEN close_code END IGNORE NULLS) OVER (PARTITION BY connection_id ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS code FROM e)"""


@query(
    "w8_session_turn_number",
    with_tables(f"{_TURN_ROWS} SELECT connection_id, msg_id, CAST(turn_index AS BIGINT) AS turn_index, st AS starts_turn, in_turn, ends_turn FROM f", "ws_messages"),
)
def session_turn_number(spark, sf):
    out = turns.assign_turns(derived.ws_messages(spark, sf))
    return out.select("connection_id", "msg_id", "turn_index", "starts_turn", "in_turn", "ends_turn")


_TURNS = f"""{_TURN_ROWS},
  g AS (SELECT connection_id, turn_index, max(CASE WHEN st THEN ts END) AS started_at, arg_max(CASE WHEN st THEN msg_type END, CASE WHEN st THEN ts END) AS start_type,
      arg_max(code, CASE WHEN st THEN ts END) AS start_code,
      max(CASE WHEN ends_turn THEN ts END) AS end_ts, max(CASE WHEN ends_turn THEN CASE WHEN opcode = 'close' THEN 'websocket_close' ELSE msg_type END END) AS end_type, max(CASE WHEN ends_turn THEN code END) AS end_code,
      count(*) FILTER (WHERE in_turn AND cl) AS request_messages, count(*) FILTER (WHERE in_turn AND NOT cl) AS response_messages,
      coalesce(sum(bytes) FILTER (WHERE in_turn AND cl), 0) AS request_bytes, coalesce(sum(bytes) FILTER (WHERE in_turn AND NOT cl), 0) AS response_bytes,
      min(ts) FILTER (WHERE in_turn AND NOT cl) AS answered
    FROM f WHERE in_turn OR ends_turn GROUP BY ALL),
  h AS (SELECT g.*, lead(started_at) OVER w AS next_ts, lead(start_code) OVER w AS next_code, l.last_ts, l.last_code FROM g
    JOIN (SELECT connection_id, max(ts) AS last_ts, arg_max(code, ts) AS last_code FROM f GROUP BY connection_id) l USING (connection_id) WINDOW w AS (PARTITION BY connection_id ORDER BY turn_index))"""


@query(
    "t3_ws_turns",
    with_tables(
        f"""{_TURNS} SELECT connection_id, CAST(turn_index AS BIGINT) AS turn_index, start_type, coalesce(end_type, CASE WHEN next_ts IS NOT NULL THEN 'next_turn_start' ELSE 'connection_closed' END) AS terminal_type,
        coalesce(end_type = 'websocket_close', true) AS incomplete, started_at, coalesce(end_ts, next_ts, last_ts) AS ended_at FROM h""",
        "ws_messages",
    ),
)
def ws_turns(spark, sf):
    out = turns.turn_table(derived.ws_messages(spark, sf))
    return out.select("connection_id", "turn_index", "start_type", "terminal_type", "incomplete", "started_at", "ended_at")


@query(
    "t4_turn_metrics",
    with_tables(
        f"""{_TURNS} SELECT connection_id, CAST(turn_index AS BIGINT) AS turn_index, request_messages, response_messages, request_messages + response_messages AS stream_chunks,
        CAST(request_bytes AS BIGINT) AS request_bytes, CAST(response_bytes AS BIGINT) AS response_bytes, (epoch_us(coalesce(end_ts, next_ts, last_ts)) - epoch_us(started_at)) // 1000 AS duration_ms,
        coalesce(epoch_us(answered) - epoch_us(started_at), 0) AS first_response_us, CASE WHEN end_ts IS NOT NULL THEN end_code WHEN next_ts IS NOT NULL THEN next_code ELSE last_code END AS close_code FROM h""",
        "ws_messages",
    ),
)
def turn_metrics(spark, sf):
    out = turns.turn_table(derived.ws_messages(spark, sf))
    return out.select(
        "connection_id", "turn_index", "request_messages", "response_messages", "stream_chunks", "request_bytes", "response_bytes", "duration_ms", "first_response_us",
        F.col("close_code").cast("bigint").alias("close_code"),
    )


@query(
    "t5_sse_assembly",
    with_tables(
        """SELECT exchange_id, sha256(encode(answer)[1:300]) AS body_sha, len(string_split(answer, chr(10))) AS stream_chunks, octet_length(encode(answer)) AS total_bytes,
        octet_length(encode(answer)) > 300 AS truncated, 1500000 AS time_to_first_token_us FROM exchanges""",
        "exchanges",
    ),
)
def sse_assembly(spark, sf):
    x = derived.exchanges(spark, sf).select("exchange_id", "started_at", "answer")
    chunks = x.select("exchange_id", "started_at", F.posexplode(F.split("answer", r"(?<=\n)")).alias("seq", "piece")).select(
        "exchange_id",
        "seq",
        (F.col("started_at") + F.make_dt_interval(secs=F.col("seq") * 2 + F.lit(1.5))).alias("at"),
        F.col("piece").cast("binary").alias("data"),
    )
    out = turns.assemble_chunks(chunks, x.select("exchange_id", "started_at"), 300)
    return out.select("exchange_id", F.sha2("body", 256).alias("body_sha"), "stream_chunks", "total_bytes", "truncated", "time_to_first_token_us")
