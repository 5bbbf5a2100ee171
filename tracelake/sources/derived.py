"""Trace-shaped tables derived from the shared test tables (events, conversations)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.pricing import estimate_cost
from tracelake.schema import conform, normalize
from tracelake.session import pin_utc


# A DataFrame is only a plan: one per session and folder is enough, and building it takes many small calls.
plan_once = lru_cache(maxsize=64)


# Spreading pays off from about this many bytes.
WORTH_SPREADING = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that lies in fewer splits than there are cores.

    A table of many files already has a task per split and is returned as it is, so nothing large
    is ever shuffled for this. Filters and column choices pass through to the scan.
    """
    execution = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if execution.toRdd().getNumPartitions() >= cores or int(str(execution.optimizedPlan().stats().sizeInBytes())) < WORTH_SPREADING:
        return df
    return df.repartition(cores)


@plan_once
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def _pick(value: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (value + 1).cast("int"))


# Raw trace rows: zeros, blanks and missing units are left in on purpose.
_EVENT_COLUMNS = """
  concat('tr_', lpad(string(event_id), 12, '0')) AS id
  concat('grp-', user_id) AS trace_group_id
  concat('org-', user_id % 3) AS org_id
  concat('ws-', user_id % 5) AS workspace_id
  ts AS timestamp
  CASE k % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'llm' END AS provider
  CASE WHEN k % 3 = 0 THEN if(k % 2 = 0, 'gpt-4o', 'gpt-4o-mini') WHEN k % 3 = 2 THEN 'local-model' ELSE element_at(array('claude-opus-4-1', 'claude-sonnet-4-20250514', 'claude-3-opus-20240229', 'Claude-3-Haiku-20240307'), k % 4 + 1) END AS model
  if(event_type = 'view', 'GET', 'POST') AS request_method
  CASE WHEN k % 3 = 0 THEN '/openai/v1/chat/completions' WHEN k % 3 = 1 THEN '/anthropic/v1/messages' WHEN k % 5 = 0 THEN '/llmish/v1/responses' WHEN k % 5 = 1 THEN '/llm' ELSE '/llm/v1/responses' END AS request_path
  if(event_type <> 'error', 200, element_at(array(400, 429, 500, 502), k % 4 + 1)) AS response_status
  int(floor(value * 10)) AS input_tokens
  k * 3 AS output_tokens
  if(event_id % 5 = 0, 0, int(floor(value * 10)) + k * 3) AS total_tokens
  bigint(floor(value * 7)) + k AS latency_ms
  if(event_id % 4 = 1, bigint(floor(value)) + 1, 0L) AS time_to_first_token_ms
  if(event_id % 4 = 2, bigint(floor(value * 1000)) + 1, 0L) AS time_to_first_token_us
  if(user_id % 7 = 6, '', concat('kh-', user_id % 50)) AS api_key_hash
  concat('{"streaming":', if(event_id % 4 IN (1, 2), 'true', 'false'), ',"access_key_id":"gk-', user_id, '","lineage_thread_id":"th-', user_id, '","lineage_run_id":"run-', event_id % 2, '"', if(event_id % 3 = 0, concat(',"lineage_checkpoint_seq":', event_id % 11), ''), '}') AS metadata
  ts + make_dt_interval(0, 0, 0, event_id % 7) AS created_at
"""


def raw_traces_from(events: DataFrame) -> DataFrame:
    with_k = events.selectExpr("*", """int(regexp_extract(props, '"k": ([0-9]+)', 1)) AS k""")
    return with_k.selectExpr(*[line.strip() for line in _EVENT_COLUMNS.strip().splitlines()])


@plan_once
def raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_traces_from(table(spark, sf_dir, "events"))


@plan_once
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form: all columns present, defaults filled, cost priced."""
    t = normalize(conform(raw_traces(spark, sf_dir)))
    return t.withColumn(
        "estimated_cost_usd",
        estimate_cost(F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens")),
    )


@plan_once
def access_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_ts"))
        .select(
            F.concat(F.lit("gk-"), user).alias("id"),
            F.concat(F.lit("th-"), user).alias("token_hash"),
            F.concat(F.lit("org-"), (F.col("user_id") % 3).cast("string")).alias("org_id"),
            F.concat(F.lit("ws-"), (F.col("user_id") % 5).cast("string")).alias("workspace_id"),
            _pick(F.col("user_id") % 4, ["owner", "developer", "viewer", "custom"]).alias("role"),
            F.when(F.col("user_id") % 4 == 3, F.lit("Analytics:Read")).otherwise(F.lit("")).alias("extra_permission"),
            "created_at",
            F.when(F.col("user_id") % 9 == 8, F.col("last_ts")).alias("revoked_at"),
        )
    )


@plan_once
def ws_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_messages_from(table(spark, sf_dir, "events"))


def ws_messages_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("conn-"), F.col("user_id").cast("string")).alias("connection_id"),
        F.col("event_id").alias("msg_id"),
        "ts",
        F.when(kind.isin("signup", "click"), F.lit("client_to_upstream"))
        .otherwise(F.lit("upstream_to_client"))
        .alias("direction"),
        F.when(kind == "error", F.lit("close")).otherwise(F.lit("text")).alias("opcode"),
        F.when(kind == "signup", F.when(F.col("event_id") % 3 == 0, F.lit("response.create"))
               .when(F.col("event_id") % 3 == 1, F.lit("turn/start")).otherwise(F.lit("conversation.item.create")))
        .when(kind == "click", F.lit("turn/steer"))
        .when(kind == "view", F.lit("response.delta"))
        .when(kind == "purchase", F.lit("turn/completed"))
        .otherwise(F.lit(""))
        .alias("msg_type"),
        F.length("props").cast("bigint").alias("bytes"),
        F.when(kind == "error", F.lit(1000) + (F.col("event_id") % 4).cast("int")).otherwise(F.lit(0)).alias("close_code"),
    )


@plan_once
def checkpoints(spark: SparkSession, sf_dir: str, forked: bool = False) -> DataFrame:
    """One checkpoint per conversation turn; the parent is the turn before.

    With ``forked`` every fourth turn hangs below the turn two before it.
    """
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")

    def name(t: Column) -> Column:
        return F.concat(F.lit("cp_"), conv, F.lit("_"), t.cast("string"))

    parent_turn = F.when((turn % 4 == 0) & F.lit(forked), turn - 2).otherwise(turn - 1)
    size = F.length("text")
    seq = F.when(size % 3 == 0, size % 7)
    metadata = F.to_json(
        F.struct(
            F.concat(F.lit("conv-"), conv).alias("lineage_group_id"),
            F.when(turn > 0, name(parent_turn)).alias("lineage_parent_checkpoint_id"),
            seq.alias("lineage_checkpoint_seq"),
            F.col("role").alias("speaker"),
        )
    )
    started = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        mins=F.col("conv_id"), secs=turn * 5
    )
    return c.select(
        name(turn).alias("id"),
        F.lit("").alias("trace_group_id"),
        F.concat(F.lit("org-"), (F.col("conv_id") % 3).cast("string")).alias("org_id"),
        F.lit("ws-0").alias("workspace_id"),
        started.alias("timestamp"),
        F.lit("llm").alias("provider"),
        F.lit("local-model").alias("model"),
        F.lit("POST").alias("request_method"),
        F.lit("/llm/v1/responses").alias("request_path"),
        F.lit(200).alias("response_status"),
        size.alias("input_tokens"),
        F.lit(0).alias("output_tokens"),
        size.alias("total_tokens"),
        (size % 97).cast("bigint").alias("latency_ms"),
        F.lit(0.0).alias("estimated_cost_usd"),
        F.col("text").alias("request_body"),
        metadata.alias("metadata"),
        started.alias("created_at"),
    )


HEADER_PREFIX = "X-Trace"


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def _sse(payload: Column, event: str | None = None) -> Column:
    head = f"event: {event}\n" if event else ""
    return F.concat(F.lit(head + "data: "), payload, F.lit("\n\n"))


@plan_once
def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured exchanges: each assistant turn answers the turn before it.

    Chat, messages and responses bodies take turns by conversation; every second answer is streamed.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    x = (
        turns.filter(F.col("role") == "assistant")
        .select("conv_id", "turn", F.col("text").alias("answer"))
        .join(asked, ["conv_id", "turn"], "left")
        .withColumns(
            {
                "question": F.coalesce("question", F.lit("")),
                "n_in": F.length(F.coalesce("question", F.lit(""))),
                "n_out": F.length("answer"),
                "fam": F.col("conv_id") % 3,
                "streaming": F.col("turn") % 4 == 1,
            }
        )
    )
    n_in, n_out, answer, question = F.col("n_in"), F.col("n_out"), F.col("answer"), F.col("question")
    gpt, haiku, local = F.lit("gpt-4o").alias("model"), F.lit("claude-3-haiku-20240307").alias("model"), F.lit("local-model").alias("model")
    chat_usage = F.struct(n_in.alias("prompt_tokens"), n_out.alias("completion_tokens"), (n_in + n_out).alias("total_tokens")).alias("usage")
    own_usage = F.struct(n_in.alias("input_tokens"), n_out.alias("output_tokens")).alias("usage")

    def say(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    ask_chat = _json(gpt, F.array(say("system", F.lit("Be brief.")), say("user", question)).alias("messages"))
    parts = F.array(F.struct(F.lit("text").alias("type"), question.alias("text")))
    ask_messages = _json(haiku, F.lit(100).alias("max_tokens"), F.array(say("user", parts)).alias("messages"))
    ask_own = _json(question.alias("input"))

    whole_chat = _json(
        gpt, F.array(F.struct(F.lit(0).alias("index"), say("assistant", answer).alias("message"))).alias("choices"), chat_usage
    )
    whole_messages = _json(haiku, F.array(F.struct(F.lit("text").alias("type"), answer.alias("text"))).alias("content"), own_usage)
    out_part = F.array(F.struct(F.lit("output_text").alias("type"), answer.alias("text")))
    out_item = F.array(F.struct(F.lit("message").alias("type"), F.lit("m1").alias("id"), out_part.alias("content")))
    whole_own = _json(F.struct(local, out_item.alias("output"), own_usage).alias("response"))

    pieces = F.split(answer, r"(?<=\n)")

    def per_piece(make) -> Column:
        return F.array_join(F.transform(pieces, make), "")

    chat_stream = F.concat(
        per_piece(
            lambda p: _sse(
                _json(gpt, F.array(F.struct(F.lit(0).alias("index"), F.struct(p.alias("content")).alias("delta"))).alias("choices"))
            )
        ),
        _sse(_json(chat_usage)),
        F.lit("data: [DONE]\n\n"),
    )
    messages_stream = F.concat(
        _sse(
            _json(
                F.lit("message_start").alias("type"),
                F.struct(haiku, F.struct(n_in.alias("input_tokens")).alias("usage")).alias("message"),
            ),
            "message_start",
        ),
        per_piece(
            lambda p: _sse(
                _json(
                    F.lit("content_block_delta").alias("type"),
                    F.lit(0).alias("index"),
                    F.struct(F.lit("text_delta").alias("type"), p.alias("text")).alias("delta"),
                ),
                "content_block_delta",
            )
        ),
        _sse(
            _json(F.lit("message_delta").alias("type"), F.struct(n_out.alias("output_tokens")).alias("usage")), "message_delta"
        ),
    )
    own_stream = F.concat(
        per_piece(
            lambda p: _sse(
                _json(
                    F.lit("response.output_text.delta").alias("type"),
                    F.lit("m1").alias("item_id"),
                    F.lit(0).alias("output_index"),
                    F.lit(0).alias("content_index"),
                    p.alias("delta"),
                ),
                "response.output_text.delta",
            )
        ),
        _sse(
            _json(F.lit("response.completed").alias("type"), F.struct(local, own_usage).alias("response")),
            "response.completed",
        ),
    )
    conv = F.col("conv_id").cast("string")

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), F.array(value).alias("value"))

    credential = F.when(F.col("conv_id") % 4 == 0, header("Authorization", F.concat(F.lit("Bearer sk-test-"), conv))).when(
        F.col("conv_id") % 4 == 1, header("X-Api-Key", F.concat(F.lit(" key-"), conv))
    ).when(F.col("conv_id") % 4 == 2, header("authorization", F.concat(F.lit("Basic "), conv)))
    headers = F.map_from_entries(
        F.filter(
            F.array(
                header("Content-Type", F.lit("application/json")),
                F.struct(
                    F.lit("user-agent").alias("key"),
                    F.array(F.concat(F.lit(" agent/"), conv), F.lit("sdk ")).alias("value"),
                ),
                credential,
                F.when(F.col("conv_id") % 5 == 0, header("Cookie", F.concat(F.lit("session="), conv))),
                header(f"{HEADER_PREFIX}-Trace-Group-ID", F.concat(F.lit("conv-"), conv)),
                header(f"{HEADER_PREFIX}-Thread-ID", F.concat(F.lit(" th-"), conv)),
                header(
                    f"{HEADER_PREFIX}-Checkpoint-Seq",
                    F.when(F.col("conv_id") % 6 == 5, F.lit("x1")).otherwise((F.col("turn") - 2).cast("string")),
                ),
                F.when(
                    F.col("turn") > 1,
                    header(
                        f"{HEADER_PREFIX}-Parent-Checkpoint-ID",
                        F.concat(F.lit("ex_"), conv, F.lit("_"), (F.col("turn") - 2).cast("string")),
                    ),
                ),
                F.when(F.col("conv_id") % 3 != 0, header("X-Request-ID", F.concat(F.lit("req:"), conv, F.when(F.col("conv_id") % 3 == 1, F.lit(" bad id")).otherwise(F.lit(""))))),
                header("X-Correlation-ID", F.concat(F.lit("corr."), conv)),
            ),
            lambda e: e.isNotNull(),
        )
    )

    def by_family(a: Column, b: Column, c: Column) -> Column:
        return F.when(F.col("fam") == 0, a).when(F.col("fam") == 1, b).otherwise(c)

    return x.select(
        F.concat(F.lit("ex_"), conv, F.lit("_"), F.col("turn").cast("string")).alias("exchange_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("conv_id"), secs=F.col("turn") * 5)).alias("started_at"),
        F.lit("POST").alias("method"),
        by_family(F.lit("/openai/v1/chat/completions"), F.lit("/anthropic/v1/messages"), F.lit("/llm/v1/responses")).alias("path"),
        headers.alias("request_headers"),
        F.create_map(
            F.lit("Content-Type"),
            F.array(F.when(F.col("streaming"), F.lit("Text/Event-Stream; charset=utf-8")).otherwise(F.lit("application/json"))),
        ).alias("response_headers"),
        by_family(ask_chat, ask_messages, ask_own).alias("request_body"),
        F.when(F.col("streaming"), by_family(chat_stream, messages_stream, own_stream))
        .otherwise(by_family(whole_chat, whole_messages, whole_own))
        .alias("response_body"),
        F.lit(200).alias("status_code"),
        "streaming",
        F.when(F.col("streaming"), F.size(pieces) + 2).otherwise(F.lit(0)).alias("stream_chunks"),
        (F.col("n_out") * 3).cast("bigint").alias("duration_ms"),
        F.lit(0).cast("bigint").alias("time_to_first_token_ms"),
        F.when(F.col("streaming"), F.col("n_out") * 7).otherwise(F.lit(0)).cast("bigint").alias("time_to_first_token_us"),
        "conv_id",
        "turn",
        "question",
        "answer",
    )


@plan_once
def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure messages of the trace writer, one per error event."""
    return write_log_from(table(spark, sf_dir, "events"))


def write_log_from(events: DataFrame) -> DataFrame:
    e = events.filter(F.col("event_type") == "error")
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("int")
    messages = [
        "dial tcp: Connection refused",
        "write: broken pipe",
        "i/o timeout",
        "context deadline exceeded",
        "SQLITE_BUSY: database is locked",
        "pq: duplicate key value violates unique constraint",
        "disk full",
    ]
    return e.select("event_id", F.col("ts"), _pick(k % 7, messages).alias("message"))


@plan_once
def queue_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue depth samples per instance."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("gw-"), (F.col("user_id") % 4).cast("string")).alias("instance"),
        "ts",
        F.least(F.floor(F.col("value") * 20).cast("int"), F.lit(1024)).alias("depth"),
        F.lit(1024).alias("capacity"),
        F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("dropped"),
    )
