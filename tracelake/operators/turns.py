"""Socket messages to turns.

Which turn is open only depends on the last message that forces a state (a turn/start opens, a
terminal message or a close frame ends) and the first opening message after it. So turns follow from
running counts and one small aggregate per segment; no connection is replayed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import sqltext as q
from tracelake.operators.sliced import in_ranges, running_max, running_sums
from tracelake.session import persist_table

# Message types that open and end turns.
ITEM, RESPONSE, START, STEER = "conversation.item.create", "response.create", "turn/start", "turn/steer"
OPENERS = (ITEM, RESPONSE, STEER)
TERMINALS = ("response.done", "response.completed", "response.failed", "error", "turn/completed", "turn/aborted", "turn/failed")
TYPE_WORDS = (ITEM, RESPONSE, "response.done", "response.completed", "response.failed", "error")
METHOD_WORDS = (START, STEER, "turn/completed", "turn/aborted", "turn/failed")


def message_type(payload: str) -> Column:
    """Known type or method of a text payload, '' for anything else."""

    def known(path: str, words: tuple[str, ...]) -> str:
        listed = ", ".join(f"'{w}'" for w in words)
        return q.let(q.trim(q.text("doc", path)).replace("doc", "{doc}"), lambda t: f"if({t} IN ({listed}), {t}, NULL)")

    def make(v: str) -> str:
        return f"coalesce({known('type', TYPE_WORDS).replace('{doc}', v)}, {known('method', METHOD_WORDS).replace('{doc}', v)}, '')"

    return F.expr(q.let(f"try_parse_json({payload})", make))


_CLIENT = "client_to_upstream"


def _placed(messages: DataFrame, slice_seconds: int | None) -> DataFrame:
    """Messages sorted by connection and cut once for all running values over them."""
    return messages if slice_seconds else in_ranges(messages, ["connection_id"], [F.col("ts"), F.col("msg_id")])


def assign_turns(messages: DataFrame, slice_seconds: int | None = None) -> DataFrame:
    """Add to each message: starts_turn, turn_index (turns started so far), in_turn, ends_turn.

    ``messages``: connection_id, msg_id, ts, direction, opcode, msg_type, close_code.
    """
    given, messages = messages.columns, _placed(messages, slice_seconds)
    client = F.col("direction") == _CLIENT
    text = F.col("opcode") == "text"
    begins = client & text & (F.col("msg_type") == START)
    ends = (~client & text & F.col("msg_type").isin(*TERMINALS)) | (F.col("opcode") == "close")
    opens = client & text & F.col("msg_type").isin(*OPENERS)
    place = F.struct("ts", "msg_id")
    m = messages.withColumns({"_begins": begins, "_ends": ends, "_opens": opens})
    m = running_sums(
        m, ["connection_id"], "ts", ["ts", "msg_id"], {"_segment": (F.col("_begins") | F.col("_ends")).cast("int")}, slice_seconds=slice_seconds
    )
    # Every step below reads its input more than once, so each is written once.
    m = persist_table(m, "turn-segments")
    segments = m.groupBy("connection_id", "_segment").agg(
        F.max("_begins").alias("_from_start"),
        F.min(F.when(F.col("_opens"), F.struct("ts", "msg_id", "msg_type"))).alias("_first"),
    )
    # A segment is the stretch between two forcing messages, so these tables have a row per turn or so.
    segments = persist_table(segments, "turn-openers")
    opened = F.col("_from_start") | F.col("_first").isNotNull()
    before = segments.select("connection_id", (F.col("_segment") + 1).alias("_segment"), opened.alias("_open_before"))
    m = m.join(segments, ["connection_id", "_segment"]).join(before, ["connection_id", "_segment"], "left")
    first_place = F.struct(F.col("_first.ts"), F.col("_first.msg_id"))
    is_first = F.col("_opens") & F.col("_first").isNotNull() & (place == first_place)
    loose = F.col("_from_start") | (F.col("_first.msg_type") != ITEM)
    again = client & text & (F.col("msg_type") == RESPONSE) & loose
    starts = F.col("_begins") | F.when(F.col("_from_start"), again).otherwise(is_first | again)
    m = persist_table(m.withColumn("starts_turn", F.coalesce(starts, F.lit(False))), "turn-starts")
    m = running_sums(m, ["connection_id"], "ts", ["ts", "msg_id"], {"turn_index": F.col("starts_turn").cast("int")}, slice_seconds=slice_seconds)
    running = F.col("_from_start") | (F.col("_first").isNotNull() & (place >= first_place))
    open_before = F.coalesce("_open_before", F.lit(False))
    return m.withColumns(
        {
            "ends_turn": F.col("_ends") & open_before,
            "in_turn": F.when(F.col("_ends"), open_before & (F.col("opcode") != "close")).otherwise(running),
        }
    ).select(*given, "starts_turn", "turn_index", "in_turn", "ends_turn")


def turn_table(messages: DataFrame, slice_seconds: int | None = None) -> DataFrame:
    """One row per turn: start, end, why it ended, message and byte counts, first response."""
    m = persist_table(assign_turns(_placed(messages, slice_seconds), slice_seconds), "turn-messages")
    seen_close = F.when(F.col("opcode") == "close", F.struct("ts", "msg_id", "close_code"))
    m = running_max(m, ["connection_id"], "ts", ["ts", "msg_id"], "_close", seen_close, slice_seconds=slice_seconds)
    code = F.coalesce(F.col("_close.close_code"), F.lit(0))
    request = F.col("in_turn") & (F.col("direction") == _CLIENT)
    response = F.col("in_turn") & (F.col("direction") != _CLIENT)
    turns = (
        m.filter(F.col("in_turn") | F.col("ends_turn"))
        .groupBy("connection_id", "turn_index")
        .agg(
            F.max(F.when(F.col("starts_turn"), F.struct("ts", "msg_type", code.alias("code")))).alias("_start"),
            F.max(F.when(F.col("ends_turn"), F.struct("ts", "opcode", "msg_type", code.alias("code")))).alias("_end"),
            F.count_if(request).alias("request_messages"),
            F.count_if(response).alias("response_messages"),
            F.coalesce(F.sum(F.when(request, F.col("bytes"))), F.lit(0)).alias("request_bytes"),
            F.coalesce(F.sum(F.when(response, F.col("bytes"))), F.lit(0)).alias("response_bytes"),
            F.min(F.when(response, F.col("ts"))).alias("_answered"),
        )
    )
    turns = persist_table(turns, "turns")
    following = turns.select("connection_id", (F.col("turn_index") - 1).alias("turn_index"), F.col("_start").alias("_next"))
    last = m.groupBy("connection_id").agg(
        F.max("ts").alias("_last_ts"), F.coalesce(F.max(F.when(F.col("opcode") == "close", F.struct("ts", "msg_id", "close_code"))).getField("close_code"), F.lit(0)).alias("_last_code")
    )
    turns = turns.join(following, ["connection_id", "turn_index"], "left").join(last, "connection_id")
    ended, followed = F.col("_end").isNotNull(), F.col("_next").isNotNull()
    closed = F.col("_end.opcode") == "close"
    ended_at = F.when(ended, F.col("_end.ts")).when(followed, F.col("_next.ts")).otherwise(F.col("_last_ts"))
    started = F.col("_start.ts")

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return turns.select(
        "connection_id",
        "turn_index",
        F.col("_start.msg_type").alias("start_type"),
        F.when(ended, F.when(closed, F.lit("websocket_close")).otherwise(F.col("_end.msg_type")))
        .when(followed, F.lit("next_turn_start"))
        .otherwise(F.lit("connection_closed"))
        .alias("terminal_type"),
        (~ended | closed).alias("incomplete"),
        started.alias("started_at"),
        ended_at.alias("ended_at"),
        "request_messages",
        "response_messages",
        (F.col("request_messages") + F.col("response_messages")).alias("stream_chunks"),
        "request_bytes",
        "response_bytes",
        F.floor((micros(ended_at) - micros(started)) / 1000).cast("bigint").alias("duration_ms"),
        F.coalesce(micros(F.col("_answered")) - micros(started), F.lit(0)).alias("first_response_us"),
        F.when(ended, F.col("_end.code")).when(followed, F.col("_next.code")).otherwise(F.col("_last_code")).alias("close_code"),
    )


def assemble_chunks(chunks: DataFrame, starts: DataFrame, max_bytes: int) -> DataFrame:
    """Body, chunk count, truncation and time to first token of streamed exchanges.

    ``chunks``: exchange_id, seq, at, data (binary); ``starts``: exchange_id, started_at. Chunks are
    cut to the byte cap before they are brought together, so what is collected per exchange is at
    most ``max_bytes``, however long the stream.
    """
    sized = chunks.withColumn("_bytes", F.octet_length("data").cast("bigint"))
    sized = running_sums(sized, ["exchange_id"], "at", ["at", "seq"], {"_before": F.col("_bytes")}, include_current=False)
    room = F.greatest(F.lit(max_bytes) - F.col("_before"), F.lit(0))
    piece = F.when((room > 0) & (F.col("_bytes") > 0), F.substring("data", F.lit(1), F.least(room, F.col("_bytes")).cast("int")))
    whole = sized.groupBy("exchange_id").agg(
        F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("at", "seq", piece.alias("piece"))))).alias("_pieces"),
        F.count(F.lit(1)).alias("stream_chunks"),
        F.sum("_bytes").alias("total_bytes"),
        F.min("at").alias("_first"),
    )
    # One pass over the pieces: text of their bytes as they are, joined at once.
    joined = F.unhex(F.array_join(F.transform("_pieces", lambda p: F.hex(p["piece"])), ""))
    first_us = F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return whole.join(starts, "exchange_id").select(
        "exchange_id",
        joined.alias("body"),
        "stream_chunks",
        "total_bytes",
        (F.col("total_bytes") > max_bytes).alias("truncated"),
        first_us.alias("time_to_first_token_us"),
    )
