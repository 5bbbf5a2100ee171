"""Streaming ingest, enrichment, limits and metrics.

All jobs read any streaming DataFrame, keep their progress in a checkpoint below the shared folder
and write files or run ``foreachBatch`` with writes that may be repeated.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.operators.analytics import RAW, raw_counts
from tracelake.operators.turns import ITEM, OPENERS, RESPONSE, START, TERMINALS
from tracelake.plans.build_trace import enrich
from tracelake.sources.store import append_batch, ensure_tenants

# Events later than this are dropped once their state is closed.
LATENESS = "10 minutes"


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Append a stream's rows to files and return them as a table."""
    path = os.path.join(folder, "rows")
    run_available(stream.writeStream.format("parquet").outputMode("append").option("path", path), os.path.join(folder, "checkpoint"))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# ---- ingest -------------------------------------------------------------------------------------


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A table that may not exist yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if found else None


def ingest_stream(exchanges: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str) -> tuple[str, str, str]:
    """Exchange stream -> trace table, tenant table and rejected rows (three paths).

    ``build`` turns exchanges into trace rows. Each micro-batch adds its missing tenants first and
    then only ids that no other batch has stored, on whatever day. Traces and rejects lie below their
    epoch, which a repeated batch replaces.
    """
    traces_path, tenants_path, rejects_path = (os.path.join(folder, n) for n in ("traces", "tenants", "rejects"))

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = build(batch).withColumn("day", F.to_date("timestamp"))
        rows.persist()
        try:
            tenant_schema = T.StructType([T.StructField(n, T.StringType()) for n in ("org_id", "workspace_id")])
            known = _stored(spark, tenants_path, tenant_schema)
            tenants = ensure_tenants(rows, spark.createDataFrame([], tenant_schema) if known is None else known)
            tenants.coalesce(1).write.mode("append").parquet(tenants_path)
            # The id is the key of the whole table: only its column is read, whatever the day.
            stored = _stored(spark, traces_path, rows.schema)
            target = rows.select("id").limit(0) if stored is None else stored.filter(F.col("epoch") != epoch).select("id")
            result = append_batch(rows, target)
            # An epoch's own folders are replaced, so a batch that runs twice changes nothing.
            for part, path in ((result.accepted.hint("rebalance", "day"), traces_path), (result.rejected, rejects_path)):
                part.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", *(["day"] if path == traces_path else [])).parquet(path)
        finally:
            rows.unpersist()

    run_available(exchanges.writeStream.foreachBatch(write), os.path.join(folder, "checkpoint"))
    return traces_path, tenants_path, rejects_path


def enrich_stream(traces: DataFrame, folder: str) -> DataFrame:
    """Prompt and response content of newly written traces, as a side table keyed by id.

    Readers prefer a value already stored in the trace, so nothing is overwritten.
    """
    derived = enrich(traces).select("id", "llm_request_prompt", "llm_response_content")
    return stream_to_files(derived, folder)


# ---- turns --------------------------------------------------------------------------------------

TURN_SCHEMA = T.StructType(
    [
        T.StructField("connection_id", T.StringType()),
        T.StructField("turn_index", T.LongType()),
        T.StructField("start_type", T.StringType()),
        T.StructField("terminal_type", T.StringType()),
        T.StructField("incomplete", T.BooleanType()),
        T.StructField("started_us", T.LongType()),
        T.StructField("ended_us", T.LongType()),
        T.StructField("request_messages", T.LongType()),
        T.StructField("response_messages", T.LongType()),
        T.StructField("request_bytes", T.LongType()),
        T.StructField("response_bytes", T.LongType()),
        T.StructField("first_response_us", T.LongType()),
        T.StructField("close_code", T.LongType()),
    ]
)

# The open turn of a connection (no kind: none is open) and what later turns need.
_OPEN = ("turns", "kind", "started", "asked", "answered", "asked_bytes", "answered_bytes", "wait", "code", "last")
_TURN_STATE = T.StructType([T.StructField(n, T.StringType() if n == "kind" else T.LongType()) for n in _OPEN])
_FRESH = (0, None, 0, 0, 0, 0, 0, 0, 0, 0)


def turns_of(rows: pd.DataFrame, saved: tuple = _FRESH) -> tuple[list[tuple], tuple]:
    """Turns that end within a connection's sorted messages, and what is open after them.

    The rules are those of the batch form (``operators/turns.py``): between two forcing messages a turn is open from the start,
    from the first opener or not at all. Everything follows from running counts over the messages.
    """
    held = dict(zip(_OPEN, saved))
    us, size, code = (rows[c].to_numpy(dtype=np.int64) for c in ("us", "bytes", "close_code"))
    word = rows["msg_type"].to_numpy(dtype=object)
    client = (rows["direction"] == "client_to_upstream").to_numpy()
    text, closes = ((rows["opcode"] == o).to_numpy() for o in ("text", "close"))
    n, place = len(rows), np.arange(len(rows))
    begins = client & text & (word == START)
    ends = ~client & text & np.isin(word, TERMINALS) | closes
    opens = client & text & np.isin(word, OPENERS)

    # Stretches between forcing messages; the first one goes on with what is held.
    stretch = np.cumsum(begins | ends)
    count = int(stretch[-1]) + 1
    opener = np.full(count, n)
    np.minimum.at(opener, stretch[opens], place[opens])
    since = np.where(opener < n, opener, n)
    first_kind = np.array([word[i] if i < n else None for i in opener], dtype=object)
    since[stretch[begins]], first_kind[stretch[begins]] = place[begins], START
    if held["kind"] is not None:
        since[0], first_kind[0] = (-1, held["kind"]) if not (n and stretch[0]) else (since[0], first_kind[0])
    open_at_end = since < n
    before = np.concatenate([[held["kind"] is not None], open_at_end[:-1]])

    # A response request starts a new turn unless an item opened the one that is open.
    again = client & text & (word == RESPONSE) & (place > since[stretch]) & (first_kind[stretch] != ITEM)
    starts = begins | again | (place == since[stretch])
    turn = held["turns"] + np.cumsum(starts)
    ended = ends & np.where(ends, before[np.maximum(stretch, 0)], False)
    if n and stretch[0] and ends[0]:
        ended[0] = held["kind"] is not None
    inside = np.where(ends, ended & ~closes, place >= since[stretch])
    # What ends a turn belongs to it; where a start follows an open turn, that one ends here.
    cut = starts & np.where(place == 0, held["kind"] is not None, np.concatenate([[False], (place >= since[stretch])[:-1] & ~ends[:-1]]))
    seen = np.maximum.accumulate(np.where(closes, place, -1))
    codes = np.where(seen >= 0, code[np.maximum(seen, 0)], held["code"])

    base, many = held["turns"], int(turn[-1]) - held["turns"] + 1 if n else 1
    at = turn - base
    started = np.full(many, held["started"])
    started[at[starts]] = us[starts]
    kind = np.array([held["kind"]] + [None] * (many - 1), dtype=object)
    kind[at[starts]] = word[starts]
    sums = {}
    for name, chosen, value in (("asked", inside & client, 1), ("answered", inside & ~client, 1), ("asked_bytes", inside & client, size), ("answered_bytes", inside & ~client, size)):
        sums[name] = np.bincount(at[chosen], weights=np.broadcast_to(value, n)[chosen], minlength=many).astype(np.int64)
        sums[name][0] += held[name]
    wait = np.zeros(many, dtype=np.int64)
    wait[0] = held["wait"]
    replies = np.flatnonzero(inside & ~client)
    for i in replies[::-1]:
        late = us[i] - started[at[i]]
        if late and not (at[i] == 0 and held["wait"]):
            wait[at[i]] = late

    out = []
    for i in np.flatnonzero(ended | cut):
        k = at[i] - 1 if cut[i] else at[i]
        why = "next_turn_start" if cut[i] else "websocket_close" if closes[i] else word[i]
        out.append((int(base + k), kind[k], why, bool(cut[i] or closes[i]), int(started[k]), int(us[i]), *(int(sums[s][k]) for s in ("asked", "answered", "asked_bytes", "answered_bytes")), int(wait[k]), int(codes[i])))
    k, still = many - 1, bool(open_at_end[-1])
    rest = (int(base + k), kind[k] if still else None, int(started[k]), *(int(sums[s][k]) for s in ("asked", "answered", "asked_bytes", "answered_bytes")), int(wait[k]), int(codes[-1]), max(held["last"], int(us[-1])))
    return out, rest


def _left_open(saved: tuple) -> tuple:
    """The row of a turn that nothing ended: it ends with its connection's last message."""
    h = dict(zip(_OPEN, saved))
    return (h["turns"], h["kind"], "connection_closed", True, h["started"], h["last"], h["asked"], h["answered"], h["asked_bytes"], h["answered_bytes"], h["wait"], h["code"])


def _turns(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    saved = tuple(state.get) if state.exists else _FRESH
    if state.hasTimedOut:
        out = [_left_open(saved)] if saved[1] is not None else []
        state.remove()
    else:
        # One connection's rows of one micro-batch.
        out, saved = turns_of(pd.concat(list(pdfs)).sort_values(["us", "msg_id"]), saved)
        state.update(saved)
        state.setTimeoutTimestamp(max(saved[-1] // 1000 + _IDLE_MS, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame([(key[0], *t) for t in out], columns=TURN_SCHEMA.fieldNames())


# A connection without messages for this long counts as closed.
_IDLE_MS = 24 * 3600 * 1000


def turn_stream(messages: DataFrame) -> DataFrame:
    """Finished turns of a message stream as soon as their end arrives; the open turn of each connection is its state.

    Takes messages in the order of their micro-batches, whose size the source's trigger options bound. Where files may come out of order, use
    ``ordered.turns_in_order``, which waits for the watermark.
    """
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    rows = timed.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("connection_id").applyInPandasWithState(
        _turns, TURN_SCHEMA, _TURN_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


# ---- limits -------------------------------------------------------------------------------------


# Lateness of a bounded run over stored files, which may come in any order: nothing since 1970 is late.
NEVER_LATE = "36500 days"


def quota_stream(traces: DataFrame, keys: Sequence[str], folder: str, lateness: str = "1 day") -> DataFrame:
    """Tokens and cost per scope and UTC day, refreshed with every batch; returns the newest state."""
    timed = traces.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    used = timed.groupBy(F.window("timestamp", "1 day").alias("w"), *keys).agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("estimated_cost_usd").alias("total_cost_usd")
    )
    flat = used.select(F.to_date("w.start").alias("day"), *keys, "total_tokens", "total_cost_usd")
    return newest_updates(flat, ["day", *keys], folder)


# ---- tables of the newest updates ---------------------------------------------------------------

# So many batches of updates are merged into one table of the newest row of each key.
MERGE_EVERY = 16


class UpdateTable:
    """The newest row of each key of a stream of updates, below one folder.

    ``epoch=N`` holds the updates of one batch, ``merged=N`` the newest rows up to that batch. A reader takes the last complete merged table and the
    at most ``merge_every`` epochs after it, so reading costs what the keys cost, however many batches there were. Epochs and merged tables are
    removed once the second next merged table is complete, so readers of the one before are not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], merge_every: int = MERGE_EVERY):
        self.spark, self.path, self.keys, self.merge_every = spark, path, list(keys), merge_every
        self.schema = T.StructType([*schema.fields, T.StructField("_epoch", T.LongType())])

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _numbers(self, kind: str) -> list[int]:
        """Epochs whose folder of this kind is complete."""
        fs, folder = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return [n for n in numbers if fs.exists(self._fs(f"{self.path}/{kind}={n}/_SUCCESS")[1])]

    def folders(self) -> list[str]:
        """What a reader takes."""
        merged = self._numbers("merged")[-1:]
        after = [n for n in self._numbers("epoch") if not merged or n > merged[0]]
        return [f"{self.path}/merged={n}" for n in merged] + [f"{self.path}/epoch={n}" for n in after]

    def _rows(self) -> DataFrame:
        folders = self.folders()
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        values = [c for c in self.schema.fieldNames() if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_epoch").alias("_n")).select(*self.keys, "_n.*")

    def read(self) -> DataFrame:
        return self._rows().select(*[c for c in self.schema.fieldNames() if c != "_epoch"])

    def write(self, batch: DataFrame, epoch: int) -> None:
        """A batch of updates; one that runs again replaces its own folder, or is known to be merged."""
        merged = self._numbers("merged")
        if merged and merged[-1] >= epoch:
            return
        batch.withColumn("_epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        if len(self.folders()) - len(merged[-1:]) < self.merge_every:
            return
        self._rows().write.mode("overwrite").parquet(f"{self.path}/merged={epoch}")
        # Nobody reads what the merged table before the last one has replaced.
        old = merged[-1] if merged else -1
        for kind, numbers in (("epoch", [n for n in self._numbers("epoch") if n <= old]), ("merged", merged[:-1])):
            for n in numbers:
                fs, folder = self._fs(f"{self.path}/{kind}={n}")
                fs.delete(folder, True)


def newest_updates(changes: DataFrame, keys: Sequence[str], folder: str, merge_every: int = MERGE_EVERY) -> DataFrame:
    """Runs a streaming aggregate over everything there is and returns the last state of each key."""
    table = UpdateTable(changes.sparkSession, os.path.join(folder, "updates"), changes.schema, keys, merge_every)
    run_available(changes.writeStream.outputMode("update").foreachBatch(table.write), os.path.join(folder, "checkpoint"))
    return table.read()


# ---- metrics ------------------------------------------------------------------------------------


def metrics_stream(traces: DataFrame, keys: Sequence[str] = ("provider",), every: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Requests, errors and latency per sliding window, emitted once a window can no longer change."""
    timed = traces.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", LATENESS)
    status = F.col("response_status")
    return (
        timed.groupBy(F.window("timestamp", every, slide).alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.count_if((status >= 500) & (status < 600)).alias("error_count"),
            F.max("latency_ms").alias("max_latency_ms"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "request_count", "error_count", "max_latency_ms")
    )


def counts_stream(traces: DataFrame, folder: str, every: str = "5 minutes", lateness: str = "1 day") -> DataFrame:
    """The counts behind request counter, latency buckets, quantile and ratio alert, from one stream.

    Takes the place of ``raw_counts`` by ``window_start``: the last windows are there too, as they stand.
    """
    timed = traces.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    counted = raw_counts(timed, F.window("timestamp", every).alias("w"))
    flat = counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *[c for c in counted.columns if c != "w"])
    return newest_updates(flat, ["window_start", *RAW], folder)


def failures_stream(log: DataFrame, time_col: str, keys: Sequence[str], folder: str, every: str = "1 minute", lateness: str = "1 day") -> DataFrame:
    """Failures by ``keys`` and slide, the counts behind the increase alert; one row of state each, not one for each window it lies in."""
    timed = log.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    counted = timed.groupBy(F.window(time_col, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("failures"))
    return newest_updates(counted.select(F.col("w.start").cast("timestamp_ntz").alias("slide_start"), *keys, "failures"), ["slide_start", *keys], folder)
