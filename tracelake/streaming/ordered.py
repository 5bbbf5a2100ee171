"""Keyed stream operators that take their rows in order of time, whatever order these arrive in.

The rows of a scope wait in disk-backed state until the watermark has passed their stretch of time; a timer then takes them in order. A
stretch with many rows is cut into 64 finer ones inside the state first, so a task holds ``MOST_ROWS`` rows or one Arrow batch at a
time, however busy the scope. Only the rows of one single microsecond are never cut.

In a live stream rows later than the watermark are dropped. In a bounded run over stored files (:func:`run_to_end`) the clock stands
still until every file is read, then passes everything: no row is late, in whatever order and in how many micro-batches the files come.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.operators.limits import RATE_SECONDS, SlidingLog
from tracelake.streaming.jobs import _FRESH, _OPEN, _TURN_STATE, LATENESS, TURN_SCHEMA, _left_open, stream_to_files, turns_of

# Stretches are 64 ** level microseconds long: 17 s in a live stream, nine years where nothing is due before the end (busy ones are cut).
LIVE, BOUNDED = 4, 8
MOST_ROWS = 200_000

# A row without a time.
TIMELESS = -(1 << 62)

# The clock of a bounded run: where it stands, and where it goes at the end (ms since 1970).
_STANDS, _END = 86_400_000, 221_845_392_000_000


class InOrder(StatefulProcessor):
    """Calls ``step`` with a scope's rows in order of time. What ``step`` carries on is the state between stretches.

    ``block``: Arrow schema of the columns that wait, ``us`` (microseconds) first.
    """

    block: pa.Schema
    order: tuple[str, ...]

    def __init__(self, level: int, most_rows: int = MOST_ROWS):
        self.level, self.most_rows = level, most_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows of a stretch, one block for each Arrow batch they came with, and how many blocks and rows a stretch has.
        self.waiting = handle.getMapState("waiting", "level long, stretch long, part long", "rows binary")
        self.stretches = handle.getMapState("stretches", "level long, stretch long", "parts long, held long")
        self.open_carry(handle)

    def close(self) -> None:
        pass

    # What a subclass gives: its carry, one step, and what is left when a scope falls silent.

    def open_carry(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self):
        raise NotImplementedError

    def save(self, carry) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: pd.DataFrame, carry) -> tuple[pd.DataFrame | None, object]:
        raise NotImplementedError

    def timeless(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        return None

    def silent_after(self, carry) -> int | None:
        """Time (us) from which the carry means nothing any more; None while only the end of the stream closes it."""
        raise NotImplementedError

    def finish(self, key: tuple, carry) -> pd.DataFrame | None:
        return None

    def fresh(self):
        raise NotImplementedError

    # Rows in

    def _store(self, level: int, rows: pd.DataFrame) -> list[int]:
        """Adds one batch of rows to the stretches of a level; returns those that are new."""
        stretch = rows["us"].to_numpy(dtype=np.int64) >> (6 * level)
        new = []
        for s in np.unique(stretch).tolist():
            parts, held = self.stretches.getValue((level, s)) or (0, 0)
            chosen = rows[stretch == s]
            data = pa.RecordBatch.from_pandas(chosen[self.block.names], self.block, preserve_index=False).serialize().to_pybytes()
            self.waiting.updateValue((level, s, parts), (data,))
            self.stretches.updateValue((level, s), (parts + 1, held + len(chosen)))
            if not parts:
                new.append(s)
        return new

    def _due_ms(self, stretch: int) -> int:
        end = -(-((stretch + 1) << (6 * self.level)) // 1000)
        return min(max(end, _STANDS), _END)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            none = batch["us"] == TIMELESS
            if none.any():
                out = self.timeless(key, batch[none])
                if out is not None:
                    yield out
            if not none.all():
                for s in self._store(self.level, batch[~none]):
                    self.handle.registerTimer(self._due_ms(s))

    # Rows out

    def _blocks(self, level: int, stretch: int, parts: int) -> Iterator[pd.DataFrame]:
        for part in range(parts):
            (data,) = self.waiting.getValue((level, stretch, part))
            self.waiting.removeKey((level, stretch, part))
            yield pa.ipc.read_record_batch(pa.py_buffer(bytes(data)), self.block).to_pandas()

    def _taken(self, level: int, stretch: int) -> Iterator[pd.DataFrame]:
        """The rows of a stretch, sorted; those of a busy one piece by piece."""
        parts, held = self.stretches.getValue((level, stretch))
        self.stretches.removeKey((level, stretch))
        if held <= self.most_rows or not level:
            rows = pd.concat(self._blocks(level, stretch, parts)) if parts > 1 else next(self._blocks(level, stretch, parts))
            yield rows.sort_values(list(self.order), na_position="first", kind="stable", ignore_index=True)
            return
        finer = set()
        for rows in self._blocks(level, stretch, parts):
            finer.update(self._store(level - 1, rows))
        for s in sorted(finer):
            yield from self._taken(level - 1, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        listed = sorted(s for _, s in self.stretches.keys())
        due = [s for s in listed if self._due_ms(s) <= now]
        carry = self.load()
        for s in due:
            for rows in self._taken(self.level, s):
                silent = self.silent_after(carry)
                if silent is not None and int(rows["us"].iloc[0]) > silent:
                    out, carry = self.finish(key, carry), self.fresh()
                    if out is not None:
                        yield out
                out, carry = self.step(key, rows, carry)
                if out is not None:
                    yield out
        if len(due) < len(listed):
            self.save(carry)
            return
        # Nothing waits: the scope ends here, or when it has been silent for long enough.
        silent = self.silent_after(carry)
        if now >= _END or silent is not None and silent <= now * 1000:
            out = self.finish(key, carry)
            if out is not None:
                yield out
            self.save(None)
            return
        self.save(carry)
        if silent is not None:
            self.handle.registerTimer(min(max(-(-silent // 1000), _STANDS), _END))


def _in_order(stream: DataFrame, scope: Sequence[str], columns: Sequence[str], time: str, make: Callable[[int], InOrder], out: T.StructType, bounded: bool) -> DataFrame:
    """``scope`` columns as one text (a NULL part is a scope of its own), rows waiting under the clock of the run."""
    when = F.col(time).cast("timestamp")
    us = F.coalesce(F.unix_micros(when), F.lit(TIMELESS)).alias("us")
    at = F.coalesce(F.col(_CLOCK), F.timestamp_millis(F.lit(_STANDS + 3_600_000))) if bounded else when
    slim = stream.select(F.to_json(F.struct(*scope)).alias("_scope"), us, *columns, at.alias("_at"))
    timed = slim.withWatermark("_at", "1 hour" if bounded else LATENESS)
    if bounded:
        timed = timed.filter(F.col("_at") < F.timestamp_millis(F.lit(_END)))
    result = timed.groupBy("_scope").transformWithStateInPandas(
        make(BOUNDED if bounded else LIVE), T.StructType([T.StructField("_scope", T.StringType()), *out.fields]), "append", "EventTime"
    )
    types = T.StructType([T.StructField(k, T.StringType()) for k in scope])
    return result.withColumn("_scope", F.from_json("_scope", types)).select("_scope.*", *out.fieldNames())


# ---- bounded runs -------------------------------------------------------------------------------

_CLOCK = "_clock"


def run_to_end(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Runs an operator (``bounded``) over all files there are, in as many micro-batches as the source asks for, then ends its stream.

    A second source brings nothing but the moment at which the clock passes everything. After a crash the same call with the same folder
    goes on where it stopped. An ended run is closed: rows that come later are ignored.
    """
    spark = stream.sparkSession
    _state_on_disk(spark)
    clock = os.path.join(folder, "clock")
    ticks = T.StructType([T.StructField(_CLOCK, T.TimestampType())])
    spark.createDataFrame([], ticks).write.mode("append").parquet(clock)
    told = stream.unionByName(spark.readStream.schema(ticks).parquet(clock), allowMissingColumns=True)
    stream_to_files(operator(told), folder)
    # An hour beyond the end, as the watermark stays an hour behind.
    spark.range(1).select(F.timestamp_millis(F.lit(_END + 3_600_000)).alias(_CLOCK)).write.mode("append").parquet(clock)
    return stream_to_files(operator(told), folder)


def _state_on_disk(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ---- turns --------------------------------------------------------------------------------------


class Turns(InOrder):
    """Turns of a connection. The carry is the open turn; a connection without messages for ``idle_us`` is closed."""

    block = pa.schema([("us", pa.int64()), ("msg_id", pa.int64()), ("direction", pa.string()), ("opcode", pa.string()), ("msg_type", pa.string()), ("bytes", pa.int64()), ("close_code", pa.int64())])
    order = ("us", "msg_id")

    def __init__(self, level: int, idle_us: int | None, most_rows: int = MOST_ROWS):
        super().__init__(level, most_rows)
        self.idle_us = idle_us

    def open_carry(self, handle):
        self.open = handle.getValueState("open", _TURN_STATE)

    def fresh(self):
        return _FRESH

    def load(self):
        return tuple(self.open.get() or _FRESH)

    def save(self, carry):
        if carry is None:
            self.open.clear()
        else:
            self.open.update(carry)

    @staticmethod
    def _frame(key, ended):
        return pd.DataFrame([(key[0], *t) for t in ended], columns=["_scope", *TURN_SCHEMA.fieldNames()[1:]]) if ended else None

    def step(self, key, rows, carry):
        ended, carry = turns_of(rows, carry)
        return self._frame(key, ended), carry

    def silent_after(self, carry):
        return None if self.idle_us is None or carry == _FRESH else carry[_OPEN.index("last")] + self.idle_us

    def finish(self, key, carry):
        return self._frame(key, [_left_open(carry)] if carry[1] is not None else [])


def turns_in_order(messages: DataFrame, bounded: bool = False, idle_seconds: int = 86_400, most_rows: int = MOST_ROWS) -> DataFrame:
    """Turns of a message stream, each once its end is certain; messages may come in any order.

    ``messages``: connection_id, msg_id (a number), ts, direction, opcode, msg_type, bytes, close_code. A message without a time belongs to no turn.
    In a live stream a connection that is silent for ``idle_seconds`` is closed, and its open turn with it; a bounded one closes all at its end only.
    """
    if idle_seconds * 1_000_000 < 64**LIVE:
        raise ValueError(f"idle_seconds must be at least {64**LIVE // 1_000_000 + 1}, the length of a stretch")
    idle = None if bounded else idle_seconds * 1_000_000
    typed = messages.withColumns({c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("bytes", "close_code")}).withColumn("msg_id", F.col("msg_id").cast("bigint"))
    schema = T.StructType(TURN_SCHEMA.fields[1:])
    return _in_order(typed, ["connection_id"], Turns.block.names[1:], "ts", lambda level: Turns(level, idle, most_rows), schema, bounded)


def all_turns(messages: DataFrame, folder: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """Turns of a bounded run over everything there is, the ones that nothing ended included."""
    return run_to_end(messages, lambda m: turns_in_order(m, bounded=True, most_rows=most_rows), folder)


# ---- limits -------------------------------------------------------------------------------------


class Limiter(InOrder):
    """Admissions of a scope. The carry is its sliding log: (time, how many) of at most ``limit`` requests."""

    block = pa.schema([("us", pa.int64()), ("id", pa.string())])
    order = ("us", "id")

    def __init__(self, level: int, limit: int, span: int, most_rows: int = MOST_ROWS):
        super().__init__(level, most_rows)
        self.limit, self.span = limit, span

    def open_carry(self, handle):
        self.log = handle.getListState("log", "us long, n long")

    def fresh(self):
        return SlidingLog(self.limit, self.span)

    def load(self):
        log = self.fresh()
        log.entries = deque([us, n] for us, n in self.log.get()) if self.log.exists() else deque()
        log.held = sum(n for _, n in log.entries)
        return log

    def save(self, carry):
        if carry is None or not carry.entries:
            self.log.clear()
        else:
            self.log.put([tuple(e) for e in carry.entries])

    def step(self, key, rows, carry):
        us = rows["us"].to_numpy(dtype=np.int64)
        times, first, counts = np.unique(us, return_index=True, return_counts=True)
        let_in, wait = carry.replay(times, counts)
        rank = np.arange(len(us)) - np.repeat(first, counts)
        admitted = rank < np.repeat(let_in, counts)
        return self._frame(key, rows, admitted, np.where(admitted, 0, np.repeat(wait, counts))), carry

    def timeless(self, key, rows):
        return self._frame(key, rows, True, 0)

    @staticmethod
    def _frame(key, rows, admitted, wait):
        return pd.DataFrame({"_scope": key[0], "id": rows["id"].to_numpy(), "admitted": admitted, "retry_after": wait})

    def silent_after(self, carry):
        return carry.entries[-1][0] + self.span if carry.entries else None


def limit_in_order(requests: DataFrame, keys: Sequence[str], limit: int, seconds: int = RATE_SECONDS, bounded: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """Admission of each request by time, then id, once its time has passed; requests may come in any order.

    Missing parts of a scope are a scope like any other; a request without a time is let in and counts for nobody, as in ``operators/limits.admit``.
    """
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.LongType())])
    return _in_order(requests, keys, ["id"], "timestamp", lambda level: Limiter(level, limit, seconds * 1_000_000, most_rows), out, bounded)


def all_admissions(requests: DataFrame, keys: Sequence[str], limit: int, folder: str, seconds: int = RATE_SECONDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Admissions of a bounded run over everything there is."""
    return run_to_end(requests, lambda r: limit_in_order(r, keys, limit, seconds, True, most_rows), folder)
