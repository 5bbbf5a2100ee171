"""Quota and rate limit audits over stored traces."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.sliced import SLICE, running_sums, top_rows, trailing_count
from tracelake.session import persist_table

KEY_SCOPE = ("org_id", "workspace_id", "access_key_id")
WORKSPACE_SCOPE = ("org_id", "workspace_id")

# Fixed value: length of the rate window.
RATE_SECONDS = 60


@dataclass(frozen=True)
class Policy:
    requests_per_minute: int = 0
    max_tokens_per_day: int = 0
    max_cost_usd_per_day: float = 0.0


def trailing_rate(traces: DataFrame, keys: Sequence[str], seconds: int = RATE_SECONDS, name: str = "requests") -> DataFrame:
    """Requests of the scope in the trailing window, the row itself and both ends included."""
    return trailing_count(traces, keys, "timestamp", seconds, name)


def _used_before(traces: DataFrame, keys: Sequence[str], prefix: str, slice_seconds: int | None) -> DataFrame:
    sums = {f"{prefix}_tokens": F.col("total_tokens").cast("bigint"), f"{prefix}_cost": F.col("estimated_cost_usd")}
    return running_sums(traces, [*keys, "_day"], "timestamp", ["timestamp", "id"], sums, slice_seconds=slice_seconds, include_current=False)


def quota_codes(traces: DataFrame, per_key: Policy, per_workspace: Policy, slice_seconds: int | None = None) -> DataFrame:
    """Add the tokens and cost used before each row on its UTC day and the limit they had reached.

    Usage at the limit counts as exceeded. Key limits are checked before workspace limits, tokens
    before cost.
    """
    day = traces.withColumn("_day", F.to_date("timestamp"))
    # A running sum reads its input twice, so the first result is written once.
    by_key = persist_table(_used_before(day, KEY_SCOPE, "key", slice_seconds), "quota-keys")
    used = _used_before(by_key, WORKSPACE_SCOPE, "workspace", slice_seconds)
    keyless = F.col("access_key_id") == ""
    used = used.withColumns(
        {f"key_{m}": F.when(keyless, F.col(f"workspace_{m}")).otherwise(F.col(f"key_{m}")) for m in ("tokens", "cost")}
    )
    codes = []
    for scope, policy in (("key", per_key), ("workspace", per_workspace)):
        if policy.max_tokens_per_day > 0:
            codes.append(F.when(F.col(f"{scope}_tokens") >= policy.max_tokens_per_day, F.lit(f"{scope.upper()}_DAILY_TOKENS_EXCEEDED")))
        if policy.max_cost_usd_per_day > 0:
            codes.append(F.when(F.col(f"{scope}_cost") >= policy.max_cost_usd_per_day, F.lit(f"{scope.upper()}_DAILY_COST_EXCEEDED")))
    return used.withColumn("quota_code", F.coalesce(*codes, F.lit("")) if codes else F.lit("")).drop("_day")


def replay_limit(times: np.ndarray, warm: np.ndarray, limit: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Admission of ordered request times (microseconds); warm ones were admitted earlier.

    Only the last ``limit`` admitted times are kept. While the window is full everything up to the
    time it opens again is denied at once.
    """
    size = len(times)
    admitted = np.zeros(size, dtype=bool)
    retry = np.zeros(size, dtype=np.int64)
    last: deque[int] = deque(maxlen=limit)
    n = 0
    while n < size:
        if warm[n] or len(last) < limit or times[n] > last[0] + span:
            admitted[n] = True
            last.append(int(times[n]))
            n += 1
            continue
        opens = int(np.searchsorted(times, last[0] + span, side="right"))
        wait = (last[0] + span - times[n:opens]) / 1_000_000
        retry[n:opens] = np.maximum(1, np.ceil(wait)).astype(np.int64)
        n = opens
    return admitted, retry


class SlidingLog:
    """The last ``limit`` admissions of one scope, as (time, how many) with equal times together."""

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span
        self.entries: deque[list[int]] = deque()
        self.held = 0

    def _let_in(self, t: int, wanted: int) -> int:
        while self.entries and self.entries[0][0] < t - self.span:
            self.held -= self.entries.popleft()[1]
        room = min(wanted, self.limit - self.held)
        if room:
            self.entries.append([t, room])
            self.held += room
        return room

    def replay(self, times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many requests of each of the ascending times get in, and how long (s) the others have to wait.

        While the log is full, everything up to the time its oldest entry leaves is denied at once.
        """
        size = len(times)
        admitted, wait = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        n = 0
        while n < size:
            admitted[n] = self._let_in(int(times[n]), int(counts[n]))
            if admitted[n] == counts[n]:
                n += 1
                continue
            opens = self.entries[0][0] + self.span
            end = max(n + 1, int(np.searchsorted(times, opens, side="right")))
            wait[n:end] = np.maximum(1, -((times[n:end] - opens) // 1_000_000))
            n = end
        return admitted, wait


_ROW, _SCOPE, _US = "_row", "_scope", "_us"


def _scoped(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row number, scope as one text (a NULL part is a scope of its own), time in microseconds and id."""
    return rows.select(_ROW, F.to_json(F.struct(*keys)).alias(_SCOPE), F.unix_micros(F.col("timestamp").cast("timestamp")).alias(_US), "id")


def _busy_times(slim: DataFrame, limit: int, span: int) -> DataFrame:
    """``scope, episode, us, n, warm``: the distinct times at which a limit may bite, with their requests.

    Time is cut into slices of one window. A slice that holds ``limit`` requests at most together with the one before is calm: all of
    them get in, whatever came earlier. The other slices form episodes; each starts from a calm slice, whose times come along as
    ``warm``, so that episodes do not depend on one another.
    """
    times = persist_table(slim.filter(F.col(_US).isNotNull()).groupBy(_SCOPE, _US).agg(F.count(F.lit(1)).alias("n")), "rate-times")
    times = times.withColumn(SLICE, F.floor(F.col(_US) / F.lit(span)).cast("bigint"))
    # One row per scope and slice from here on.
    timeline = Window.partitionBy(_SCOPE).orderBy(SLICE)
    follows = F.lag(SLICE).over(timeline) == F.col(SLICE) - 1
    slices = times.groupBy(_SCOPE, SLICE).agg(F.sum("n").alias("held"))
    slices = slices.withColumn("busy", F.col("held") + F.coalesce(F.when(follows, F.lag("held").over(timeline)), F.lit(0)) > limit)
    starts = F.col("busy") & ~F.coalesce(follows & F.lag("busy").over(timeline), F.lit(False))
    slices = slices.withColumn("starts", starts).withColumn("episode", F.sum(F.col("starts").cast("int")).over(timeline)).filter("busy")
    warm = slices.filter("starts").select(_SCOPE, (F.col(SLICE) - 1).alias(SLICE), "episode", F.lit(True).alias("warm"))
    wanted = slices.select(_SCOPE, SLICE, "episode", F.lit(False).alias("warm")).unionByName(warm)
    return times.join(wanted, [_SCOPE, SLICE]).select(_SCOPE, "episode", _US, "n", "warm")


def _refused_times(busy: DataFrame, limit: int, span: int, chunk_rows: int) -> DataFrame:
    """``scope, us, let_in, wait`` of the times at which not all requests get in.

    An episode is a stream of (time, count), at most one pair per microsecond however many requests there were; its task holds a
    chunk of it and the log.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        log, last = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                scope, episode = part.column(0), part.column(1)
                change = pc.or_(pc.not_equal(scope[1:], scope[:-1]), pc.not_equal(episode[1:], episode[:-1])).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(change) + 1).tolist(), part.num_rows]
                times, counts, warm = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                let_in, wait = np.zeros(part.num_rows, dtype=np.int64), np.zeros(part.num_rows, dtype=np.int64)
                for a, b in zip(cuts, cuts[1:]):
                    key = (scope[a].as_py(), episode[a].as_py())
                    if key != last:
                        log, last = SlidingLog(limit, span), key
                    let_in[a:b], wait[a:b] = log.replay(times[a:b], counts[a:b])
                refused = np.flatnonzero((let_in < counts) & ~warm)
                columns = [scope.take(pa.array(refused)), pa.array(times[refused]), pa.array(let_in[refused]), pa.array(wait[refused])]
                yield pa.RecordBatch.from_arrays(columns, [_SCOPE, _US, "let_in", "wait"])

    ordered = busy.repartition(_SCOPE, "episode").sortWithinPartitions(_SCOPE, "episode", _US)
    return ordered.mapInArrow(run, f"{_SCOPE} string, {_US} long, let_in long, wait long")


def _denied(slim: DataFrame, limit: int, span: int, chunk_rows: int) -> DataFrame:
    """``_row, wait`` of the requests that the limiter turns away. A fixed number of jobs, whatever the limit and the load."""
    refused = persist_table(_refused_times(_busy_times(slim, limit, span), limit, span, chunk_rows), "rate-refused")
    at_full = slim.join(refused, [_SCOPE, _US])
    # Of requests at one time, the first by id get in as long as there is room.
    chosen = top_rows(at_full.filter("let_in > 0"), [_SCOPE, _US], [F.col("id"), F.col(_ROW)], limit).filter(F.col("_rank") <= F.col("let_in"))
    return persist_table(at_full.join(chosen.select(_ROW), _ROW, "left_anti").select(_ROW, "wait"), "rate-denied")


def _numbered(requests: DataFrame) -> DataFrame:
    """Each row with a number of its own, written once: ids may repeat or be missing."""
    return persist_table(requests.withColumn(_ROW, F.monotonically_increasing_id()), "rate-rows")


def admit(requests: DataFrame, keys: Sequence[str], limit: int, *, seconds: int = RATE_SECONDS, chunk_rows: int = 500_000) -> DataFrame:
    """Add ``admitted`` and ``retry_after`` of a limiter that lets ``limit`` requests per window through.

    Denied requests do not count, so admission depends on order: by time, then id. Every row comes back once, with repeated or missing
    ids too. Missing parts of a scope are a scope like any other; a request without a time lies in no window and is let in.
    """
    rows = _numbered(requests)
    denied = _denied(_scoped(rows, keys), limit, seconds * 1_000_000, chunk_rows)
    out = rows.join(denied, _ROW, "left")
    return out.select(*requests.columns, F.col("wait").isNull().alias("admitted"), F.coalesce("wait", F.lit(0)).cast("bigint").alias("retry_after"))


def rate_limit_audit(requests: DataFrame, per_key: Policy, per_workspace: Policy, *, seconds: int = RATE_SECONDS, chunk_rows: int = 500_000) -> DataFrame:
    """Add ``rate_code`` and ``retry_after``: the key limit first, then the workspace limit.

    A request denied for its workspace has still used its key's slot, so the workspace pass runs
    over the requests the key pass let through.
    """
    span = seconds * 1_000_000
    rows = _numbered(requests)
    out, passed = rows, rows.select(_ROW, "id", "timestamp", *KEY_SCOPE)
    waits: list[tuple[str, str]] = []
    for scope, keys, policy in (("KEY", KEY_SCOPE, per_key), ("WORKSPACE", WORKSPACE_SCOPE, per_workspace)):
        if policy.requests_per_minute <= 0:
            continue
        denied = _denied(_scoped(passed, keys), policy.requests_per_minute, span, chunk_rows)
        passed = passed.join(denied, _ROW, "left_anti")
        waits.append((f"{scope}_RATE_LIMIT_EXCEEDED", f"_wait_{scope.lower()}"))
        out = out.join(denied.withColumnRenamed("wait", waits[-1][1]), _ROW, "left")
    codes = [F.when(F.col(name).isNotNull(), F.lit(code)) for code, name in waits]
    wait = F.coalesce(*[F.col(name) for _, name in waits], F.lit(0)).cast("bigint")
    return out.select(*requests.columns, F.coalesce(*codes, F.lit("")).alias("rate_code"), wait.alias("retry_after"))


def limit_decisions(traces: DataFrame, per_key: Policy, per_workspace: Policy, *, seconds: int = RATE_SECONDS, slice_seconds: int | None = None) -> DataFrame:
    """The limit each request hits first: daily key, daily workspace, key rate, workspace rate.

    A request denied by a quota never reaches the rate limiter.
    """
    slim = traces.select("id", *KEY_SCOPE, "timestamp", "total_tokens", "estimated_cost_usd")
    checked = quota_codes(slim, per_key, per_workspace, slice_seconds).select("id", *KEY_SCOPE, "timestamp", "quota_code")
    checked = persist_table(checked, "quota")
    rated = rate_limit_audit(checked.filter("quota_code = ''"), per_key, per_workspace, seconds=seconds)
    over = checked.filter("quota_code <> ''").select("id", F.col("quota_code").alias("limit_code"), F.lit(0).cast("bigint").alias("retry_after"))
    return over.unionByName(rated.select("id", F.col("rate_code").alias("limit_code"), "retry_after"))


def merge_codes(*codes: Column) -> Column:
    """First code that is set."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in codes], F.lit(""))
