"""The limiter beside the simple rule: repeated and missing ids, scopes and times, ties, many slots."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import at

from tracelake.operators.limits import Policy, SlidingLog, admit, rate_limit_audit

SCHEMA = "org_id string, workspace_id string, access_key_id string, id string, timestamp timestamp, note string"


def naive(times, limit, span):
    log, out = [], []
    for t in times:
        log = [a for a in log if a >= t - span]
        out.append(0 if len(log) < limit else max(1, -((t - span - log[0]) // 1_000_000)))
        if not out[-1]:
            log.append(t)
    return out


def micros(when):
    return (when - at(0)) // dt.timedelta(microseconds=1)


def expected(rows, places, limit, seconds=60):
    """Waits of the rows by number; ties go by id, then in any order."""
    scopes, waits = defaultdict(list), {}
    for n, r in enumerate(rows):
        if r[4] is not None:
            scopes[tuple(r[p] for p in places)].append((micros(r[4]), r[3] is not None, r[3] or "", n))
    for members in scopes.values():
        members.sort()
        waits.update(zip((m[-1] for m in members), naive([m[0] for m in members], limit, seconds * 1_000_000)))
    return [waits.get(n, 0) for n in range(len(rows))]


def some_rows(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        org = rng.choice(["o", "o", None, ""])
        key = None if rng.random() < 0.4 else f"k{rng.randrange(3)}"
        second = rng.choice([rng.randrange(900), 300, 300 + rng.randrange(20), rng.random() * 900])
        row_id = rng.choice([None, "twice", f"r{i}", f"r{i}", f"r{i}"])
        rows.append((org, None if rng.random() < 0.2 else "w", key, row_id, at(round(second, 2)), f"n{i}"))
    return rows + [("o", "w", "k0", "late", None, "x"), ("o", "w", "k0", None, None, "y"), rows[0], rows[0]]


@pytest.mark.parametrize("limit", [1, 3, 40])
@pytest.mark.parametrize("chunk_rows", [17, 500_000])
def test_every_row_once(spark, limit, chunk_rows):
    rows = some_rows(limit)
    got = admit(spark.createDataFrame(rows, SCHEMA), ["org_id", "workspace_id", "access_key_id"], limit, chunk_rows=chunk_rows).collect()
    want = expected(rows, (0, 1, 2), limit)
    assert Counter((tuple(r)[:6], r["admitted"], r["retry_after"]) for r in got).total() == len(rows)
    # Rows alike in time and id may trade places, so notes do not count.
    assert Counter((tuple(r)[:5], r["admitted"], r["retry_after"]) for r in got) == Counter((r[:5], not w, w) for r, w in zip(rows, want))


def test_missing_scope_is_limited(spark):
    rows = [(None, None, None, None if i % 2 else "same", at(i), "") for i in range(20)]
    got = admit(spark.createDataFrame(rows, SCHEMA), ["org_id", "workspace_id"], 2).collect()
    assert len(got) == 20 and sum(r["admitted"] for r in got) == 2


def test_key_before_workspace(spark):
    rows = some_rows(9)
    got = rate_limit_audit(spark.createDataFrame(rows, SCHEMA), Policy(2), Policy(5), chunk_rows=50).collect()
    key = expected(rows, (0, 1, 2), 2)
    passed = [n for n, w in enumerate(key) if not w]
    # Rows alike in time and id may trade places across keys, so only totals are compared.
    late = expected([rows[n] for n in passed], (0, 1), 5)
    assert len(got) == len(rows)
    codes = Counter(r["rate_code"] for r in got)
    assert codes["KEY_RATE_LIMIT_EXCEEDED"] == sum(w > 0 for w in key)
    assert codes["WORKSPACE_RATE_LIMIT_EXCEEDED"] == sum(w > 0 for w in late)
    assert all((r["retry_after"] > 0) == (r["rate_code"] != "") for r in got)
    assert [r["rate_code"] for r in got if r["timestamp"] is None] == ["", ""]


def test_no_rows_and_no_policy(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rate_limit_audit(none, Policy(1), Policy(1)).collect() == []
    one = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    assert [r["rate_code"] for r in rate_limit_audit(one, Policy(), Policy()).collect()] == [""]


def test_log_goes_on_from_chunk_to_chunk():
    rng = random.Random(4)
    for limit in (1, 2, 7):
        times = sorted({rng.randrange(0, 300_000_000, 500_000) for _ in range(200)})
        counts = [rng.randrange(1, 5) for _ in times]
        flat = naive([t for t, c in zip(times, counts) for _ in range(c)], limit, 60_000_000)
        log, at_row = SlidingLog(limit, 60_000_000), 0
        for start in range(0, len(times), 13):
            part, held = np.array(times[start : start + 13]), np.array(counts[start : start + 13])
            for c, let_in, wait in zip(held, *log.replay(part, held)):
                own = flat[at_row : at_row + c]
                assert own == [0] * let_in + [wait] * (c - let_in)
                at_row += c
