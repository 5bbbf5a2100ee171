import pytest
from helpers import dicts, trace, traces

from tracelake.operators import analytics as a
from tracelake.operators.filters import TraceFilter, apply_filter
from tracelake.plans.report import report_sections


# model, provider, key, input, output, latency, first token, cost in thousandths
CALLS = [
    ("mini", "openai", "ka", 11, 4, 70, 7, 4),
    ("mini", "openai", "ka", 2, 9, 130, 0, 0),
    ("mini", "openai", "kb", 40, 1, 10, 3, 5),
    ("opus", "anthropic", "kb", 8, 8, 900, 60, 12),
    ("opus", "anthropic", "", 1, 0, 40, 0, 1),
]


@pytest.fixture(scope="module")
def stats(spark):
    rows = [
        trace(f"c{n}", n, model=m, provider=p, api_key_hash=k, access_key_id=f"id-{k}" if k else "", input_tokens=i, output_tokens=o, total_tokens=i + o, latency_ms=ms,
              time_to_first_token_ms=first, estimated_cost_usd=cost / 1000)
        for n, (m, p, k, i, o, ms, first, cost) in enumerate(CALLS)
    ]
    return traces(spark, rows)


def column(at, **only):
    where = {"provider": 1, "key": 2}
    return [c[at] for c in CALLS if all(c[where[n]] == v for n, v in only.items())]


def test_usage_cost_and_models(stats):
    openai = apply_filter(stats, TraceFilter(provider="openai"))
    i, o = sum(column(3, provider="openai")), sum(column(4, provider="openai"))
    assert dicts(a.usage_summary(openai)) == [{"total_input_tokens": i, "total_output_tokens": o, "total_tokens": i + o}]
    assert dicts(a.cost_summary(openai))[0]["total_cost_usd"] == pytest.approx(sum(column(7, provider="openai")) / 1000)
    mini = dicts(a.model_stats(openai))[0]
    assert (mini["request_count"], mini["avg_latency_ms"], mini["total_tokens"]) == (3, pytest.approx(70), i + o)


def test_access_key_filter_and_empty_sums(stats):
    own = dicts(a.usage_summary(apply_filter(stats, TraceFilter(access_key_id="id-kb"))))[0]
    assert own["total_tokens"] == sum(column(3, key="kb")) + sum(column(4, key="kb"))
    nothing = apply_filter(stats, TraceFilter(provider="none"))
    assert dicts(a.usage_summary(nothing)) == [{"total_input_tokens": 0, "total_output_tokens": 0, "total_tokens": 0}]
    assert dicts(a.cost_summary(nothing)) == [{"total_cost_usd": 0.0}]
    empty = dicts(a.summary(nothing))[0]
    assert (empty["total_requests"], empty["top_model"], empty["active_keys"]) == (0, "", 0)


def test_series_sum_to_the_summary(stats):
    points = dicts(a.usage_series(stats, "day", "provider"), "group_key")
    assert [(p["group_key"], p["total_tokens"]) for p in points] == [(n, sum(column(3, provider=n)) + sum(column(4, provider=n))) for n in ("anthropic", "openai")]
    costs = dicts(a.cost_series(stats, "hour", "provider"), "group_key")
    assert costs[1]["avg_cost_usd"] == pytest.approx(0.003)
    assert sum(p["total_tokens"] for p in points) == dicts(a.usage_summary(stats))[0]["total_tokens"]
    with pytest.raises(ValueError):
        a.usage_series(stats, "month")


def test_report_orders_and_ties(spark):
    rows = [trace(f"r{i}", i, model=m, api_key_hash=k, total_tokens=t, provider=p)
            for i, (m, k, t, p) in enumerate([(" b", "k2", 5, "x"), ("a", "k1", 5, "y"), ("c", "k3", 50, ""), ("c", "k3", 1, "")])]
    sections = report_sections(traces(spark, rows))
    assert [r["model"] for r in dicts(sections["models"])] == ["c", "a", " b"]
    assert [r["provider"] for r in dicts(sections["providers"])] == ["(unknown)", "x", "y"]
    assert [r["id"] for r in dicts(sections["recent"])] == ["r3", "r2", "r1", "r0"]
    assert dicts(sections["summary"])[0]["active_keys"] == 3


def test_latency_and_errors(spark):
    calls = [("a" if n % 3 else "b", 7 * n * n % 101, (200, 404, 503, 201)[n % 4]) for n in range(23)]
    t = traces(spark, [trace(f"l{i}", i, provider=p, latency_ms=ms, response_status=s) for i, (p, ms, s) in enumerate(calls)])
    by = {r["group_key"]: r for r in dicts(a.latency_percentiles(t, "provider"))}
    errors = {r["group_key"]: r for r in dicts(a.error_rates(t, "provider"))}
    for name in ("a", "b"):
        times = sorted(ms for p, ms, _ in calls if p == name)
        status = [s for p, _, s in calls if p == name]
        middle = (len(times) - 1) / 2
        half = times[int(middle)] + (times[-int(-middle // 1)] - times[int(middle)]) * (middle % 1)
        assert (by[name]["request_count"], by[name]["min_ms"], by[name]["max_ms"], by[name]["p50_ms"]) == (len(times), times[0], times[-1], half)
        assert (errors[name]["error_count_4xx"], errors[name]["error_count_5xx"]) == (status.count(404), status.count(503))
        assert errors[name]["error_rate"] == pytest.approx((status.count(404) + status.count(503)) / len(status))
    assert dicts(a.latency_percentiles(t))[0]["request_count"] == len(calls)


def test_percentile_points(spark):
    five = traces(spark, [trace(f"p{i}", latency_ms=v) for i, v in enumerate([10, 20, 30, 40, 50])])
    points = {"p0": 0.0, "p50": 0.5, "p100": 1.0}
    got = dicts(a.percentiles(five, [], "latency_ms", points))[0]
    assert (got["p0"], got["p50"], got["p100"]) == (10, 30, 50)
    none = dicts(a.percentiles(five.filter("false"), [], "latency_ms", points))[0]
    assert (none["p0"], none["p50"], none["p100"], none["request_count"]) == (0, 0, 0, 0)


def test_write_error_classes(spark):
    from pyspark.sql import functions as F

    from tracelake.functions.text import write_error_class

    messages = {"dial: Connection Refused (timeout)": "connection", "i/o timeout": "timeout", "SQLITE_BUSY": "contention",
                "duplicate key value": "constraint", "other": "unknown"}
    df = spark.createDataFrame([(m,) for m in messages], "m string").select("m", write_error_class(F.col("m")).alias("c"))
    assert {r["m"]: r["c"] for r in df.collect()} == messages
