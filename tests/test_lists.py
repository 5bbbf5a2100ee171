import datetime as dt

import pytest
from helpers import at, dicts, trace, traces
from pyspark.sql import functions as F

from tracelake.functions.text import clean_prefix, normalize_prefix
from tracelake.operators import paging
from tracelake.operators.filters import TraceFilter, apply_filter, parse_bound, parse_bound_column
from tracelake.schema import normalize


def test_pages_follow_each_other(spark):
    t = traces(spark, [trace(f"t{i:02d}", i // 2) for i in range(7)])
    seen, cursor = [], ""
    while True:
        page = dicts(paging.list_page(t, limit=3, cursor=cursor))
        page.sort(key=lambda r: (r["created_at"], r["id"]), reverse=True)
        seen += [r["id"] for r in page]
        cursor = next((r["next_cursor"] for r in page if r["next_cursor"]), "")
        if not cursor:
            break
    assert seen == [f"t{i:02d}" for i in reversed(range(7))]
    assert dicts(paging.list_total(t))[0]["total_count"] == 7
    numbered = dicts(paging.assign_pages(t, ["org_id", "workspace_id"], 3, slice_seconds=1), "row_no")
    assert [r["id"] for r in numbered] == seen
    assert [r["page_no"] for r in numbered] == [0, 0, 0, 1, 1, 1, 2]


def test_export_is_half_open_and_oldest_first(spark):
    t = traces(spark, [trace("b", 0), trace("a", 0), trace("c", 5), trace("end", 10), trace("other", 1, org_id="x")])
    f = TraceFilter(org_id="default")
    first = dicts(paging.export_page(t, at(0), at(10), 2, f=f), "timestamp", "id")
    assert [r["id"] for r in first] == ["a", "b"]
    rest = dicts(paging.export_page(t, at(0), at(10), 2, first[-1]["next_cursor"], f))
    assert [r["id"] for r in rest] == ["c"] and rest[0]["next_cursor"] is None


def test_cursor_text(spark):
    when = dt.datetime(2026, 1, 2, 3, 4, 50, 120000)
    df = spark.createDataFrame([(when, "id|with|bars"), (dt.datetime(2026, 1, 2, 3, 4, 0), "x")], "at timestamp, id string")
    df = df.select("id", paging.cursor_of(F.col("at"), F.col("id")).alias("c"))
    by_id = {r["id"]: r["c"] for r in df.collect()}
    assert paging.decode_cursor(by_id["id|with|bars"]) == (when, "id|with|bars")
    assert paging.decode_cursor(by_id["x"])[0] == dt.datetime(2026, 1, 2, 3, 4)
    back = df.select("id", *[c.alias(n) for c, n in zip(paging.cursor_fields(F.col("c")), ("at", "back"))])
    assert all(r["id"] == r["back"] for r in back.collect())
    for bad in ("!!", "bm9iYXI", "MjAyNg"):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad)


def test_prefix_filter_is_by_segment(spark):
    t = traces(spark, [trace("root", request_path="/llm"), trace("child", request_path="/llm/v1/responses"), trace("no", request_path="/llmish/v1"), trace("wild", request_path="/l_m")])
    got = {r["id"] for r in dicts(apply_filter(t, TraceFilter(path_prefix="/llm")))}
    assert got == {"root", "child"}
    assert {r["id"] for r in dicts(apply_filter(t, TraceFilter(path_prefix="/l_m")))} == {"wild"}
    assert apply_filter(t, TraceFilter(path_prefix=" / ")).count() == 4


def test_prefix_forms(spark):
    cases = ["", " ", "/", "//", "a", "/a/", " a//", "/a/b"]
    df = spark.createDataFrame([(c,) for c in cases], "p string").select("p", normalize_prefix(F.col("p")).alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == {c: clean_prefix(c) for c in cases}


def test_thread_and_run(spark):
    rows = [trace("a", 1, meta={"lineage_thread_id": "thread-1", "lineage_run_id": "run-1"}),
            trace("c", 3, meta={"lineage_thread_id": "thread-1", "lineage_run_id": "run-2"}), trace("bad", 4, metadata="oops")]
    t = traces(spark, rows)
    assert [r["id"] for r in dicts(apply_filter(t, TraceFilter(thread_id="thread-1", run_id="run-2")))] == ["c"]


def test_time_bounds(spark):
    assert parse_bound("2026-02-12") == dt.datetime(2026, 2, 12)
    assert parse_bound("2026-02-12", end=True) == dt.datetime(2026, 2, 12, 23, 59, 59, 999999)
    assert parse_bound("2026-02-12T01:00:00+01:00") == dt.datetime(2026, 2, 12)
    with pytest.raises(ValueError):
        parse_bound("yesterday")
    df = spark.createDataFrame([("2026-02-12",), ("2026-02-12T01:00:00.5+01:00",), ("x",)], "s string")
    got = [r[0] for r in df.select(parse_bound_column(F.col("s"), end=True)).collect()]
    assert got == [dt.datetime(2026, 2, 12, 23, 59, 59, 999999), dt.datetime(2026, 2, 12, 0, 0, 0, 500000), None]
    with pytest.raises(ValueError):
        apply_filter(traces(spark, [trace("a")]), TraceFilter(since=at(5), until=at(1)))


def test_normalize_defaults(spark):
    row = trace("n", org_id="", workspace_id=None, provider="", model=None, request_method="", request_path="", input_tokens=3,
                output_tokens=4, time_to_first_token_us=1500, access_key_id="", meta={"access_key_id": " gk "})
    got = dicts(normalize(traces(spark, [row])))[0]
    assert (got["org_id"], got["workspace_id"], got["provider"], got["model"]) == ("default", "default", "unknown", "unknown")
    assert (got["request_method"], got["request_path"], got["total_tokens"]) == ("UNKNOWN", "/", 7)
    assert (got["time_to_first_token_ms"], got["access_key_id"]) == (2, "gk")


def test_filters_reach_the_file_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    traces(spark, [trace("a", 1), trace("b", 2)]).write.parquet(path)
    t = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = apply_filter(t, TraceFilter(provider="openai", since=at(0), status=200)).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for name in ("GreaterThanOrEqual(timestamp", "EqualTo(provider,openai)", "EqualTo(response_status,200)"):
        assert name in pushed
    assert "request_body" not in plan[plan.index("ReadSchema"):]


def test_providers_by_name(spark):
    from pyspark.sql import functions as F

    from tracelake.functions.pricing import estimate_cost
    from tracelake.functions.providers import Provider, default_registry, prices_of

    known = default_registry()
    assert known.names() == ["anthropic", "openai"] and known.get(" OpenAI ").name == "openai" and known.get("none") is None
    known.add(Provider("own", prices_of("own", {f"m{n}": (n / 1000, 0.0) for n in range(1200)}, {"m": (9.0, 0.0)})))
    df = spark.createDataFrame([("own", "m7"), ("own", "m1100"), ("own", "mx"), ("openai", "gpt-4o"), ("gone", "m7")], "p string, m string")
    cost = df.select(estimate_cost(F.col("p"), F.col("m"), F.lit(1000), F.lit(0), known.prices())).collect()
    assert [round(r[0], 6) for r in cost] == [0.007, 1.1, 9.0, 0.005, 0.0]
    body = spark.createDataFrame([('{"model":"m7","usage":{"prompt_tokens":3,"completion_tokens":4}}', False)], "b string, s boolean")
    row = known.get("own").answers(body, "b", "s", "x").first()
    assert (row["x_model"], row["x_in"], row["x_out"], row["x_total"]) == ("m7", 3, 4, 7)


def test_plans(spark):
    """No nested loop for routes, one scan behind counter and histogram."""
    from tracelake.operators import analytics, joins

    rows = spark.createDataFrame([("/a/b",), ("/a",), ("/ab/c",), ("",), (None,)], "request_path string")
    routes = spark.createDataFrame([("one", "/a"), ("all", "/"), ("two", "a/b/")], "name string, prefix string")
    out = joins.route_join(rows, routes)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert {r["request_path"]: r["route_provider"] for r in out.collect()} == {"/a/b": "all", "/a": "all", "/ab/c": "all", "": "all", None: "unknown"}
    plan = analytics.duration_histogram(traces(spark, [trace("a")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") <= 1
