"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.catalog.sql import on_traces
from tracelake.operators import analytics as ops
from tracelake.operators.filters import TraceFilter, apply_filter
from tracelake.registry import query
from tracelake.sources import derived


def rounded(df, *names: str):
    """Floating sums depend on the order of addition; checks compare eight decimals."""
    return df.withColumns({n: F.round(n, 8) for n in names})


_SUMS = """CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens"""


@query(
    "a1_usage_summary",
    on_traces(
        """SELECT CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
        CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens FROM traces WHERE provider = 'openai'"""
    ),
)
def usage_summary(spark, sf):
    return ops.usage_summary(apply_filter(derived.traces(spark, sf), TraceFilter(provider="openai")))


@query("a2_cost_summary", on_traces("SELECT round(coalesce(sum(estimated_cost_usd), 0), 8) AS total_cost_usd FROM traces WHERE org_id = 'org-1'"))
def cost_summary(spark, sf):
    return rounded(ops.cost_summary(apply_filter(derived.traces(spark, sf), TraceFilter(org_id="org-1"))), "total_cost_usd")


@query(
    "a3_model_stats",
    on_traces(
        """SELECT model, count(*) AS request_count, round(avg(latency_ms), 8) AS avg_latency_ms, round(avg(time_to_first_token_ms), 8) AS avg_ttft_ms,
        CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost_usd), 8) AS total_cost_usd FROM traces GROUP BY model"""
    ),
)
def model_stats(spark, sf):
    return rounded(ops.model_stats(derived.traces(spark, sf)), "avg_latency_ms", "avg_ttft_ms", "total_cost_usd")


@query(
    "a4_key_stats",
    on_traces(
        """SELECT api_key_hash, count(*) AS request_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        round(sum(estimated_cost_usd), 8) AS total_cost_usd, max(timestamp) AS last_active_at
        FROM traces WHERE trim(api_key_hash) <> '' GROUP BY api_key_hash"""
    ),
)
def key_stats(spark, sf):
    return rounded(ops.key_stats(derived.traces(spark, sf)), "total_cost_usd")


for _bucket, _group in (("hour", ""), ("day", "provider"), ("week", "model")):
    _key = _group or "''"

    @query(
        f"a5_usage_series_{_bucket}",
        on_traces(f"SELECT CAST(date_trunc('{_bucket}', timestamp) AS TIMESTAMP) AS bucket_start, {_key} AS group_key, {_SUMS} FROM traces GROUP BY ALL"),
    )
    def usage_series(spark, sf, bucket=_bucket, group=_group):
        return ops.usage_series(derived.traces(spark, sf), bucket, group)

    @query(
        f"a6_cost_series_{_bucket}",
        on_traces(
            f"""SELECT CAST(date_trunc('{_bucket}', timestamp) AS TIMESTAMP) AS bucket_start, {_key} AS group_key,
            round(sum(estimated_cost_usd), 8) AS total_cost_usd, count(*) AS request_count, round(avg(estimated_cost_usd), 6) AS avg_cost_usd
            FROM traces GROUP BY ALL"""
        ),
    )
    def cost_series(spark, sf, bucket=_bucket, group=_group):
        out = rounded(ops.cost_series(derived.traces(spark, sf), bucket, group), "total_cost_usd")
        return out.withColumn("avg_cost_usd", F.round("avg_cost_usd", 6))


_GROUP_SQL = {"": "''", "provider": "provider", "model": "model", "route": "request_path", "key": "access_key_id"}

for _group, _sql in _GROUP_SQL.items():

    @query(
        f"a7_latency_percentiles_{_group or 'all'}",
        on_traces(
            f"""SELECT {_sql} AS group_key, count(*) AS request_count, round(avg(latency_ms), 8) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
            round(quantile_cont(latency_ms, 0.5), 8) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 8) AS p95_ms,
            round(quantile_cont(latency_ms, 0.99), 8) AS p99_ms FROM traces GROUP BY ALL"""
        ),
    )
    def latency_percentiles(spark, sf, group=_group):
        return rounded(ops.latency_percentiles(derived.traces(spark, sf), group), "avg_ms", "p50_ms", "p95_ms", "p99_ms")


@query(
    "a8_percentile_points",
    on_traces(
        """SELECT org_id, count(*) AS request_count, min(latency_ms) AS p0, round(quantile_cont(latency_ms, 0.5), 8) AS p50, max(latency_ms) AS p100
        FROM traces GROUP BY org_id"""
    ),
)
def percentile_points(spark, sf):
    out = ops.percentiles(derived.traces(spark, sf), ["org_id"], "latency_ms", {"p0": 0.0, "p50": 0.5, "p100": 1.0})
    return rounded(out, "p50").select("org_id", "request_count", F.col("p0").cast("bigint").alias("p0"), "p50", F.col("p100").cast("bigint").alias("p100"))


_RATES = """count(*) AS total_requests, count(*) FILTER (WHERE response_status BETWEEN 400 AND 499) AS error_count_4xx,
  count(*) FILTER (WHERE response_status BETWEEN 500 AND 599) AS error_count_5xx,
  round(count(*) FILTER (WHERE response_status BETWEEN 400 AND 599) / count(*), 8) AS error_rate"""

for _group in ("", "provider", "route"):

    @query(f"a9_error_rate_{_group or 'all'}", on_traces(f"SELECT {_GROUP_SQL[_group]} AS group_key, {_RATES} FROM traces GROUP BY ALL"))
    def error_rate(spark, sf, group=_group):
        return rounded(ops.error_rates(derived.traces(spark, sf), group), "error_rate")


for _group in ("route", "key"):

    @query(f"a10_error_rate_by_{_group}", on_traces(f"SELECT {_GROUP_SQL[_group]} AS group_key, {_RATES} FROM traces GROUP BY ALL"))
    def group_key_map(spark, sf, group=_group):
        return rounded(ops.error_rates(derived.traces(spark, sf), group), "error_rate")


@query(
    "a11_summary",
    on_traces(
        """SELECT count(*) AS total_requests, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
        CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost_usd), 8) AS total_cost_usd,
        (SELECT model FROM traces GROUP BY model ORDER BY count(*) DESC, model LIMIT 1) AS top_model,
        count(DISTINCT nullif(trim(api_key_hash), '')) AS active_keys FROM traces"""
    ),
)
def summary(spark, sf):
    return rounded(ops.summary(derived.traces(spark, sf)), "total_cost_usd")


@query("a12_provider_rollup", on_traces(f"SELECT provider, {_SUMS}, round(sum(estimated_cost_usd), 8) AS total_cost_usd FROM traces GROUP BY provider"))
def provider_rollup(spark, sf):
    return rounded(ops.provider_rollup(derived.traces(spark, sf)), "total_cost_usd")


@query("j9_usage_cost_merge", on_traces(f"SELECT provider, {_SUMS}, round(sum(estimated_cost_usd), 8) AS total_cost_usd FROM traces GROUP BY provider"))
def usage_cost_merge(spark, sf):
    t = derived.traces(spark, sf)
    return rounded(ops.merge_usage_and_cost(ops.usage_series(t, "day", "provider"), ops.cost_series(t, "day", "provider")), "total_cost_usd")


_ROUTE = """CASE WHEN request_path = '/llm' OR starts_with(request_path, '/llm/') THEN '/llm/*' WHEN starts_with(request_path, '/openai/') THEN '/openai/*'
  WHEN starts_with(request_path, '/anthropic/') THEN '/anthropic/*' ELSE '/other' END"""


@query(
    "a14_request_counter",
    on_traces(
        f"SELECT provider, model, org_id, workspace_id, {_ROUTE} AS route, response_status AS status_code, count(*) AS request_total FROM traces GROUP BY ALL"
    ),
)
def request_counter(spark, sf):
    return ops.request_counter(derived.traces(spark, sf))


@query(
    "a15_duration_histogram",
    on_traces(
        f"""WITH b AS (SELECT unnest(['0.005','0.01','0.025','0.05','0.1','0.25','0.5','1.0','2.5','5.0','10.0','+Inf']) AS le),
        d AS (SELECT provider, model, org_id, workspace_id, {_ROUTE} AS route, latency_ms / 1000.0::DOUBLE AS s FROM traces)
        SELECT provider, model, org_id, workspace_id, route, le, round(sum(s), 8) AS duration_sum,
          count(*) FILTER (WHERE le = '+Inf' OR s <= TRY_CAST(le AS DOUBLE)) AS bucket_count FROM d CROSS JOIN b GROUP BY ALL"""
    ),
)
def duration_histogram(spark, sf):
    return rounded(ops.duration_histogram(derived.traces(spark, sf)), "duration_sum")


@query(
    "a16_histogram_quantile",
    on_traces(
        """WITH d AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, provider, latency_ms / 1000.0::DOUBLE AS s FROM traces),
        b AS (SELECT unnest([0.005,0.01,0.025,0.05,0.1,0.25,0.5,1.0,2.5,5.0,10.0])::DOUBLE AS hi, unnest([0,0.005,0.01,0.025,0.05,0.1,0.25,0.5,1.0,2.5,5.0])::DOUBLE AS lo),
        t AS (SELECT window_start, provider, count(*) AS n FROM d GROUP BY ALL),
        c AS (SELECT window_start, provider, hi, lo, count(*) FILTER (WHERE s <= hi) AS upto, count(*) FILTER (WHERE s <= lo) AS below FROM d CROSS JOIN b GROUP BY ALL),
        h AS (SELECT c.*, n FROM c JOIN t USING (window_start, provider) WHERE upto >= 0.99::DOUBLE * n
              QUALIFY row_number() OVER (PARTITION BY window_start, provider ORDER BY hi) = 1)
        SELECT t.window_start, t.provider, t.n AS request_count,
          round(coalesce(lo + (hi - lo) * ((0.99::DOUBLE * t.n - CASE WHEN lo = 0 THEN 0 ELSE below END) / (upto - CASE WHEN lo = 0 THEN 0 ELSE below END)), 10.0), 8) AS quantile_seconds,
          coalesce(lo + (hi - lo) * ((0.99::DOUBLE * t.n - CASE WHEN lo = 0 THEN 0 ELSE below END) / (upto - CASE WHEN lo = 0 THEN 0 ELSE below END)), 10.0) > 1 AS firing
        FROM t LEFT JOIN h USING (window_start, provider)"""
    ),
)
def histogram_quantile(spark, sf):
    return rounded(ops.latency_quantile_alert(derived.traces(spark, sf), threshold=1.0), "quantile_seconds")


@query(
    "a17_error_ratio_alert",
    on_traces(
        """SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, count(*) AS request_count,
        count(*) FILTER (WHERE response_status >= 500) AS error_count, round(count(*) FILTER (WHERE response_status >= 500) / count(*), 8) AS error_ratio,
        count(*) FILTER (WHERE response_status >= 500) / count(*) > 0.05 AS firing FROM traces GROUP BY ALL"""
    ),
)
def error_ratio_alert(spark, sf):
    return rounded(ops.error_ratio_alert(derived.traces(spark, sf)), "error_ratio")


_CLASSES = """(SELECT ts, CASE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) % 7 WHEN 0 THEN 'connection' WHEN 1 THEN 'connection' WHEN 2 THEN 'timeout'
  WHEN 3 THEN 'timeout' WHEN 4 THEN 'contention' WHEN 5 THEN 'constraint' ELSE 'unknown' END AS error_class FROM events WHERE event_type = 'error')"""


@query(
    "a18_increase_alert",
    f"""SELECT window_start, error_class, count(*) AS increase FROM (
      SELECT date_trunc('minute', ts) - unnest([0, 1, 2, 3, 4]) * INTERVAL 1 MINUTE AS window_start, error_class FROM {_CLASSES}) GROUP BY ALL""",
)
def increase_alert(spark, sf):
    log = derived.write_log(spark, sf)
    return ops.increase_alert(log.withColumn("error_class", ops.write_error_class(F.col("message"))), "ts", ["error_class"])


@query("a19_classify_write_errors", f"SELECT error_class, count(*) AS failures FROM {_CLASSES} GROUP BY ALL")
def classify_write_errors(spark, sf):
    return ops.write_errors(derived.write_log(spark, sf))


@query("a20_distinct_active_keys", on_traces("SELECT count(DISTINCT nullif(trim(api_key_hash), '')) AS active_keys FROM traces"))
def distinct_active_keys(spark, sf):
    return ops.active_key_count(derived.traces(spark, sf))


@query(
    "a22_daily_usage",
    on_traces(
        """SELECT CAST(timestamp AS DATE) AS day, org_id, workspace_id, access_key_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        round(sum(estimated_cost_usd), 8) AS total_cost_usd FROM traces GROUP BY ALL"""
    ),
)
def daily_usage(spark, sf):
    return rounded(ops.daily_usage(derived.traces(spark, sf)), "total_cost_usd")
