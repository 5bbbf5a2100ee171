"""Usage, cost, latency and error aggregates.

All of them are one partial aggregation and one small shuffle, so a hot provider, model or tenant
is reduced to one row per task before anything moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import (
    LATENCY_BUCKETS,
    blank_to_null,
    route_pattern,
    squeeze,
    write_error_class,
)

TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def _sum0(name: str) -> Column:
    zero = F.lit(0.0) if name.endswith("_usd") else F.lit(0)
    return F.coalesce(F.sum(name), zero)


def usage_summary(df: DataFrame) -> DataFrame:
    return df.agg(*[_sum0(c).cast("bigint").alias(f"total_{c}" if not c.startswith("total") else c) for c in TOKENS])


def cost_summary(df: DataFrame) -> DataFrame:
    return df.agg(_sum0("estimated_cost_usd").alias("total_cost_usd"))


def model_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("model").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg("time_to_first_token_ms").alias("avg_ttft_ms"),
        _sum0("total_tokens").alias("total_tokens"),
        _sum0("estimated_cost_usd").alias("total_cost_usd"),
    )


def key_stats(df: DataFrame) -> DataFrame:
    """Per provider key; calls without a key are left out."""
    return (
        df.filter(blank_to_null(F.col("api_key_hash")).isNotNull())
        .groupBy("api_key_hash")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            _sum0("total_tokens").alias("total_tokens"),
            _sum0("estimated_cost_usd").alias("total_cost_usd"),
            F.max("timestamp").alias("last_active_at"),
        )
    )


BUCKETS = ("hour", "day", "week")


def bucket_start(df: DataFrame, bucket: str) -> Column:
    """Start of the UTC hour, day or (Monday) week."""
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {BUCKETS}")
    return F.date_trunc(bucket, F.col("timestamp")).cast(df.schema["timestamp"].dataType)


# What a breakdown may be grouped by, and the column behind it.
GROUPS = {"provider": "provider", "model": "model", "route": "request_path", "key": "access_key_id"}


def group_column(group_by: str) -> Column:
    if not group_by:
        return F.lit("")
    return F.col(GROUPS[group_by])


def usage_series(df: DataFrame, bucket: str = "day", group_by: str = "") -> DataFrame:
    return df.groupBy(bucket_start(df, bucket).alias("bucket_start"), group_column(group_by).alias("group_key")).agg(
        *[F.sum(c).alias(c) for c in TOKENS]
    )


def cost_series(df: DataFrame, bucket: str = "day", group_by: str = "") -> DataFrame:
    return df.groupBy(bucket_start(df, bucket).alias("bucket_start"), group_column(group_by).alias("group_key")).agg(
        F.sum("estimated_cost_usd").alias("total_cost_usd"),
        F.count(F.lit(1)).alias("request_count"),
        F.avg("estimated_cost_usd").alias("avg_cost_usd"),
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation; 0 for an empty group.

    Values are counted first, so what reaches a group's final step is one entry per distinct value
    (whole milliseconds), not one per row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    found = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in points.values()]), F.col("_n"))
    stats = counted.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("request_count"),
        F.coalesce(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), F.lit(0.0)).alias("avg_value"),
        F.coalesce(F.min(value), F.lit(0)).alias("min_value"),
        F.coalesce(F.max(value), F.lit(0)).alias("max_value"),
        found.alias("_p"),
    )
    return stats.withColumns(
        {name: F.coalesce(F.col("_p")[i], F.lit(0.0)) for i, name in enumerate(points)}
    ).drop("_p")


def latency_percentiles(df: DataFrame, group_by: str = "") -> DataFrame:
    grouped = df.select(group_column(group_by).alias("group_key"), "latency_ms")
    out = percentiles(grouped, ["group_key"] if group_by else [], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    out = out if group_by else out.withColumn("group_key", F.lit(""))
    return out.select(
        "group_key",
        "request_count",
        F.col("avg_value").alias("avg_ms"),
        F.col("min_value").alias("min_ms"),
        F.col("max_value").alias("max_ms"),
        "p50_ms",
        "p95_ms",
        "p99_ms",
    )


def error_rates(df: DataFrame, group_by: str = "") -> DataFrame:
    status = F.col("response_status")
    counted = df.groupBy(group_column(group_by).alias("group_key")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if((status >= 400) & (status < 500)).alias("error_count_4xx"),
        F.count_if((status >= 500) & (status < 600)).alias("error_count_5xx"),
    )
    failed = F.col("error_count_4xx") + F.col("error_count_5xx")
    return counted.withColumn("error_rate", failed / F.col("total_requests"))


def model_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("request_count"))


def top_model(df: DataFrame) -> DataFrame:
    """Most used model; the smallest name wins a tie."""
    best = F.min_by(F.struct("model", "request_count"), F.struct(-F.col("request_count"), squeeze(F.col("model"))))
    return model_counts(df).agg(best.alias("b")).select(F.col("b.model").alias("top_model"), F.col("b.request_count").alias("request_count"))


def summary(df: DataFrame) -> DataFrame:
    """Requests, tokens, cost, active keys and top model in one scan.

    Rows are reduced to one per (model, key) first; everything else is computed from that.
    """
    return summary_of(
        df.groupBy("model", blank_to_null(F.col("api_key_hash")).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("estimated_cost_usd").alias("cost")
        )
    )


def summary_of(base: DataFrame) -> DataFrame:
    """:func:`summary` from rows reduced to one per (model, key)."""
    per_model = base.groupBy("model").agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in TOKENS],
        F.sum("cost").alias("cost"),
    )
    totals = per_model.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c if c.startswith("total") else f"total_{c}") for c in TOKENS],
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.min_by("model", F.struct(-F.col("n"), squeeze(F.col("model")))), F.lit("")).alias("top_model"),
    )
    keys = base.agg(F.count_distinct("key").alias("active_keys"))
    # Both sides are ungrouped aggregates: exactly one row each.
    return totals.join(F.broadcast(keys), F.lit(True))


def provider_rollup(df: DataFrame) -> DataFrame:
    name = F.coalesce(blank_to_null(F.col("provider")), F.lit("(unknown)"))
    return df.groupBy(name.alias("provider")).agg(
        *[F.sum(c).alias(c) for c in TOKENS], F.sum("estimated_cost_usd").alias("total_cost_usd")
    )


def usage_rollup(df: DataFrame) -> DataFrame:
    """One row per (provider, model, provider key) with all that the report's lists add up."""
    return df.groupBy("provider", "model", "api_key_hash").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in TOKENS],
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
        *[f(c).alias(f"{c}_{name}") for c in ("latency_ms", "time_to_first_token_ms") for name, f in (("sum", F.sum), ("count", F.count))],
        F.max("timestamp").alias("timestamp"),
    )


def lists_of(rollup: DataFrame) -> dict[str, DataFrame]:
    """Summary, providers, models and keys from :func:`usage_rollup`; the trace table is not read again."""

    def mean(c: str, name: str) -> Column:
        return F.try_divide(F.sum(f"{c}_sum").cast("double"), F.sum(f"{c}_count")).alias(name)

    count, tokens, cost = F.sum("n").alias("request_count"), _sum0("total_tokens").alias("total_tokens"), _sum0("estimated_cost_usd").alias("total_cost_usd")
    key = blank_to_null(F.col("api_key_hash"))
    pairs = rollup.groupBy("model", key.alias("key")).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("estimated_cost_usd").alias("cost"))
    models = rollup.groupBy("model").agg(count, mean("latency_ms", "avg_latency_ms"), mean("time_to_first_token_ms", "avg_ttft_ms"), tokens, cost)
    keys = rollup.filter(key.isNotNull()).groupBy("api_key_hash").agg(count, tokens, cost, F.max("timestamp").alias("last_active_at"))
    return {"summary": summary_of(pairs), "providers": provider_rollup(rollup), "models": models, "keys": keys}


def merge_usage_and_cost(usage: DataFrame, cost: DataFrame) -> DataFrame:
    """Add up two series per provider; a provider may appear in only one of them."""
    name = F.coalesce(blank_to_null(F.col("group_key")), F.lit("(unknown)"))
    left = usage.groupBy(name.alias("provider")).agg(*[F.sum(c).alias(c) for c in TOKENS])
    right = cost.groupBy(name.alias("provider")).agg(F.sum("total_cost_usd").alias("total_cost_usd"))
    return left.join(right, "provider", "full_outer").select(
        "provider", *[F.coalesce(c, F.lit(0)).alias(c) for c in TOKENS], F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd")
    )


def _places(df: DataFrame, label: str, name: str, *order: Column) -> DataFrame:
    # One row per model, key or provider: an aggregate, not the trace table.
    place = F.row_number().over(Window.partitionBy(F.lit(label)).orderBy(*order))
    return df.select(F.lit(label).alias("list"), F.col(name).alias("name"), place.alias("place"))


def report_places(df: DataFrame) -> DataFrame:
    """Where each model, key and provider stands in the report's lists."""
    count_order = lambda n: (F.col("request_count").desc(), squeeze(F.col(n)).asc())
    models = _places(model_counts(df), "model", "model", *count_order("model"))
    keys = _places(key_stats(df), "key", "api_key_hash", *count_order("api_key_hash"))
    providers = _places(
        provider_rollup(df), "provider", "provider", F.col("total_tokens").desc(), F.col("total_cost_usd").desc(), squeeze(F.col("provider")).asc()
    )
    return models.unionByName(keys).unionByName(providers)


LABELS = ("provider", "model", "org_id", "workspace_id", "route")


def labelled(df: DataFrame) -> DataFrame:
    from tracelake.functions.privacy import telemetry_label

    return df.withColumns(
        {
            "route": route_pattern(F.col("request_path")),
            **{c: telemetry_label(F.col(c)) for c in ("provider", "model", "org_id", "workspace_id")},
        }
    )


RAW = ("provider", "model", "org_id", "workspace_id", "request_path", "response_status")


def raw_counts(df: DataFrame, *keys: Column | str, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Requests, seconds and latency buckets by ``keys`` and the labels as they were recorded.

    What A14 to A17 need, in one aggregate; labels are cleaned once for each group rather than for each request.
    """
    seconds = F.col("latency_ms").cast("double") / F.lit(1000.0)
    return df.groupBy(*keys, *RAW).agg(F.count(F.lit(1)).alias("_all"), F.sum(seconds).alias("_seconds"), *_bucket_counts(bounds, seconds))


def counter_of(counts: DataFrame) -> DataFrame:
    return labelled(counts).groupBy(*LABELS, F.col("response_status").alias("status_code")).agg(F.sum("_all").alias("request_total"))


def request_counter(df: DataFrame) -> DataFrame:
    return counter_of(raw_counts(df))


def _bucket_counts(bounds: Sequence[float], seconds: Column) -> list[Column]:
    return [F.count_if(seconds <= b).alias(f"_le{i}") for i, b in enumerate(bounds)]


def _buckets(counts: DataFrame, keys: Sequence[Column | str], bounds: Sequence[float]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("_all").alias("_all"), F.sum("_seconds").alias("duration_sum"), *[F.sum(f"_le{i}").alias(f"_le{i}") for i in range(len(bounds))])


def histogram_of(counts: DataFrame, keys: Sequence[str] = LABELS, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative latency buckets, one output row per bucket bound."""
    wide = _buckets(labelled(counts), keys, bounds)
    entries = [F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"_le{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("bucket_count")))
    return wide.select(*keys, "duration_sum", F.inline(F.array(*entries)))


def duration_histogram(df: DataFrame, keys: Sequence[str] = LABELS, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    return histogram_of(raw_counts(df, bounds=bounds), keys, bounds)


def quantile_from_buckets(q: float, cumulative: Sequence[Column], total: Column, bounds: Sequence[float]) -> Column:
    """Quantile estimated inside its bucket, linear between the bounds; NULL without observations.

    A rank beyond the last bound gives that bound.
    """
    rank = F.lit(q) * total
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(float(bounds[i - 1])) if i else F.lit(0.0)
        below = cumulative[i - 1] if i else F.lit(0).cast("bigint")
        inside = cumulative[i] - below
        guess = low + (F.lit(float(bounds[i])) - low) * F.try_divide(rank - below, inside)
        out = F.when(cumulative[i] >= rank, guess).otherwise(out)
    return F.when(total > 0, out)


def _window_start(column: str, every: str) -> Column:
    return F.window(column, every).getField("start").cast("timestamp_ntz").alias("window_start")


def quantile_alert_of(counts: DataFrame, q: float = 0.99, threshold: float = 10.0) -> DataFrame:
    """``counts``: :func:`raw_counts` by ``window_start``."""
    wide = _buckets(counts, ["window_start", "provider"], LATENCY_BUCKETS)
    value = quantile_from_buckets(q, [F.col(f"_le{i}") for i in range(len(LATENCY_BUCKETS))], F.col("_all"), LATENCY_BUCKETS)
    return wide.select("window_start", "provider", F.col("_all").alias("request_count"), value.alias("quantile_seconds"), (value > threshold).alias("firing"))


def latency_quantile_alert(df: DataFrame, q: float = 0.99, threshold: float = 10.0, every: str = "5 minutes") -> DataFrame:
    return quantile_alert_of(raw_counts(df, _window_start("timestamp", every)), q, threshold)


def ratio_alert_of(counts: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``counts``: :func:`raw_counts` by ``window_start``."""
    status = F.col("response_status")
    failed = F.when((status >= 500) & (status < 600), F.col("_all")).otherwise(F.lit(0))
    counted = counts.groupBy("window_start").agg(F.sum("_all").alias("request_count"), F.sum(failed).alias("error_count"))
    ratio = F.col("error_count") / F.col("request_count")
    return counted.select("window_start", "request_count", "error_count", ratio.alias("error_ratio"), (ratio > threshold).alias("firing"))


def error_ratio_alert(df: DataFrame, threshold: float = 0.05, every: str = "5 minutes") -> DataFrame:
    return ratio_alert_of(raw_counts(df, _window_start("timestamp", every)), threshold)


def increase_alert(log: DataFrame, time_col: str, keys: Sequence[str], every: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Windows in which a failure counter went up, with the increase."""
    return (
        log.groupBy(F.window(time_col, every, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("increase"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "increase")
    )


def increase_of(counts: DataFrame, keys: Sequence[str], slides: int = 5, slide_seconds: int = 60) -> DataFrame:
    """``counts``: failures by ``slide_start`` and ``keys``; a window is ``slides`` of them long and starts with each."""
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slides - 1)), lambda n: F.col("slide_start") - F.make_dt_interval(secs=n * slide_seconds)))
    shown = counts.select(start.alias("window_start"), *keys, "failures")
    return shown.groupBy("window_start", *keys).agg(F.sum("failures").alias("increase"))


def write_errors(log: DataFrame) -> DataFrame:
    return log.groupBy(write_error_class(F.col("message")).alias("error_class")).agg(F.count(F.lit(1)).alias("failures"))


def active_key_count(df: DataFrame, approximate: bool = False) -> DataFrame:
    key = blank_to_null(F.col("api_key_hash"))
    counted = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.agg(counted.alias("active_keys"))


def daily_usage(df: DataFrame, keys: Sequence[str] = ("org_id", "workspace_id", "access_key_id")) -> DataFrame:
    return df.groupBy(F.to_date("timestamp").alias("day"), *keys).agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("estimated_cost_usd").alias("total_cost_usd")
    )
