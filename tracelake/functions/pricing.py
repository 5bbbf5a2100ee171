"""Model prices and cost."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import squeeze


@dataclass(frozen=True)
class Price:
    provider: str
    pattern: str
    exact: bool
    input_per_1k: float
    output_per_1k: float


# USD per 1000 tokens. Exact names are tried before prefixes, prefixes in list order.
OPENAI_EXACT = {
    "gpt-4o": (0.005, 0.015),
    "gpt-4o-mini": (0.00015, 0.0006),
}
ANTHROPIC_EXACT = {
    "claude-opus-4-1": (0.015, 0.075),
    "claude-opus-4-6": (0.005, 0.025),
    "claude-sonnet-4-20250514": (0.003, 0.015),
    "claude-haiku-4-5-20251001": (0.001, 0.005),
    "claude-3-5-haiku-20241022": (0.0008, 0.004),
}
ANTHROPIC_PREFIX = {
    "claude-opus-4-6-": (0.005, 0.025),
    "claude-opus-4-1-": (0.015, 0.075),
    "claude-opus-4-": (0.015, 0.075),
    "claude-sonnet-4-6-": (0.003, 0.015),
    "claude-sonnet-4-": (0.003, 0.015),
    "claude-haiku-4-6-": (0.001, 0.005),
    "claude-haiku-4-5-": (0.001, 0.005),
    "claude-haiku-4-": (0.001, 0.005),
    "claude-3-7-sonnet-": (0.003, 0.015),
    "claude-3-5-sonnet-": (0.003, 0.015),
    "claude-3-5-haiku-": (0.0008, 0.004),
    "claude-3-opus-": (0.015, 0.075),
    "claude-3-sonnet-": (0.003, 0.015),
    "claude-3-haiku-": (0.00025, 0.00125),
}

# Providers whose model names are compared trimmed and in lower case.
FOLDED_PROVIDERS = ("anthropic",)


def default_prices() -> list[Price]:
    groups = (("openai", OPENAI_EXACT, True), ("anthropic", ANTHROPIC_EXACT, True), ("anthropic", ANTHROPIC_PREFIX, False))
    return [Price(p, name, exact, *rates) for p, names, exact in groups for name, rates in names.items()]


def comparable_model(provider: Column, model: Column) -> Column:
    return F.when(provider.isin(*FOLDED_PROVIDERS), squeeze(F.lower(model))).otherwise(model)


# A price list is written into the plan as constant maps of this many entries each; a very long one is better a table (price_join).
PRICES_PER_MAP = 500


def rate_column(provider: Column, model: Column, prices: list[Price] | None = None) -> Column:
    """The row's rates as struct(input_per_1k, output_per_1k), NULL for unpriced models. No join, no shuffle.

    Exact names are looked up first. Prefixes become one alternation, which prefers the earlier
    prefix just as the list does.
    """
    prices = default_prices() if prices is None else prices
    name = F.concat(provider, F.lit("|"), comparable_model(provider, model))

    def constant_map(rows: list[Price]) -> Column:
        entries = []
        for p in rows:
            rates = f"named_struct('input_per_1k', {p.input_per_1k!r}D, 'output_per_1k', {p.output_per_1k!r}D)"
            entries.append("'" + f"{p.provider}|{p.pattern}".replace("'", r"\'") + f"', {rates}")
        return F.expr(f"map({', '.join(entries)})")

    def parts(rows: list[Price]) -> list[list[Price]]:
        return [rows[i : i + PRICES_PER_MAP] for i in range(0, len(rows), PRICES_PER_MAP)]

    found = [F.try_element_at(constant_map(rows), name) for rows in parts([p for p in prices if p.exact])]
    for rows in parts([p for p in prices if not p.exact]):
        choice = "^(" + "|".join(re.escape(f"{p.provider}|{p.pattern}") for p in rows) + ")"
        found.append(F.try_element_at(constant_map(rows), F.regexp_extract(name, choice, 1)))
    if not found:
        return F.lit(None).cast("struct<input_per_1k: double, output_per_1k: double>")
    return F.coalesce(*found)


def cost_of(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    thousand = F.lit(1000.0)
    cost = (tokens_in.cast("double") / thousand) * rate_in + (tokens_out.cast("double") / thousand) * rate_out
    return F.coalesce(cost, F.lit(0.0))


def estimate_cost(provider: Column, model: Column, tokens_in: Column, tokens_out: Column, prices: list[Price] | None = None) -> Column:
    rate = rate_column(provider, model, prices)
    return cost_of(tokens_in, tokens_out, rate["input_per_1k"], rate["output_per_1k"])


def price_join(traces: DataFrame, prices: DataFrame) -> DataFrame:
    """Table form: match each distinct (provider, model) once, then join the rates back.

    ``prices``: provider, pos, exact, pattern, input_per_1k, output_per_1k. Exact rows win over
    prefixes, then the lowest position. A model is shown whole and cut to each length that a prefix of the list has, and meets the
    prices by equality; none is compared with all prices of its provider. A hot model is one row in the match; AQE broadcasts the list of
    pairs if it is small and otherwise splits a hot pair.
    """
    # Driver side: one number for each distinct length of a pattern.
    lengths = [r["n"] for r in prices.filter(~F.col("exact")).select(F.length("pattern").alias("n")).filter("n IS NOT NULL").distinct().collect()]
    whole = F.struct(F.lit(True).alias("exact"), F.col("_name").alias("pattern"))
    cuts = [F.when(F.length("_name") >= n, F.struct(F.lit(False).alias("exact"), F.substring("_name", 1, n).alias("pattern"))) for n in sorted(lengths)]
    pairs = traces.select("provider", "model").distinct().withColumn("_name", comparable_model(F.col("provider"), F.col("model")))
    shown = pairs.select("provider", "model", F.inline(F.array_compact(F.array(whole, *cuts))))
    matched = (
        shown.join(prices, ["provider", "exact", "pattern"])
        .groupBy("provider", "model")
        .agg(F.min_by(F.struct("pattern", "input_per_1k", "output_per_1k"), F.struct(~F.col("exact"), F.col("pos"))).alias("rate"))
    )
    return (
        traces.join(matched, ["provider", "model"], "left")
        .withColumns({"price_pattern": F.col("rate.pattern"), "input_per_1k": F.col("rate.input_per_1k"), "output_per_1k": F.col("rate.output_per_1k")})
        .drop("rate")
    )
