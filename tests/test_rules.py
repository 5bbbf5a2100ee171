"""Rules and prices met by equality equal the row-by-row forms."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.pricing import Price, price_join, rate_column
from tracelake.operators.joins import PolicyRule, policy_columns, policy_join

FALLBACK = PolicyRule("rest", "store")
RULE = "pos int, policy_id string, mode string, org_id string, workspace_id string, key_id string, provider string, route_prefix string"
REQUEST = "id int, org_id string, workspace_id string, access_key_id string, provider string, request_path string, pii_mark string"


def rule_rows(spark, rules):
    rows = [(i, r.policy_id, r.mode, r.org_id, r.workspace_id, r.key_id, r.provider, r.route_prefix) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE)


def requests(spark, rng, n):
    paths = [None, "", "/", "//", "/a", "/a/", "/a/b", "/a/bc", "/a/b/c", "a/b", "//x", "/é/b"]
    rows = [(i // 2, *[rng.choice([None, "", "x", "y", "z"]) for _ in range(4)], rng.choice(paths), "kept") for i in range(n)]
    return spark.createDataFrame(rows, REQUEST)


@pytest.mark.parametrize("seed", [1, 2])
def test_policy_join_equals_case(spark, seed):
    rng = random.Random(seed)
    rules = []
    while len(rules) < 40:
        rule = PolicyRule(f"p{len(rules)}", rng.choice("mn"), *[rng.choice(["", "", " ", "x", " y "]) for _ in range(4)], rng.choice(["", " ", "/", "//", "a", "/a/b/", "/a/b", "/é"]))
        rules += [rule] if rule.selectors() else []
    rows = requests(spark, rng, 300)
    want = policy_columns(rules, FALLBACK, *[F.col(c) for c in ("org_id", "workspace_id", "access_key_id", "provider", "request_path")])
    got = policy_join(rows, rule_rows(spark, rules), FALLBACK)
    assert got.columns == [*rows.columns, "pii_mode", "pii_policy_id"]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select("*", *[c.alias(n) for n, c in want.items()]).collect()))


def test_policy_join_edges(spark):
    rows = requests(spark, random.Random(3), 20)
    assert {r["pii_policy_id"] for r in policy_join(rows, rule_rows(spark, []), FALLBACK).collect()} == {"rest"}
    assert policy_join(rows.limit(0), rule_rows(spark, [PolicyRule("a", "m", provider="x")]), FALLBACK).count() == 0
    with pytest.raises(ValueError):
        policy_join(rows, rule_rows(spark, [PolicyRule("none", "off")]), FALLBACK)


def test_many_rules_keep_the_plan_small(spark):
    """One join whatever the number of rules, and no comparison of requests with rules of other values."""
    rules = spark.range(10_000).selectExpr("CAST(id AS INT) pos", "concat('p', id) policy_id", "'m' mode", "concat('o', id) org_id", "'' workspace_id", "'' key_id", "IF(id % 2 = 0, 'x', '') provider", "'/a' route_prefix")
    rows = spark.createDataFrame([(1, "o5", "", "", "x", "/a/b", ""), (2, "o6", "", "", "x", "/a", ""), (3, "o6", "", "", "y", "/a", "")], REQUEST)
    got = policy_join(rows, rules, FALLBACK)
    assert {r["id"]: r["pii_policy_id"] for r in got.collect()} == {1: "p5", 2: "p6", 3: "rest"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_price_join_equals_list(spark):
    prices = [Price("openai", "gpt", True, 1.0, 2.0), Price("anthropic", "cl-a", True, 3.0, 4.0), Price("anthropic", "cl-", False, 5.0, 6.0), Price("anthropic", "cl-a-b", False, 7.0, 8.0),
              Price("anthropic", "cl-a", False, 9.0, 10.0), Price("llm", "", False, 11.0, 12.0), Price("anthropic", "é", False, 13.0, 14.0)]
    table = spark.createDataFrame([(p.provider, i, p.exact, p.pattern, p.input_per_1k, p.output_per_1k) for i, p in enumerate(prices)], "provider string, pos int, exact boolean, pattern string, input_per_1k double, output_per_1k double")
    models = ["gpt", "gpt-4", " CL-A ", "cl-a-b-c", "cl", "", None, "éa", "x" * 5000]
    rows = spark.createDataFrame([(p, m) for p in ("openai", "anthropic", "llm", None) for m in models], "provider string, model string")
    got = price_join(rows, table).select("provider", "model", "input_per_1k", "output_per_1k")
    want = rows.select("provider", "model", rate_column(F.col("provider"), F.col("model"), prices).alias("r")).select("provider", "model", "r.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert price_join(rows, table.limit(0)).filter("input_per_1k IS NOT NULL").count() == 0
