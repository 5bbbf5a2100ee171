"""Order and numbers of forests by pointer doubling, beside the rules for one chain in plain Python."""

import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from tracelake.operators import lineage
from tracelake.operators.forest import order_forest
from tracelake.operators.sliced import numbered, range_sums

SCHEMA = "node long, chain string, checkpoint_id string, parent_checkpoint_id string, seq long, order_time timestamp, id string, created_at timestamp"


def chain_rows(rng, chain, size, first, cycles=True):
    rows = []
    for i in range(size):
        parent = rng.choice(["", "gone", f"n{rng.randrange(size) if cycles else rng.randrange(i + 1)}", f"n{max(0, i - 1)}", f"n{max(0, i - 1)}"])
        seq = rng.choice([0, 0, 0, rng.randrange(1, 9), i + 1])
        name = f"n{rng.randrange(size)}" if rng.random() < 0.08 else f"n{i}"
        when = at(rng.choice([i, rng.randrange(size), 3]))
        rows.append((first + i, chain, name, parent, seq, when, rng.choice([f"id{first + i}", f"id{first + i}", "same", None]), at(rng.randrange(5))))
    return rows


def plain(rows):
    """Steps and numbers by the helper for one chain, which is itself held against a naive form; positions newest first, ties by time, id, position."""
    out = {}
    for chain in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == chain), key=lambda r: (r[7], r[6] is not None, r[6] or "", r[0]), reverse=True)
        tie = {r[0]: n for n, r in enumerate(sorted(mine, key=lambda r: (r[5], r[6] is not None, r[6] or "", -r[7].timestamp(), r[0])))}
        found = lineage.order_nodes([r[2] for r in mine], [r[3] for r in mine], [r[4] for r in mine], [tie[r[0]] for r in mine])
        out.update({r[0]: (*f, len(mine)) for r, f in zip(mine, found)})
    return out


def check(spark, rows):
    got = {r["node"]: (r["step"], r["resolved_seq"], r["chain_size"]) for r in order_forest(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain(rows)
    assert got == want, sorted((k, got.get(k), want[k], rows[k]) for k in want if got.get(k) != want[k])[:5]


def test_many_random_chains(spark):
    rng, rows = random.Random(11), []
    for n in range(120):
        rows += chain_rows(rng, f"c{n}", rng.randrange(1, 14), len(rows), cycles=n % 3 > 0)
    check(spark, rows)


def test_one_deep_chain_with_forks(spark):
    rng, rows = random.Random(12), []
    for i in range(150):
        parent = "" if i == 0 else f"n{i - 1}" if i % 4 else f"n{i // 2}"
        rows.append((i, "deep", f"n{i}", parent, rng.choice([0, 0, 0, 0, i + 1, 150 - i]), at(rng.choice([i, 150 - i])), f"id{i}", at(i)))
    check(spark, rows)


def test_links_without_numbers_and_numbers_without_links(spark):
    rows = [(i, "up", f"n{i}", f"n{i - 1}" if i else "", 40 if i == 30 else 0, at(i), f"u{i}", at(i)) for i in range(60)]
    rows += [(100 + i, "flat", f"m{i}", "", rnd, at(-i), f"f{i}", at(i)) for i, rnd in enumerate([3, 0, 1, 2, 0])]
    rows += [(200 + i, "ring", f"r{i}", f"r{(i + 1) % 5}", 7 if i == 2 else 0, at(i), f"g{i}", at(i)) for i in range(5)]
    rows += [(300 + i, "ring", f"t{i}", f"r{i}", 0, at(9), f"t{i}", at(i)) for i in range(3)]
    check(spark, rows)


def test_nothing(spark):
    assert order_forest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("packed", [0, 3, 5_000])
def test_repeated_and_missing_ids_keep_their_rows(spark, packed):
    from helpers import trace, traces

    rows = [trace("x", i, trace_group_id="g") for i in range(3)] + [trace(None, 9, trace_group_id="g"), trace(None, 9, trace_group_id="g"), trace("y", 4, trace_group_id="h", org_id=None)]
    got = lineage.ordered_chains(traces(spark, rows), packed=packed).collect()
    assert sorted((r["group_id"], r["step"], r["chain_size"]) for r in got) == [("g", n, 5) for n in range(1, 6)] + [("h", 1, 1)]


def test_numbers_and_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "k", None]), rng.randrange(6), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v long").repartition(3)
    got = numbered(df, ["k"], [F.col("t").desc(), F.col("i")], "n", "size")
    got = range_sums(got, ["k"], ["t", "i"], "v", "upto")
    by = {}
    for r in got.collect():
        by.setdefault(r["k"], []).append(r)
    for mine in by.values():
        assert [r["i"] for r in sorted(mine, key=lambda r: r["n"])] == [r["i"] for r in sorted(mine, key=lambda r: (-r["t"], r["i"]))]
        assert {r["size"] for r in mine} == {len(mine)} and sorted(r["n"] for r in mine) == list(range(1, len(mine) + 1))
        total = 0
        for r in sorted(mine, key=lambda r: (r["t"], r["i"])):
            total += r["v"]
            assert r["upto"] == total


def test_steps_are_compared_across_stretches(spark, monkeypatch):
    from helpers import trace, traces

    from tracelake.operators import diffs

    monkeypatch.setattr(diffs, "STRETCH", 4)
    rows = [trace(f"d{i:02d}", i, trace_group_id="g", org_id=None, total_tokens=i * i) for i in range(19)]
    got = diffs.checkpoint_diffs(lineage.ordered_chains(diffs.digested(traces(spark, rows)), packed=5), lineage.CHAIN_KEYS).collect()
    assert sorted((r["step"], r["from_checkpoint_id"], r["to_checkpoint_id"], r["total_tokens_delta"]) for r in got) == [(i + 1, f"d{i - 1:02d}", f"d{i:02d}", 2 * i - 1) for i in range(1, 19)]


@pytest.mark.parametrize("span_rows", [0, None])
def test_a_burst_is_cut_like_other_rows(spark, span_rows):
    """Nearly all rows of one key lie within a fifth of a second; no range holds more than twice its share."""
    from tracelake.operators.sliced import in_ranges, running_sums, trailing_count

    rows = [("hot", i, at(0.2 * i / 19_000)) for i in range(19_000)] + [("k", i, at(i)) for i in range(1_000)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = [r["count"] for r in in_ranges(df, ["k"], [F.col("ts"), F.col("i")]).groupBy("_range").count().collect()]
        assert len(held) == 4 and max(held) <= 2 * len(rows) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = running_sums(df, ["k"], "ts", ["ts", "i"], {"n": F.lit(1)})
    assert got.filter("n <> i + 1").isEmpty()
    counts = trailing_count(df, ["k"], "ts", 60, "n", span_rows).filter("k = 'k'").collect()
    assert all(r["n"] == min(r["i"] + 1, 61) for r in counts)
    assert trailing_count(df, ["k"], "ts", 60, "n", span_rows).filter("k = 'hot' and n <> i + 1").isEmpty()
