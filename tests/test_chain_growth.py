"""Chains without links that count take no rounds, joins or packed rows; results as by the longer ways."""

from helpers import at, dicts, trace, traces

from tracelake.operators import forest, lineage
from tracelake.plans import debug

SCHEMA = "node long, chain string, checkpoint_id string, parent_checkpoint_id string, seq long, order_time timestamp, id string, created_at timestamp"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(n: int):
    return [trace(f"t{i}", i, trace_group_id=f"g{i % 3}", total_tokens=i, meta={"lineage_thread_id": "th", "lineage_checkpoint_seq": 9 - i if i % 4 == 0 else None}) for i in range(n)]


def test_links_in_order_of_time_take_no_rounds(spark, monkeypatch):
    labels, write = [], forest.persist_table
    monkeypatch.setattr(forest, "persist_table", lambda df, label: labels.append(label) or write(df, label))
    rows = [(i, "c", f"n{i}", f"n{i - 3}" if i > 2 else "", 0, at(i), f"id{i}", at(i)) for i in range(30)]
    got = forest.order_forest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["node"]: (r["step"], r["resolved_seq"], r["chain_size"]) for r in got} == {i: (i + 1, 0, 30) for i in range(30)}
    assert not {"reach", "claims", "count-jumps", "wait-jumps"} & set(labels)


def test_plain_and_tangled_chains_together(spark):
    rows = [(i, "c", f"n{i}", f"n{i - 1}" if i else "", 0, at(i), f"id{i}", at(i)) for i in range(5)]
    rows += [(10 + i, "d", f"n{i}", f"n{i + 1}" if i < 4 else "", 0, at(i), f"id{i}", at(i)) for i in range(5)]
    rows += [(20 + i, "e", f"n{i}", f"n{i - 1}" if i else "", 3 if i == 2 else 0, at(i), f"id{i}", at(i)) for i in range(5)]
    got = {r["node"]: (r["step"], r["resolved_seq"]) for r in forest.order_forest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: (i + 1, 0) for i in range(5)}, **{10 + i: (5 - i, 0) for i in range(5)}, **{20 + i: (i + 1, i + 1) for i in range(5)}}


def test_short_chains_are_ordered_and_compared_without_joins(spark):
    chain = debug.debug_chain(traces(spark, rows_of(12)))
    assert "Join" not in plan(chain) and "collect_list" not in plan(chain)
    got = dicts(chain.select("group_id", "step", "id", "from_checkpoint_id", "total_tokens_delta", "response_status_changed"), "group_id", "step")
    assert len(got) == 12
    first = [r for r in got if r["step"] == 1]
    assert len(first) == 3 and all(r["from_checkpoint_id"] is None and r["response_status_changed"] is None for r in first)
    by_id = {r["id"]: r for r in got}
    assert all(r["total_tokens_delta"] == int(r["id"][1:]) - int(r["from_checkpoint_id"][1:]) for r in by_id.values() if r["step"] > 1)


def test_both_ways_give_one_order(spark):
    rows = traces(spark, rows_of(15))
    got = [dicts(lineage.ordered_chains(rows, packed=p).select("id", "step", "resolved_seq", "chain_size"), "id") for p in (0, 100)]
    assert got[0] == got[1]


def test_replay_without_links_packs_no_rows(spark):
    rows = traces(spark, rows_of(12))
    asked = spark.createDataFrame([("t11", "")], "source_id string, target_id string")
    out = lineage.replay(rows, asked, 2)
    assert "collect_list" not in plan(out)
    assert [(r["id"], r["truncated"]) for r in dicts(out, "step")] == [("t8", True), ("t11", True)]
