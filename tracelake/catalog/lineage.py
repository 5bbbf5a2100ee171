"""Lineage chains, order, replay, forks and differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.catalog.sql import on_traces, with_tables
from tracelake.operators import diffs, joins
from tracelake.operators import lineage as ops
from tracelake.plans import debug
from tracelake.registry import query
from tracelake.session import new_folder
from tracelake.sources import derived

# Chains of the events-derived traces: user and run; sequence numbers on a third of the rows, no parents.
_CHAINED = """SELECT *, json_extract_string(metadata, '$.lineage_run_id') AS run_id, json_extract_string(metadata, '$.lineage_thread_id') AS thread_id,
  CAST(coalesce(json_extract_string(metadata, '$.lineage_checkpoint_seq'), '0') AS BIGINT) AS seq FROM traces"""
_KEPT = f"""SELECT *, count(*) OVER chain AS chain_size FROM ({_CHAINED})
  WINDOW chain AS (PARTITION BY org_id, workspace_id, trace_group_id, thread_id, run_id)
  QUALIFY row_number() OVER (PARTITION BY org_id, workspace_id, trace_group_id, thread_id, run_id ORDER BY created_at DESC, id DESC) <= 20"""
_WHOLE = f"""SELECT *, count(*) OVER (PARTITION BY org_id, workspace_id, trace_group_id, thread_id, run_id) AS chain_size FROM ({_CHAINED})"""
_STEPS = f"""SELECT *, row_number() OVER (PARTITION BY trace_group_id, thread_id, run_id ORDER BY seq = 0, seq, created_at, id) AS step FROM ({_WHOLE})"""


@query(
    "l1_chain_items",
    on_traces(
        f"""SELECT trace_group_id AS group_id, run_id, id, row_number() OVER (PARTITION BY trace_group_id, thread_id, run_id ORDER BY created_at DESC, id DESC) - 1 AS position,
        chain_size > 20 AS truncated FROM ({_KEPT})"""
    ),
)
def chain_items(spark, sf):
    return ops.chain_items(derived.traces(spark, sf), 20).select("group_id", "run_id", "id", "position", "truncated")


@query("w1_checkpoint_steps", on_traces(f"SELECT trace_group_id AS group_id, run_id, id, step FROM ({_STEPS})"))
def checkpoint_steps(spark, sf):
    return ops.ordered_chains(derived.traces(spark, sf)).select("group_id", "run_id", "id", "step")


_PATH_SEQ = """WITH a AS (SELECT *, CASE WHEN seq > 0 THEN seq ELSE 0 END AS s FROM checkpoints),
  b AS (SELECT *, CASE WHEN s > 0 THEN s WHEN lag(s) OVER c > 0 THEN lag(s) OVER c + 1 ELSE 0 END AS f FROM a WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
  d AS (SELECT *, min(CASE WHEN f > 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_turn FROM b),
  e AS (SELECT d.*, n.f AS next_f FROM d LEFT JOIN b n ON n.conv_id = d.conv_id AND n.turn = d.next_turn),
  g AS (SELECT *, CASE WHEN f > 0 THEN f WHEN next_f - (next_turn - turn) > 0 THEN next_f - (next_turn - turn) ELSE 0 END AS r FROM e),
  h AS (SELECT *, max(CASE WHEN r > 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_turn FROM g)
  SELECT h.id, h.conv_id, h.turn, CASE WHEN h.r > 0 THEN h.r ELSE coalesce(p.r + h.turn - h.prev_turn, 0) END AS resolved_seq FROM h LEFT JOIN g p ON p.conv_id = h.conv_id AND p.turn = h.prev_turn"""


@query("l2_resolve_seq", with_tables(f"SELECT id, CAST(resolved_seq AS BIGINT) AS resolved_seq FROM ({_PATH_SEQ})", "checkpoints"))
def resolve_seq(spark, sf):
    return ops.ordered_chains(derived.checkpoints(spark, sf)).select("id", "resolved_seq")


@query("l3_lineage_order", with_tables("SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM checkpoints", "checkpoints"))
def lineage_order(spark, sf):
    return ops.ordered_chains(derived.checkpoints(spark, sf)).select("id", "step")


# Every fourth turn hangs below the turn two before. Numbers are filled from the last turn back, then from the first on; of the turns above, a turn
# waits for those of larger rank, nearest last, and the order is that of these lists.
_FORKED = """WITH RECURSIVE a AS (SELECT id, conv_id, turn, CASE WHEN seq > 0 THEN seq ELSE 0 END AS s, CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 0 THEN turn - 2 ELSE turn - 1 END AS up FROM checkpoints),
  b AS (SELECT a.*, CASE WHEN a.s > 0 THEN a.s WHEN p.s > 0 THEN p.s + 1 ELSE 0 END AS f, max(a.turn) OVER (PARTITION BY a.conv_id) AS last FROM a LEFT JOIN a p ON p.conv_id = a.conv_id AND p.turn = a.up),
  r AS (SELECT conv_id, turn, f AS r, 0 AS below FROM b WHERE turn = last UNION ALL
    SELECT b.conv_id, b.turn, CASE WHEN b.f > 0 THEN b.f ELSE coalesce(least(CASE WHEN (b.turn + 1) % 4 <> 0 AND r.r > 1 THEN r.r - 1 END, CASE WHEN (b.turn + 2) % 4 = 0 AND r.below > 1 THEN r.below - 1 END), 0) END, r.r
    FROM r JOIN b ON b.conv_id = r.conv_id AND b.turn = r.turn - 1),
  c AS (SELECT conv_id, turn, r AS c, 0 AS above FROM r WHERE turn = 0 UNION ALL
    SELECT r.conv_id, r.turn, CASE WHEN r.r > 0 THEN r.r WHEN r.turn % 4 = 0 THEN CASE WHEN c.above > 0 THEN c.above + 1 ELSE 0 END WHEN c.c > 0 THEN c.c + 1 ELSE 0 END, c.c
    FROM c JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1),
  k AS (SELECT conv_id, turn, c, row_number() OVER (PARTITION BY conv_id ORDER BY c = 0, c, turn) AS n FROM c),
  w AS (SELECT conv_id, turn, [n] AS line, CAST([] AS BIGINT[]) AS above FROM k WHERE turn = 0 UNION ALL
    SELECT k.conv_id, k.turn, list_append(list_filter(CASE WHEN k.turn % 4 = 0 THEN w.above ELSE w.line END, lambda x: x > k.n), k.n), w.line FROM w JOIN k ON k.conv_id = w.conv_id AND k.turn = w.turn + 1)
  SELECT 'conv-' || a.conv_id AS group_id, a.id, row_number() OVER (PARTITION BY a.conv_id ORDER BY w.line) AS step, CAST(k.c AS BIGINT) AS resolved_seq
  FROM a JOIN k USING (conv_id, turn) JOIN w USING (conv_id, turn)"""


@query("l3_lineage_order_forked", with_tables(_FORKED, "checkpoints"))
def lineage_order_forked(spark, sf):
    return ops.ordered_chains(derived.checkpoints(spark, sf, True)).select("group_id", "id", "step", "resolved_seq")


@query("l3_lineage_order_doubling", with_tables(_FORKED, "checkpoints"))
def lineage_order_doubling(spark, sf):
    """All chains the way of the long ones."""
    return ops.ordered_chains(derived.checkpoints(spark, sf, True), packed=0).select("group_id", "id", "step", "resolved_seq")


def _one_target_per_chain(spark, sf):
    cp = derived.table(spark, sf, "conversations")
    size = F.struct(F.length("text"), "turn")
    picked = cp.groupBy("conv_id").agg(F.max("turn").alias("source"), F.max_by("turn", size).alias("target"))

    def name(t):
        return F.concat(F.lit("cp_"), F.col("conv_id").cast("string"), F.lit("_"), F.col(t).cast("string"))

    return picked.select(name("source").alias("source_id"), name("target").alias("target_id"))


@query(
    "l4_replay",
    with_tables(
        """WITH p AS (SELECT conv_id, max(turn) AS source, arg_max(turn, (length(text), turn)) AS target FROM conversations GROUP BY conv_id)
        SELECT 'cp_' || p.conv_id || '_' || p.source AS source_id, 'cp_' || p.conv_id || '_' || p.target AS target_id, c.id,
          row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS step, false AS truncated
        FROM p JOIN checkpoints c ON c.conv_id = p.conv_id AND c.turn <= p.target""",
        "checkpoints",
    ),
)
def replay(spark, sf):
    out = ops.replay(derived.checkpoints(spark, sf), _one_target_per_chain(spark, sf))
    return out.select("source_id", "target_id", "id", "step", "truncated")


@query(
    "l4_replay_cut_chains",
    on_traces(
        f"""WITH src AS (SELECT trace_group_id, thread_id, run_id, min_by(id, (created_at, id)) AS source_id FROM ({_CHAINED}) GROUP BY ALL),
        members AS (SELECT s.source_id, k.* FROM src s JOIN ({_KEPT}) k USING (trace_group_id, thread_id, run_id)
          UNION SELECT s.source_id, c.*, (SELECT count(*) FROM ({_CHAINED}) x WHERE x.trace_group_id = c.trace_group_id AND x.run_id = c.run_id) FROM src s JOIN ({_CHAINED}) c ON c.id = s.source_id),
        o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq = 0, seq, created_at, id) AS step FROM members),
        t AS (SELECT source_id, max(CASE WHEN id = source_id THEN step END) AS target, max(step) AS last FROM o GROUP BY source_id)
        SELECT o.source_id, o.id, o.step, o.chain_size > 20 AND t.target = t.last AS truncated FROM o JOIN t USING (source_id) WHERE o.step <= t.target"""
    ),
)
def replay_cut(spark, sf):
    # The oldest trace of each chain is replayed; in long chains it lies outside the kept rows.
    t = derived.traces(spark, sf)
    oldest = ops.with_lineage(t).groupBy("group_id", "thread_id", "run_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("source_id"))
    out = ops.replay(t, oldest.select("source_id", F.lit("").alias("target_id")), 20)
    return out.select("source_id", "id", "step", "truncated")


@query(
    "l5_fork_plan",
    on_traces(
        """SELECT id AS source_id, id AS parent_checkpoint_id, trace_group_id AS group_id, json_extract_string(metadata, '$.lineage_thread_id') AS thread_id,
        'run_' || left(sha256('run|' || id || '|' || id), 16) AS run_id,
        CASE WHEN CAST(coalesce(json_extract_string(metadata, '$.lineage_checkpoint_seq'), '0') AS BIGINT) > 0 THEN CAST(json_extract_string(metadata, '$.lineage_checkpoint_seq') AS BIGINT) + 1 ELSE 1 END AS checkpoint_seq
        FROM traces"""
    ),
)
def fork_plan(spark, sf):
    t = derived.traces(spark, sf)
    plan = ops.fork_plan(t, t.select(F.col("id").alias("source_id")))
    return plan.select("source_id", "parent_checkpoint_id", "group_id", "thread_id", "run_id", "checkpoint_seq")


@query(
    "l6_chain_identifier",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 <> 0 THEN 'trace_group_id' WHEN event_id % 5 <> 0 THEN 'lineage_thread_id' WHEN event_id % 7 <> 0 THEN 'lineage_run_id' ELSE '(single trace)' END
       ELSE CASE CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END
         WHEN 0 THEN '(single trace)' WHEN 1 THEN CASE WHEN event_id % 3 <> 0 THEN 'trace_group_id' WHEN event_id % 5 <> 0 THEN 'lineage_thread_id' ELSE 'lineage_run_id' END ELSE 'composite_filter' END END AS identifier FROM events""",
)
def chain_identifier(spark, sf):
    e = F.col("event_id")
    g, t, r = [F.when(e % n != 0, F.lit("x")).otherwise(F.lit("")) for n in (3, 5, 7)]
    return derived.table(spark, sf, "events").select("event_id", ops.chain_identifier(g, t, r, e % 2 == 1).alias("identifier"))


@query(
    "l7_chain_summary",
    on_traces(
        f"""SELECT trace_group_id AS group_id, run_id, count(*) AS checkpoint_count, max(chain_size) > 20 AS truncated, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        min(created_at) AS first_at, max(created_at) AS last_at, 'trace_group_id' AS lineage_identifier FROM ({_KEPT}) GROUP BY ALL"""
    ),
)
def chain_summary(spark, sf):
    return ops.chain_summary(derived.traces(spark, sf), 20).select(
        "group_id", "run_id", "checkpoint_count", "truncated", "total_tokens", "first_at", "last_at", "lineage_identifier"
    )


@query(
    "l7_chain_summary_whole",
    on_traces(
        f"""SELECT trace_group_id AS group_id, run_id, count(*) AS checkpoint_count, false AS truncated, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        min(created_at) AS first_at, max(created_at) AS last_at, 'trace_group_id' AS lineage_identifier FROM ({_CHAINED}) GROUP BY ALL"""
    ),
)
def chain_summary_whole(spark, sf):
    return ops.chain_summary(derived.traces(spark, sf)).select(
        "group_id", "run_id", "checkpoint_count", "truncated", "total_tokens", "first_at", "last_at", "lineage_identifier"
    )


_LAGGED = f"""SELECT *, lag(id) OVER c AS p_id, lag(provider) OVER c AS p_provider, lag(model) OVER c AS p_model, lag(request_path) OVER c AS p_path, lag(response_status) OVER c AS p_status,
  lag(total_tokens) OVER c AS p_tokens, lag(latency_ms) OVER c AS p_latency, lag(estimated_cost_usd) OVER c AS p_cost, lag(metadata) OVER c AS p_meta, lag(seq) OVER c AS p_seq
  FROM ({_STEPS}) WINDOW c AS (PARTITION BY trace_group_id, thread_id, run_id ORDER BY step)"""


@query(
    "w2_checkpoint_diff",
    on_traces(
        f"""SELECT p_id AS from_checkpoint_id, id AS to_checkpoint_id, step, p_provider <> provider AS provider_changed, p_model <> model AS model_changed, p_path <> request_path AS request_path_changed,
        p_status <> response_status AS response_status_changed, total_tokens - p_tokens AS total_tokens_delta, latency_ms - p_latency AS latency_ms_delta,
        round(estimated_cost_usd - p_cost, 8) AS estimated_cost_usd_delta, sha256(p_meta) <> sha256(metadata) AS request_body_changed,
        octet_length(encode(p_meta)) AS request_body_bytes_from, octet_length(encode(metadata)) AS request_body_bytes_to FROM ({_LAGGED}) WHERE p_id IS NOT NULL"""
    ),
)
def checkpoint_diff(spark, sf):
    t = derived.traces(spark, sf).withColumn("request_body", F.col("metadata"))
    d = diffs.checkpoint_diffs(ops.ordered_chains(diffs.digested(t)), ops.CHAIN_KEYS)
    return d.select(
        "from_checkpoint_id", "to_checkpoint_id", "step", "provider_changed", "model_changed", "request_path_changed", "response_status_changed",
        "total_tokens_delta", "latency_ms_delta", F.round("estimated_cost_usd_delta", 8).alias("estimated_cost_usd_delta"),
        "request_body_changed", "request_body_bytes_from", "request_body_bytes_to",
    )


_HAS = "CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 3 = 0"
_HAD = "CAST(regexp_extract(p_id, '[0-9]+$') AS BIGINT) % 3 = 0"


@query(
    "w3_metadata_key_diff",
    on_traces(
        f"""SELECT p_id AS from_checkpoint_id, id AS to_checkpoint_id, CASE WHEN {_HAS} AND NOT {_HAD} THEN 'lineage_checkpoint_seq' ELSE '' END AS added,
        CASE WHEN {_HAD} AND NOT {_HAS} THEN 'lineage_checkpoint_seq' ELSE '' END AS removed,
        concat_ws(',', CASE WHEN {_HAS} AND {_HAD} AND seq <> p_seq THEN 'lineage_checkpoint_seq' END,
          CASE WHEN json_extract_string(metadata, '$.streaming') <> json_extract_string(p_meta, '$.streaming') THEN 'streaming' END) AS changed FROM ({_LAGGED}) WHERE p_id IS NOT NULL"""
    ),
)
def metadata_key_diff(spark, sf):
    d = diffs.checkpoint_diffs(ops.ordered_chains(derived.traces(spark, sf)), ops.CHAIN_KEYS)
    joined = {n: F.array_join(f"metadata_keys_{n}", ",").alias(n) for n in ("added", "removed", "changed")}
    return d.select("from_checkpoint_id", "to_checkpoint_id", *joined.values())


@query(
    "u2_key_sets",
    on_traces(
        f"""SELECT id, CASE WHEN {_HAS} THEN 'a,access_key_id,lineage_checkpoint_seq,lineage_run_id,lineage_thread_id,streaming' ELSE 'a,access_key_id,lineage_run_id,lineage_thread_id,streaming' END AS all_keys,
        CASE WHEN {_HAS} THEN 'lineage_checkpoint_seq,lineage_run_id,lineage_thread_id' ELSE 'lineage_run_id,lineage_thread_id' END AS only_before, 'access_key_id,streaming' AS shared FROM traces"""
    ),
)
def key_sets(spark, sf):
    sets = diffs.key_sets(F.col("metadata"), F.lit('{"streaming":1,"access_key_id":null,"a":[]}'))
    return derived.traces(spark, sf).select("id", *[F.array_join(c, ",").alias(n) for n, c in sets.items()])


@query(
    "u1_add_if_missing",
    """SELECT doc_id AS id, 'label' AS origin FROM labels UNION ALL SELECT DISTINCT conv_id, 'conversation' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)""",
)
def add_if_missing(spark, sf):
    known = derived.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("origin"))
    extra = derived.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.lit("conversation").alias("origin")).distinct()
    return ops.add_if_missing(known, extra)


@query(
    "l8_debug_chain",
    on_traces(
        f"""SELECT trace_group_id AS group_id, run_id, step, id, p_id AS from_checkpoint_id, total_tokens - p_tokens AS total_tokens_delta, false AS truncated, sha256(metadata) AS request_sha,
        'trace_group_id' AS lineage_identifier FROM ({_LAGGED})"""
    ),
)
def debug_chain(spark, sf):
    from tracelake.sources.store import gzip_text

    t = derived.traces(spark, sf)
    bodies = t.select(F.col("id").alias("trace_id"), gzip_text("metadata").alias("request_body_gzip"), F.lit(None).cast("binary").alias("response_body_gzip"))
    d = debug.debug_chain(t, bodies)
    return d.select(
        "group_id", "run_id", "step", "id", "from_checkpoint_id", "total_tokens_delta", "truncated", F.sha2("request_body", 256).alias("request_sha"), "lineage_identifier"
    )


@query("s21_debug_bundle_export", on_traces(f"SELECT sha256(concat_ws('|', org_id, workspace_id, trace_group_id, thread_id, run_id, '')) AS name, count(*) AS checkpoints FROM ({_WHOLE}) GROUP BY org_id, workspace_id, trace_group_id, thread_id, run_id"))
def debug_bundle_export(spark, sf):
    return debug.export_bundles(debug.debug_chain(derived.traces(spark, sf)), new_folder(spark, "bundles")).select("name", "checkpoints")


@query(
    "l9_forest",
    with_tables(
        """SELECT c.id, coalesce(p.id, '') AS parent_id, p.id IS NULL AS is_root, CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS in_degree, coalesce(k.id, '') AS children FROM checkpoints c
        LEFT JOIN checkpoints p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN checkpoints k ON k.conv_id = c.conv_id AND k.turn = c.turn + 1""",
        "checkpoints",
    ),
)
def forest(spark, sf):
    f = ops.forest(derived.checkpoints(spark, sf))
    return f.select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "is_root", "in_degree", F.array_join("children", ",").alias("children"))


@query(
    "j6_parent_link",
    with_tables("SELECT id, parent_id FROM checkpoints WHERE parent_id IS NOT NULL", "checkpoints"),
)
def parent_link(spark, sf):
    return joins.parent_links(ops.chained(derived.checkpoints(spark, sf)), ops.CHAIN_KEYS).select("id", "parent_id")


# Five long chains: all traces whose user leaves the same rest; the parent is the user's own event before.
_LONG = """SELECT id, 'long-' || CAST(user_id % 5 AS VARCHAR) AS chain, lag(id) OVER (PARTITION BY user_id ORDER BY created_at, id) AS parent_id, created_at
  FROM (SELECT *, CAST(regexp_extract(trace_group_id, '[0-9]+') AS BIGINT) AS user_id FROM traces)"""


def _long_chains(spark, sf, linked: bool):
    t = derived.traces(spark, sf)
    user = F.regexp_extract("trace_group_id", "[0-9]+", 0).cast("long")
    before = F.lag("id").over(Window.partitionBy("trace_group_id").orderBy("created_at", "id"))
    meta = F.to_json(F.struct(before.alias("lineage_parent_checkpoint_id"))) if linked else F.lit("{}")
    group = F.concat(F.lit("long-"), (user % 5).cast("string")).alias("trace_group_id")
    return t.select("id", "timestamp", "created_at", meta.alias("metadata"), group, F.lit("o").alias("org_id"), F.lit("w").alias("workspace_id"))


@query("j6_parent_link_long", on_traces(f"SELECT id, parent_id FROM ({_LONG}) WHERE parent_id IS NOT NULL"))
def parent_link_long(spark, sf):
    return joins.parent_links(ops.chained(_long_chains(spark, sf, True)), ops.CHAIN_KEYS).select("id", "parent_id")


@query("l9_forest_long", on_traces(f"SELECT id, coalesce(parent_id, '') AS parent_id, parent_id IS NULL AS is_root FROM ({_LONG})"))
def forest_long(spark, sf):
    return ops.forest(_long_chains(spark, sf, True)).select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "is_root")


@query("w1_checkpoint_steps_long", on_traces(f"SELECT id, row_number() OVER (PARTITION BY chain ORDER BY created_at, id) AS step, count(*) OVER (PARTITION BY chain) AS chain_size FROM ({_LONG})"))
def checkpoint_steps_long(spark, sf):
    return ops.ordered_chains(_long_chains(spark, sf, False), packed=1_000).select("id", "step", "chain_size")


@query("l3_lineage_order_long", on_traces(f"SELECT id, row_number() OVER (PARTITION BY chain ORDER BY created_at, id) AS step FROM ({_LONG})"))
def lineage_order_long(spark, sf):
    """Each user's events hang below one another; among those ready the oldest is next, which is the order of time."""
    return ops.ordered_chains(_long_chains(spark, sf, True), packed=1_000).select("id", "step")
