"""Order and numbers of whole forests of checkpoints by pointer doubling.

No chain is ever brought into one row, one window or one task. Nodes carry a number of their own; what a node needs to know of
nodes far above or below it is found in rounds of equi joins in which every pointer skips twice as far as in the round before. Each
round is written, so lineage stays short and a lost executor costs one round. Rounds follow from the depth, and only nodes that
still wait for an answer take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.sliced import numbered, range_sums
from tracelake.session import persist_table


def _empty(rows: DataFrame) -> bool:
    return rows.isEmpty()


def parent_nodes(nodes: DataFrame) -> DataFrame:
    """``chain, node, up, backward``: the node that owns the parent's checkpoint id in the same chain, for nodes that have one.

    Of several nodes with one checkpoint id the newest owns it; a node is never its own parent. ``backward`` links lead to a parent that comes later
    than its child by time, id and the newest row.
    """
    newest_first = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1))
    timed = nodes.withColumn("age", F.struct("order_time", "id", newest_first.alias("recent"), "node"))
    owners = timed.filter(F.col("checkpoint_id") != "").groupBy("chain", F.col("checkpoint_id").alias("parent_checkpoint_id"))
    owners = owners.agg(F.max(F.struct("created_at", "id", "node", "age")).alias("o")).select("chain", "parent_checkpoint_id", F.col("o.node").alias("up"), F.col("o.age").alias("up_age"))
    children = timed.filter(F.col("parent_checkpoint_id") != "").select("chain", "parent_checkpoint_id", "node", "age")
    links = children.join(owners, ["chain", "parent_checkpoint_id"]).filter(F.col("up") != F.col("node"))
    return links.select("chain", "node", "up", (~(F.col("up_age") < F.col("age"))).alias("backward"))


def _of_up(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """``rows`` with ``up_<name>`` of the node that ``up`` points at."""
    seen = table.select(F.col("node").alias("up"), *[F.col(n).alias(f"up_{n}") for n in names])
    return rows.join(seen, "up", "left")


def _rootless(links: DataFrame) -> DataFrame:
    """``node, on_cycle`` of the nodes from which no root is reached: those on cycles and those that hang below one.

    Only chains with a backward link can have cycles. There, pointers double until they
    span the longest of them: what has not come out by then ends on a cycle, and the nodes it ends at are the cycles' nodes.
    """
    doubtful = persist_table(links.filter("backward").select("chain").distinct(), "doubtful")
    if _empty(doubtful):
        return links.filter("false").select("node", F.lit(False).alias("on_cycle"))
    jumps = persist_table(links.join(doubtful, "chain", "left_semi").select("chain", "node", "up"), "jumps")
    longest = jumps.groupBy("chain").count().agg(F.max("count")).first()[0]
    jumps, span = jumps.drop("chain"), 1
    while span <= longest:
        # A pointer at a root has no row of its own and is dropped.
        jumps = persist_table(jumps.join(jumps.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), "jumps")
        span *= 2
        if _empty(jumps):
            break
    ends = jumps.select(F.col("up").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    return persist_table(jumps.select("node").join(ends, "node", "left").select("node", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")), "rootless")


def _room_above(known: DataFrame, links: DataFrame, waiting: DataFrame) -> DataFrame:
    """``node, seq`` of waiting nodes that have numbered descendants: the smallest number that leaves room for the steps down to them.

    A number that leaves no room says nothing to the nodes above. All waiting nodes first take the smallest claim from
    below, however far; claims that ran out on the way make some of them doubtful, and only those ask again, now from children that are
    settled.
    """
    settled, open_nodes = known.select("node", "seq"), waiting
    found = []
    while True:
        inner = persist_table(links.join(open_nodes, "node", "left_semi"), "open-links")
        below = links.join(settled.filter("seq > 1"), "node").groupBy(F.col("up").alias("node")).agg(F.min(F.col("seq") - 1).alias("claim"))
        claims = persist_table(open_nodes.join(below, "node", "left"), "claims")
        reach = persist_table(inner.join(open_nodes.select(F.col("node").alias("up")), "up", "left_semi").select("node", "up"), "reach")
        step = 1
        while not _empty(reach):
            higher = reach.join(claims, "node").groupBy(F.col("up").alias("node")).agg(F.min(F.col("claim") - step).alias("higher"))
            claims = persist_table(claims.join(higher, "node", "left").select("node", F.least("claim", "higher").alias("claim")), "claims")
            reach = persist_table(reach.join(reach.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), "reach")
            step *= 2
        done = claims.filter("claim is null or claim >= 1").select("node", F.coalesce("claim", F.lit(0)).cast("bigint").alias("seq"))
        found.append(done.filter("seq > 0"))
        open_nodes = persist_table(claims.filter("claim < 1").select("node"), "doubtful-claims")
        if _empty(open_nodes):
            break
        settled = settled.unionByName(done)
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def _count_on(seqs: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without a number count on from the nearest numbered node above: ``node, seq``."""
    waiting = links.join(seqs.filter("seq = 0").select("node"), "node", "left_semi")
    jumps = persist_table(_of_up(waiting, seqs, "seq").select("node", "up", F.lit(1).cast("bigint").alias("steps"), "up_seq"), "count-jumps")
    while True:
        going = jumps.filter("up_seq = 0")
        if _empty(going):
            return jumps.select("node", (F.col("up_seq") + F.col("steps")).alias("seq"))
        seen = jumps.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("up_seq").alias("next_seq"))
        # A pointer at a root has no row of its own and is dropped; nodes that have their answer stay for others to skip along.
        moved = going.drop("up_seq").join(seen, "up").select("node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("next_seq").alias("up_seq"))
        jumps = persist_table(jumps.filter("up_seq > 0").unionByName(moved), "count-jumps")


def resolved_numbers(nodes: DataFrame, links: DataFrame, rootless: DataFrame) -> DataFrame:
    """``node, seq`` with missing sequence numbers filled (0: unknown), nearest knowledge first.

    A node below a numbered parent follows it. Of the others, one with numbered descendants takes the smallest number that
    leaves room for the steps down to them. The rest count on from the nearest numbered ancestor. On a cycle only the first rule holds.
    """
    # Chains without any number have none to fill.
    some = nodes.filter("seq > 0").select("chain").distinct()
    counted = persist_table(nodes.join(some, "chain", "left_semi").select("node"), "counted-nodes")
    given = nodes.select("node", F.greatest(F.coalesce("seq", F.lit(0)), F.lit(0)).cast("bigint").alias("seq"))
    if _empty(counted):
        return given
    links = links.join(counted, "node", "left_semi")
    after = _of_up(given.join(links, "node", "left"), given, "seq")
    first = persist_table(after.select("node", F.when(F.col("seq") > 0, F.col("seq")).when(F.col("up_seq") > 0, F.col("up_seq") + 1).otherwise(F.lit(0)).cast("bigint").alias("seq")), "numbers")
    tied = links.select("node").unionByName(links.select(F.col("up").alias("node"))).distinct()
    free = first.filter("seq = 0").join(tied, "node", "left_semi").join(rootless.filter("on_cycle"), "node", "left_anti").select("node")
    free = persist_table(free, "unnumbered")
    if _empty(free):
        return first
    # What waits on a cycle is like a root without a number.
    straight = persist_table(links.join(rootless.filter("on_cycle"), "node", "left_anti"), "straight-links")
    second = _room_above(first.filter("seq > 0"), straight, free)
    numbers = persist_table(first.join(second.withColumnRenamed("seq", "room"), "node", "left").select("node", F.coalesce("room", "seq").alias("seq")), "numbers")
    third = _count_on(numbers, straight)
    return persist_table(numbers.join(third.withColumnRenamed("seq", "counted"), "node", "left").select("node", F.coalesce("counted", "seq").alias("seq")), "numbers")


def _held_back(ranks: DataFrame, links: DataFrame) -> DataFrame:
    """``node, up``: the nearest node above with a larger rank, which a node has to wait for; only nodes that have one.

    All nodes between a node and its pointer have smaller ranks than it, so the pointer may skip to where the pointed node points.
    """
    jumps = persist_table(_of_up(links.join(ranks.select("node", "rank"), "node"), ranks, "rank"), "wait-jumps")
    while True:
        going = jumps.filter("up_rank < rank")
        if _empty(going):
            return jumps.select("node", "up")
        seen = jumps.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("up_rank").alias("next_rank"))
        # As above: a pointer at a root is dropped, and what has its answer stays.
        moved = going.drop("up_rank").join(seen, "up").select(F.col("next").alias("up"), "node", "rank", F.col("next_rank").alias("up_rank"))
        jumps = persist_table(jumps.filter("up_rank > rank").select("up", "node", "rank", "up_rank").unionByName(moved), "wait-jumps")


def _descend(ranks: DataFrame, held: DataFrame) -> DataFrame:
    """``node, step`` of the nodes of chains in which some node waits for one with a larger rank.

    Whatever waits for a node follows right after it, so the order is that of a walk through the tree of waiting: a
    node, then its subtree by rank. A subtree's size is summed up along doubling pointers, and so are the places before a node.
    """
    sizes = persist_table(ranks.select("node").withColumn("size", F.lit(1).cast("bigint")), "tree-sizes")
    jumps = held
    while not _empty(jumps):
        more = jumps.join(sizes, "node").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        sizes = persist_table(sizes.join(more, "node", "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "tree-sizes")
        jumps = persist_table(jumps.join(jumps.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), "tree-jumps")
    placed = ranks.join(sizes, "node").join(held, "node", "left").withColumn("under", F.coalesce("up", F.lit(-1)))
    placed = range_sums(placed.select("chain", "under", "rank", "node", "up", "size"), ["chain", "under"], ["rank"], "size", "upto")
    places = persist_table(placed.select("node", "up", (F.col("upto") - F.col("size") + 1).alias("step")), "tree-places")
    while True:
        going = places.filter("up is not null")
        if _empty(going):
            return places.select("node", "step")
        seen = places.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("step").alias("more"))
        moved = going.join(seen, "up").select("node", F.col("next").alias("up"), (F.col("step") + F.col("more")).alias("step"))
        places = persist_table(places.filter("up is null").unionByName(moved), "tree-places")


def order_forest(nodes: DataFrame) -> DataFrame:
    """``node, step, resolved_seq, chain_size`` of all nodes.

    ``nodes``: node (a number of its own), chain (not NULL), checkpoint_id, parent_checkpoint_id, seq, order_time, id, created_at. Parents come
    before children. Among those ready, known numbers go first, in order; then time, id and the newest row decide. What hangs in a cycle
    follows at the end in the same order. Ids may repeat or be missing.
    """
    links = persist_table(parent_nodes(nodes), "links")
    if _empty(links):
        return _by_rank(nodes)
    # In other chains every parent is placed before its child by time already, and there is no number to fill: the order is that of time.
    numbers = links.select("chain").distinct().join(nodes.filter("seq > 0").select("chain").distinct(), "chain", "left_semi")
    tangled = persist_table(links.filter("backward").select("chain").unionByName(numbers).distinct(), "tangled-chains")
    if _empty(tangled):
        return _by_rank(nodes)
    # Most tables have chains of both kinds; written, as each round reads them again.
    walked = _walked(persist_table(nodes.join(tangled, "chain", "left_semi"), "tangled-nodes"), persist_table(links.join(tangled, "chain", "left_semi"), "tangled-links"))
    plain = nodes.join(tangled, "chain", "left_anti")
    return walked if _empty(plain) else walked.unionByName(_by_rank(plain))


def _ranked(nodes: DataFrame) -> DataFrame:
    """Adds to nodes with filled numbers the ``rank`` in the chain that they have without links, and the chain's size."""
    order = [F.col("late"), F.col("seq"), F.col("order_time"), F.col("id"), F.col("created_at").desc(), F.col("node")]
    return numbered(nodes.withColumn("late", F.col("seq") == 0), ["chain"], order, "rank", "chain_size")


def _by_rank(nodes: DataFrame) -> DataFrame:
    """Order of chains in which links change nothing: known numbers, time, id and the newest row decide."""
    given = F.greatest(F.coalesce("seq", F.lit(0)), F.lit(0)).cast("bigint")
    ranks = _ranked(nodes.select("chain", "node", "order_time", "id", "created_at", given.alias("seq")))
    return ranks.select("node", F.col("rank").alias("step"), F.col("seq").alias("resolved_seq"), "chain_size")


def _walked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Order of chains in which links count."""
    rootless, links = _rootless(links), links.select("node", "up")
    numbers = resolved_numbers(nodes, links, rootless)
    ranks = _ranked(nodes.select("chain", "node", "order_time", "id", "created_at").join(numbers, "node"))
    ranks = persist_table(ranks.select("chain", "node", "seq", "rank", "chain_size"), "ranks")
    backward = _of_up(links.join(ranks.select("chain", "node", "rank"), "node"), ranks, "rank").filter("up_rank > rank")
    waiting = persist_table(backward.select("chain").distinct(), "waiting-chains")
    plain = ranks.select("node", F.col("rank").alias("step"), F.col("seq").alias("resolved_seq"), "chain_size")
    if _empty(waiting):
        return plain
    tangled = ranks.join(waiting, "chain", "left_semi")
    rooted = persist_table(tangled.join(rootless, "node", "left_anti").select("chain", "node", "rank"), "rooted")
    steps = _descend(rooted, _held_back(rooted, links.join(rooted.select("node"), "node", "left_semi")))
    last = tangled.join(rootless.select("node"), "node", "left_semi").select("chain", "node", "rank")
    if not _empty(rootless):
        before = rooted.groupBy("chain").agg(F.count(F.lit(1)).alias("before"))
        last = numbered(last, ["chain"], [F.col("rank")], "at").join(before, "chain", "left")
        steps = steps.unionByName(last.select("node", (F.col("at") + F.coalesce("before", F.lit(0))).alias("step")))
    steps = persist_table(steps.withColumnRenamed("step", "walked"), "steps")
    return plain.join(steps, "node", "left").select("node", F.coalesce("walked", "step").alias("step"), "resolved_seq", "chain_size")
