"""Merkle manifests as persistent trees: a changed leaf makes a version that copies its ancestors and shares every other node.

Leaves of one key form a tree, and the roots of these trees, in the order of their keys, form the top tree. Both are built
the same way: nodes are numbered, every ``SPAN`` levels a task takes aligned blocks of ``ARITY ** SPAN`` nodes, and the blocks' roots
are the nodes of the next round. A key may hold all rows: it is cut into blocks like any other.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import fresh
from tracelake.session import persist_table

ARITY = 8
#: Levels that one task builds: blocks of 4,096 nodes.
SPAN = 4
_PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _hash(text: str) -> str:
    from hashlib import sha256

    return sha256(text.encode()).hexdigest()


def _depth(n: int, arity: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def _levels(nodes: list[str], height: int, arity: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([_hash("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return out


def _path(levels: list[list[str]], at: int, arity: int) -> list[tuple[str, str]]:
    """For each level the siblings to the left and to the right, joined."""
    path = []
    for nodes in levels[:-1]:
        first = at - at % arity
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + arity])))
        at //= arity
    return path


def _folded(node: str, path: list[tuple[str, str]]) -> list[str]:
    """The new ancestors of a node, lowest first."""
    out = []
    for left, right in path:
        node = _hash(left + node + right)
        out.append(node)
    return out


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``pos`` (from 0, within ``tree``, by ``order``) and ``n`` (rows of the tree). ``tree`` must not be null.

    Rows are sorted by ranges and written; a task's place of a row and the counts of trees in tasks before it give the number, so
    no tree is ordered in one task.
    """
    at = fresh(rows, "at")[0]
    placed = persist_table(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn(at, F.monotonically_increasing_id()), label)
    placed = placed.withColumn("part", F.shiftright(at, 33))
    runs = placed.groupBy("tree", "part").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("held"))
    # One row for each task that has rows of the tree.
    tasks = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tasks.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(tasks).alias("n"))
    return placed.join(runs, ["tree", "part"]).withColumn("pos", F.col(at) + F.col("shift")).drop(at, "part", "shift")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


class Tree:
    """Trees over ``leaves`` (``tree, pos, n, hash``; ``n`` leaves of the tree).

    ``nodes`` holds ``tree, level, pos, hash`` of all levels above the leaves, ``roots`` holds ``tree, root``; a lone leaf is its root.
    """

    def __init__(self, leaves: DataFrame, arity: int = ARITY, span: int = SPAN):
        self.arity, self.span, self.size = arity, span, arity**span
        self.bases = [leaves.select("tree", "pos", "n", "hash")]
        written, roots = [], [leaves.filter("n = 1").select("tree", F.col("hash").alias("root"))]
        most = leaves.agg(F.max("n")).first()[0] or 0
        while True:
            level = persist_table(self._above(self.bases[-1], span * (len(self.bases) - 1)), "nodes")
            written.append(level.select("tree", "level", "pos", "hash"))
            roots.append(level.filter("top and n = 1").select("tree", F.col("hash").alias("root")))
            if most <= self.size:
                break
            self.bases.append(level.filter("top and n > 1").select("tree", "pos", "n", "hash"))
            most = -(-most // self.size)
        self.nodes, self.roots = _union(written), _union(roots)

    def _blocks(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.floor(F.col("pos") / self.size))

    def _above(self, base: DataFrame, first: int) -> DataFrame:
        """Nodes over each block: ``n`` nodes are on the level; ``top`` is the last level of this round."""
        arity, span, size = self.arity, self.span, self.size

        def build(table):
            import pyarrow as pa

            tree, at, n = table.column("tree")[0].as_py(), table.column("block")[0].as_py() * size, table.column("n")[0].as_py()
            height, out = min(span, _depth(n, arity)), []
            for up, nodes in enumerate(_levels(table.sort_by("pos").column("hash").to_pylist(), height, arity)):
                if up:
                    at, n = at // arity, -(-n // arity)
                    out += [(tree, first + up, at + i, n, h, up == height) for i, h in enumerate(nodes)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            columns = zip(*out) if out else [[]] * 6
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "level", "pos", "n", "hash", "top"])

        return self._blocks(base).groupBy("tree", "block").applyInArrow(build, "tree string, level int, pos long, n long, hash string, top boolean")

    def _over_blocks(self, rows: DataFrame, upper: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(rows, levels, paths, upper path)`` for the rows of each block, with the path of each row inside its block."""
        arity, span = self.arity, self.span

        def run(table, up):
            table = table.sort_by("pos")
            height = min(span, _depth(table.column("n")[0].as_py(), arity))
            levels = _levels(table.column("hash").to_pylist(), height, arity)
            path = [(p["left"], p["right"]) for p in up.column("path")[0].as_py()]
            return fn(table, levels, [_path(levels, i, arity) for i in range(len(levels[0]))], path)

        ups = upper.select("tree", "block", "path").toDF("up_tree", "up_block", "path")
        return self._blocks(rows).groupBy("tree", "block").cogroup(ups.groupBy("up_tree", "up_block")).applyInArrow(run, schema)

    def upper_paths(self, above: DataFrame) -> DataFrame:
        """``tree, block, path``: from the root of each block of leaves to the root of its tree, and on along ``above`` (``tree, path``).

        From the top down; a round has one row for each node, and the last one, for blocks of leaves, one for each ``ARITY ** SPAN`` leaves.
        """

        def paths(table, levels, own, path):
            import pyarrow as pa

            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            whole = [[{"left": a, "right": b} for a, b in p + path] for p in own]
            return pa.table([table.column("tree"), table.column("pos"), pa.array(whole, kind)], names=["tree", "block", "path"])

        upper = None
        for r in reversed(range(len(self.bases))):
            ends = self.bases[r].filter((F.col("n") <= self.size) & (F.col("pos") == 0)).select("tree", F.lit(0).cast("long").alias("block"))
            ends = ends.join(above, "tree")
            upper = ends if upper is None else ends.unionByName(upper)
            if r:
                upper = persist_table(self._over_blocks(self.bases[r], upper, paths, f"tree string, block long, path {_PATH}"), "paths")
        return upper

    def versions(self, rows: DataFrame, above: DataFrame, columns: list[str]) -> DataFrame:
        """For each leaf: ``columns``, ``root_of_tree, root, proof, copies``.

        ``rows`` are the leaves again, with ``changed``: the leaf of the version, null for none. ``copies`` are the ancestors the version
        has anew, lowest first and on to the end of ``above``; all other nodes are those of the tree. An unchanged leaf is folded
        too. ``proof`` is the hash of all siblings from the leaf up, left to right. A task copies the ancestors in its own block and goes on with
        the block's upper path, so the versions of all blocks meet in no common node.
        """
        arity = self.arity

        def fold(table, levels, own, path):
            from hashlib import sha256

            import pyarrow as pa

            depth = _depth(table.column("n")[0].as_py(), arity)
            line = [levels[-1][0], *_folded(levels[-1][0], path)]
            subroot, root = line[depth - (len(levels) - 1)], line[-1]
            tail = "".join(a + b for a, b in path)
            known = {levels[-1][0]: line[1:]}
            proofs, copies = [], []
            for leaf, changed, p in zip(levels[0], table.column("changed").to_pylist(), own):
                proofs.append(sha256(("".join(a + b for a, b in p) + tail).encode()).hexdigest())
                node = leaf if changed is None else changed
                inside = _folded(node, p)
                block = inside[-1] if inside else node
                copies.append(inside + (known[block] if block in known else _folded(block, path)))
            found = [pa.array([subroot] * len(proofs), pa.string()), pa.array([root] * len(proofs), pa.string()), pa.array(proofs, pa.string()), pa.array(copies, pa.list_(pa.string()))]
            return pa.table([*(table.column(c) for c in columns), *found], names=[*columns, "root_of_tree", "root", "proof", "copies"])

        kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
        return self._over_blocks(rows, self.upper_paths(above), fold, f"{kept}, root_of_tree string, root string, proof string, copies array<string>")


class Manifest:
    """The trees over a table: one for each value of ``key``, ordered by ``doc_id``, and the top tree over their roots.

    Null keys come first, others in the order of their UTF-8 bytes; of rows with the same id the smaller leaf comes first, and rows without
    id come before all. Every row is a leaf: repeated rows too, and rows with nothing but nulls. Columns beyond ``fields`` do not
    count. An empty table has no tree and no root. ``tampered`` tells for which rows ``changed_text`` takes the place of the text.
    """

    def __init__(self, docs: DataFrame, tampered: Column, changed_text: Column, key: str = "lang", doc_id: str = "doc_id", text: str = "text", fields: tuple = FIELDS):
        changed = F.when(tampered, digest(*(changed_text if f == text else F.col(f) for f in fields)))
        # Null is the empty text here, so that it sorts first and joins.
        tree = F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.lit(""))
        slim = docs.select(tree.alias("tree"), F.col(doc_id).cast("long").alias("doc_id"), digest(*(F.col(f) for f in fields)).alias("hash"), changed.alias("changed"))
        # One pass over the texts; sorting samples its input, which then are hashes only.
        self.leaves = ranked(persist_table(slim, "leaves"), ["doc_id", "hash", "changed"], "leaves-in-order")
        self.leaves = persist_table(self.leaves, "leaves-placed")
        self.tree = Tree(self.leaves)
        top = ranked(self.tree.roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("root").alias("hash")), ["own"], "subroots")
        self.tops = persist_table(top, "subroots-placed")
        self.top_tree = Tree(self.tops)

    def _top_paths(self) -> DataFrame:
        def paths(table, levels, own, path):
            import pyarrow as pa

            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            return pa.table([table.column("own"), pa.array([[{"left": a, "right": b} for a, b in p + path] for p in own], kind)], names=["tree", "path"])

        none = self.top_tree.roots.select("tree", F.array().cast(_PATH).alias("path"))
        return self.top_tree._over_blocks(self.tops, self.top_tree.upper_paths(none), paths, f"tree string, path {_PATH}")

    def audit(self) -> DataFrame:
        """``doc_id, tree, pos, leaf, changed, subroot, root, proof_sha256, copies, folded_root, verified`` for each row."""
        above = persist_table(self._top_paths(), "top-paths")
        found = self.tree.versions(self.leaves, above, ["doc_id", "tree", "pos", "hash", "changed"])
        folded = F.coalesce(F.try_element_at("copies", F.lit(-1)), "changed", "hash")
        return found.select(
            "doc_id", "tree", "pos", F.col("hash").alias("leaf"), "changed", F.col("root_of_tree").alias("subroot"), "root",
            F.col("proof").alias("proof_sha256"), "copies", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
        )


def version_nodes(audited: DataFrame) -> DataFrame:
    """The persistent versions as a table: ``tree, pos`` name the changed leaf, ``level`` and ``hash`` the copied ancestor."""
    return audited.filter(F.col("changed").isNotNull()).select("tree", "pos", F.posexplode("copies").alias("below", "hash")).select("tree", "pos", (F.col("below") + 1).alias("level"), "hash")


def manifest_rows(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its leaf, roots and proof; rows whose id's CRC-32 three divides have their text in lower case.

    An id that is missing is never tampered with, and a missing text stays missing.
    """
    doc_id = F.col("doc_id").cast("long").cast("string")
    tampered = F.crc32(doc_id.cast("binary")) % 3 == 0
    audited = Manifest(docs, tampered, lower_ascii(F.col("text"))).audit()
    return audited.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
