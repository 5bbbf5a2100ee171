"""Manifests beside plain Python."""

import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash string, pos int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def tampered(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0


def brute(rows):
    trees = {}
    for row in rows:
        own = leaf(row, row[4])
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, own, leaf(row, row[4].translate(LOWER)) if tampered(row) and row[4] is not None else own, row[0]))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in order}
    top, out = levels([built[k][-1][0] for k in order]), []
    for place, k in enumerate(order):
        for i, (_, _, own, node, doc) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            proof = ""
            for tree, at in ((built[k], i), (top, place)):
                for nodes in tree[:-1]:
                    first = at - at % 8
                    left, right = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])
                    proof, node, at = proof + left + right, h(left + node + right), at // 8
            out.append((-1 if doc is None else doc, own, built[k][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", 1) for r in rows], SCHEMA)


def found(spark, rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in merkle.manifest_rows(frame(spark, rows)).collect())


def some(n, langs):
    return [(i * 7, f"s{i % 4}", langs[i % len(langs)], i, f"Tide {i} Über") for i in range(n)]


ODD = [(None, None, None, None, None), (None, "a", "en", 1, "X"), (3, "a", "en", 1, None), (3, "a", "en", 1, None), (5, None, "", 0, ""), (6, "é", "ünd", 2, "Long " * 5000), (6, "é", "ünd", 2, "ABC")]


@pytest.mark.parametrize("span", [1, 2, 4])
def test_rows(spark, monkeypatch, span):
    monkeypatch.setattr(merkle.Tree.__init__, "__defaults__", (8, span))
    rows = some(150, ["en", "en", "de", None, "en"]) + ODD
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_sizes_of_one_tree(spark, monkeypatch, n):
    monkeypatch.setattr(merkle.Tree.__init__, "__defaults__", (8, 1))
    rows = some(n, ["en"])
    assert found(spark, rows) == brute(rows)


def test_many_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle.Tree.__init__, "__defaults__", (8, 1))
    rows = some(80, [f"l{i}" for i in range(70)])
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_versions_share_untouched_nodes(spark, monkeypatch):
    """A version's copies over the manifest's nodes are the tree that the changed table would have."""
    monkeypatch.setattr(merkle.Tree.__init__, "__defaults__", (8, 1))
    rows = some(100, ["en"])
    changed = F.col("doc_id").isin(0, 350, 693)
    made = merkle.Manifest(frame(spark, rows), changed, F.lit("other"))
    base = {(r["level"], r["pos"]): r["hash"] for r in made.tree.nodes.collect()}
    copies = {}
    for r in merkle.version_nodes(made.audit()).collect():
        copies.setdefault(r["pos"], {})[r["level"]] = r["hash"]
    assert sorted(copies) == [0, 50, 99]
    for pos, own in copies.items():
        whole = levels([leaf(r, "other" if i == pos else r[4]) for i, r in enumerate(rows)])
        want = {(level, i): node for level, nodes in enumerate(whole) if level for i, node in enumerate(nodes)}
        version = base | {(level, pos // 8**level): node for level, node in own.items() if level < len(whole)}
        assert version == want
        assert sum(base[k] != v for k, v in version.items()) == len(whole) - 1
