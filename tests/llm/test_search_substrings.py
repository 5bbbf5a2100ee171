"""Exact search and repeated substrings beside plain Python."""

import hashlib
import math
import random
from collections import Counter

import pytest

from tracelake.llm import nearest, substrings


def brute(rows, k, every):
    table = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in table.items():
        if q % every == 0:
            score = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in table.items() if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score[:k])]
    return sorted(out)


@pytest.mark.parametrize("bits", [2, 6, 8])
def test_top_neighbours(spark, bits, monkeypatch):
    monkeypatch.setattr(nearest, "SMALL_BLOCK", 40)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 5)
    rng = random.Random(bits)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(200)]
    rows += [(i, [0.25] * 8) for i in range(200, 260)]  # ties
    rows += [(300, None), (310, [None] * 8), (320, [float("nan")] * 8), (330, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (340, [1.0, 2.0]), (341, [1.0, 1.0]), (350, []), (7, rows[7][1]), (400, [1e6] * 8)]
    docs = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted(tuple(r) for r in nearest.top_neighbours(docs, 5, 10, bits=bits).collect())
    assert got == brute(rows, 5, 10)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.top_neighbours(none).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert nearest.top_neighbours(one).collect() == []


def without(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        runs = []
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        edges = [0, *[x for p in runs for x in p], len(r)]
        left = b"".join(r[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append((-1 if doc is None else doc, len(r), len(r) - len(left), [tuple(p) for p in runs], hashlib.sha256(left).hexdigest(), left))
    return sorted(out)


def check(spark, rows, length, gram, widths):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, first string, span int")
    for texts in (True, False):
        got = substrings.without_repeats(docs, length, gram, widths, texts=texts).collect()
        mine = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"], *([bytes(r["kept"])] if texts else [])) for r in got)
        assert mine == [w if texts else w[:5] for w in without(rows, length)]


@pytest.mark.parametrize("seed", range(4))
def test_passages(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(rng.randrange(30, 120)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a:], text(rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, None), (102, ""), (None, passages[0]), (103, "z" * 400), (104, "ab" * 300)]
    check(spark, rows, 40, 10, (8, 1))


def test_production_length_and_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(399), text(400), text(401), text(900)]
    rows = [(i, text(300) + s + text(300)) for i, s in enumerate(shared + shared)]
    rows += [(20, text(3000) + shared[3][:650] + text(100)), (21, shared[3][200:] + text(20)), (22, "-" * 1200)]
    check(spark, rows, 400, 100, (20, 1))


def test_pieces_of_a_long_text(monkeypatch):
    """Anchors of a text cut into pieces stand for the same strings."""
    rng = random.Random(2)
    raw = bytes(rng.randrange(97, 101) for _ in range(3000))
    whole = substrings.anchors_of([raw], 40, 10)
    monkeypatch.setattr(substrings, "PIECE", 256)
    cut = substrings.anchors_of([raw], 40, 10)
    strings = lambda found: sorted((f + i, f + b) for f, b, s in zip(*(c.tolist() for c in found[1:4])) for i in range(s + 1))
    assert strings(whole) == strings(cut)
    assert [s for s, _ in strings(whole)] == list(range(3000 - 39))


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_repeats(none).collect() == []
