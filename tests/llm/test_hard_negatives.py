"""Hard negatives beside plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, want string, low int, block int"


def brute(rows, every, low=80, high=100, k=5, m=5):
    """Each id once: of different rows the one with the largest label, then vector."""
    table = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        table[i] = max(table.get(i, row), row)
    out = []
    for a, (label, v) in table.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in table.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2]][:k]:
            good = [(s, i) for s, i, same in scored if not same and low * -ps <= 100 * -s <= high * -ps]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i) in enumerate(good[:m])]
    return sorted(out)


def rows_of(rng, n, dims=6, spread=1.0):
    heads = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        head, scale = rng.choice(heads), rng.choice([0.01, 0.3, 1.0, 5.0])
        out.append((i, [scale * (h + rng.gauss(0, spread)) for h in head], rng.randrange(3)))
    return out


@pytest.mark.parametrize("spread,bucket", [(1.0, 2048), (0.2, 16), (0.05, 7)])
def test_mine(spark, monkeypatch, spread, bucket):
    monkeypatch.setattr(hard_negatives, "SMALL_BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "ASKED", 7)
    rng = random.Random(bucket)
    rows = rows_of(rng, 300, spread=spread)
    rows += [(i, [0.25] * 6, i % 2) for i in range(300, 340)]  # ties
    rows += [(350, None, 1), (360, [None] * 6, 1), (370, [float("nan")] * 6, 1), (380, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (390, [1.0] * 6, None)]
    rows += [(400, [1.0, 2.0], 0), (401, [1.0, 2.0], 0), (402, [1.0, 1.5], 1), (410, [], 0), (411, [], 1), (420, [0.0] * 6, 1), (430, [-1.0] * 6, 2), (440, [1e7] * 6, 2)]
    rows += [rows[10], (20, [9.0] * 6, 2)]
    docs = spark.createDataFrame([(i, v, label, "r", "w", 1, 2) for i, v, label in rows], SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives.mine(docs, every=10).collect())
    assert got == brute(rows, 10)
    assert got


def test_other_ranges_and_labels(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 120)
    docs = spark.createDataFrame([(i, v, label, "r", "w", 1, 2) for i, v, label in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    moved = [(i, v, (label + 1) % 3 if i % 7 == 0 else label) for i, v, label in rows]
    got = sorted(tuple(r) for r in hard_negatives.mine(docs, every=4, label=label, positives=3, negatives=2, low=-50, high=133).collect())
    assert got == brute(moved, 4, -50, 133, 3, 2)


def test_lists_prune(spark):
    """Rows at a right angle to the anchor are cut off by the lists, not by their scores."""
    import numpy as np

    rng = np.random.default_rng(1)
    exact = np.concatenate([rng.integers(-3, 4, (500, 8)) + np.array([100] + [0] * 7), rng.integers(-3, 4, (500, 8)) + np.array([0, 100] + [0] * 6)])
    block = hard_negatives.Block(np.arange(1000), np.zeros(1000, dtype=np.int64), exact)
    anchor = np.array([100.0] + [0.0] * 7)
    kept = sum(len(b.feasible(anchor, 100.0, 5000.0)) for b in block.buckets)
    assert 500 <= kept < 520


def test_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "r", "w", 1, 2), (1, [1.0], 2, "r", "w", 1, 2)], SCHEMA)
    assert hard_negatives.mine(one).collect() == []
