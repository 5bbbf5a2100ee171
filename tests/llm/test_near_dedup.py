"""Near-duplicates beside all pairs."""

import random
import re

import numpy as np
import pytest

from tracelake.llm import near_dedup
from tracelake.llm.shingles import Shingler

SCHEMA = "doc_id long, text string, rep string, component string, kept int, _gone int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, threshold):
    sets, up = [shingles(t, size) for _, t in rows], {}
    for i, _ in rows:
        up[i] = i

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            if x is None or y is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1, i is None or find(i) == i) for (i, _), s in zip(rows, sets))


def check(spark, rows, size=3, threshold=85):
    got = near_dedup.near_duplicates(frame(spark, rows), size, threshold).collect()
    null = lambda v: -1 if v is None else v
    assert sorted((null(r["doc_id"]), r["n_shingles"], null(r["component_id"]), r["kept"]) for r in got) == brute(rows, size, threshold)


def family(rng, n, first, length=120, rates=(0.0, 0.01, 0.02, 0.04, 0.08)):
    base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    return [(first + i, " ".join(f"e{rng.randrange(10**9)}" if rng.random() < rates[i % len(rates)] else w for w in base)) for i in range(n)]


def test_families_of_edited_copies(spark):
    rng = random.Random(5)
    rows = family(rng, 60, 0) + family(rng, 25, 1000, 60) + [(2000 + i, f"alone {rng.random()} " * 5) for i in range(40)]
    check(spark, rows)
    check(spark, rows, 5, 80)


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup.dealt, "__defaults__", ("rep", 7))
    check(spark, family(random.Random(6), 80, 0))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two\n"), (8, "a b c"), (8, "x y z"), (9, "A B C"), (10, "x y z"), (None, "a b c"), (11, "a b c d"), (11, "a b c d")]
    check(spark, rows)
    check(spark, [(1, "word " * 200_000 + "end"), (2, "word " * 150_000 + "end")])
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).collect() == []
    docs = frame(spark, rows)
    out = near_dedup.keep_one(docs, 3, 85)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 6, 8, 8, 11, 11]


def test_shingles_do_not_depend_on_cuts(monkeypatch):
    from tracelake.llm import shingles as module

    texts = ["One two  three four", "x" * 500 + " y z w", None, "a", " ".join(str(i) for i in range(500))]
    whole = Shingler(3).sets(texts)
    monkeypatch.setattr(module, "PIECE", 64)
    for a, b in zip(whole, Shingler(3).sets(texts)):
        assert a.tolist() == b.tolist()
    assert [len(s) for s in whole] == [len(shingles(t, 3)) for t in texts]


def test_bounds_keep_what_is_similar():
    """The chance that a pair at the threshold is ever pruned stays small."""
    rng = np.random.default_rng(1)
    bounds = near_dedup.least_matches(0.85, 144)
    agree = rng.random((20_000, 144)) < 0.85 + 0.15 / 256
    lost = np.zeros(len(agree), dtype=bool)
    for t, least in bounds:
        lost |= agree[:, :t].sum(axis=1) < least
    assert lost.mean() < 0.002
    far = rng.random((2000, 144)) < 0.5
    assert all(far[:, :t].sum(axis=1).mean() < least for t, least in bounds[2:])


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.85, 0.9])
def test_pairs_at_the_threshold_are_lost_with_the_stated_chance(threshold):
    """Bands and all batches together, beside the exact distribution of matches."""
    from math import comb

    rows, bands, bounds = near_dedup.layout(threshold)
    assert bounds[-1][0] == rows * bands <= 150
    agree, alive, before = threshold + (1 - threshold) / 256, {0: 1.0}, 0
    for t, least in bounds:
        step, after = t - before, {}
        for m, chance in alive.items():
            for k in range(step + 1):
                if m + k >= least:
                    after[m + k] = after.get(m + k, 0.0) + chance * comb(step, k) * agree**k * (1 - agree) ** (step - k)
        alive, before = after, t
    assert (1 - threshold**rows) ** bands + 1 - sum(alive.values()) <= 1.0001e-4
