"""Token counts, packing and token files beside the library itself."""

from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import packing, token_counts, token_file
from tracelake.llm.encoding import WordEncoder
from tracelake.llm.queries import tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path())
ENCODER = WordEncoder(tokenizer_path())
TEXTS = [None, "", " ", "a", "One  two\n\nthree.", "it's \"quoted\", isn't it?\n- yes\t\tno ", "naïve café 123 ∆ 漢字 🙂", "<|endoftext|> in a text<|endoftext|>", "x" * 5000, "word " * 3000, "same same", "same same"]


def plain(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def frame(spark, texts):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé.,$ \n\t  1漢<|endoftext|>"), max_size=40), max_size=5))
def test_words_give_the_librarys_ids(texts):
    assert [b for b in ENCODER.encode(texts)] == [plain(t).tobytes() for t in texts]


SPACES = ["  ", "\n", "\n\n    ", "\t", "\r\n", "\x0b", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", " "]
UNITS = ["a", "b's", "'ll", "x1", "...", "end.", "é", "漢", "🙂", "<|endoftext|>", "w" * 201, " " * 300, "\n" * 250]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SPACES + UNITS), max_size=14).map("".join), max_size=4))
def test_white_space_is_a_unit(texts):
    assert ENCODER.encode(texts) == [plain(t).tobytes() for t in texts]


def test_texts_with_paragraphs_are_put_together_from_units(monkeypatch):
    """Only the special token's string and the marks need the library for a whole text."""
    enc, whole = WordEncoder(tokenizer_path()), []
    inner = WordEncoder.whole
    monkeypatch.setattr(WordEncoder, "whole", lambda self, t: whole.append(t) or inner(self, t))
    text = "  First line.\n\n    Indented, twice  spaced\tand tabbed\r\nlines. \n" * 3
    assert enc.encode([text, "a<|endoftext|>b"]) == [plain(text).tobytes(), plain("a<|endoftext|>b").tobytes()]
    assert max(len(t) for t in whole if t != "a<|endoftext|>b") < 10


def test_special_token_is_kept():
    assert ENCODER.encode(["a <|endoftext|> b"])[0] == plain("a <|endoftext|> b").tobytes()


def test_length_histogram(spark):
    lengths = [len(plain(t)) for t in TEXTS]
    hist = token_counts.length_histogram(token_counts.token_lengths(frame(spark, TEXTS), tokenizer_path()), block=7)
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["tokens_total"] == sum(lengths) and r["docs_total"] == len(lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    assert {r[0]: r[1] for r in token_counts.truncated_totals(hist, [1, 100]).collect()} == {n: sum(min(x, n) for x in lengths) for n in (1, 100)}
    assert {r[0]: r[1] for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[len(lengths) // 2 - 1], 1.0: max(lengths)}


def test_no_documents(spark):
    none = frame(spark, []).limit(0)
    assert token_counts.length_histogram(token_counts.token_lengths(none, tokenizer_path())).collect() == []
    assert packing.pack(none, tokenizer_path()).collect() == []
    assert token_file.round_trip(none, tokenizer_path()).collect() == []


def check_packing(rows, docs, size):
    ids = {i: np.append(plain(t), [1]).astype("<u4") for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            assert crc32(ids[doc][at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[doc])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing(spark):
    docs = list(enumerate(TEXTS))
    rows = packing.pack(frame(spark, TEXTS).repartition(2), tokenizer_path()).collect()
    assert check_packing(rows, docs, 2048) == 0
    rows = packing.pack(frame(spark, TEXTS).coalesce(1), tokenizer_path(), size=16).collect()
    assert check_packing(rows, docs, 16) == 0


def test_packing_rounds(spark, monkeypatch):
    """Leftovers of many splits are placed by the rule again; groups and poured groups of any size lose nothing."""
    rng = np.random.default_rng(5)
    texts = ["same words here", *TEXTS, *(" ".join(["ab", "cd ef", "x"][k % 3] for k in range(n)) for n in rng.integers(0, 60, 500).tolist())]
    docs = list(enumerate(texts))
    for group, pour in ((200_000, 20_000), (100, 7)):
        monkeypatch.setattr(packing, "GROUP", group)
        monkeypatch.setattr(packing, "POUR", pour)
        rows = packing.pack(frame(spark, texts).repartition(6), tokenizer_path(), size=64).collect()
        assert check_packing([r for r in rows], docs, 64) == 0
        sums = {}
        for r in rows:
            sums.setdefault((r["sequence_id"], r["by_rule"]), []).append(r["length"])
        assert len({s for s, _ in sums}) == len(sums)
        assert all(sum(n) == 64 for (_, ruled), n in sums.items() if ruled)
        assert any(r["by_rule"] and r["sequence_id"] >= 1 << 55 for r in rows)  # windows that a later round has filled


def test_packing_without_ids_and_with_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "c"), (5, "c"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, tokenizer_path()).collect()
    total = 2 * (len(plain("a b")) + 1) + 2 * (len(plain("c")) + 1) + 1
    assert sum(r["length"] for r in rows) == total
    places = sorted((r["sequence_id"], r["offset"] + k) for r in rows for k in range(r["length"]))
    assert len(set(places)) == total


def test_sum_of_squares_rule():
    """Each placement makes the sum of squared counts as small as any other would."""
    rng = np.random.default_rng(3)
    packer, levels = packing.Packer(32, 0), [0] * 33
    for s in rng.integers(1, 32, 400).tolist():
        cost = {}
        for h in range(0, 33 - s):
            if h == 0 or levels[h]:
                after = levels[:]
                if h:
                    after[h] -= 1
                if h + s < 32:
                    after[h + s] += 1
                cost[h] = sum(n * n for n in after[1:32])
        before = packer.levels.copy()
        packer.add(("d", 0, b"", 0, 0), s)
        gone = [h for h in range(1, 32) if packer.levels[h] < before[h]]
        # A window that moves from h to h + s may also show as no change at all when s levels are the same count.
        h = gone[0] if gone else 0
        assert cost[h] == min(cost.values())
        levels = packer.levels.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_come_back(ids, percentile):
    raw = token_file.write_segment([1, None], [len(ids), 0], np.array(ids, dtype="<u4"), percentile)
    seg = token_file.Segment(raw)
    assert seg.ids().tolist() == ids
    assert seg.lengths.tolist() == [len(ids), 0] and seg.missing.tolist() == [0, 1]
    if len(ids) > token_file.BLOCK:
        assert seg.ids(1, 2).tolist() == ids[token_file.BLOCK : 2 * token_file.BLOCK]


def test_token_file(spark, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT_IDS", 1000)
    rows = token_file.round_trip(frame(spark, TEXTS).repartition(3), tokenizer_path()).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.append(plain(TEXTS[r["doc_id"]]), [2]).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(TEXTS)


def test_token_file_without_ids_and_with_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c"), (5, "d")], "doc_id long, text string")
    rows = sorted(token_file.round_trip(docs, tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 5, 5, 5]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows][:-1]]).tolist()
