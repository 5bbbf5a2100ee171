"""Packing over residual gaps beside plain Python."""

import random
import struct
import zlib
from collections import defaultdict

import pytest

from tracelake.llm import gap_packing
from tracelake.llm.queries import tokenizer_path
from tracelake.llm.word_units import UnitEncoder

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece int, sequence_id string"


def pieces_of(library, rows, size, end=0):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        for i in range(0, len(ids), size):
            part = ids[i : i + size]
            out.append((doc if doc is not None else -1, i // size, i, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out)


def check(got, rows, size):
    """Every piece is there once, and sequences are filled without gaps up to ``size``."""
    from tokenizers import Tokenizer

    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert found == pieces_of(Tokenizer.from_file(PATH), rows, size)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def texts(rng, n):
    words = ["sea", "Tide,", "harbour", "it's", "'stop", "ÉCOLE", "x<|endoftext|>y", "1234", "...", "Σας", "boat.", "|", "a|b"]
    gaps = [" ", "\n\n", "\t", "  ", " \x0b", "　", "\x1c"]
    out = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 90)))) for i in range(n)]
    return out + [(3, out[3][1]), (None, "no id"), (None, None), (n, None), (n + 1, ""), (n + 2, "sea " * 400), (n + 3, "w" * 5000), (n + 4, "\n \t")]


def test_few_sequences(spark):
    rows = texts(random.Random(1), 300)
    docs = spark.createDataFrame([(d, t, 7, "z") for d, t in rows], SCHEMA)
    got = gap_packing.pack_gaps(docs, PATH, size=128).collect()
    n = check(got, rows, 128)
    tokens = sum(r["length"] for r in got)
    assert n <= 1.01 * tokens / 128 + 1
    assert set(map(tuple, got)) == set(map(tuple, gap_packing.pack_gaps(docs, PATH, size=128).collect()))


@pytest.mark.parametrize("shrinks", [0.5, 0.0])
def test_rounds_of_groups(spark, monkeypatch, shrinks):
    monkeypatch.setattr(gap_packing, "GROUP", 150)
    monkeypatch.setattr(gap_packing, "SHRINKS", shrinks)
    rows = texts(random.Random(2), 900)
    docs = spark.createDataFrame([(d, t, 7, "z") for d, t in rows], SCHEMA).repartition(3)
    got = gap_packing.pack_gaps(docs, PATH, size=64).collect()
    n = check(got, rows, 64)
    assert n <= 1.1 * sum(r["length"] for r in got) / 64 + 1


def test_lengths_that_never_fill(spark, monkeypatch):
    """All pieces longer than half a sequence: each stands alone, and no group takes them all."""
    monkeypatch.setattr(gap_packing, "GROUP", 50)
    rows = [(i, "sea " * 40) for i in range(300)]
    docs = spark.createDataFrame([(d, t, 7, "z") for d, t in rows], SCHEMA)
    assert check(gap_packing.pack_gaps(docs, PATH, size=64).collect(), rows, 64) == 300


def test_empty(spark):
    assert gap_packing.pack_gaps(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_rule():
    """Each piece goes where the sum of the squared counts of open gaps becomes smallest, on a tie to the smallest gap."""
    rng, size = random.Random(5), 24
    packer, counts = gap_packing.GapPacker(size), [0] * (size + 1)
    for item in range(2000):
        s = rng.randrange(1, size)
        options = []
        for gap in [g for g in range(s, size) if counts[g]] + [size]:
            after = counts.copy()
            if gap < size:
                after[gap] -= 1
            after[gap - s] += 1
            options.append((sum(c * c for c in after[1:size]), gap, after))
        counts = min(options)[2]
        packer.add(item, s)
        counts[0] = 0
        assert packer.count[1:size] == counts[1:size]
    assert all(len(members) for members in packer.full + packer.still_open())


def test_units_have_the_library_s_ids():
    encoder = UnitEncoder(PATH)
    odd = ["a%sb, c." % chr(c) for c in [*range(0, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    odd += ["it's 'stop Don'T <|endoftext|> <|EndOfText|> x<|startoftext|>, A.. b'' c'd, İx ﬁ é. é. ́x  \n\n\tq", "", None, "x" * 1000 + " y", "a̸= ≠", "ΣΑΣ ΟΔΥΣΣΕΥΣ. ς'", "'s' s's. CAN'T!", "a | b |c| |"]
    for _ in range(2):  # known words the second time
        for text, got in zip(odd, encoder.encode(odd)):
            ids = encoder.library.encode(text or "", add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(ids)}I", *ids), text
