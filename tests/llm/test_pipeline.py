"""The stages one after the other, each beside plain Python on its own input."""

import re
from collections import Counter

import corpus_pipeline
from tracelake.llm.common import table
from tracelake.session import persist_table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_stages(spark):
    rows = table(spark, SF, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in rows.collect()}
        n_before = rows.count()
        rows = persist_table(stage(spark, rows, SF), "test-stage")
        got = rows.collect()
        if name != "packing":
            assert rows.columns == COLUMNS
            assert all(r == before[r["doc_id"]] for r in got)
        ids = [r["doc_id"] for r in got]
        if name == "toxicity":
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in set(ids) for i in clean) >= 0.97 * len(clean)
        if name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]["text"] or ""), i)
            assert sorted(ids) == sorted(first.values())
        if name == "near dedup":
            sets = {i: shingles(r["text"]) for i, r in before.items()}
            up = {i: i for i in before}

            def find(i):
                while up[i] != i:
                    i = up[i]
                return i

            order = sorted(before)
            for x in order:
                for y in order:
                    if y < x and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                        a, b = find(x), find(y)
                        up[max(a, b)] = min(a, b)
            assert sorted(ids) == [i for i in order if find(i) == i]
        if name == "mixing":
            assert max(Counter(ids).values()) <= 3
        if name == "packing":
            assert set(ids) == set(before)
            whole = Counter(r["doc_id"] for r in got if r["start"] == 0)
            assert sum(whole.values()) == n_before


def test_empty_and_odd_rows(spark):
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "no id", "en", "s", 5), (2, "", "en", "s", 0), (3, "word " * 100_000, "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (5, "a b  c d e f", "en", "s", 1)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, place string, score string, size string, row string, _here int"
    for rows, left in ((odd, 4), ([], 0)):
        docs = persist_table(spark.createDataFrame([(*r, "p", "q", "r", "s", 1) for r in rows], extra), "test-odd")
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = persist_table(stage(spark, docs, SF), "test-odd")
            assert name == "packing" or docs.columns == columns
            if name == "exact dedup":
                assert docs.count() == left


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[0] == "doc_id" and got.count() > 0
