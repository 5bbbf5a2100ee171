"""Links between blocks of one large group."""

import random
import uuid

import numpy as np
import pytest

from tracelake.llm import near_dedup


def test_links_of_a_group_of_copies_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup.dealt, "__defaults__", ("rep", 7))
    rows = spark.range(140).selectExpr("id AS rep", "0L AS component", "140L AS n")

    def meet(table):
        ids = np.array(table.column("rep"), dtype=np.int64)
        side, label = (np.array(table.column(c)) for c in ("side", "label"))
        signatures = np.ones((len(ids), 4), dtype=np.uint8)
        return near_dedup._meet(table, ids, signatures, side, label, [(4, 4)])

    links = near_dedup.linked(rows, ["component"], rows.select("n").distinct(), meet, "test")
    found = [tuple(r) for r in links.collect()]
    # A spanning forest of each of 20 blocks and one link for two of them; whole forests of all pairs of blocks were 2,540.
    assert len(found) <= 140 + 190
    groups = near_dedup.Groups(140)
    for a, b in found:
        groups.join(a, b)
    assert {groups.find(i) for i in range(140)} == {0}


def plain(tmp_path):
    """Links rows whose signatures (their id by 4) agree; notes how many rows each block or pair of blocks has read."""

    def meet(table):
        ids = np.array(table.column("rep"), dtype=np.int64)
        side, label = (np.array(table.column(c)) for c in ("side", "label"))
        (tmp_path / f"{uuid.uuid4().hex}").write_text(str(len(ids)))
        signatures = np.repeat((ids % 4).astype(np.uint8)[:, None], 4, axis=1)
        return near_dedup._meet(table, ids, signatures, side, label, [(4, 4)])

    return meet


@pytest.mark.parametrize("few", [0, 1])
def test_rows_that_meet_grow_with_a_group_that_hangs_together(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(near_dedup.dealt, "__defaults__", ("rep", 7))
    read = []
    for n in (140, 280):
        # Alike but for a few rows, which find each other in any block.
        rows = spark.range(n).selectExpr(f"id * 4 + if(id < {3 * few}, 1, 0) AS rep", "0L AS component", f"{n}L AS n")
        more = spark.range(4, n).selectExpr("id * 4 AS a", "(id - 1) * 4 AS b")
        (tmp_path / str(n)).mkdir()
        links = near_dedup.linked(rows, ["component"], rows.select("n").distinct(), plain(tmp_path / str(n)), "test", more)
        groups = near_dedup.Groups(4 * n)
        for a, b in [tuple(r) for r in links.collect()]:
            assert a % 4 == b % 4
            groups.join(a, b)
        assert len({groups.find(r["rep"]) for r in rows.select("rep").collect()}) == 1 + few
        read.append(sum(int(f.read_text()) for f in (tmp_path / str(n)).iterdir()))
    # Each row once by itself and once for each block of the few; all pairs of blocks were 2,800 and 11,200 rows.
    assert read[0] <= (1 + 2 * few) * 160 and read[1] <= 2.2 * read[0]


def test_large_and_small_components_of_a_group_meet(spark, monkeypatch, tmp_path):
    """Three kinds are partly linked before; the fourth only block by block."""
    monkeypatch.setattr(near_dedup.dealt, "__defaults__", ("rep", 7))
    rows = spark.range(160).selectExpr("id AS rep", "0L AS component", "160L AS n")
    more = spark.range(4, 160).filter("(id % 4 < 2 AND id <> 80 AND id <> 81) OR (id % 4 = 2 AND id > 140)").selectExpr("id AS a", "id - 4 AS b")
    links = near_dedup.linked(rows, ["component"], rows.select("n").distinct(), plain(tmp_path), "test", more)
    found = {r["node"]: r["component"] for r in near_dedup.components(links, "test").collect()}
    assert found == {i: i % 4 for i in range(160)}


def test_components_read_a_link_once(spark, monkeypatch):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(1000, 1300)]  # names run along the chain
    links += [(5000, i) for i in range(3000, 3300)] + [(i, i) for i in (1, 1010)]  # the centre comes last
    links += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(3000)]
    links += [(7000 + a, 7000 + b) for a, b in zip(rng.sample(range(300), 300), rng.sample(range(300), 300))]
    groups = near_dedup.Groups(8000)
    for a, b in links:
        groups.join(a, b)
    written = []
    persist = near_dedup.persist_table

    def noted(df, label):
        out = persist(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "persist_table", noted)
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"), "test")
    assert {r["node"]: r["component"] for r in got.collect()} == {x: groups.find(x) for link in links for x in link}
    # Every link in either direction was read by each round: 7,000 rows and more.
    assert sum(n for label, n in written if label.endswith("-links")) <= 1.2 * len(links)


def test_pairs_of_blocks_link_names():
    """What hangs together already is linked by its name, whichever of its rows meet."""
    import pyarrow as pa

    table = pa.table({"i": [0] * 4, "j": [1] * 4})
    signatures = np.ones((4, 4), dtype=np.uint8)
    links = near_dedup._meet(table, np.array([15, 16, 25, 26]), signatures, np.array([0, 0, 1, 1]), np.array([1, 1, 2, 2]), [(4, 4)])
    assert links == [(2, 1)]


@pytest.mark.parametrize("n", [40, 80])
def test_tables_written_for_a_family_of_many_blocks(spark, monkeypatch, n):
    """Small steps cost what their tasks cost, however few rows they have: what is found already is not searched for again."""
    monkeypatch.setattr(near_dedup.dealt, "__defaults__", ("rep", 7))
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"e{i}"])) for i in range(n)], "doc_id long, text string")
    written, persist = [], near_dedup.persist_table
    monkeypatch.setattr(near_dedup, "persist_table", lambda df, label: written.append(label) or persist(df, label))
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(i, 0, i == 0) for i in range(n)]
    # No second search for components where blocks have found all; a family's blocks overlap, so that they are linked before pairs of them meet.
    assert not [label for label in written if label.endswith(("met", "met-links"))]
    assert len(written) <= 24
