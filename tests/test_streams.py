"""Streams over tables of several part files."""

import shutil

import pytest

import tracelake.catalog.streams as streams
from tracelake.registry import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [n for n in QUERIES if n[:3] in ("t1_", "t2_", "t3_", "t6_", "t7_", "t8_")]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in ("events", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stream_reads_file_and_folder(spark, parts, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    for folder in (parts, str(tmp_path)):
        rows = streams.jobs.stream_to_files(streams.stream_of(spark, folder, "events"), str(tmp_path / f"out-{folder == parts}"))
        assert rows.count() == spark.read.parquet(f"{SF}/events.parquet").count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_part_files_give_the_same_table(spark, parts, name):
    want = QUERIES[name](spark, SF)
    got = QUERIES[name](spark, parts).select(*want.columns).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, want.collect()))
