"""Tables of the newest updates: merged now and then, the same after any restart, complete over unsorted files."""

import os
import random

from pyspark.sql import functions as F

from helpers import at, dicts
from tracelake.operators.analytics import increase_alert, increase_of
from tracelake.streaming import jobs
from tracelake.streaming.jobs import UpdateTable

SCHEMA = "k string, v int"


def table(spark, folder, every=3):
    return UpdateTable(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, ["k"], every)


def put(spark, t, epoch, **rows):
    t.write(spark.createDataFrame(list(rows.items()), SCHEMA), epoch)


def state(t):
    return {r["k"]: r["v"] for r in t.read().collect()}


def test_reads_stay_short_and_epochs_go(spark, tmp_path):
    t, want = table(spark, tmp_path / "t"), {}
    assert state(t) == {}
    for epoch in range(11):
        rows = {f"k{epoch % 4}": epoch, "all": -epoch}
        put(spark, t, epoch, **rows)
        want.update(rows)
        assert state(t) == want and len(t.folders()) <= 3
    assert len([n for n in os.listdir(tmp_path / "t") if n[0] in "em"]) <= 8


def test_batches_that_run_again(spark, tmp_path):
    t = table(spark, tmp_path / "t", 2)
    put(spark, t, 0, a=1)
    put(spark, t, 0, a=2, b=1)
    assert state(t) == {"a": 2, "b": 1}
    put(spark, t, 1, a=3)
    assert t._numbers("merged") == [1]
    put(spark, t, 1, a=9)  # merged already
    assert state(t) == {"a": 3, "b": 1}


def test_half_written_merge_is_not_read(spark, tmp_path):
    t = table(spark, tmp_path / "t", 2)
    put(spark, t, 0, a=1)
    put(spark, t, 1, a=2)
    (tmp_path / "t" / "merged=1" / "_SUCCESS").unlink()
    assert state(t) == {"a": 2} and t._numbers("merged") == []
    put(spark, t, 1, a=2)
    assert t._numbers("merged") == [1] and state(t) == {"a": 2}


def test_null_keys(spark, tmp_path):
    t = table(spark, tmp_path / "t", 2)
    for epoch in range(3):
        t.write(spark.createDataFrame([(None, epoch)], SCHEMA), epoch)
    assert state(t) == {None: 2}


def test_increase_over_unsorted_files_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(at(rng.random() * 9 * 86_400), rng.choice(["x", "y", None])) for _ in range(200)]
    schema = "ts timestamp, c string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = increase_of(jobs.failures_stream(stream, "ts", ["c"], folder, lateness=jobs.NEVER_LATE), ["c"])
    want = increase_alert(spark.createDataFrame(rows, schema), "ts", ["c"])
    assert sorted(map(str, dicts(got))) == sorted(map(str, dicts(want.select(*got.columns))))
    assert got.agg(F.sum("increase")).first()[0] == 1000


def test_quota_over_unsorted_files(spark, tmp_path):
    rows = [(f"o{i % 2}", at(((i * 7) % 10) * 86_400), i, float(i)) for i in range(40)]
    schema = "org_id string, timestamp timestamp, total_tokens int, estimated_cost_usd double"
    source = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = jobs.quota_stream(stream, ["org_id"], str(tmp_path / "out"), jobs.NEVER_LATE)
    want = spark.createDataFrame(rows, schema).groupBy(F.to_date("timestamp").alias("day"), "org_id").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("estimated_cost_usd").alias("total_cost_usd"))
    assert dicts(got, "day", "org_id") == dicts(want, "day", "org_id")
