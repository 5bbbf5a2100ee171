"""The versioned store: changes are whole or not there, touch only their partitions and may be repeated."""

import pytest
from helpers import at, dicts, trace, traces

from tracelake.schema import TRACE_SCHEMA
from tracelake.session import new_folder
from tracelake.sources.versioned import Conflict, VersionedStore

DAY = 86_400
BODIES = "trace_id string, body string, created_at timestamp"


@pytest.fixture
def store(spark):
    body_schema = spark.createDataFrame([], BODIES).schema
    made = VersionedStore(spark, new_folder(spark, "store"), {"traces": TRACE_SCHEMA, "bodies": body_schema}, buckets=8)
    made.ingest(traces(spark, [trace(f"t{d}{i}", d * DAY + i, llm_request_prompt="own" if i == 0 else None) for d in range(4) for i in range(3)]))
    return made


def ids(store, version=None):
    return sorted(r["id"] for r in store.read("traces", version).collect())


def test_ids_stay_unique_over_days_and_redelivery(spark, store):
    batch = traces(spark, [trace("t00", 3 * DAY), trace("new", 9), trace("new", 8), trace(None, 1), trace("none", 0, timestamp=None)])
    rejected = store.ingest(batch, ("ingest", 7))
    assert sorted((r["id"], r["reason"], r["rows"]) for r in rejected.collect()) == [("", "missing_id", 1), ("new", "repeated_in_batch", 1), ("t00", "already_stored", 1)]
    once, version = ids(store), store.version()
    assert len(once) == 14 and store.applied(("ingest", 7)) and not store.applied(("ingest", 8))
    store.ingest(traces(spark, [trace("other", 5)]), ("ingest", 7))
    assert (ids(store), store.version()) == (once, version)
    store.ingest(batch)
    assert ids(store) == once


def test_bodies_touch_their_buckets_only(spark, store):
    before = store.manifest()
    store.upsert_bodies(spark.createDataFrame([(f"t{d}{i}", "first", at(0)) for d in range(4) for i in range(3)], BODIES))
    middle = store.manifest()["tables"]["bodies"]
    assert store.upsert_bodies(spark.createDataFrame([("t00", "older", at(5)), ("t00", "second", at(9))], BODIES)) == 1
    after = store.manifest()["tables"]["bodies"]
    assert sum(middle[p] != after[p] for p in middle) == 1 and store.manifest()["tables"]["traces"] == before["tables"]["traces"]
    got = {r["trace_id"]: (r["body"], r["created_at"]) for r in store.read("bodies").collect()}
    assert got["t00"] == ("second", at(0)) and len(got) == 12


def test_derived_columns_fill_and_never_overwrite(spark, store):
    changes = spark.createDataFrame([("t10", "derived"), ("t11", "derived"), ("t12", " "), ("gone", "derived")], "id string, llm_request_prompt string")
    before = store.manifest()["tables"]["traces"]
    assert store.fill_columns(changes, ["llm_request_prompt"]) == 1
    after = store.manifest()["tables"]["traces"]
    assert sum(before[d] != after[d] for d in before) == 1
    got = {r["id"]: r["llm_request_prompt"] for r in dicts(store.read("traces"))}
    assert (got["t10"], got["t11"], got["t12"], got["t01"]) == ("own", "derived", None, None)
    version = store.version()
    assert store.fill_columns(changes, ["llm_request_prompt"]) == 0 and store.version() == version


def test_retention_takes_bodies_and_ids_along(spark, store):
    store.upsert_bodies(spark.createDataFrame([(f"t{d}{i}", "b", at(0)) for d in range(4) for i in range(3)], BODIES))
    old = store.version()
    assert store.retain(at(DAY + 1)) == 4
    left = ["t11", "t12", "t20", "t21", "t22", "t30", "t31", "t32"]
    assert ids(store) == left
    assert sorted(r["trace_id"] for r in store.read("bodies").collect()) == left == sorted(r["id"] for r in store.read("ids").collect())
    assert len(ids(store, old)) == 12  # a reader of the version before still has it whole
    assert store.retain(at(DAY + 1)) == 0
    assert [r["reason"] for r in store.ingest(traces(spark, [trace("t00", DAY * 5)])).collect()] == []


@pytest.mark.parametrize("change", ["ingest", "bodies", "fill", "retain"])
def test_a_writer_that_dies_leaves_the_old_state(spark, store, monkeypatch, change):
    run = {
        "ingest": lambda: store.ingest(traces(spark, [trace("late", 50)]), ("w", 1)),
        "bodies": lambda: store.upsert_bodies(spark.createDataFrame([("t00", "x", at(0))], BODIES)),
        "fill": lambda: store.fill_columns(spark.createDataFrame([("t11", "x")], "id string, llm_request_prompt string"), ["llm_request_prompt"]),
        "retain": lambda: store.retain(at(DAY)),
    }[change]
    state = lambda: [sorted(map(str, store.read(t).collect())) for t in ("traces", "bodies", "ids")]
    before = state()

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", die)
        with pytest.raises(RuntimeError):
            run()
    assert state() == before
    run()
    assert state() != before
    kept = state()
    assert store.vacuum(keep=1) >= 1
    assert state() == kept


def test_a_second_writer_is_refused(store):
    base = store.manifest()
    store._commit(base, {})
    with pytest.raises(Conflict):
        store._commit(base, {})
