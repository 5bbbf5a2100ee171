"""A trace store that can be changed safely: traces, bodies and an id index below one numbered manifest.

Every change writes new folders first and then one small manifest, which names all folders of all tables. A reader takes the latest
manifest, so it sees a change whole or not at all, whatever table it touches; a writer that dies leaves folders nobody names. Only
the partitions that a change touches are written again. Traces lie in a partition for each day, bodies and ids in hash buckets,
so a batch looks for its ids in their buckets only and never in everything ever stored.

The manifest holds one line for each partition and folder, not for each file or row. One writer at a time: a second one that
started from the same version is refused.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.text import blank_to_null
from tracelake.sources.store import append_batch, upsert_bodies
from tracelake.session import persist_table

NO_DAY = "none"
_PART = "_part"


class Conflict(RuntimeError):
    """Another writer has committed since this one looked."""


class VersionedStore:
    """``schemas``: table name -> schema of ``traces`` (id, timestamp, …) and, if wanted, ``bodies`` (trace_id, created_at, …)."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType], buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schemas = {**schemas, "ids": T.StructType([T.StructField("id", T.StringType()), T.StructField("day", T.StringType())])}

    # ---- manifest -------------------------------------------------------------------------------

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _names(self, path: str) -> list[str]:
        fs, folder = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self) -> int:
        numbers = [int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json")]
        return max(numbers, default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {name: {} for name in self.schemas}, "done": {}}
        fs, file = self._fs(f"{self.path}/versions/{version:012d}.json")
        stream = fs.open(file)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, changed: dict[str, dict[str, list[str]]], label: tuple[str, int] | None = None) -> int:
        """Put ``changed`` (table -> partition -> folders, none: dropped) in place of what ``base`` names."""
        tables = {name: dict(base["tables"].get(name, {})) for name in self.schemas}
        for name, parts in changed.items():
            for part, folders in parts.items():
                if folders:
                    tables[name][part] = folders
                else:
                    tables[name].pop(part, None)
        done = {**base["done"], **({label[0]: label[1]} if label else {})}
        number = base["version"] + 1
        fs, target = self._fs(f"{self.path}/versions/{number:012d}.json")
        _, draft = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps({"version": number, "tables": tables, "done": done}).encode())
        stream.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"version {number} is there already")
        return number

    def applied(self, label: tuple[str, int]) -> bool:
        """Whether a writer's batch, or a later one, has been committed."""
        return self.manifest()["done"].get(label[0], -1) >= label[1]

    # ---- folders --------------------------------------------------------------------------------

    def _read(self, table: str, base: dict, parts: Sequence[str] | None = None) -> DataFrame:
        listed = base["tables"].get(table, {})
        folders = [f"{self.path}/{f}" for p, held in listed.items() if parts is None or p in parts for f in held]
        schema = self.schemas[table]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._read(table, self.manifest(version))

    def _part(self, table: str) -> Column:
        if table == "traces":
            return F.coalesce(F.to_date("timestamp").cast("string"), F.lit(NO_DAY))
        return F.pmod(F.xxhash64("trace_id" if table == "bodies" else "id"), F.lit(self.buckets)).cast("string")

    def _write(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        """Rows in new folders; partition -> folders."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        kept = rows.select(*self.schemas[table].fieldNames()).withColumn(_PART, self._part(table)).hint("rebalance", _PART)
        kept.write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        return {n[len(_PART) + 1 :]: [f"{folder}/{n}"] for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{_PART}=")}

    def _touched(self, table: str, rows: DataFrame) -> list[str]:
        """Partitions that rows fall into: at most as many as there are days or buckets."""
        return [r[0] for r in rows.select(self._part(table)).distinct().collect()]

    def _rewritten(self, table: str, base: dict, parts: Sequence[str], change: Callable[[DataFrame], DataFrame]) -> dict[str, list[str]]:
        new = self._write(table, change(self._read(table, base, parts)))
        return {p: new.get(p, []) for p in {*parts, *new}}

    # ---- changes --------------------------------------------------------------------------------

    def ingest(self, batch: DataFrame, label: tuple[str, int] | None = None) -> DataFrame:
        """Append rows whose id is not stored yet, on whatever day; returns what was set aside (``id, reason, rows``).

        A ``label`` (writer, growing number) makes a batch that is delivered again, also after a crash, change nothing.
        """
        base = self.manifest()
        batch = persist_table(batch.select(*self.schemas["traces"].fieldNames()), "ingest-batch")
        known = self._read("ids", base, self._touched("ids", batch))
        result = append_batch(batch, known)
        rejected = persist_table(result.rejected, "ingest-rejected")
        if label and base["done"].get(label[0], -1) >= label[1]:
            return rejected
        traces = self._write("traces", result.accepted)
        # What was written is read again: one evaluation decides for both tables.
        stored = self._read("traces", {"tables": {"traces": traces}})
        ids = self._write("ids", stored.select("id", self._part("traces").alias("day")))
        grown = {name: {p: [*base["tables"][name].get(p, []), *held] for p, held in new.items()} for name, new in (("traces", traces), ("ids", ids))}
        self._commit(base, grown, label)
        return rejected

    def upsert_bodies(self, incoming: DataFrame) -> int:
        """The newest incoming body of a trace takes the place of the stored one. Returns the number of buckets written."""
        base = self.manifest()
        incoming = persist_table(incoming.select(*self.schemas["bodies"].fieldNames()), "bodies-batch")
        parts = self._touched("bodies", incoming)
        if parts:
            self._commit(base, {"bodies": self._rewritten("bodies", base, parts, lambda stored: upsert_bodies(stored, incoming))})
        return len(parts)

    def fill_columns(self, changes: DataFrame, columns: Sequence[str]) -> int:
        """Put derived values (``id`` and ``columns``) into traces that have none. Stored values are never overwritten.

        Returns the number of days written; a run that finds nothing to fill commits nothing.
        """
        base = self.manifest()
        changes = changes.groupBy("id").agg(*[F.max(blank_to_null(F.col(c))).alias(f"_new_{c}") for c in columns])
        changes = persist_table(changes, "column-changes")
        held = self._read("ids", base, self._touched("ids", changes)).join(changes.select("id"), "id", "left_semi")
        days = [r[0] for r in held.select("day").distinct().collect()]
        empty = [blank_to_null(F.col(c)).isNull() & F.col(f"_new_{c}").isNotNull() for c in columns]
        gain = empty[0]
        for e in empty[1:]:
            gain = gain | e
        open_rows = self._read("traces", base, days).join(changes, "id").filter(gain)
        days = [r[0] for r in open_rows.select(self._part("traces")).distinct().collect()]
        if not days:
            return 0

        def fill(stored: DataFrame) -> DataFrame:
            both = stored.join(changes, "id", "left")
            return both.withColumns({c: F.coalesce(blank_to_null(F.col(c)), F.col(f"_new_{c}"), F.col(c)) for c in columns})

        self._commit(base, {"traces": self._rewritten("traces", base, days, fill)})
        return len(days)

    def retain(self, cutoff: dt.datetime) -> int:
        """Delete traces before ``cutoff``, their bodies and their ids, all in one commit; returns how many.

        Whole days are dropped by name; the day of the cutoff and the buckets of deleted ids are written again.
        """
        base = self.manifest()
        edge = f"{cutoff:%Y-%m-%d}"
        days = [d for d in base["tables"]["traces"] if d != NO_DAY and d <= edge]
        gone = persist_table(self._read("traces", base, days).filter(F.col("timestamp") < F.lit(cutoff)).select("id"), "retention-gone")
        deleted = gone.count()
        if not deleted:
            return 0
        traces: dict[str, list[str]] = {d: [] for d in days if d < edge}
        if edge in days:
            traces |= self._rewritten("traces", base, [edge], lambda rows: rows.filter(F.col("timestamp") >= F.lit(cutoff)))
        changed = {"traces": traces}
        lost = gone.select("id", F.col("id").alias("trace_id"))
        for table, key in (("ids", "id"), ("bodies", "trace_id")):
            if table in self.schemas:
                changed[table] = self._rewritten(table, base, self._touched(table, lost), lambda rows, key=key: rows.join(lost.select(key), key, "left_anti"))
        self._commit(base, changed)
        return deleted

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` versions names, those of writers that died included; returns how many.

        Not while a writer is at work: its folders are named by its commit only.
        """
        last = self.version()
        named = {f.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for held in t.values() for f in held}
        stale = [n for n in self._names(f"{self.path}/data") if n not in named]
        for name in stale:
            fs, folder = self._fs(f"{self.path}/data/{name}")
            fs.delete(folder, True)
        for v in range(1, last - keep + 1):
            fs, file = self._fs(f"{self.path}/versions/{v:012d}.json")
            fs.delete(file, False)
        return len(stale)
