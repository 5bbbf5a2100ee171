"""What the operators share: reading tables, the rows of Arrow batches, caches of a Python worker."""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import pin_utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def has_place(docs: DataFrame) -> bool:
    """Whether rows come straight from Parquet files, which say where each one lies."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def place(docs: DataFrame) -> Column:
    """Where a row's content lies: ``file, row``. Reading again, on fewer machines too, gives the same places.

    Rows that come from elsewhere are numbered by task, which holds within one run of a plan.
    """
    if has_place(docs):
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names that ``rows`` does not have, whatever the case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def worker_cache(name: str, make):
    """One object per Python worker: it outlives a task, so the next one on the same worker finds it filled.

    A worker holds one at a time: the next operator's takes the place of the former's, so that memory does not add up over stages.
    """
    kept = vars(sys).setdefault("_tracelake_llm", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def by_group(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` for each group of a few rows: takes an Arrow table, returns tuples of ``schema``.

    One Arrow stream for each task instead of one for each group, so that very many small groups cost little. Keys must not be null.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(found):
            columns = list(zip(*found)) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows, dtype=bool)
            for key in keys:
                values = table.column(key).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = [0, *np.flatnonzero(change).tolist()]
            found: list[tuple] = []
            for a, b in zip(starts, starts[1:]):
                found += fn(table.slice(a, b - a))
            rest = table.slice(starts[-1])
            yield out(found)
        if rest is not None:
            yield out(fn(rest))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
