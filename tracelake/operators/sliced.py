"""Running values per key that never put a whole key into one task.

A plain window sorts all rows of a key in one task. Here rows are sorted by key and order in ranges
of about equal counts, whose bounds follow from a sample of the sort key itself, and written: neither a
hot key nor a burst makes a range large. Totals per (key, range) are carried forward over the short list of
ranges and joined back, so the only row-level window covers one range. A caller may ask for slices of a
fixed time instead, which need no sort of the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import persist_table

SLICE = "_slice"
_NO_TIME = -(1 << 62)

# Rows of one key and span up to which a window counts them.
SPAN_ROWS = 500_000


def time_slice(ts: Column, seconds: int) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")


def _join_null_safe(rows: DataFrame, totals: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which a NULL key or a NULL time (its own slice) finds its totals."""
    named = totals.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return rows.join(named, same).drop(*[f"_on_{c}" for c in on])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    order: Sequence[str],
    sums: dict[str, Column],
    *,
    slice_seconds: int | None = None,
    descending: bool = False,
    include_current: bool = True,
) -> DataFrame:
    """Add running sums over ``order`` within ``keys``; the current row is optional.

    The input is read twice: for the cut and for the rows. Write an expensive input first. ``order`` must start with
    ``time_col``. All sum expressions must be non-NULL.
    """
    if order[0] != time_col:
        raise ValueError("order must start with the time column")
    keys = list(keys)
    names = list(sums)
    towards = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    rows = df.withColumns({f"_v_{n}": sums[n] for n in names})
    if slice_seconds is None:
        rows, piece, within, ahead = in_ranges(rows, keys, [towards(c) for c in order]), "_range", [F.col("_at")], F.col("_range")
    else:
        rows, piece, within, ahead = rows.withColumn(SLICE, time_slice(F.col(time_col), slice_seconds)), SLICE, [towards(c) for c in order], towards(SLICE)
    before = Window.partitionBy(*keys).orderBy(ahead).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, piece)
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
        .select(*keys, piece, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names])
    )
    last = 0 if include_current else -1
    inside = Window.partitionBy(*keys, piece).orderBy(*within).rowsBetween(Window.unboundedPreceding, last)
    joined = _join_null_safe(rows, carried, [*keys, piece])
    out = joined.withColumns({n: F.col(f"_c_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
    return out.select(*df.columns, *names)


def running_max(
    df: DataFrame, keys: Sequence[str], time_col: str, order: Sequence[str], name: str, value: Column, *, slice_seconds: int | None = None
) -> DataFrame:
    """Add the largest value so far, current row included; NULLs are skipped."""
    keys = list(keys)
    rows = df.withColumn("_v", value)
    if slice_seconds is None:
        rows, piece, within = in_ranges(rows, keys, [F.col(c) for c in order]), "_range", ["_at"]
    else:
        rows, piece, within = rows.withColumn(SLICE, time_slice(F.col(time_col), slice_seconds)), SLICE, list(order)
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, piece).agg(F.max("_v").alias("_t")).select(*keys, piece, F.max("_t").over(before).alias("_c"))
    inside = Window.partitionBy(*keys, piece).orderBy(*within).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_null_safe(rows, carried, [*keys, piece]).withColumn(name, F.greatest("_c", F.max("_v").over(inside)))
    return out.select(*df.columns, name)


def trailing_count(
    df: DataFrame, keys: Sequence[str], time_col: str, seconds: int, name: str, span_rows: int | None = None
) -> DataFrame:
    """Rows of the same key within the last ``seconds``, both ends included, ties included; rows without a time count each other.

    While no key has more than ``span_rows`` rows in one span, a window over two spans counts them. Beyond that, the count is a difference of
    ranks: rows up to the time less rows before the window, both running counts in one sorted run of a key's distinct times and
    window starts. No window then holds the rows of a key or of a span. The input is read twice; write an expensive one first.
    """
    span = seconds * 1_000_000
    # Both are never NULL, so that rows and counts meet by plain equality.
    own, us = F.to_json(F.struct(*keys)), F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(_NO_TIME))
    rows = df.withColumns({"_scope": own, "_us": us})
    home = F.floor(F.col("_us") / F.lit(span)).cast("bigint")
    busiest = rows.groupBy("_scope", home.alias("_home")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if busiest <= (SPAN_ROWS if span_rows is None else span_rows):
        # Each row is also shown to the next span, so a window covers two spans of a key, whose size was just checked.
        shown = rows.withColumn("_home", home).withColumn(SLICE, F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
        within = Window.partitionBy("_scope", SLICE).orderBy("_us").rangeBetween(-span, 0)
        return shown.withColumn(name, F.count(F.lit(1)).over(within)).filter(F.col(SLICE) == F.col("_home")).select(*df.columns, name)
    times = persist_table(rows.groupBy("_scope", "_us").agg(F.count(F.lit(1)).alias("_n")), "times")
    # A start lies before the times equal to it: rows at the very start of the window count.
    none = F.lit(0).cast("bigint")
    ends = F.array(F.struct(F.col("_us").alias("x"), F.lit(1).alias("kind"), F.col("_n").alias("n")), F.struct((F.col("_us") - span).alias("x"), F.lit(0).alias("kind"), none.alias("n")))
    points = times.filter(F.col("_us") > _NO_TIME).select("_scope", "_us", F.explode(ends).alias("p")).select("_scope", "_us", "p.*")
    ranked = range_sums(points, ["_scope"], ["x", "kind", "_us"], "n", "upto")
    upto, before = (F.max(F.when(F.col("kind") == k, F.col("upto"))) for k in (1, 0))
    counts = ranked.groupBy("_scope", "_us").agg((upto - before).alias(name))
    counts = counts.unionByName(times.filter(F.col("_us") == _NO_TIME).select("_scope", "_us", F.col("_n").alias(name)))
    return rows.join(counts, ["_scope", "_us"]).select(*df.columns, name)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, *, salts: int = 256, rank: str = "_rank") -> DataFrame:
    """The first ``limit`` rows of each key with their rank.

    Two rounds. Every task first cuts each key to its own best rows (Spark does so for a rank filter
    before the shuffle); these are brought together by key and task group, so no task sees more than
    its share of a hot key, and only ``salts * limit`` rows of a key meet in the end. Which task
    group a row falls into does not change the result.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= limit).drop(rank, "_salt")
    final = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= limit)


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` in order, cut into ranges of about equal counts, written with ``_at``: the range (upper part) and the place in it.

    Ranges follow from a sample of the sort key, not of the time line, so neither a hot key nor a burst makes one large. Running values
    take a table that has been cut already as it is.
    """
    if "_range" in df.columns:
        return df
    by = [*[F.col(k) for k in keys], *order]
    return persist_table(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, size: str | None = None) -> DataFrame:
    """Add the row's number (from 1) within ``keys`` by ``order``, which must be a total order, and the number of rows of the key."""
    keys = list(keys)
    placed = in_ranges(df, keys, order)
    runs = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    # One row per key and range that holds some of it.
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_held").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*keys, "_range", (before - F.col("_first") + 1).alias("_shift"), F.sum("_held").over(of_key).alias("_size"))
    out = _join_null_safe(placed, runs, [*keys, "_range"]).withColumn(name, F.col("_at") + F.col("_shift"))
    return out.select(*df.columns, name, *([F.col("_size").alias(size)] if size else []))


def range_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the running sum of ``value`` within ``keys`` by ``order``, the row itself included; ``value`` must not be NULL."""
    keys = list(keys)
    placed = in_ranges(df, keys, [F.col(c) for c in order])
    runs = placed.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = _join_null_safe(placed, runs, [*keys, "_range"]).withColumn(name, F.col("_carried") + F.sum(value).over(inside))
    return out.select(*df.columns, name)
