"""Daily exports: ordered gzip JSON lines in parts of bounded size, with a manifest."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.filters import export_range
from tracelake.operators.sliced import running_sums
from tracelake.session import persist_table

# Size of one part, file name layout.
PART_BYTES = 128 * 1024 * 1024
PART_NAME = "request_details_%s_part_%06d_%s_%s.ndjson.gz"

# The default JSON time text stops at milliseconds; exports keep microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def local_day(day: dt.date, zone: str) -> tuple[dt.datetime, dt.datetime]:
    """UTC start and end of a local calendar day."""
    tz = ZoneInfo(zone)
    edges = [dt.datetime.combine(d, dt.time(), tz) for d in (day, day + dt.timedelta(days=1))]
    start, end = [e.astimezone(dt.timezone.utc).replace(tzinfo=None) for e in edges]
    return start, end


def previous_day(now: dt.datetime, zone: str) -> dt.date:
    """The last completed local day."""
    at = now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
    return at.astimezone(ZoneInfo(zone)).date() - dt.timedelta(days=1)


def day_dir(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyMMdd")


def hhmm(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "HHmm")


def part_name(window_start: Column, number: Column, first: Column, last: Column, zone: str) -> Column:
    return F.format_string(PART_NAME, day_dir(window_start, zone), number.cast("int"), hhmm(first, zone), hhmm(last, zone))


def cut_parts(rows: DataFrame, part_bytes: int) -> DataFrame:
    """``timestamp, id, line`` -> the same with ``bytes`` (line end included) and ``_cut``, which sorts by time and names a part.

    Cuts follow from the bytes before a row in the order of (timestamp, id), running sums over sorted ranges. Steps of seven eighths of the bound leave
    room for the row that reaches over a cut; a row of more than an eighth stands in a part of its own. So no part exceeds
    ``part_bytes``, plain or compressed, but for a single row that does.
    """
    # What gzip may add to text it cannot shrink stays free.
    room = part_bytes - part_bytes // 1000 - 64
    if room < 8:
        raise ValueError("part_bytes is too small")
    long = room // 8
    sized = rows.withColumns({"bytes": F.octet_length("line").cast("bigint") + 1, "_window": F.lit(0)})
    lies = running_sums(
        sized, ["_window"], "timestamp", ["timestamp", "id"], {"_before": F.col("bytes"), "_longs": (F.col("bytes") > long).cast("bigint")}, include_current=False
    )
    step = F.floor(F.col("_before") / F.lit(room - long)).cast("bigint")
    return lies.withColumn("_cut", F.struct(step.alias("step"), F.col("_longs").alias("longs"), (F.col("bytes") > long).alias("alone"))).drop("_window", "_before", "_longs")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def export_window(traces: DataFrame, start: dt.datetime, end: dt.datetime, path: str, part_bytes: int = PART_BYTES, zone: str = "UTC") -> DataFrame:
    """Write the window's traces, bodies included, as ordered gzip JSON lines; returns one row per part.

    Parts are stretches of the time order with at most ``part_bytes`` (see :func:`cut_parts`), one file each, under the names of the daily folder.
    Files appear in ``path`` when all are written.
    """
    spark = traces.sparkSession
    window = export_range(traces, start, end)
    lines = window.select("timestamp", "id", F.to_json(F.struct(*window.columns), JSON_TIMES).alias("line"))
    cut = cut_parts(lines, part_bytes)
    found = cut.groupBy("_cut").agg(
        F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("plain_bytes"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")
    )
    # One row per part from here on.
    number = F.row_number().over(Window.orderBy("_cut"))
    named = found.withColumn("part_number", number)
    at = F.lit(start.isoformat(sep=" ")).cast("timestamp")
    parts = persist_table(named.withColumn("part_name", part_name(at, F.col("part_number"), F.col("first_at"), F.col("last_at"), zone)), "export-parts")
    # Beside the target, so that naming a file moves no bytes.
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    (
        cut.join(parts.select("_cut", "part_number"), "_cut")
        .repartition("part_number")
        .sortWithinPartitions("part_number", "timestamp", "id")
        .select("part_number", "line")
        .write.partitionBy("part_number")
        .option("compression", "gzip")
        .text(staged)
    )
    fs, target = _fs(spark, path)
    fs.delete(target, True)
    fs.mkdirs(target)
    # Names only: one file for each part.
    for row in parts.select("part_number", "part_name").toLocalIterator():
        (file,) = [s.getPath() for s in fs.listStatus(_fs(spark, f"{staged}/part_number={row['part_number']}")[1])]
        if not fs.rename(file, _fs(spark, f"{path}/{row['part_name']}")[1]):
            raise OSError(f"cannot name part {row['part_number']}")
    fs.delete(_fs(spark, staged)[1], True)
    return parts.drop("_cut")


def manifest(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """The parts with their file, compressed bytes and sha256.

    Hashing one file of bounded size is bounded work for one task.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.ndjson.gz")
        .load(path)
        .select(
            F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
            F.col("length").alias("compressed_bytes"),
            F.sha2("content", 256).alias("sha256"),
        )
    )
    return files.join(parts.withColumn("file", F.col("part_name")), "file")


def manifest_totals(parts: DataFrame) -> DataFrame:
    return parts.agg(
        F.count(F.lit(1)).alias("part_count"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("total_compressed_bytes"),
    )


def read_export(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**JSON_TIMES).json(path)


def export_day(traces: DataFrame, day: dt.date, zone: str, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Export one local day below ``root`` and write its manifest last; returns the manifest."""
    spark = traces.sparkSession
    start, end = local_day(day, zone)
    folder = os.path.join(root, f"{day:%y%m%d}")
    parts_path, listed = os.path.join(folder, "parts"), os.path.join(folder, "manifest")
    # A day is complete when its manifest is there.
    fs, old = _fs(spark, listed)
    fs.delete(old, True)
    parts = export_window(traces, start, end, parts_path, part_bytes, zone)
    # Files are hashed where they are read; only the lines of the manifest come together.
    out = manifest(spark, parts_path, parts)
    out.repartition(1).sortWithinPartitions("part_number").write.options(**JSON_TIMES).json(listed)
    return spark.read.schema(out.schema).options(**JSON_TIMES).json(listed)
