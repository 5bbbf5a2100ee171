"""The usage report: summary, providers, models, keys and recent traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import analytics, paging
from tracelake.operators.filters import TraceFilter, apply_filter
from tracelake.session import new_folder, persist_table

REPORT_VERSION = "report.v1"


def report_sections(traces: DataFrame, f: TraceFilter = TraceFilter(), recent: int = 10) -> dict[str, DataFrame]:
    """The report's sections. The table is read once for all sums, which are written as one small rollup, and once for the recent rows."""
    rows = apply_filter(traces, f)
    lists = analytics.lists_of(persist_table(analytics.usage_rollup(rows), "report-rollup"))
    return {
        "summary": lists["summary"],
        "providers": paging.by_usage(lists["providers"]),
        "models": paging.by_requests(lists["models"], "model"),
        "keys": paging.by_requests(lists["keys"], "api_key_hash"),
        "recent": paging.recent(rows, recent),
    }


def report_rows(traces: DataFrame, f: TraceFilter = TraceFilter(), recent: int = 10, decimals: int = 8) -> DataFrame:
    """All sections in long form: section, name, metric, value (text)."""
    sections = report_sections(traces, f, recent)
    names = {"summary": F.lit(""), "providers": F.col("provider"), "models": F.col("model"), "keys": F.col("api_key_hash"), "recent": F.col("id")}

    def text(df: DataFrame, c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        if kind == "double":
            return F.format_string(f"%.{decimals}f", F.round(c, decimals))
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.col(c).cast("string")

    def long(section: str, df: DataFrame) -> DataFrame:
        values = [F.struct(F.lit(c).alias("metric"), text(df, c).alias("value")) for c in df.columns]
        return df.select(F.lit(section).alias("section"), names[section].alias("name"), F.inline(F.array(*values)))

    parts = [long(s, df) for s, df in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report(traces: DataFrame, f: TraceFilter = TraceFilter(), recent: int = 10) -> dict[str, str]:
    """Write each section as JSON below one folder; returns the paths."""
    folder = new_folder(traces.sparkSession, "report")
    paths = {}
    for section, df in report_sections(traces, f, recent).items():
        paths[section] = f"{folder}/{section}"
        df.withColumn("schema_version", F.lit(REPORT_VERSION)).write.json(paths[section])
    return paths
