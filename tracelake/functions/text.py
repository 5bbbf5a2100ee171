"""Text, path and label columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, ASCII and beyond.
WHITE_SPACE = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def squeeze(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(squeeze(col), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is not blank, trimmed; '' when there is none."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def tenant_or_default(col: Column) -> Column:
    return F.coalesce(blank_to_null(col), F.lit("default"))


def _slashed(col: Column, blank: str) -> Column:
    """Trimmed, one leading slash added if missing, trailing slashes cut; ``blank`` for blank text."""
    value = squeeze(F.coalesce(col, F.lit("")))
    # A single slash stays; several and nothing else leave no text at all.
    cut = F.regexp_replace(F.regexp_replace(value, "^(?!/)(?=.)", "/"), "^//+$|(?<=.)/+$", "")
    return F.when(value == "", F.lit(blank)).otherwise(cut)


def normalize_prefix(col: Column) -> Column:
    """Leading slash, no trailing slash; blank means the root."""
    return _slashed(col, "/")


def clean_prefix(prefix: str) -> str:
    value = prefix.strip()
    if not value:
        return "/"
    value = value if value.startswith("/") else "/" + value
    return value.rstrip("/") if len(value) > 1 else value


def clean_prefixes(prefixes: Sequence[str]) -> list[str]:
    """Configured prefixes, root dropped, first spelling kept."""
    return list(dict.fromkeys(p for p in map(clean_prefix, prefixes) if p != "/"))


def distinct_prefixes(col: Column) -> Column:
    """Array form of :func:`clean_prefixes` for prefixes stored in a column."""
    return F.array_distinct(F.filter(F.transform(col, normalize_prefix), lambda p: p != F.lit("/")))


def under_prefix(path: Column, prefix: str | Column) -> Column:
    """Path equals the prefix or lies below it, by whole path segments."""
    if isinstance(prefix, str):
        fixed = clean_prefix(prefix)
        if fixed == "/":
            return F.lit(True)
        return (path == F.lit(fixed)) | path.startswith(fixed + "/")
    fixed_col = normalize_prefix(prefix)
    return (fixed_col == "/") | (path == fixed_col) | path.startswith(F.concat(fixed_col, F.lit("/")))


def endpoint_path(col: Column) -> Column:
    """A request path with a leading slash and no trailing ones; blank stays blank."""
    return _slashed(col, "")


def matched_prefix(path: Column, prefixes: Sequence[str]) -> Column:
    """First configured prefix the path lies under, '' if none."""
    # The alternation tries prefixes in their order; the look-ahead keeps it to whole segments.
    fixed = clean_prefixes(prefixes)
    if not fixed:
        return F.lit("")
    choice = "^(" + "|".join(re.escape(p) for p in fixed) + ")(?=/|$)"
    return F.regexp_extract(endpoint_path(path), choice, 1)


def endpoint_of(path: Column, prefixes: Sequence[str]) -> Column:
    """Path without its configured prefix; '/' when nothing is left."""
    fixed = clean_prefixes(prefixes)
    clean = endpoint_path(path)
    if fixed:
        clean = F.regexp_replace(clean, "^(?:" + "|".join(re.escape(p) for p in fixed) + ")(?=/|$)", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("/"))


def endpoint_candidates(endpoint: str, prefixes: Sequence[str]) -> list[str]:
    """All stored paths one endpoint can have: bare and below each prefix."""
    value = endpoint.strip()
    if not value:
        return []
    value = value if value.startswith("/") else "/" + value
    if len(value) > 1:
        value = value.rstrip("/")
    return list(dict.fromkeys([value, *[p + value for p in clean_prefixes(prefixes)]]))


# Route families used as metric labels, tried in this order.
ROUTE_FAMILIES = ("/llm", "/openai", "/anthropic", "/api")


def route_pattern(path: Column) -> Column:
    out = F.lit("/other")
    for family in reversed(ROUTE_FAMILIES):
        out = F.when(under_prefix(path, family), F.lit(family + "/*")).otherwise(out)
    return out


def provider_of_path(path: Column, routes: dict[str, str]) -> Column:
    """Configured provider name for a path; names are tried in sorted order, 'unknown' if none fits."""
    out = F.lit("unknown")
    for name in sorted(routes, reverse=True):
        out = F.when(under_prefix(path, routes[name]), F.lit(name)).otherwise(out)
    return out


# Latency bucket bounds in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
FLUSH_BUCKETS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)

# Message fragments per write-failure class, classes tried in this order.
WRITE_ERROR_FRAGMENTS = {
    "connection": ("connection refused", "broken pipe", "no such host"),
    "timeout": ("timeout", "deadline exceeded"),
    "contention": ("sqlite_busy", "database is locked"),
    "constraint": (
        "violates foreign key constraint",
        "violates unique constraint",
        "violates check constraint",
        "duplicate key",
    ),
}


def write_error_class(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for name, fragments in reversed(WRITE_ERROR_FRAGMENTS.items()):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | lowered.contains(fragment)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def queue_utilization(depth: Column, capacity: Column) -> Column:
    share = F.floor(depth.cast("bigint") * 100 / capacity.cast("bigint")).cast("int")
    return (
        F.when((capacity <= 0) | (depth <= 0), F.lit(0)).when(depth >= capacity, F.lit(100)).otherwise(share)
    )


def pressure_state(utilization: Column) -> Column:
    return (
        F.when(utilization >= 100, F.lit("saturated"))
        .when(utilization >= 80, F.lit("high"))
        .when(utilization >= 50, F.lit("elevated"))
        .otherwise(F.lit("ok"))
    )
