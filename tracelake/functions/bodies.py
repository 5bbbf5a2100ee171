"""Captured body bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(body: Column, limit: int) -> dict[str, Column]:
    """Keep at most ``limit`` bytes (0: all). The size is that of the whole body, the hash that of the kept bytes."""
    size = F.coalesce(F.octet_length(body), F.lit(0))
    kept = F.substring(body, 1, limit) if limit > 0 else body
    return {
        "kept": kept,
        "size_bytes": size.cast("bigint"),
        "truncated": (size > limit) if limit > 0 else F.lit(False),
        "sha256": F.when(size > 0, F.sha2(kept, 256)).otherwise(F.lit("")),
    }
