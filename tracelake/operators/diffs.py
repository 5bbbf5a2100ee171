"""Differences between neighbouring checkpoints of a chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.metadata import metadata_view
from tracelake.functions.text import squeeze

#: Steps of a chain that are compared in one window.
STRETCH = 4096

# Compared after trimming, exactly, by difference, and by hash plus size.
TRIMMED = ("provider", "model", "request_method", "request_path")
DELTAS = ("input_tokens", "output_tokens", "total_tokens", "latency_ms", "estimated_cost_usd")
TEXTS = ("request_headers", "response_headers", "request_body", "response_body")


def canonical_values(metadata: Column) -> Column:
    """Top-level keys with their values as canonical JSON text."""
    entries = F.try_variant_get(metadata_view(metadata), "$", "map<string,variant>")
    return F.coalesce(F.transform_values(entries, lambda _, v: F.to_json(v)), F.create_map().cast("map<string,string>"))


def key_changes(before: Column, after: Column) -> dict[str, Column]:
    """Sorted keys added, removed and changed between two canonical maps."""
    old, new = F.map_keys(before), F.map_keys(after)
    shared = F.array_intersect(old, new)
    return {
        "metadata_keys_added": F.array_sort(F.array_except(new, old)),
        "metadata_keys_removed": F.array_sort(F.array_except(old, new)),
        "metadata_keys_changed": F.array_sort(F.filter(shared, lambda k: ~before[k].eqNullSafe(after[k]))),
    }


def key_sets(before: Column, after: Column) -> dict[str, Column]:
    """Union, difference and intersection of the keys of two metadata documents."""
    old, new = F.map_keys(canonical_values(before)), F.map_keys(canonical_values(after))
    return {
        "all_keys": F.array_sort(F.array_union(old, new)),
        "only_before": F.array_sort(F.array_except(old, new)),
        "shared": F.array_sort(F.array_intersect(old, new)),
    }


def digested(traces: DataFrame) -> DataFrame:
    """Replace headers and bodies by hash and size, so chains are ordered and compared without texts."""
    present = [c for c in TEXTS if c in traces.columns]
    slim = traces.withColumns({f"{c}_digest": _digest(traces, c) for c in TEXTS})
    return slim.drop(*present, "llm_request_prompt", "llm_response_content")


def _digest(df: DataFrame, name: str) -> Column:
    if f"{name}_digest" in df.columns:
        return F.col(f"{name}_digest")
    text = F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")
    return F.struct(F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("size"))


def checkpoint_diffs(ordered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per step after the first of each bounded, ordered chain.

    Apply :func:`digested` to the traces before their chains are built, so bodies are never moved.
    """
    paired = with_differences(ordered, keys, True)
    return paired.select(*keys, "step", *[c for c in paired.columns if c not in ordered.columns])


def with_differences(ordered: DataFrame, keys: Sequence[str], only: bool = False) -> DataFrame:
    """``ordered`` with the differences to the step before (``only``: without the steps that have none before them).

    One window does it: nothing is joined, and differences nobody asks for are not computed.
    """
    keys = list(keys)
    fields = [squeeze(F.col("id")).alias("id")]
    fields += [squeeze(F.coalesce(c, F.lit(""))).alias(c) for c in TRIMMED]
    fields += [F.col("response_status")]
    fields += [F.coalesce(c, F.lit(0)).alias(c) for c in DELTAS]
    fields += [_digest(ordered, c).alias(c) for c in TEXTS]
    fields += [canonical_values(F.coalesce("metadata", F.lit(""))).alias("meta")]
    # Column by column, so that only those asked for are computed and moved.
    now = {n: f"_now_{i}" for i, n in enumerate(["id", *TRIMMED, "response_status", *DELTAS, *TEXTS, "meta"])}
    slim = ordered.withColumns(dict(zip(now.values(), fields, strict=True)))
    # Chains are cut into stretches; the last step of one is also shown to the next, so no window holds more than a stretch.
    own = F.floor(F.col("step") / STRETCH)
    shown = F.when((F.col("step") + 1) % STRETCH == 0, F.array(own, own + 1)).otherwise(F.array(own))
    slim = slim.withColumn("_own", own).withColumn("_stretch", F.explode(shown))
    steps = Window.partitionBy(*keys, "_stretch").orderBy("step")
    was = {n: f"_was{c}" for n, c in now.items()}
    before = {"_was": F.lag(F.lit(True)).over(steps), **{was[n]: F.lag(c).over(steps) for n, c in now.items()}}
    paired = slim.withColumns(before).filter(F.col("_own") == F.col("_stretch"))
    was, now = ({n: F.col(c) for n, c in side.items()} for side in (was, now))
    if only:
        paired = paired.filter("_was")
    out = [was["id"].alias("from_checkpoint_id"), now["id"].alias("to_checkpoint_id")]
    out += [(was[c] != now[c]).alias(f"{c}_changed") for c in TRIMMED]
    out += [(~was["response_status"].eqNullSafe(now["response_status"])).alias("response_status_changed")]
    out += [(now[c] - was[c]).alias(f"{c}_delta") for c in DELTAS]
    for c in TEXTS:
        out += [
            (was[c]["sha"] != now[c]["sha"]).alias(f"{c}_changed"),
            was[c]["size"].alias(f"{c}_bytes_from"),
            now[c]["size"].alias(f"{c}_bytes_to"),
        ]
    out += [c.alias(n) for n, c in key_changes(was["meta"], now["meta"]).items()]
    names = ["from_checkpoint_id", "to_checkpoint_id", *[f"{c}_changed" for c in (*TRIMMED, "response_status")], *[f"{c}_delta" for c in DELTAS]]
    names += [f"{c}_{n}" for c in TEXTS for n in ("changed", "bytes_from", "bytes_to")]
    names += [f"metadata_keys_{n}" for n in ("added", "removed", "changed")]
    return paired.select(*ordered.columns, *[F.when(F.col("_was"), c).alias(n) for n, c in zip(names, out, strict=True)])
