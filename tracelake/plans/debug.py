"""Debug view of chains: ordered checkpoints, differences and files per chain."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.diffs import digested, with_differences
from tracelake.operators.lineage import CHAIN_KEYS, chain_identifier, ordered_chains
from tracelake.sources.store import hydrate

#: Steps of a chain that are hashed together.
STRETCH = 4096
DOCUMENT_VERSION = "debug-chain.v1"


def debug_chain(traces: DataFrame, bodies: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Ordered checkpoints of every chain with the differences to the step before.

    All checkpoints, or the newest ``limit``; ``truncated`` says so. Bodies, if given, are joined by id at the end.
    """
    ordered = ordered_chains(digested(traces), limit)
    keys = list(CHAIN_KEYS)
    chain = with_differences(ordered, keys)
    chain = chain.select(*keys, "step", *[c for c in chain.columns if c not in (*keys, "step")])
    if bodies is not None:
        empty = F.lit(None).cast("string")
        chain = hydrate(chain.withColumns({"request_body": empty, "response_body": empty}), bodies)
    return chain.withColumn(
        "lineage_identifier", chain_identifier(F.col("group_id"), F.col("thread_id"), F.col("run_id"))
    )


def export_bundles(chain: DataFrame, path: str) -> DataFrame:
    """Write one JSON line per checkpoint, by chain and step, and return the manifest of the chains.

    No row holds more than one checkpoint's bodies, however long its chain. The manifest names each chain with its
    checkpoints, its bytes and the hash of its stretches' hashes in order (a stretch: the hash of its lines' hashes); it is written last.
    """
    spark = chain.sparkSession
    keys = list(CHAIN_KEYS)
    fields = [c for c in ("step", "id", "order_time", "provider", "model", "request_path", "response_status", "total_tokens", "latency_ms", "metadata", "request_body", "response_body") if c in chain.columns]
    line = F.to_json(F.struct(F.lit(DOCUMENT_VERSION).alias("schema_version"), *keys, "lineage_identifier", "truncated", *fields))
    folder = os.path.join(path, "chains")
    slim = chain.select(F.sha2(F.concat_ws("|", *keys), 256).alias("name"), "step", *dict.fromkeys([*keys, "lineage_identifier", "truncated", *fields[1:]]))
    # Lines are made behind the sort: its sample reads the rows once more.
    slim.repartitionByRange("name", "step").sortWithinPartitions("name", "step").select("name", "step", line.alias("document")).write.mode("overwrite").option("compression", "gzip").json(folder)
    written = spark.read.schema("name string, step int, document string").json(folder)
    each = written.select("name", F.struct("step", F.sha2("document", 256).alias("sha")).alias("line"), F.octet_length("document").alias("size"))
    in_order = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["sha"]), ""), 256)
    # Lines are hashed by stretches of steps, and the chain over its stretches, so no row holds the hashes of a long chain.
    stretch = F.floor((F.col("line.step") - 1) / STRETCH)
    parts = each.groupBy("name", stretch.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), in_order("line").alias("sha"))
    manifest = parts.groupBy("name").agg(F.sum("n").alias("checkpoints"), F.sum("size").alias("bytes"), in_order(F.struct("step", "sha")).alias("sha256"))
    manifest.write.mode("overwrite").json(os.path.join(path, "manifest"))
    return spark.read.schema(manifest.schema).json(os.path.join(path, "manifest"))
