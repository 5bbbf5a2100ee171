"""The registered queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, gap_packing, hard_negatives, merkle, mixing, near_dedup, nearest, packing, secret_scan, sql, substrings, token_counts, token_file, toxicity
from tracelake.llm.common import table
from tracelake.registry import query


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_mixing", sql.MIXING)
def mixing_query(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op2_secrets")
def secrets_query(spark, sf):
    """A source's documents in one language count as a repository, the source as its owner."""
    repo = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return secret_scan.scan_secrets(table(spark, sf, "documents"), repo, F.col("source"))


@query("op3_near_dedup", sql.NEAR_DEDUP)
def near_dedup_query(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"), size=3, threshold=85)


@query("op4_toxicity")
def toxicity_query(spark, sf):
    return toxicity.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_token_counts")
def token_counts_query(spark, sf):
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf, "documents"), tokenizer_path()))


@query("op6_packing")
def packing_query(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query("op7_substrings")
def substrings_query(spark, sf):
    found = substrings.without_repeats(table(spark, sf, "documents"))
    kept_text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", kept_text)


@query("op8_nearest", sql.NEAREST)
def nearest_query(spark, sf):
    return nearest.top_neighbours(table(spark, sf, "embeddings"))


@query("op9_exact_dedup", sql.EXACT_DEDUP)
def exact_dedup_query(spark, sf):
    return exact_dedup.dedup(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_token_file")
def token_file_query(spark, sf):
    return token_file.round_trip(table(spark, sf, "documents"), tokenizer_path())


@query("op11_gap_packing")
def gap_packing_query(spark, sf):
    return gap_packing.pack_gaps(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op12_hard_negatives", sql.HARD_NEGATIVES)
def hard_negatives_query(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), label=label)


@query("op13_manifest", sql.MANIFEST)
def manifest_query(spark, sf):
    return merkle.manifest_rows(table(spark, sf, "documents"))
