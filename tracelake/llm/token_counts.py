"""Exact histogram of document lengths in tokens, and what its suffix sums answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.encoding import encoder, slices
from tracelake.session import persist_table


def token_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row ``n_tokens`` for each row of ``docs``; a missing or empty text has 0 tokens."""

    def lengths(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for a, b in slices(texts):
                out += [len(ids) // 4 for ids in enc.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 4096) -> DataFrame:
    """Suffix sums over the documents' lengths, one row per distinct length.

    Columns: ``n_tokens``, ``n_docs`` of that length, ``docs_at_least`` and ``tokens_at_least`` (documents that long or
    longer, and their tokens), ``docs_total``, ``tokens_total``, ``truncated_total`` (tokens kept if every document is cut to
    ``n_tokens``) and ``quantile`` (share of documents no longer than that). An empty table gives no row.

    Documents are counted before the shuffle. Sums run inside blocks of lengths; only one row per block meets the others.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / block))
    counts = persist_table(counts, "token-lengths")
    tokens = F.col("n_tokens") * F.col("n_docs")
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = (
        counts.groupBy("_block")
        .agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
        .select(
            "_block",
            F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_later"),
            F.coalesce(F.sum("_tokens").over(later), F.lit(0)).alias("_tokens_later"),
            F.sum("_docs").over(everything).alias("docs_total"),
            F.sum("_tokens").over(everything).alias("tokens_total"),
        )
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("_docs_here", F.sum("n_docs").over(inside))
        .withColumn("_tokens_here", F.sum(tokens).over(inside))
        .join(blocks, "_block")
        .withColumn("docs_at_least", F.col("_docs_here") + F.col("_docs_later"))
        .withColumn("tokens_at_least", F.col("_tokens_here") + F.col("_tokens_later"))
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            "docs_total",
            "tokens_total",
            (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
        )
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens kept at each context limit, whether or not a document has exactly that length: ``limit_tokens, kept_tokens``."""
    below = [F.sum(F.least(F.col("n_tokens"), F.lit(int(n))) * F.col("n_docs")).alias(f"n{n}") for n in limits]
    sums = histogram.agg(*below)
    pairs = F.array(*[F.struct(F.lit(int(n)).alias("limit_tokens"), F.coalesce(F.col(f"n{n}"), F.lit(0)).alias("kept_tokens")) for n in limits])
    return sums.select(F.inline(pairs))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of documents does not exceed: ``share, n_tokens``."""
    lows = [F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return histogram.agg(*lows).select(F.inline(pairs))
