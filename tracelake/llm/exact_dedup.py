"""Exact de-duplication as a stream with keyed state on disk, in column expressions only."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelake.llm.common import fresh, has_place, place
from tracelake.session import new_folder, persist_table

_STORE = "spark.sql.streaming.stateStore."
_SETTINGS = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.changelogCheckpointing.enabled": "true",
    _STORE + "rocksdb.boundedMemoryUsage": "true",
    _STORE + "rocksdb.maxMemoryUsageMB": "100",
    # Many small stores: space is not set aside before it is needed.
    _STORE + "rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """A missing text is empty; runs of ASCII white space count as one blank."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]++", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def arrivals(docs: DataFrame, path: str, digest=sha256, text: str = "text", doc_id: str = "doc_id") -> None:
    """Appends the documents' ``doc_id, digest, sha, place`` to ``path``: what the stream reads. Texts stay where ``place`` says."""
    whole = normalised(F.col(text))
    slim = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("_whole"), place(docs).alias("place"))
    slim.select("doc_id", digest(F.col("_whole")).alias("digest"), sha256(F.col("_whole")).alias("sha"), "place").write.mode("append").parquet(path)


def first_copies(spark: SparkSession, path: str, state: str, batch_bytes: int = 1 << 30) -> DataFrame:
    """Runs the stream over whatever is new in ``path``; returns for each digest ``digest, first, group_size``.

    The state holds for each digest its first document (the smallest ``doc_id``, then ``place``) and the number of its copies, in
    RocksDB under ``state``; no watermark, so nothing expires. Rows are combined by digest before the shuffle, so one digest
    on a third of all rows costs one row per task. A batch writes the digests it changed to its own folder ``epoch=N``,
    overwriting what a failed try of the same batch left.
    """
    changes = f"{state}/changes"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
    # Documents without an id come after all others.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("place"))).alias("first")
    held = rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/epoch={epoch}")

    with _settings(spark, _SETTINGS):
        job = held.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
        job.awaitTermination()
    latest = spark.read.schema(StructType([*held.schema.fields, StructField("epoch", LongType())])).parquet(changes)
    return latest.groupBy("digest").agg(F.max_by(F.struct("first", "group_size"), "epoch").alias("_s")).select("digest", "_s.first", "_s.group_size")


def dedup(docs: DataFrame, digest=sha256, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, place, keep_id, group_size, kept, text_sha256``, one row for each document.

    Texts are equal if identical after each run of ASCII white space became one blank; a missing text is empty. Of equal
    texts the row with the smallest ``doc_id`` stays (rows without one come last, repeated rows by their place). Digests only
    propose: the full texts of all hits are compared, and where one digest stands for different texts, these are grouped by
    their bytes. An empty table gives no row.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "exact-dedup")
    arrivals(docs, f"{folder}/arrivals", digest, text, doc_id)
    rows = spark.read.parquet(f"{folder}/arrivals")
    if rows.isEmpty():
        return rows.select("doc_id", "place", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    held = persist_table(first_copies(spark, f"{folder}/arrivals", folder), "exact-dedup-state")

    # Hits: full texts of all digests with several documents. The join splits hot digests; then each digest's rows are
    # dealt over several tasks, which reduce equal texts to one row before these meet.
    hits = held.filter("group_size > 1").select("digest")
    whole = docs.select(normalised(F.col(text)).alias("_whole"), F.col(doc_id).alias("doc_id"), place(docs).alias("place"))
    whole = whole.withColumn("digest", digest(F.col("_whole")))
    seen = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("place"))
    dealt = whole.join(hits, "digest", "left_semi").withColumn("_deal", F.pmod(F.col("place.row"), F.lit(64))).repartition("digest", "_deal")
    one = dealt.groupBy("digest", "_whole").agg(F.count(F.lit(1)).alias("_n"))
    mixed = persist_table(one.groupBy("digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("digest"), "exact-dedup-mixed")
    named = rows.join(held, "digest")
    plain = named.join(mixed, "digest", "left_anti").select("doc_id", "place", "first", "group_size", "sha")
    if mixed.isEmpty():
        result = plain
    else:
        clash = persist_table(whole.join(mixed, "digest", "left_semi"), "exact-dedup-clash")
        groups = clash.groupBy("digest", "_whole").agg(F.min(seen).alias("first"), F.count(F.lit(1)).alias("group_size"))
        apart = clash.join(groups, ["digest", "_whole"]).select("doc_id", "place", "first", "group_size", sha256(F.col("_whole")).alias("sha"))
        result = plain.unionByName(apart)
    return result.select(
        "doc_id", "place", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("first.place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    here, there = fresh(docs, "_here", "_there")
    if not has_place(docs):  # rows get one by being written
        docs = persist_table(docs, "exact-dedup-rows")
    stay = dedup(docs, text=text, doc_id=doc_id).filter("kept").select(F.col("place").alias(there))
    return docs.withColumn(here, place(docs)).join(stay, F.col(here) == F.col(there), "left_semi").drop(here)
