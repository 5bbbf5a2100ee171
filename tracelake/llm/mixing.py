"""Mixing sources to target weights by Pareto order sampling, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import fresh, has_place, place
from tracelake.session import persist_table

#: Ranking values are cut into this many classes; only the class at a source's limit is ordered row by row.
CLASSES = 1 << 16
_ROW = (1 << 33) - 1
#: Documents that fill what the ranked ones leave of a source's target.
FILLERS = 4


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space. Each run becomes one letter, so no list of words is built."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]++", "")).cast("long")


def numbered_sources(base: DataFrame) -> DataFrame:
    """``source, source_size`` and the source's place ``number`` (from 0) by code point, null last.

    Sources are sorted in parallel; only the tasks' row counts meet in one task.
    """
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = persist_table(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_at", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = listed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return listed.withColumn("_part", part).join(offsets, "_part").select("source", "source_size", (F.col("_before") + F.col("_at").bitwiseAND(_ROW)).alias("number"))


def targets(sources: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """Adds ``target``: all words shared by weight, no source above ``limit`` times its own, the excess shared again.

    A round asks for three sums over the sources; each round but the last caps at least one more of them. Sums and
    comparisons are of whole numbers, so that reruns agree.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    rows = persist_table(sources.withColumn("_weight", weight), "mix-weights")
    wide, most = "decimal(38,0)", F.col("source_size") * limit
    left, share = None, 0
    capped = F.lit(False)
    while True:
        got = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, most)).alias("capped"),
            F.sum(F.when(~capped, F.col("_weight"))).alias("weights"),
        ).first()
        now = ((got["all"] or 0) - (got["capped"] or 0), got["weights"] or 0)
        if now == (left, share) or not now[1]:
            break
        left, share = now
        capped = most.cast(wide) * F.lit(share).cast("decimal(18,0)") < F.col("_weight").cast("decimal(18,0)") * F.lit(left).cast("decimal(18,0)")
    fair = (F.col("_weight") * F.lit(left or 0)).cast("double") / F.lit(float(share or 1))
    return rows.select("source", "source_size", "number", F.when(capped, most.cast("double")).otherwise(fair).alias("target"))


def length_class(size: Column) -> Column:
    """A document's weight within its source: one more for each doubling of its words."""
    return F.length(F.bin(size)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: str = "mix", size: Column | None = None, importance=length_class, doc_id: str = "doc_id", source: str = "source", row: Column | None = None) -> DataFrame:
    """Which documents the mix takes, and how often: ``doc_id, source, size, source_size, target, copies, taken, row``.

    A source's target is met in two steps. Its documents expect ``least(limit, f * importance)`` copies, with ``f`` such that
    the expected words are the target; the whole copies are certain. What is left is the inclusion chance ``p`` of one more
    copy. Pareto order sampling ranks by ``u / (1 - u) * (1 - p) / p``, ``u`` a uniform number from the hash of ``doc_id``,
    and takes documents in that order while their words fit what the whole copies leave. A few more (``FILLERS``) of the
    others narrow the gap: each the largest that fits, the last the one that comes nearest.

    ``size`` is the number of words by default; ``importance`` maps it to a whole number of few distinct values. Missing texts have
    size 0 and take nothing; documents without a source form one; rows without ``doc_id`` and repeated rows are rows of
    their own, ordered by their place in the input on ties. An empty table gives no row.

    No source is brought into one task: sums go by source and class of ranking values, and only the class at the
    limit is ordered.
    """
    size = word_count(F.col("text")) if size is None else size
    # ``row`` comes back with each row, for a caller that wants to find it again.
    row = F.lit(None) if row is None else row
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), row.cast("struct<file: string, row: bigint>").alias("row"))
    base = persist_table(base.withColumn("_row", F.monotonically_increasing_id()), "mix-documents")
    plan = persist_table(targets(numbered_sources(base), weights, limit), "mix-targets")

    rows = base.withColumn("_class", importance(F.col("size")))
    classes = rows.groupBy("source", "_class").agg(F.sum("size").alias("_words"))
    same = classes["source"].eqNullSafe(plan["source"])
    classes = classes.join(plan, same).select("number", "source_size", "target", "_class", "_words", plan["source"])
    upper = Window.partitionBy("number").orderBy(F.desc("_class"))
    above = F.coalesce(F.sum("_words").over(upper.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_class") * F.col("_words")).over(upper.rowsBetween(0, Window.unboundedFollowing))
    factor = F.try_divide(F.col("target") - limit * F.col("_above"), F.col("_rest"))
    classes = classes.withColumn("_above", above).withColumn("_rest", rest).withColumn("_f", F.when(F.col("_rest") > 0, factor))
    # The highest class that stays under the limit fixes the factor; where none does, everything is taken to the limit.
    fits = F.when(F.col("_f") * F.col("_class") <= limit, F.struct("_class", "_f"))
    classes = classes.withColumn("_f", F.coalesce(F.max(fits).over(Window.partitionBy("number"))["_f"], F.lit(float(limit))))
    expected = F.least(F.lit(float(limit)), F.greatest(F.lit(0.0), F.col("_f") * F.col("_class")))
    classes = classes.withColumn("_whole", F.floor(expected)).withColumn("_p", expected - F.col("_whole"))
    left = F.col("target") - F.sum(F.col("_whole") * F.col("_words")).over(Window.partitionBy("number"))
    classes = persist_table(classes.withColumn("_left", left).select("source", "number", "source_size", "target", "_class", "_whole", "_p", "_left"), "mix-classes")

    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rank = (u / (1 - u)) * F.try_divide(1 - F.col("_p"), F.col("_p"))
    drawn = rows.join(classes, rows["source"].eqNullSafe(classes["source"]) & (rows["_class"] == classes["_class"])).select(
        "_row", "row", "doc_id", rows["source"], "size", "number", "source_size", "target", "_whole", "_left", F.when((F.col("_p") > 0) & (F.col("size") > 0), rank).alias("_rank")
    )
    drawn = persist_table(drawn.withColumn("_slot", F.floor(F.col("_rank") / (1 + F.col("_rank")) * CLASSES)), "mix-ranks")

    open_rows = drawn.filter(F.col("_rank").isNotNull())
    order = Window.partitionBy("number").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = open_rows.groupBy("number", "_slot", "_left").agg(F.sum("size").alias("_words")).withColumn("_upto", F.sum("_words").over(order))
    cut = (
        slots.filter(F.col("_upto") > F.col("_left"))
        .groupBy("number")
        .agg(F.min_by(F.struct("_slot", (F.col("_upto") - F.col("_words")).alias("_before")), "_slot").alias("_c"))
        .select("number", F.col("_c._slot").alias("_cut"), F.col("_c._before").alias("_before"))
    )
    marked = drawn.join(cut, "number", "left")
    last = marked.filter(F.col("_slot") == F.col("_cut"))
    running = F.sum("size").over(Window.partitionBy("number").orderBy("_rank", "_row").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("_upto", F.col("_before") + running).select("_row", "size", "number", (F.col("_upto") <= F.col("_left")).alias("_in"), "_upto")
    last = persist_table(last, "mix-limits")
    taken = last.filter("_in").groupBy("number").agg(F.max("_upto").alias("_taken"))
    gaps = cut.join(taken, "number", "left").select("number", "_cut", F.coalesce("_taken", "_before").alias("_taken"))
    # Candidates for the last gap: every document behind the limit, those of the class at the limit as far as not taken.
    behind = open_rows.join(gaps, "number").filter(F.col("_slot") >= F.col("_cut"))
    behind = behind.join(last.filter("_in").select("_row"), "_row", "left_anti").withColumn("_gap", F.col("_left") - F.col("_taken"))
    behind = persist_table(behind.select("number", "_row", "_rank", "size", "_gap").filter("size < 2 * _gap"), "mix-gaps")
    extra = last.filter("_in").select("_row")
    for turn in range(FILLERS):
        # The largest document that fits; at last the one that comes nearest, even if it is too large.
        off = F.abs(F.col("_gap") - F.col("size"))
        near = behind.filter(off < F.col("_gap")) if turn == FILLERS - 1 else behind.filter(F.col("size") <= F.col("_gap"))
        found = near.groupBy("number").agg(F.min(F.struct(off.alias("_off"), F.col("_rank"), F.col("_row").alias("_fill"))).alias("_f"))
        found = persist_table(found.select("number", "_f._off", "_f._fill"), "mix-fill")
        extra = extra.unionByName(found.select(F.col("_fill").alias("_row")))
        left_over = behind.join(found, "number").filter(F.col("_row") != F.col("_fill"))
        behind = left_over.select("number", "_row", "_rank", "size", F.col("_off").alias("_gap"))
    extra = extra.withColumn("_extra", F.lit(True))
    result = marked.join(extra, "_row", "left")
    chosen = F.coalesce(F.col("_slot") < F.coalesce(F.col("_cut"), F.lit(CLASSES + 1)), F.lit(False)) | F.coalesce("_extra", F.lit(False))
    copies = (F.col("_whole") + chosen.cast("long")).cast("long")
    return result.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns."""
    if not has_place(docs):  # rows get one by being written
        docs = persist_table(docs, "mix-rows")
    here, chosen, copies, again = fresh(docs, "_here", "_chosen", "_copies", "_again")
    taken = mix(docs, row=place(docs), **settings).filter("copies > 0").select(F.col("row").alias(chosen), F.col("copies").alias(copies))
    rows = docs.withColumn(here, place(docs)).join(taken, F.col(here) == F.col(chosen))
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(here, chosen, copies, again)
