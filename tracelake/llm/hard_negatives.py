"""Hard negatives by inner product: length buckets with sorted coordinate lists, pruned by feasible ranges of focus coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import persist_table

#: Vectors of one block, at most (about; they are dealt by hash) and at least, and anchors that a copy of a block serves.
BLOCK, SMALL_BLOCK, ASKED = 32_768, 1_024, 131_072
#: A length bucket ends where vectors get shorter than this share of its longest, or after this many.
SHORTER, BUCKET = 0.9, 2_048
#: Coordinates of an anchor, largest first, whose lists are looked up.
FOCUS = 5
_ROUNDING = 1e-6


class Bucket:
    """Vectors of about one length. ``lists[f]`` holds the unit vectors' coordinate ``f`` in ascending order, and whose it is."""

    def __init__(self, ids, labels, exact, norms):
        import numpy as np

        self.np, self.ids, self.labels, self.exact = np, ids, labels, exact
        self.longest, self.shortest = float(norms[0]), float(norms[-1])
        self.rounded = exact.astype(np.float64)
        self.unit = self.rounded / np.where(norms > 0, norms, 1.0)[:, None]
        self.peak = int(np.abs(exact).max(initial=0))
        self.lists: dict[int, tuple] = {}

    def coordinate(self, f: int):
        if f not in self.lists:
            order = self.np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = (self.unit[order, f], order)
        return self.lists[f]

    def feasible(self, anchor, length: float, least: float):
        """Rows that can reach the score ``least``: those in the feasible range of every focus coordinate.

        At an angle of at most ``t`` from the anchor, which is at ``a`` from the axis, a unit vector's coordinate lies between
        ``cos(a + t)`` and ``cos(a - t)``.
        """
        np = self.np
        every = np.arange(len(self.ids))
        if least == -np.inf or length == 0 or self.shortest == 0:
            return every
        cosine = least / (length * (self.longest if least > 0 else self.shortest))
        if cosine > 1 + _ROUNDING:
            return every[:0]
        if cosine <= -1:
            return every
        angle = np.arccos(min(1.0, cosine)) + _ROUNDING
        unit = anchor / length
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            axis = np.arccos(min(1.0, max(-1.0, unit[f])))
            values, order = self.coordinate(f)
            first = np.searchsorted(values, np.cos(min(np.pi, axis + angle)) - _ROUNDING, "left")
            end = np.searchsorted(values, np.cos(max(0.0, axis - angle)) + _ROUNDING, "right")
            if end - first < len(values):
                ranges.append(order[first:end])
        if not ranges:
            return every
        seen = np.zeros(len(self.ids), dtype=np.int8)
        for rows in ranges:
            seen[rows] += 1
        return np.flatnonzero(seen == len(ranges))

    def scores(self, rows, anchor, rounded, peak: int):
        if self.peak * peak * len(anchor) < 1 << 53:  # then floating point is exact
            return (self.rounded[rows] @ rounded).astype(self.np.int64)
        return self.exact[rows] @ anchor


class Block:
    def __init__(self, ids, labels, exact):
        import numpy as np

        self.np = np
        norms = np.sqrt((exact.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        ids, labels, exact, norms = ids[order], labels[order], exact[order], norms[order]
        self.buckets, start = [], 0
        while start < len(ids):
            end = start + int(np.searchsorted(-norms[start : start + BUCKET], -SHORTER * norms[start], "right"))
            self.buckets.append(Bucket(ids[start:end], labels[start:end], exact[start:end], norms[start:end]))
            start = end

    def search(self, anchor_id: int, label: int, anchor, wants: list[tuple], same: bool, k: int) -> list[list[tuple[int, int]]]:
        """For each ``(lowest, highest)`` score the first ``k`` rows ``(score, id)`` with the anchor's label, or with another one.

        Buckets come longest first. A want's bound is its lowest score until it holds ``k`` rows, then the worst of them.
        """
        np = self.np
        rounded = anchor.astype(np.float64)
        length, peak = float(np.sqrt((rounded**2).sum())), int(np.abs(anchor).max(initial=0))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in wants]
        bounds = [-np.inf if low is None else low for low, _ in wants]
        for bucket in self.buckets:
            least = min(bounds)
            if least > 0 and length * bucket.longest * (1 + _ROUNDING) < least:
                break
            rows = bucket.feasible(rounded, length, least)
            rows = rows[((bucket.labels[rows] == label) == same) & (bucket.ids[rows] != anchor_id)]
            if not len(rows):
                continue
            scores, ids = bucket.scores(rows, anchor, rounded, peak), bucket.ids[rows]
            for i, (_, high) in enumerate(wants):
                good = scores >= bounds[i]
                if high is not None:
                    good &= scores <= high
                if good.any():
                    s, d = np.concatenate([best[i][0], scores[good]]), np.concatenate([best[i][1], ids[good]])
                    first = np.lexsort((d, -s))[:k]
                    best[i] = (s[first], d[first])
                    if len(first) == k:
                        bounds[i] = int(s[first[-1]])
        return [list(zip(s.tolist(), d.tolist())) for s, d in best]


def labelled(vectors: DataFrame, label: Column, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, label, v, dims`` of the rows that take part, one for each id."""
    x = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    cells = F.transform("x", lambda c: F.floor(c * float(scale)))
    one = rows.groupBy("vec_id").agg(F.max(F.struct("label", cells.alias("v"))).alias("row"))
    return one.select("vec_id", "row.label", "row.v", F.size("row.v").alias("dims"))


def _found(rows: DataFrame, anchors: DataFrame, size: dict, same: bool, k: int) -> DataFrame:
    """``anchor_id, want, vec_id, score``: the first ``k`` of each block for each want of each anchor (``vec_id, label, v, dims, wants``).

    Rows are dealt to blocks by hash, so all blocks hold alike much, whatever the lengths and labels. A task keeps one block; its
    anchors come after it as a stream and are never held together.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, kinds = ["anchor_id", "want", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        key, parts, block = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("block", "asked", "dims", "is_anchor")], axis=1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:]):
                *place, is_anchor = keys[a].tolist()
                if place != key:
                    key, parts, block = place, [], None
                some = table.slice(a, b - a)
                ids, labels = some.column("vec_id").to_numpy(), some.column("label").to_numpy()
                exact = some.column("v").combine_chunks().flatten().to_numpy().reshape(b - a, key[2])
                if not is_anchor:
                    parts.append((ids, labels, exact))
                    continue
                if block is None and parts:
                    block = Block(*(np.concatenate(p) for p in zip(*parts)))
                    parts = []
                if block is None:
                    continue
                wants = some.column("wants").to_pylist()
                for i, own, v, asked in zip(ids.tolist(), labels.tolist(), exact, wants):
                    ranges = [(w["low"], w["high"]) for w in asked]
                    for want, got in enumerate(block.search(i, own, v, ranges, same, k)):
                        out += [(i, want, d, s) for s, d in got]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    spread, wants = F.xxhash64("vec_id"), "array<struct<low:bigint,high:bigint>>"
    key = {"block": F.pmod(spread, F.lit(size["blocks"])), "asked": F.pmod(F.shiftright(spread, 20), F.lit(size["asked"]))}
    columns = ["dims", "vec_id", "label", "v"]
    held = rows.withColumn("block", key["block"]).withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(size["asked"] - 1))))
    held = held.select("block", F.col("asked").cast("long"), F.lit(0).alias("is_anchor"), *columns, F.lit(None).cast(wants).alias("wants"))
    asking = anchors.withColumn("asked", key["asked"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(size["blocks"] - 1))))
    asking = asking.select(F.col("block").cast("long"), "asked", F.lit(1).alias("is_anchor"), *columns, F.col("wants").cast(wants))
    place = ["block", "asked", "dims"]
    met = held.unionByName(asking).repartition(*place).sortWithinPartitions(*place, "is_anchor", "vec_id")
    best = met.mapInArrow(run, "anchor_id long, want int, vec_id long, score long")
    # Each block has sent k rows at most for each want.
    order = Window.partitionBy("anchor_id", "want").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, every: int = 100, label: Column | None = None, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components count as ``floor(scale * x)``, scores are integer inner products, ties go to the smaller id. Anchors are the rows whose id
    ``every`` divides. The first ``positives`` other rows of an anchor's label are its positives, and for each of them the first
    ``negatives`` rows of other labels come out whose score is ``low`` to ``high`` per cent of the positive's; with fewer all of them, and
    with none no row.

    Rows without id, label or vector, or with a missing or non-finite component, take no part. Only rows with as many components as the
    anchor meet it. A repeated row counts once; of different rows with one id the one with the largest label, then vector (in array
    order) counts. An empty table gives no row. Scores must fit a long. Columns beyond the three are not looked at.

    Both searches are exact. Nothing is broadcast: anchors are sent to every block of rows, and blocks once for every ``ASKED`` anchors.
    """
    spark = vectors.sparkSession
    rows = persist_table(labelled(vectors, F.col("label") if label is None else label, scale, vec_id, embedding), "vectors")
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = {"blocks": max(-(-held["n"] // BLOCK), min(tasks, -(-held["n"] // SMALL_BLOCK)), 1), "asked": max(1, -(-held["anchors"] // ASKED))}
    anchors = rows.filter(F.col("vec_id") % every == 0)

    anything = F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    near = persist_table(_found(rows, anchors.withColumn("wants", anything), size, True, positives), "positives")
    # In whole numbers: low * positive <= 100 * negative <= high * positive.
    least = F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100")
    most = F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100")
    asked = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score", least.alias("low"), most.alias("high")))).alias("wants"))
    asking = anchors.join(asked, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    ranges = F.transform("wants", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high")))
    far = _found(rows, asking.withColumn("wants", ranges), size, False, negatives)
    far = far.select("anchor_id", (F.col("want") + 1).alias("_want"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("anchor_id", F.col("rank").alias("_want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["anchor_id", "_want"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
