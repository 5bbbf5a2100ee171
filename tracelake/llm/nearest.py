"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import persist_table

#: Bits of a cell in each dimension.
BITS = 6
#: Vectors and queries that meet in one task, at most (about; they are dealt by hash) and vectors at least.
BLOCK, SMALL_BLOCK, QUERY_BLOCK = 32_768, 1_024, 2_048
#: Exact vectors read at a time.
READ = 32


def whole_vectors(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v`` with ``v`` the components as ``floor(scale * x)``.

    Rows without id or vector, or with a missing or non-finite component, take no part. A repeated row counts once; of rows with
    one id and different vectors the largest vector (in array order) counts.
    """
    x = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("_x")).filter(F.col("vec_id").isNotNull() & F.col("_x").isNotNull())
    rows = rows.select("vec_id", F.when(F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.transform("_x", lambda c: F.floor(c * float(scale)))).alias("v"))
    return rows.filter(F.col("v").isNotNull()).groupBy("vec_id").agg(F.max("v").alias("v"))


def marks(rows: DataFrame) -> dict[int, tuple[list[int], list[int]]]:
    """For each number of dimensions the smallest and largest component of each dimension: what the cells are cut from.

    A task sends one row for each dimension it has seen, whatever the number of vectors.
    """

    def bounds(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict[int, tuple] = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                v = np.array(v, dtype=np.int64)
                low, high = seen.get(len(v), (v, v))
                seen[len(v)] = (np.minimum(low, v), np.maximum(high, v))
        rows = [(n, i, int(low[i]), int(high[i])) for n, (low, high) in seen.items() for i in range(n)]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dims", "at", "low", "high"])

    ends = rows.select("v").mapInArrow(bounds, "dims long, at long, low long, high long").groupBy("dims", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, tuple[list[int], list[int]]] = {}
    for r in sorted(ends.collect(), key=lambda r: (r["dims"], r["at"])):
        low, high = out.setdefault(r["dims"], ([], []))
        low.append(r["low"])
        high.append(r["high"])
    return out


def search(vectors, queries, bounds, k: int = 5, bits: int = BITS):
    """Top ``k`` of a block for each query: ``(query_id, vec_id, score)``. Arguments are lists of ``(id, components)`` of one dimension.

    The block's vectors are first seen as cells only, which bound each score from both sides. Exact vectors are read in the order
    of their upper bounds, ties by smaller id, until the kth score beats the next bound.
    """
    import numpy as np

    ids = np.array([i for i, _ in vectors], dtype=np.int64)
    order = np.argsort(ids)
    ids, exact = ids[order], np.array([v for _, v in vectors], dtype=np.int64).reshape(len(vectors), len(bounds[0]))[order]
    low, high = (np.array(b, dtype=np.int64) for b in bounds)
    width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))
    cells = ((exact - low) // width).astype(np.uint8 if bits <= 8 else np.uint16)
    bottom = low + cells * width
    top = np.minimum(bottom + width - 1, high).astype(np.float64)
    bottom = bottom.astype(np.float64)
    largest = np.maximum(np.abs(low), np.abs(high)).astype(np.float64)
    out = []
    step = max(1, (1 << 22) // max(1, len(ids)))
    for a in range(0, len(queries), step):
        some = queries[a : a + step]
        q = np.array([v for _, v in some], dtype=np.int64).reshape(len(some), len(bounds[0]))
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        slack = 1e-9 * (np.abs(q).astype(np.float64) @ largest) + 1e-6  # rounding must not make a bound too tight
        above = up @ top.T + down @ bottom.T + slack[:, None]
        below = up @ bottom.T + down @ top.T - slack[:, None]
        for (query, _), exact_query, hi, lo in zip(some, q, above, below):
            own = np.searchsorted(ids, query)
            if own < len(ids) and ids[own] == query:
                hi[own] = lo[own] = -np.inf
            room = min(k, int(np.isfinite(hi).sum()))
            if not room:
                continue
            kth = np.partition(lo, len(lo) - room)[len(lo) - room]
            left = np.flatnonzero(hi >= kth)
            left = left[np.argsort(-hi[left], kind="stable")]
            best: list[tuple[int, int]] = []
            for at in range(0, len(left), READ):
                if len(best) == room and -best[-1][0] > hi[left[at]]:
                    break
                read = left[at : at + READ]
                best = sorted(best + [(-int(s), int(ids[i])) for i, s in zip(read, exact[read] @ exact_query)])[:room]
            out += [(query, i, -s) for s, i in best]
    return out


def top_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, bits: int = BITS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides its ``k`` highest integer inner products.

    All other rows of the same number of dimensions are candidates; ties go to the smaller id; with fewer candidates all are
    returned, and an empty table gives no row. Vectors and queries are dealt into blocks by hash; every pair of blocks is one
    small search, and a query's winners in the blocks, ``k`` for each, are ranked at last. Scores must fit a long.
    """
    spark = vectors.sparkSession
    rows = persist_table(whole_vectors(vectors, scale), "vectors").withColumn("dims", F.size("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-size["n"] // BLOCK), min(tasks, -(-size["n"] // SMALL_BLOCK)), 1)
    query_blocks = max(1, -(-size["q"] // QUERY_BLOCK))
    bounds = marks(rows)

    spread = F.xxhash64(F.col("vec_id"))
    asked = rows.filter(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.shiftright(spread, 8), F.lit(query_blocks)).cast("int").alias("asked"), "dims", F.lit(True).alias("query"), "vec_id", "v"
    )
    held = rows.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("asked"), "dims", F.lit(False).alias("query"), "vec_id", "v")

    def found(table):
        import pyarrow as pa

        flags, ids, vs = (table.column(c).to_pylist() for c in ("query", "vec_id", "v"))
        queries = sorted((i, v) for f, i, v in zip(flags, ids, vs) if f)
        others = [(i, v) for f, i, v in zip(flags, ids, vs) if not f]
        got = search(others, queries, bounds.get(len(vs[0]), ([], [])), k, bits) if queries and others else []
        columns = list(zip(*got)) if got else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    best = asked.unionByName(held).groupBy("block", "asked", "dims").applyInArrow(found, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
