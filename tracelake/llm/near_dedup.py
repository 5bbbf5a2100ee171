"""Near-duplicate documents by banded MinHash, sequential Bayesian pruning and exact verification.

1. Each document becomes a set of shingle hashes, a signature of ``rows * bands`` minima (one byte of each is kept) and a key for each band.
   Documents with equal sets are one class from here on, represented by the smallest id.
2. Classes that share a band's key are candidates. Inside a bucket signatures are compared in batches; after each batch the pairs
   whose similarity is at least the threshold only with a small posterior chance are dropped (``layout``). What survives links
   classes to families. A bucket is cut into blocks; a block returns the links of a spanning forest only, and blocks that hold more than one component then
   meet pairwise to link what is not connected yet.
3. The full sets of a family's classes meet in blocks again. Pairs that survive the same test and are not yet connected are verified
   on their sets. Again a task returns a spanning forest, and the forests' components are the result.

Never are the pairs of a group written out as rows: what leaves a task is fewer rows than it read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import by_group, fresh, worker_cache
from tracelake.llm.encoding import slices
from tracelake.llm.shingles import Shingler, mix
from tracelake.session import persist_table

#: Chance at which a pair at the threshold may be lost, by bands and by pruning together, and signature bytes compared at a time.
MISS, BATCH = 1e-4, 16
#: Minima of a signature, at most; and in a band.
MOST_MINIMA, MOST_ROWS = 150, 8
#: Classes of a bucket or family that one task holds from either side.
BLOCK = 512


def sketch(docs: DataFrame, size: int, text: str = "text", doc_id: str = "doc_id", rows: int = 6, bands: int = 24) -> DataFrame:
    """``doc_id, n_shingles, digest, signature, bands`` for every row; without shingles the last three are null."""

    def run(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        shingler = worker_cache(f"shingler:{size}", lambda: Shingler(size))
        k = rows * bands
        factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        offsets = mix(np.arange(k + 1, 2 * k + 1, dtype=np.uint64))
        weights = mix(np.arange(7, rows + 7, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = shingler.sets(texts[a:b])
                n = [len(s) for s in sets]
                full = [i for i, m in enumerate(n) if m]
                signatures, named = [None] * len(n), [None] * len(n)
                if full:
                    every = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum([n[i] for i in full])])[:-1]
                    low = np.empty((len(full), k), dtype=np.uint64)
                    work = np.empty_like(every)
                    for j in range(k):
                        np.multiply(every, factors[j], out=work)
                        np.bitwise_xor(work, offsets[j], out=work)
                        low[:, j] = np.minimum.reduceat(work, at)
                    bytes_ = (low >> np.uint64(24)).astype(np.uint8)
                    keys = mix((low.reshape(len(full), bands, rows) * weights).sum(axis=2, dtype=np.uint64)).astype(np.int64)
                    for row, i in enumerate(full):
                        signatures[i], named[i] = bytes_[row].tobytes(), keys[row]
                digests = [sha256(s.tobytes()).digest() if len(s) else None for s in sets]
                columns = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(named, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "signature", "bands"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>")


def least_matches(threshold: float, length: int, miss: float = MISS, batch: int = BATCH) -> list[tuple[int, int]]:
    """For each number of compared bytes the least matches with which a pair stays.

    The chance that bytes agree is ``c = J + (1 - J) / 256``; before any comparison all ``c`` are equally likely, after ``m`` matches of ``t``
    its density goes with ``c ** m * (1 - c) ** (t - m)``. A pair stays if ``c`` reaches the threshold's with a chance above ``miss``.
    """
    import numpy as np

    c = (np.arange(20_000) + 0.5) / 20_000
    high = c >= threshold + (1 - threshold) / 256
    out = []
    for t in [*range(batch, length, batch), length]:
        for m in range(t + 1):
            log = m * np.log(c) + (t - m) * np.log1p(-c)
            density = np.exp(log - log.max())
            if density[high].sum() > miss * density.sum():
                break
        out.append((t, m))
    return out


def lost(bounds: list[tuple[int, int]], threshold: float) -> float:
    """The chance that a pair at the threshold is pruned by any of the ``bounds``."""
    import numpy as np

    agree, alive, before = threshold + (1 - threshold) / 256, np.ones(1), 0
    for t, least in bounds:
        for _ in range(t - before):
            alive = np.append(alive, 0.0) * (1 - agree) + np.append(0.0, alive) * agree
        alive[:least] = 0.0
        before = t
    return 1.0 - float(alive.sum())


def layout(threshold: float) -> tuple[int, int, list[tuple[int, int]]]:
    """Rows and bands of the signature and the bounds of its batches, so that a pair at the threshold is lost with chance ``MISS`` at most."""
    from math import ceil, log, log1p

    def bands_of(rows):
        shared = max(threshold, 0.01) ** rows
        return 1 if shared >= 1 else ceil(log(MISS / 8) / log1p(-shared))

    rows = max((r for r in range(1, MOST_ROWS + 1) if r * bands_of(r) <= MOST_MINIMA), default=1)
    bands, miss = bands_of(rows), MISS
    apart = (1 - min(threshold, 1.0) ** rows) ** bands if threshold > 0.01 else MISS / 8
    while True:
        bounds = least_matches(threshold, rows * bands, miss)
        if apart + lost(bounds, threshold) <= MISS:
            return rows, bands, bounds
        miss /= 2


class Groups:
    """Disjoint sets of numbers, named by their smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def compare(ids, signatures, left, right, bounds, groups: Groups, verify=None) -> None:
    """Joins the ``groups`` of plausible pairs between rows ``left`` and ``right`` (the same list: each pair once).

    Each row's signature meets those of all rows not yet connected with it, batch by batch. ``verify(i, j)`` has the last word.
    """
    import numpy as np

    same = left is right
    for place, i in enumerate(left):
        others = np.array(right[place + 1 :] if same else right, dtype=np.int64)
        own = groups.find(i)
        others = others[[groups.find(j) != own for j in others.tolist()]] if len(others) else others
        matches, before = np.zeros(len(others), dtype=np.int64), 0
        for t, least in bounds:
            if not len(others):
                break
            matches += (signatures[others, before:t] == signatures[i, before:t]).sum(axis=1)
            keep = matches >= least
            others, matches, before = others[keep], matches[keep], t
        for j in others[np.argsort(-matches, kind="stable")].tolist():
            if groups.find(i) != groups.find(j) and (verify is None or verify(i, j)):
                groups.join(i, j)


def _sides(side) -> tuple[list[int], list[int]]:
    """Places of the rows of either block; twice the same list if there is one block only."""
    import numpy as np

    own = np.flatnonzero(side == side.min()).tolist()
    return own, np.flatnonzero(side != side.min()).tolist() or own


def _meet(table, ids, signatures, side, label, bounds, verify=None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the labels, each the name of rows that hang together already."""
    groups, (own, other) = Groups(len(ids)), _sides(side)
    first: dict[int, int] = {}
    for place, name in enumerate(label.tolist()):
        groups.join(first.setdefault(name, place), place)
    known = [groups.find(i) for i in range(len(ids))]
    if other is not own or table.column("i")[0] == table.column("j")[0]:
        compare(ids, signatures, own, other, bounds, groups, verify)
    named = label.tolist()
    # Of each known group its first row stands for the rest.
    return [(named[i], named[groups.find(i)]) for i in range(len(named)) if known[i] == i and groups.find(i) != i]


def dealt(rows: DataFrame, group: list[str], times: int, member: str = "rep", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows of groups (``n`` of them) in blocks, ``i, j, side`` added: each block by itself. And the rows of groups of several blocks, ``room`` added.

    Each group is dealt in its own way, so that blocks of groups with the same rows overlap; groups of several blocks are dealt ``times`` times.
    """
    number = F.ceil(F.col("n") / F.lit(block))
    first = F.pmod(F.xxhash64(member, *group), number).cast("long")
    again = [-1 - t - (times - 1) * F.pmod(F.xxhash64(member, *group, F.lit(t)), number).cast("long") for t in range(times - 1)]
    own = F.when(F.col("n") > block, F.array(first, *again)).otherwise(F.array(first))
    plain = [c for c in rows.columns if c != "n"]
    alone = rows.select(*plain, F.explode(own).alias("i")).withColumns({"j": F.col("i"), "side": F.col("i")})
    return alone, rows.filter(F.col("n") > block).select(*plain, F.lit(block).alias("room"))


def paired(several: DataFrame, group: list[str], found: DataFrame) -> DataFrame | None:
    """Rows of groups of several blocks for all pairs of blocks that may still link something: ``label, i, j, side`` added; none if each group has one label.

    Blocks are dealt anew. A label (``found`` has ``rep, label``; other rows are their own) of more than a block's rows has blocks to itself, which never meet each other; the rest share
    blocks, which meet by themselves too. So the rows of a group that hangs together but for a few come once for each block of these few.
    """
    several = several.join(found, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    kinds = several.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("_same"), F.max("room").alias("room"))
    mixed = kinds.filter("_same <= room").groupBy(*group).agg(F.ceil(F.sum("_same") / F.max("room")).alias("_shared"))
    kinds = kinds.join(mixed, group, "left").withColumn("_whole", F.col("_same") > F.col("room"))
    # Shared blocks have small numbers, a label's own ones hashes.
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_same") / F.col("room")) - 1), lambda k: F.xxhash64("label", k))
    shared = F.array(F.pmod(F.xxhash64("label"), F.col("_shared")).cast("long"))
    kinds = persist_table(kinds.select(*group, "label", "_whole", F.when(F.col("_whole"), own).otherwise(shared).alias("_blocks")), "block-labels")
    if kinds.groupBy(*group).count().filter("count > 1").isEmpty():
        return None
    blocks = kinds.select(*group, F.explode("_blocks").alias("id"), F.when(F.col("_whole"), F.col("label")).alias("of")).distinct()
    blocks = blocks.groupBy(*group).agg(F.collect_list(F.struct("id", "of")).alias("_there"))
    rows = several.join(kinds, [*group, "label"]).join(blocks, group)
    rows = rows.withColumn("side", F.element_at("_blocks", (F.pmod(F.xxhash64("rep"), F.size("_blocks")) + 1).cast("int")))
    others = F.filter("_there", lambda b: F.when(F.col("_whole"), ~b["of"].eqNullSafe(F.col("label"))).otherwise(F.lit(True)))
    rows = rows.withColumn("_other", F.explode(F.transform(others, lambda b: b["id"])))
    return rows.select(*(c for c in several.columns if c != "room"), F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"), "side")


def linked(rows: DataFrame, group: list[str], sizes: DataFrame, fn, name: str, more: DataFrame | None = None, times: int = 1) -> DataFrame:
    """Links ``a, b`` by which the rows of each group hang together, ``b`` the smallest row of a component: blocks first, with the links in ``more``, then pairs of blocks.

    Pairs of blocks meet with the components that blocks have found (``sizes`` holds each group's ``n``), and return only what links two of them, by their names. A group of copies is linked by its
    blocks: its links grow with its rows, not with its pairs of blocks. Rows dealt more ``times`` link blocks that overlap, and leave fewer components to meet.
    """
    alone, several = dealt(rows, group, times)
    own = F.col("rep").alias("label")
    links = by_group(alone.select("*", own), [*group, "i", "j"], fn, "a long, b long")
    found = components(links if more is None else links.unionByName(more), name).toDF("a", "b")
    if dealt(sizes.select("n", F.lit(0).alias("rep")), [], 1)[1].isEmpty():
        return found
    met = paired(several, group, found.toDF("rep", "label"))
    if met is None:
        return found
    met = components(by_group(met, [*group, "i", "j"], fn, "a long, b long"), f"{name}-met")
    if met.isEmpty():
        return found
    # What blocks have left alone is not among the found ones.
    return persist_table(found.join(met, F.col("b") == F.col("node"), "full_outer").select(F.coalesce("a", "node").alias("a"), F.coalesce("component", "b").alias("b")), name)


def components(links: DataFrame, label: str) -> DataFrame:
    """``node, component`` for links ``a, b``, a component named by its smallest node.

    Each node hangs on the smallest one around, and takes the name at the end of that chain. Links between the names go on to the next round,
    those inside a name are done: a link is read once, and after two rounds at most half of the nodes are left.
    """
    links = persist_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = None
    while True:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Kept before its names are joined with each other: a small table is then broadcast instead of shuffled for each of these joins.
        least = persist_table(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), label)
        step = chased(least, label)
        if names is None:
            names = step
        else:
            further = names.join(step.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
            names = persist_table(further.select("node", F.coalesce("further", "component").alias("component")), label)
        left = links.join(step.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        left = left.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        links = persist_table(left, f"{label}-links")
        if links.isEmpty():
            return names


def chased(names: DataFrame, label: str) -> DataFrame:
    """``node, component`` with each name replaced by its own name, and so on to the end of the chain; chains shorten to a third at a time."""
    while True:
        jump = names.select(F.col("node").alias("component"), F.col("component").alias("before"))
        again = names.select(F.col("node").alias("before"), F.col("component").alias("further"))
        now = names.join(jump, "component").select("node", "before").join(again, "before").select("node", "before", F.col("further").alias("component"))
        now = persist_table(now, label)
        names = now.select("node", "component")
        if now.filter("component < before").isEmpty():
            return names


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each document.

    Documents are linked if ``100 * common >= threshold * all`` for their sets of ``size``-word shingles; a component's id is its
    smallest document. With fewer words than ``size`` the whole sequence is one shingle; without words or text the set is empty, and the
    document is alone. Rows without ``doc_id`` are alone too (component null, kept); rows with one id and different texts are
    connected through it; repeated rows come out as often as they came in. An empty table gives no row.
    """
    rows, bands, bounds = layout(threshold / 100)
    sketches = persist_table(sketch(docs, size, text, doc_id, rows, bands), "sketches")
    full = sketches.filter("n_shingles > 0 and doc_id is not null")
    # One row for each class, whose signature and bands are those of any of its documents; its id may occur with other texts, so classes are named by place, not by document.
    heads = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    heads = persist_table(heads.select(F.xxhash64("digest").alias("rep"), "digest", "doc_id", "signature", "bands"), "class-heads")

    keyed = heads.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).filter("n > 1")
    shared = persist_table(shared, "buckets")
    signed = heads.select("rep", "signature")

    def plausible(table):
        import numpy as np

        ids = np.array(table.column("rep"), dtype=np.int64)
        order = np.argsort(ids)
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        return _meet(table, ids[order], signatures[order], np.array(table.column("side"))[order], np.array(table.column("label"))[order], bounds)

    # Two members are a pair whatever the band: most pairs share several. Their ids name the bucket.
    pairs = shared.filter("n = 2").select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("rep"), F.col("a").alias("band"), F.col("b").alias("key"), F.lit(2).cast("long").alias("n"))
    members = keyed.join(shared.filter("n > 2").select("band", "key", "n"), ["band", "key"]).withColumn("band", F.col("band").cast("long"))
    members = members.unionByName(pairs).join(signed, "rep")
    members = members if shared.filter(F.col("n") > BLOCK).isEmpty() else persist_table(members, "bucket-members")
    families = linked(members, ["band", "key"], shared, plausible, "families").toDF("node", "component")
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = families.join(sizes, "component").withColumnRenamed("node", "rep").join(heads.select("rep", "signature", "doc_id", "digest"), "rep")
    placed = persist_table(placed, "family-members")

    def full_sets(batches):
        from hashlib import sha256

        import pyarrow as pa

        shingler = worker_cache(f"shingler:{size}", lambda: Shingler(size))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keep, sets = [], []
            for a, b in slices(texts):
                for i, s in enumerate(shingler.sets(texts[a:b]), a):
                    # An id that occurs with several texts: only the one of this class.
                    if sha256(s.tobytes()).digest() == batch.column("digest")[i].as_py():
                        keep.append(i)
                        sets.append(s.tobytes())
            some = batch.take(pa.array(keep, pa.int64()))
            columns = [some.column(c) for c in ("rep", "component", "n", "signature")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], ["rep", "component", "n", "signature", "shingles"])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = texts.join(placed, "doc_id").select("text", "rep", "component", "n", "signature", "digest")
    # Read by the blocks and again by their pairs.
    sets = wanted.mapInArrow(full_sets, "rep long, component long, n long, signature binary, shingles binary")
    sets = sets if sizes.filter(F.col("n") > BLOCK).isEmpty() else persist_table(sets, "full-sets")

    def verified(table):
        import numpy as np

        ids, first = np.unique(np.array(table.column("rep"), dtype=np.int64), return_index=True)
        side, label = (np.array(table.column(c))[first] for c in ("side", "label"))
        raw = table.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in first.tolist()]
        bytes_ = table.column("signature").to_pylist()
        signatures = np.frombuffer(b"".join(bytes_[i] for i in first.tolist()), dtype=np.uint8).reshape(len(ids), -1)
        _, places = np.unique(np.concatenate(sets), return_inverse=True)
        places = np.split(places, np.cumsum([len(s) for s in sets])[:-1])
        marked, whose = np.zeros(max(int(p.max()) for p in places) + 1, dtype=bool), -1

        def similar(i, j):
            nonlocal whose
            if whose != i:
                if whose >= 0:
                    marked[places[whose]] = False
                marked[places[i]] = True
                whose = i
            common = int(marked[places[j]].sum())
            return 100 * common >= threshold * (len(places[i]) + len(places[j]) - common)

        return _meet(table, ids, signatures, side, label, bounds, similar)

    found = linked(sets, ["component"], sizes, verified, "components", times=2).toDF("rep", "component")
    # A component's id is the smallest of its classes' documents.
    named = persist_table(heads.select("rep", "digest", "doc_id").join(found, "rep", "left").select("digest", "doc_id", F.coalesce("component", "rep").alias("component")), "class-names")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("digest", "doc_id", "component_id")
    # Ids that occur with several texts tie classes together.
    several = persist_table(full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id"), "several-texts")
    if not several.isEmpty():
        ties = full.join(several, "doc_id", "left_semi").select("digest", F.col("doc_id").alias("a")).join(named.select("digest", F.col("doc_id").alias("b")), "digest").select("a", "b")
        tied = components(named.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(ties), "ties").toDF("doc_id", "tied")
        named = named.join(tied, "doc_id").select("digest", F.col("tied").alias("component_id"))
    joined = sketches.select("doc_id", "n_shingles", "digest").join(named.select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, threshold: int = 80, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document stays: one of each component. Repeated rows of a document that stays all stay."""
    (name,) = fresh(docs, "_gone")
    gone = near_duplicates(docs, size, threshold, doc_id=doc_id).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")
