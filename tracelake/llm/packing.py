"""Sum-of-squares packing of documents into training windows, in rounds of bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.encoding import encoder, slices
from tracelake.session import persist_table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that one task of a later round places, about (they are dealt by hash), and pieces that one task pours out with their ids.
GROUP, POUR = 200_000, 20_000
#: A pass that leaves more than this share of its pieces in open windows is the last one over them.
SHRINKS = 0.9


class Packer:
    """Windows of ``size`` tokens, filled online.

    ``levels[h]`` counts the open windows filled to ``h``. A piece of ``s`` tokens goes to the level (0: a new window) for which
    the sum of the squared counts grows least; on a tie to the fullest one. Full windows leave at once, so memory holds
    the open ones only, about one for each level at most times a small factor.
    """

    def __init__(self, size: int, first_id: int):
        import numpy as np

        self.np, self.size, self.next_id = np, size, first_id
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def add(self, piece: tuple, s: int):
        """Places a piece; returns the window as a list of pieces if it is full now."""
        if s >= self.size:
            return [piece]
        np, levels, size = self.np, self.levels, self.size
        cost = 2 * levels[s : size + 1] + 1  # of the level that gains a window
        cost[-1] = 0  # full windows are not counted
        cost[1:] -= 2 * levels[1 : size + 1 - s] - 1  # of the level that loses one
        cost[1:][levels[1 : size + 1 - s] == 0] = np.iinfo(np.int64).max
        at = size - s - int(np.argmin(cost[::-1]))
        window = self.open[at].pop() if at else []
        if at:
            levels[at] -= 1
        window.append(piece)
        if at + s == size:
            return window
        levels[at + s] += 1
        self.open.setdefault(at + s, []).append(window)
        return None

    def rest(self):
        """Pieces of the windows still open, fullest windows first."""
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                yield from window


def _in_splits(docs: DataFrame, tokenizer: str, end_id: int, size: int, text: str, doc_id: str) -> DataFrame:
    """First round: pieces as each split's rows arrive. Those of open windows have no ``sequence_id`` but their ``ids``.

    ``part`` and ``n`` are the number of the split and of the piece in it.
    """

    def packed(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        packer = Packer(size, part << 33)
        rows: list[tuple] = []
        names = [*(c.split()[0] for c in SCHEMA.split(", ")), "part", "n", "ids"]

        def emit(window):
            offset = 0
            for doc, start, ids, total, n in window:
                rows.append((doc, start, len(ids) // 4, crc32(ids), total, packer.next_id, offset, part, n, None))
                offset += len(ids) // 4
            packer.next_id += 1

        def flush():
            columns = zip(*rows) if rows else [[]] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for c, name in zip(columns, names)], names)
            rows.clear()
            return batch

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc, tokens in zip(ids[a:b], enc.encode(texts[a:b])):
                    tokens += end
                    total = len(tokens) // 4
                    for start in range(0, total, size):
                        own = tokens[4 * start : 4 * (start + size)]
                        window = packer.add((doc, start, own, total, number), len(own) // 4)
                        number += 1
                        if window:
                            emit(window)
                if len(rows) > 10_000:
                    yield flush()
        for doc, start, ids, total, n in packer.rest():
            rows.append((doc, start, len(ids) // 4, crc32(ids), total, None, None, part, n, ids))
            if len(rows) > 10_000:
                yield flush()
        yield flush()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(packed, f"{SCHEMA}, part long, n long, ids binary")


def _again(left: DataFrame, groups: int, number: int, size: int) -> DataFrame:
    """A later round: the rule goes on in each group, first by hash, then over what that leaves, the longest pieces first."""

    def fill(table):
        import numpy as np
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        order = np.lexsort([table.column(c).to_numpy() for c in ("n", "part", "deal")]).tolist()
        first = (number << 55) + ((table.column("group")[0].as_py() << 28) if len(lengths) else 0)
        sequence, offset = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        while order:
            packer = Packer(size, first)
            for i in order:
                window = packer.add(i, int(lengths[i]))
                if window:
                    sequence[window] = first
                    offset[window] = np.cumsum(lengths[window]) - lengths[window]
                    first += 1
            before, order = len(order), list(packer.rest())
            order.sort(key=lambda i: -lengths[i])
            if len(order) > SHRINKS * before:
                break
        out = table.drop_columns(["group", "deal"])
        out = out.append_column("sequence_id", pa.array(sequence, pa.int64(), mask=sequence < 0))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    deal = F.xxhash64("part", "n", F.lit(number))
    dealt = left.withColumn("deal", deal).withColumn("group", F.pmod("deal", F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("group").applyInArrow(fill, schema)


def _poured(left: DataFrame, groups: int, size: int) -> DataFrame:
    """Pieces with their ``ids`` cut anew into full sequences; a group's last tokens go to powers of two."""

    def pour(table):
        from zlib import crc32

        import pyarrow as pa

        pieces = table.sort_by([("part", "ascending"), ("n", "ascending")]).to_pylist()
        tokens = sum(p["length"] for p in pieces)
        sequence = (60 << 55) + ((pieces[0]["group"] << 28) if pieces else 0)
        rows, room, offset = [], 0, 0
        for p in pieces:
            ids, start = p["ids"], p["start"]
            while ids:
                if not room:  # the next sequence: a full one, or the largest power of two that the rest fills
                    room, offset = size if tokens >= size else 1 << (tokens.bit_length() - 1), 0
                    sequence += 1
                now = ids[: 4 * room]
                n = len(now) // 4
                rows.append((p["doc_id"], start, n, crc32(now), p["doc_tokens"], sequence, offset))
                ids, start, room, offset, tokens = ids[4 * n :], start + n, room - n, offset + n, tokens - n
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

    dealt = left.withColumn("group", F.pmod(F.xxhash64("part", "n"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pour, SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens, columns as in ``SCHEMA`` and ``by_rule``.

    A document's ids (a missing text counts as empty) and ``end_id`` are cut into full sequences and one last piece, which the
    sum-of-squares rule places, split by split as the rows arrive. Pieces of windows that are still open when a split ends go on
    to a second round, without their ids, in groups of the leftovers of many splits, and so on until one group is left or
    few windows get full. What the last round leaves, about one open window for each level and group, is poured out: cut anew
    into full sequences, the last tokens into powers of two, which need no padding. ``by_rule`` says that the rule has filled the
    piece's sequence (or that the piece fills it alone). Each id is in exactly one piece.

    Each round reads a written table or the input's own splits, so a task that runs again makes the same sequences. Rows without
    ``doc_id`` and repeated rows are packed like any other, columns beyond the two are not looked at; an empty table gives no row.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    first = persist_table(_in_splits(docs, tokenizer, end_id, size, text, doc_id), "packed-0")
    placed = F.col("sequence_id").isNotNull()
    done = [first.filter(placed).select(*names, F.lit(True).alias("by_rule"))]
    left = first.filter(~placed).drop("sequence_id", "offset", "ids")
    held, number = left.count(), 1
    while held:
        groups = -(-held // GROUP)
        packed = persist_table(_again(left, groups, number, size), f"packed-{number}")
        done.append(packed.filter(placed).select(*names, F.lit(True).alias("by_rule")))
        left = packed.filter(~placed).drop("sequence_id", "offset")
        before, held, number = held, left.count(), number + 1
        if groups == 1 or held > SHRINKS * before:
            break
    if held:
        ids = first.filter(~placed).select("part", "n", "ids")
        poured = _poured(left.join(ids, ["part", "n"]), -(-held // POUR), size)
        done.append(poured.withColumn("by_rule", F.lit(False)))
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out
