"""Best-fit packing of whole documents: the sum-of-squares rule over residual gaps, in rounds of bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.word_units import unit_encoder
from tracelake.session import persist_table

#: Pieces that one task packs, about (they are dealt by hash).
GROUP = 200_000
#: A round that leaves more than this share of its pieces in open sequences is the last one.
SHRINKS = 0.5
_FAR = 1 << 60


class GapPacker:
    """Open sequences by residual gap.

    ``gain[g]`` is what one more open sequence with gap ``g`` adds to the sum of the squared counts, ``loss[g]`` what one less takes
    away. A piece of length ``s`` goes where ``gain[g - s] - loss[g]`` is smallest, on a tie to the smallest gap; gap ``size`` stands for a
    new sequence. With ``closing`` a new one is opened only if no open gap is wide enough.
    """

    def __init__(self, size: int, closing: bool = False):
        import numpy as np

        self.size = size
        self.count = [0] * (size + 1)
        self.gain = np.ones(size + 1, dtype=np.int64)
        self.gain[0] = 0  # full sequences are not counted
        self.loss = np.full(size + 1, -_FAR, dtype=np.int64)
        self.loss[size] = -_FAR // 2 if closing else 0
        self.open: dict[int, list[list[int]]] = {}
        self.full: list[list[int]] = []

    def add(self, item: int, s: int) -> None:
        size = self.size
        gap = s + int((self.gain[: size + 1 - s] - self.loss[s:]).argmin())
        if gap < size:
            members = self.open[gap].pop()
            self._counted(gap, -1)
        else:
            members = []
        members.append(item)
        if gap == s:
            self.full.append(members)
        else:
            self.open.setdefault(gap - s, []).append(members)
            self._counted(gap - s, 1)

    def _counted(self, gap: int, step: int) -> None:
        n = self.count[gap] = self.count[gap] + step
        self.gain[gap] = 2 * n + 1
        self.loss[gap] = 2 * n - 1 if n else -_FAR

    def still_open(self) -> list[list[int]]:
        return [members for gap in sorted(self.open) for members in self.open[gap]]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, text: str, doc_id: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``part, n``: the number of the split and of the piece in it."""

    def encoded(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = unit_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, number, rows = TaskContext.get().partitionId(), 0, []
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "n"]

        def flush():
            columns = zip(*rows) if rows else [[]] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            rows.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, tokens in zip(ids, enc.encode_each(batch.column(1))):
                tokens += end
                for piece, at in enumerate(range(0, len(tokens), 4 * size)):
                    own = tokens[at : at + 4 * size]
                    rows.append((doc, piece, piece * size, len(own) // 4, crc32(own), part, number))
                    number += 1
            yield flush()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(encoded, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, n long")


def _round(left: DataFrame, groups: int, number: int, size: int, closing: bool) -> DataFrame:
    """Packs each group by itself; rows of sequences that are still open have no ``sequence_id``, unless ``closing``."""

    def fill(table):
        import numpy as np
        import pyarrow as pa

        columns = {c: table.column(c).to_numpy() for c in ("part", "n", "deal", "group", "length")}
        lengths = columns["length"]
        # The order of arrival is by hash; what closes goes from the longest piece to the shortest.
        order = np.lexsort((columns["n"], columns["part"], columns["deal"], *([-lengths] if closing else [])))
        packer = GapPacker(size, closing)
        for item, s in zip(order.tolist(), lengths[order].tolist()):
            packer.add(item, s)
        done = packer.full + packer.still_open() if closing else packer.full
        sequence, offset = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        first = (number << 55) + (int(columns["group"][0]) << 28) if len(lengths) else 0
        for i, members in enumerate(done):
            sequence[members] = first + i
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        out = table.drop_columns(["group", "deal"])
        out = out.append_column("sequence_id", pa.array(sequence, pa.int64(), mask=sequence < 0))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    deal = F.xxhash64("part", "n", F.lit(number))
    dealt = left.withColumn("deal", deal).withColumn("group", F.pmod("deal", F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("group").applyInArrow(fill, schema)


def pack_gaps(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: documents in sequences of at most ``size`` tokens.

    A document's ids (a missing text counts as empty) and ``end_id`` stay together; only longer ones are cut, into pieces of ``size``.
    Full pieces are sequences of their own. The others are written once, without their ids, and dealt to groups by hash,
    so that neither a source nor copies of one length make a group large. A task places the pieces of its group by the
    sum-of-squares rule; what stands in sequences that did not get full goes on to the next round, whose groups hold the leftovers
    of many. The last round takes the longest first and opens no sequence while one is open that holds the piece. Rounds end
    when one group is left, or when the lengths are such that most sequences never get full; then each group closes by itself.

    Rows without ``doc_id``, repeated rows, empty and very long texts are packed like any other, and columns of ``docs`` beyond the two are
    not looked at; an empty table gives no row. Every step reads a written table or the input's own splits, so a task that
    runs again makes the same sequences.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = persist_table(pieces(docs, tokenizer, end_id, size, text, doc_id), "pieces")
    whole = cut.filter(F.col("length") == size)
    done = [whole.select(*names, (F.col("part") * (1 << 33) + F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = cut.filter(F.col("length") < size)
    held, number = left.count(), 1
    closing = held <= GROUP
    while held:
        groups = max(1, -(-held // GROUP))
        packed = persist_table(_round(left, groups, number, size, closing), f"packed-{number}")
        done.append(packed.filter(F.col("sequence_id").isNotNull()).select(*names, "sequence_id", "offset"))
        if closing:
            break
        left = packed.filter(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
        before, held, number = held, left.count(), number + 1
        closing = held <= GROUP or held > SHRINKS * before
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out
