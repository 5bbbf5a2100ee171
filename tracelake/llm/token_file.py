"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents:

    header      magic, number of documents, ids, blocks and exceptions
    documents   doc_id (int64), whether it is missing (uint8), number of ids (uint32)
    blocks      minimum (uint32), width in bits (uint8), exceptions (uint16), byte where the block starts (uint32)
    packed      each block's ids less their minimum, ``width`` low bits each
    exceptions  place in the block (uint16), what is above the low bits (uint32)

Segments are the rows of a Parquet table, so Spark's commit protocol decides which of them count when a task runs twice,
and any store that Spark writes to will do. ``Segment.ids`` reads single blocks without the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.encoding import encoder, slices
from tracelake.session import new_folder

MAGIC = b"PFOR0001"
BLOCK = 256
#: Share of a block's values that its width must hold; the others are exceptions.
PERCENTILE = 0.9
#: A segment ends with the document that brings it to this many ids.
SEGMENT_IDS = 1 << 18


def _bits(values):
    """Bits that each unsigned 32-bit value needs."""
    import numpy as np

    # The exponent of the value as a floating-point number, which holds 32 bits exactly; of zero it is far below.
    exponent = (values.astype(np.float64).view(np.uint64) >> np.uint64(52)).astype(np.int16) - 1022
    return np.maximum(exponent, 0).astype(np.uint8)


def _pack(values, width: int):
    """Rows of ``BLOCK`` values as bytes, ``width`` low bits of each one after the other: 64 values fill ``width`` 64-bit words."""
    import numpy as np

    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64)) & np.uint64((1 << width) - 1)
    words = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for i in range(64):
        word, off = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(off)
        if off + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - off)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpack(raw, width: int):
    """What ``_pack`` has packed, as rows of ``BLOCK`` values."""
    import numpy as np

    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").reshape(-1, width).T)
    lanes, mask = np.empty((64, words.shape[1]), dtype=np.uint32), np.uint64((1 << width) - 1)
    for i in range(64):
        word, off = divmod(i * width, 64)
        value = words[word] >> np.uint64(off)
        if off + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - off))
        lanes[i] = (value & mask).astype(np.uint32)
    return lanes.T.reshape(len(raw), BLOCK)


def write_segment(doc_ids: list, lengths: list[int], ids, percentile: float = PERCENTILE) -> bytes:
    import numpy as np

    n = len(ids)
    n_blocks = -(-n // BLOCK)
    last = ids[-1] if n else 0
    grid = np.concatenate([ids, np.full(n_blocks * BLOCK - n, last, dtype="<u4")]).reshape(n_blocks, BLOCK)
    low = grid.min(axis=1, initial=0xFFFFFFFF) if n_blocks else np.zeros(0, "<u4")
    rest = grid - low[:, None]
    need = _bits(rest)
    wide = int(np.ceil(percentile * BLOCK)) - 1
    width = np.partition(need, wide, axis=1)[:, wide].astype(np.int64) if n_blocks else np.zeros(0, np.int64)
    over = need > width[:, None]
    at_block, at = np.nonzero(over)
    high = (rest[at_block, at].astype(np.uint64) >> width[at_block].astype(np.uint64)).astype("<u4")
    sizes = width * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(int(starts[-1]), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed[(starts[own][:, None] + np.arange(int(w) * BLOCK // 8)).ravel()] = _pack(rest[own], int(w)).ravel()
    missing = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join(
        [
            MAGIC,
            np.array([len(doc_ids), n, n_blocks, len(at)], dtype="<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            missing.tobytes(),
            np.array(lengths, dtype="<u4").tobytes(),
            low.astype("<u4").tobytes(),
            width.astype(np.uint8).tobytes(),
            over.sum(axis=1).astype("<u2").tobytes(),
            starts[:-1].astype("<u4").tobytes(),
            packed.tobytes(),
            at.astype("<u2").tobytes(),
            high.tobytes(),
        ]
    )


class Segment:
    """Views of a segment's parts; nothing is unpacked until asked for."""

    def __init__(self, raw: bytes):
        import numpy as np

        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.np = np
        docs, self.n, self.n_blocks, n_over = np.frombuffer(raw, "<u8", 4, len(MAGIC)).tolist()
        place = len(MAGIC) + 32

        def take(kind, count):
            nonlocal place
            out = np.frombuffer(raw, kind, count, place)
            place += out.nbytes
            return out

        self.doc_ids, self.missing, self.lengths = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
        self.low, self.width, self.over, self.starts = take("<u4", self.n_blocks), take(np.uint8, self.n_blocks), take("<u2", self.n_blocks), take("<u4", self.n_blocks)
        self.packed = take(np.uint8, int(self.width.astype(np.int64).sum()) * BLOCK // 8)
        self.at, self.high = take("<u2", n_over), take("<u4", n_over)
        self.first_over = np.concatenate([[0], np.cumsum(self.over.astype(np.int64))])

    def ids(self, first: int = 0, end: int | None = None):
        """Ids of blocks ``first`` to ``end``."""
        np = self.np
        end = self.n_blocks if end is None else end
        width, starts = self.width[first:end], self.starts[first:end].astype(np.int64)
        grid = np.zeros((end - first, BLOCK), dtype=np.uint32)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                rows = self.packed[(starts[own][:, None] + np.arange(int(w) * BLOCK // 8)).ravel()].reshape(len(own), -1)
                grid[own] = _unpack(rows, int(w))
        a, b = int(self.first_over[first]), int(self.first_over[end])
        rows = np.repeat(np.arange(end - first), self.over[first:end])
        grid[rows, self.at[a:b]] |= (self.high[a:b].astype(np.uint64) << width[rows].astype(np.uint64)).astype(np.uint32)
        flat = (grid + self.low[first:end, None]).ravel()
        return flat[: max(0, self.n - first * BLOCK)].astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the ids of all documents, in ascending order of ``doc_id``, as a table of segments to ``path``.

    Rows without ``doc_id`` come first; rows with the same one stand in the order of their texts. A missing text is empty and
    has ``end_id`` only. The table is ordered by ranges of ``doc_id``: each task encodes its own range and numbers its ids
    from 0; readers add up the tasks' totals. ``part`` and ``segment`` give the order.
    """

    def encoded(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, lengths, tokens, size = [], [], [], 0

        def segment():
            raw = write_segment(ids, lengths, np.frombuffer(b"".join(tokens), "<u4"))
            columns = [[part], [number], [before], [size], [raw]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "segment", "first", "n_ids", "payload"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for name, got in zip(names[a:b], enc.encode(texts[a:b])):
                    ids.append(name)
                    tokens.append(got + end)
                    lengths.append(len(got) // 4 + 1)
                    size += lengths[-1]
                    if size >= SEGMENT_IDS:
                        yield segment()
                        number, before, size = number + 1, before + size, 0
                        ids, lengths, tokens = [], [], []
        if ids:
            yield segment()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encoded, "part int, segment long, first long, n_ids long, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a table of segments: ``doc_id, start`` (ids of all documents before), ``n_tokens, ids_crc32``."""

    def decoded(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                seg = Segment(raw.as_py())
                ids = seg.ids().tobytes()
                ends = np.cumsum(seg.lengths.astype(np.int64))
                starts = ends - seg.lengths
                crc = [crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(seg.doc_ids, pa.int64(), mask=seg.missing.astype(bool)), pa.array(starts + first), pa.array(seg.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # One row for each task of the writer, whatever the number of documents.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    placed = segments.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("first"), "payload")
    return placed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = new_folder(docs.sparkSession, "token-ids")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
