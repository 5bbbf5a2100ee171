"""Removal of byte strings that repeat anywhere in the corpus, by refining buckets of q-grams.

A string of ``LENGTH`` bytes is named after the q-gram inside it whose hash is smallest (ties: the first), its anchor. Equal strings have
equal anchors at the same place, so only anchors need buckets: about one for every 150 bytes. An anchor stands for a range
of strings, those that start up to ``LENGTH - GRAM`` bytes before it.

1. The q-grams of all anchors form the first buckets. A bucket of one is done: its strings are unique.
2. A bucket is refined by the identifiers of the strings around its anchors, taken at earlier and later offsets. If an anchor's
   whole range has the same identifier as another's, all its strings repeat. What is still undecided is split into narrower ranges,
   and these are refined again: the bucket's identifier and that of the part all strings of a range share make the new one.
3. In ranges of one string the identifier is the string's own, and every bucket of two or more repeats.

Identifiers are 64-bit hashes, computed from the bytes rather than looked up, so offsets need no join; strings count as equal only if two
of them agree. Buckets are counted, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import worker_cache
from tracelake.llm.shingles import mix
from tracelake.session import persist_table

LENGTH, GRAM = 400, 100
#: Widths of the ranges that an undecided range is split into, one after the other. The last must be 1.
WIDTHS = (20, 1)
#: Bytes handled in one go; long texts are cut into pieces that overlap by a string.
PIECE = 1 << 20
_PLACE = (1 << 24) - 1
_KEY = "k1 long, k2 long"


class Identifiers:
    """Hashes of any part of a buffer from sums over its prefixes."""

    def __init__(self, n: int):
        import numpy as np

        self.np = np
        base = 0xD6E8FEB86659FD93
        self.values = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)]))

    def sums(self, b):
        np = self.np
        out = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self.values[b] * self.up[: len(b)], out=out[1:])
        return out

    def of(self, sums, start, end):
        return (sums[end] - sums[start]) * self.down[start]


def _identifiers() -> Identifiers:
    return worker_cache(f"identifiers:{PIECE}", lambda: Identifiers(PIECE + 1))


def _joined(parts, sizes, limit):
    """Places of parts that fill a buffer of about ``limit`` bytes, one list after the other."""
    some, total = [], 0
    for i, size in enumerate(sizes):
        if some and total + size > limit:
            yield some
            some, total = [], 0
        some.append(i)
        total += size
    if some:
        yield some


def anchors_of(raws: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Anchors of many texts: arrays ``text, first, back, span, gram, range``.

    The strings that start at ``first`` to ``first + span`` have their anchor ``back`` bytes after ``first``; ``gram`` and ``range`` are the identifiers of
    the anchor's q-gram and of all bytes of these strings, together with ``back`` and ``span``.
    """
    import numpy as np

    ids, wide = _identifiers(), length - gram + 1
    pieces = []
    for i, raw in enumerate(raws):
        for start in range(0, max(0, len(raw) - length + 1), PIECE - length + 1):
            pieces.append((i, start, raw[start : start + PIECE]))
    out = []
    for some in _joined(pieces, [len(p[2]) for p in pieces], PIECE):
        b = np.frombuffer(b"".join(pieces[i][2] for i in some), dtype=np.uint8)
        sizes = np.array([len(pieces[i][2]) for i in some])
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = ids.sums(b)
        n = len(b) - gram + 1
        grams = mix((sums[gram:] - sums[:-gram]) * ids.down[:n])
        # The place in the lower bits lets a minimum carry where it was found.
        ranked = (grams & np.uint64(~_PLACE & 0xFFFFFFFFFFFFFFFF)) | np.arange(n, dtype=np.uint64)
        grid = np.full(-(-n // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:n] = ranked
        grid = grid.reshape(-1, wide)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(after[: n - wide + 1], before[wide - 1 : n]) & np.uint64(_PLACE)).astype(np.int64)
        counts = sizes - length + 1
        starts = np.repeat(offsets, counts) + (np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts))
        own = anchor[starts]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
        at = np.flatnonzero(new)
        first, last, place = starts[at], starts[np.concatenate([at[1:] - 1, [len(starts) - 1]])], own[at]
        back, span = place - first, last - first
        around = ids.of(sums, first, last + length) + (back * 1024 + span).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        piece = np.searchsorted(offsets, first, side="right") - 1
        text = np.array([pieces[i][0] for i in some])[piece]
        out.append((text, first - offsets[piece] + np.array([pieces[i][1] for i in some])[piece], back, span, grams[place].view(np.int64), mix(around).view(np.int64)))
    if not out:
        return [np.zeros(0, dtype=np.int64)] * 6
    return [np.concatenate(c) for c in zip(*out)]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raws = batch.column(2).cast(pa.binary()).to_pylist()
            sizes = [len(r) for r in raws]
            for some in _joined(raws, sizes, 4 * PIECE):
                found = anchors_of([raws[i] for i in some], length, gram)
                text = pa.array(found[0] + some[0])
                keys = [batch.column(c).take(text) for c in (0, 1)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(f, k) for f, k in zip(found[1:], kinds)]], ["k1", "k2", "first", "back", "span", "bucket", "around"])

    long = docs.filter(F.octet_length("text") >= length).select("k1", "k2", "text")
    return long.mapInArrow(run, f"{_KEY}, first long, back int, span int, bucket long, around long")


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows in buckets of several: those whose whole range some other row has too, and one of each kind of a bucket still open.

    A bucket is open if it holds a row without an equal. Its settled rows go on as one for each kind: the others may share
    single strings with them.
    """
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    members = persist_table(rows.join(shared, "bucket"), "bucket-members")
    kinds = members.groupBy("bucket", "around").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("k1", "k2", "first", "back", "span")).alias("one"))
    kinds = persist_table(kinds, "bucket-kinds")
    settled = members.join(kinds.filter("same > 1").select("bucket", "around"), ["bucket", "around"]).select("k1", "k2", "first", "span")
    open_ = kinds.groupBy("bucket").agg(F.min("same").alias("_least")).filter("_least = 1").select("bucket")
    return settled, kinds.join(open_, "bucket").select("bucket", "one.*")


def ranges_of(contexts: list[bytes], back, span, bucket, width: int, length: int = LENGTH):
    """Splits each context's range of strings at multiples of ``width`` before its anchor.

    Arrays ``context, shift, back, span, bucket, around``: the strings that start ``shift`` to ``shift + span`` bytes into the context.
    """
    import numpy as np

    ids, out = _identifiers(), []
    for some in _joined(contexts, [len(c) for c in contexts], PIECE):
        b = np.frombuffer(b"".join(contexts[i] for i in some), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(contexts[i]) for i in some])[:-1]])
        some = np.array(some)
        sums, far, near = ids.sums(b), back[some], back[some] - span[some]
        node = near // width
        many = far // width - node + 1
        which = np.repeat(np.arange(len(some)), many)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + node[which]
        low, high = np.maximum(number * width, near[which]), np.minimum(number * width + width - 1, far[which])
        shift, spans = far[which] - high, high - low
        start = offsets[which]
        around = ids.of(sums, start + shift, start + shift + spans + length) + (low * 1024 + spans).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        anchor = start + far[which]
        shared = ids.of(sums, anchor - number * width, anchor - (number * width + width - 1) + length)
        new = mix(bucket[some][which].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(shared + number.astype(np.uint64)))
        out.append((some[which], shift, high, spans, new.view(np.int64), mix(around).view(np.int64)))
    if not out:
        return [np.zeros(0, dtype=np.int64)] * 6
    return [np.concatenate(c) for c in zip(*out)]


def refined(contexts: DataFrame, width: int, length: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raws = batch.column("context").to_pylist()
            back, span, bucket, first = (np.array(batch.column(c), dtype=np.int64) for c in ("back", "span", "bucket", "first"))
            which, shift, high, spans, new, around = ranges_of(raws, back, span, bucket, width, length)
            take = pa.array(which, pa.int64())
            columns = [batch.column("k1").take(take), batch.column("k2").take(take), pa.array(first[which] + shift), pa.array(high, pa.int32()), pa.array(spans, pa.int32()), pa.array(new), pa.array(around)]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "first", "back", "span", "bucket", "around"])

    return contexts.mapInArrow(run, f"{_KEY}, first long, back int, span int, bucket long, around long")


def _packed(docs: DataFrame, length: int) -> DataFrame:
    """Texts that can hold a string, packed for the way through a shuffle."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            pack = zstandard.ZstdCompressor(level=1).compress
            packed = pa.array([pack(r) for r in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["k1", "k2", "packed"])

    return docs.filter(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(run, f"{_KEY}, packed binary")


def _with_context(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Adds to undecided rows the bytes of their strings."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        names = ["k1", "k2", "first", "back", "span", "bucket", "context"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for k1, k2, packed, parts in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "packed", "parts"))):
                raw = zstandard.ZstdDecompressor().decompress(packed)
                out += [(k1, k2, p["first"], p["back"], p["span"], p["bucket"], raw[p["first"] : p["first"] + p["span"] + length]) for p in parts]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    parts = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "back", "span", "bucket")).alias("parts"))
    both = _packed(docs, length).join(parts, ["k1", "k2"])
    return both.mapInArrow(run, f"{_KEY}, first long, back int, span int, bucket long, context binary")


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text`` and the key of a row: its id and a hash of its text. A missing text is empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long"))
    return docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), named.alias("k1"), F.xxhash64(whole).alias("k2"))


def repeated(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``k1, k2, first, span``: strings that start at ``first`` to ``first + span`` of a text and occur elsewhere too."""
    found = persist_table(anchors(rows, length, gram), "anchors")
    out, open_ = judged(found)
    contexts = persist_table(_with_context(rows, open_, length), "contexts")
    for width in widths:
        settled, open_ = judged(persist_table(refined(contexts, width, length), "ranges"))
        out = out.unionByName(settled)
        if width > 1:
            contexts = persist_table(_narrowed(contexts, open_, length), "contexts")
    return out


def _narrowed(contexts: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Contexts of the ranges still undecided, cut from those of the wider ranges."""
    narrow = rows.select("k1", "k2", F.col("first").alias("_first"), F.col("back").alias("_back"), F.col("span").alias("_span"), F.col("bucket").alias("_bucket"), (F.col("first") + F.col("back")).alias("_anchor"))
    wide = contexts.select("k1", "k2", "first", "span", "context", (F.col("first") + F.col("back")).alias("_anchor"))
    both = narrow.join(wide, ["k1", "k2", "_anchor"]).filter((F.col("_first") >= F.col("first")) & (F.col("_first") + F.col("_span") <= F.col("first") + F.col("span")))
    cut = F.substring("context", (F.col("_first") - F.col("first") + 1).cast("int"), F.col("_span") + length)
    return both.select("k1", "k2", F.col("_first").alias("first"), F.col("_back").alias("back"), F.col("_span").alias("span"), F.col("_bucket").alias("bucket"), cut.alias("context"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS, text: str = "text", doc_id: str = "doc_id", texts: bool = True) -> DataFrame:
    """Every document without the bytes covered by a string of ``length`` bytes that also starts anywhere else.

    ``doc_id, n_bytes, n_removed, spans, kept_sha256, kept``: ``spans`` are the removed runs (``start, end``, bytes), ``kept`` the remaining bytes
    (left out unless ``texts``). All strings are judged on the input; overlapping occurrences and those in the same text count;
    none crosses documents. A missing text is empty; texts shorter than ``length`` stay whole; repeated rows are occurrences of each
    other; an empty table gives no row.
    """
    rows = keyed(docs, text, doc_id)
    spans = repeated(rows, length, gram, widths).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "span")).alias("found"))
    kept = "kept binary, " if texts else ""

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa
        import zstandard

        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for doc, packed, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "found"))):
                raw = zstandard.ZstdDecompressor().decompress(packed)
                runs: list[list[int]] = []
                for first, end in sorted((f["first"], f["first"] + f["span"] + length) for f in found):
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([first, end])
                edges = [0, *[x for r in runs for x in r], len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc, len(raw), len(raw) - len(left), [{"start": a, "end": b} for a, b in runs], sha256(left).hexdigest(), *([left] if texts else [])))
            kinds = [batch.column("doc_id").type, pa.int64(), pa.int64(), shape, pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"][: 6 if texts else 5]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string" + (", kept binary" if kept else "")
    spans = persist_table(spans, "repeated")
    # Texts without repeats are described where they are read; only the others go through a shuffle.
    hit = rows.select("doc_id", "k1", "k2", F.col("text")).filter(F.octet_length("text") >= length)
    packed = _packed_with_id(hit).join(spans, ["k1", "k2"])
    changed = packed.select("doc_id", "packed", "found").mapInArrow(run, schema)
    plain = rows.join(spans.select("k1", "k2"), ["k1", "k2"], "left_anti") if texts else _described(rows).join(spans.select("k1", "k2"), ["k1", "k2"], "left_anti")
    if texts:
        plain = plain.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    plain = plain.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), "kept_sha256", *(["kept"] if texts else []))
    return changed.unionByName(plain)


def _described(rows: DataFrame) -> DataFrame:
    return rows.select("k1", "k2", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _packed_with_id(rows: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            pack = zstandard.ZstdCompressor(level=1).compress
            packed = pa.array([pack(r) for r in batch.column(3).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed], ["doc_id", "k1", "k2", "packed"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_KEY}, packed binary")
