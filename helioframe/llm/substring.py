"""Substring dedup with difference-cover anchors.

Two equal windows of ``span`` words that start at positions p and q share, for some
shift d below the period, cover positions p + d and q + d (a difference cover holds a
pair for every difference modulo the period).  So hashing only the ``anchor`` words
at cover positions finds every match; a window is then a candidate if it contains an
anchor that occurs twice, and candidates are compared by a second, wider hash of all
their ``span`` words.  Nothing is ever paired: occurrences are counted by hash.

Rows travel as blocks.  A block of texts is stored once; it sends its distinct hashes
to buckets, and each bucket answers with one bit for each hash received.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm import kernel
from helioframe.llm.common import partitions, settle, ship

#: Perfect difference sets, by period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}

_BLOCK = "block long, data binary"
_SENT = "bucket int, block long, keys binary"
_MARK = "block long, bucket int, bits binary"
BLOCKS_PER_BUCKET = 64


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _to_blocks(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for piece in kernel.chunks(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([_pack(piece)], pa.binary())], ["block", "data"])
            n += 1

    return run


def _distinct(keys: np.ndarray, second: np.ndarray | None):
    """Distinct keys in order, whether each occurs again in the block, and the place of each input."""
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    if second is not None:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    again = np.diff(np.append(at, len(k))) > 1
    place = np.empty(len(k), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return k[at], None if second is None else s[at], again, place


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _anchors(w: kernel.Words, period: int, anchor: int):
    """Positions of the cover, counted from the start of each text, and the hash of their words."""
    h = kernel.windows(w.hashes, anchor)
    at = np.arange(len(h)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))[: len(h)]
    cover = np.zeros(period, dtype=bool)
    cover[list(COVERS[period])] = True
    pos = np.flatnonzero(cover[at % period] & kernel.inside(w.bounds, anchor, len(h)))
    return pos, h[pos]


def _candidates(w: kernel.Words, pos: np.ndarray, shared: np.ndarray, anchor: int, span: int):
    """Window starts that contain a shared anchor, and two hashes of their words."""
    n = len(w.hashes) - span + 1
    if n <= 0 or not shared.any():
        none = np.zeros(0, dtype=np.uint64)
        return np.zeros(0, dtype=np.int64), none, none
    change = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    a = pos[shared]
    np.add.at(change, np.maximum(a + anchor - span, 0), 1)
    np.add.at(change, a + 1, -1)
    starts = np.flatnonzero((np.cumsum(change)[:n] > 0) & kernel.inside(w.bounds, span, n))
    return starts, kernel.windows(w.hashes, span)[starts], kernel.windows(w.hashes, span, kernel.SECOND_BASE)[starts] >> np.uint64(32)


def _bits(marks: list[dict] | None) -> np.ndarray:
    """Bits of all buckets in the order in which the block sent its keys."""
    if not marks:
        return np.zeros(0, dtype=bool)
    out = []
    for m in sorted(marks, key=lambda m: m["bucket"]):
        n = int.from_bytes(m["bits"][:4], "little")
        out.append(np.unpackbits(np.frombuffer(m["bits"], np.uint8, offset=4), count=n))
    return np.concatenate(out).astype(bool)


class _Scan:
    """The two rounds and the cut over one block, always recomputed from the stored texts."""

    def __init__(self, text: str, span: int, period: int, buckets: int):
        self.text, self.span, self.period, self.buckets, self.anchor = text, span, period, buckets, span - period + 1

    def _words(self, data: bytes):
        rows = _unpack(data)
        return rows, kernel.words(rows.column(self.text).to_pylist())

    def _send(self, block: int, keys, second) -> pa.RecordBatch:
        keys, second, again, _ = _distinct(keys, second)
        to = _bucket(keys, self.buckets)  # ordered, as the keys are
        cuts = np.searchsorted(to, np.arange(self.buckets + 1))
        full = [b for b in range(self.buckets) if cuts[b] < cuts[b + 1]]
        blobs = []
        for b in full:
            part = slice(cuts[b], cuts[b + 1])
            blob = (cuts[b + 1] - cuts[b]).astype("<u4").tobytes() + keys[part].tobytes()
            blob += b"" if second is None else second[part].astype("<u4").tobytes()
            blobs.append(blob + np.packbits(again[part]).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "keys"]
        )

    def anchors(self, batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                _, w = self._words(data.as_buffer().to_pybytes())
                _, h = _anchors(w, self.period, self.anchor)
                yield self._send(block, h, None)

    def _found(self, w, marks):
        pos, h = _anchors(w, self.period, self.anchor)
        place = _distinct(h, None)[3]
        shared = _bits(marks)[place] if len(h) else np.zeros(0, dtype=bool)
        return _candidates(w, pos, shared, self.anchor, self.span)

    def candidates(self, batches):
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                _, w = self._words(batch.column("data")[i].as_py())
                _, h1, h2 = self._found(w, batch.column("marks")[i].as_py())
                yield self._send(block, h1, h2)

    def cut(self, fields: list[str]):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    rows, w = self._words(batch.column("data")[i].as_py())
                    starts, h1, h2 = self._found(w, batch.column("marks")[i].as_py())
                    change = np.zeros(len(w.hashes) + 1, dtype=np.int64)
                    if len(starts):
                        again = _bits(batch.column("found")[i].as_py())[_distinct(h1, h2)[3]]
                        np.add.at(change, starts[again], 1)
                        np.add.at(change, starts[again] + self.span, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    n_words, n_gone, kept = [], [], []
                    for k, t in enumerate(rows.column(self.text).to_pylist()):
                        lo, hi = w.bounds[k], w.bounds[k + 1]
                        n_words.append(int(hi - lo))
                        n_gone.append(int(gone[lo:hi].sum()))
                        parts = [] if t is None else w.data[w.start[lo] : w.end[hi - 1]].split() if hi > lo else []
                        kept.append(b" ".join(compress(parts, ~gone[lo:hi]) if n_gone[-1] else parts).decode("utf-8", "surrogatepass"))
                    out = rows.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_gone, pa.int64()))
                    out = out.append_column("kept_text", pa.array(kept, pa.string()))
                    out = out.append_column("kept_sha256", pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string()))
                    yield from out.select(fields).combine_chunks().to_batches()

        return run


def _count(wide: bool):
    """One bucket: which of the keys that each block sent occur twice or more in all."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = [b.as_buffer().to_pybytes() for b in rows.column("keys")]
        keys, seconds, again, sizes = [], [], [], []
        for b in blobs:
            n = int.from_bytes(b[:4], "little")
            sizes.append(n)
            keys.append(np.frombuffer(b, "<u8", n, 4))
            if wide:
                seconds.append(np.frombuffer(b, "<u4", n, 4 + 8 * n))
            again.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=4 + (12 if wide else 8) * n), count=n))
        k, s = np.concatenate(keys), np.concatenate(seconds) if wide else None
        _, _, twice, place = _distinct(k, s)
        inner = np.zeros(len(twice), dtype=bool)
        inner[place[np.concatenate(again).astype(bool)]] = True
        flags = np.split((twice | inner)[place], np.cumsum(sizes)[:-1])
        bits = [n.to_bytes(4, "little") + np.packbits(f).tobytes() for n, f in zip(sizes, flags, strict=True)]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, text: str = "text", span: int = 35, period: int = 21) -> DataFrame:
    """Remove every word covered by a window of ``span`` words that also starts elsewhere.

    Adds ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and
    ``kept_sha256`` to the rows of ``docs``; input columns of these names are replaced,
    all others are kept.  Windows lie within one row and are judged on the input.

    A null or blank text has no words and keeps ''.  Texts under ``span`` words never
    lose a word.  Repeated rows count as occurrences, so each loses its windows.  An
    empty table gives an empty table.  A very long text is a block of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    added = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    own = [c for c in docs.columns if c not in added]
    docs = docs.select(*own)
    blocks = settle(docs.mapInArrow(_to_blocks(text), _BLOCK))
    buckets = max(partitions(spark), -(-blocks.count() // BLOCKS_PER_BUCKET))
    scan = _Scan(text, span, period, buckets)

    def answers(sent: DataFrame, wide: bool, name: str) -> DataFrame:
        marks = sent.groupBy("bucket").applyInArrow(_count(wide), _MARK)
        return settle(marks.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)))

    marks = answers(blocks.mapInArrow(scan.anchors, _SENT), False, "marks")
    marked = blocks.join(marks, "block", "left")
    found = answers(marked.mapInArrow(scan.candidates, _SENT), True, "found")
    schema = T.StructType(
        [f for f in docs.schema.fields] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())]
    )
    return marked.join(found, "block", "left").mapInArrow(scan.cut(own + added), schema)
