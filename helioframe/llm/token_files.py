"""Token files of independent zstandard frames with a trailing seek table.

A shard is a sequence of zstandard frames, each holding the ids of whole documents,
followed by a skippable frame with the compressed size, plain size and checksum of
every frame (the public seekable layout).  A reader opens the seek table from the
end of the file and decompresses just the frames of the documents it wants.

Shards are named by an attempt's own random part, and only the shards that the
stored index names are read: a lost or repeated task leaves an unused file at most.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from helioframe.functions.stages import shared_folder
from helioframe.llm import kernel, tokens
from helioframe.llm.common import partitions, settle, ship

#: Fixed values of the seekable layout.
SKIPPABLE, SEEK_MAGIC, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 18

INDEX = ["shard", "file", "frame", "frame_offset", "shard_before", "n_tokens"]
_KINDS = {"file": T.StringType()}


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shard:
    """Writes one file, frame by frame."""

    def __init__(self, uri: str, frame_bytes: int):
        import zstandard

        system, path = _open(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.limit = system.open_output_stream(path), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=1, write_content_size=True)
        self.plain, self.table = bytearray(), []

    def add(self, blob: bytes) -> tuple[int, int]:
        """Frame number and byte offset in the frame of the document just added."""
        if self.plain and len(self.plain) + len(blob) > self.limit:
            self.flush()
        at = len(self.table), len(self.plain)
        self.plain += blob
        return at

    def flush(self) -> None:
        if self.plain:
            data = bytes(self.plain)
            packed = self.zstd.compress(data)
            self.out.write(packed)
            self.table.append((len(packed), len(data), _checksum(data)))
            self.plain.clear()

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKED, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Random access to the frames of one file."""

    def __init__(self, uri: str):
        import zstandard

        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKED:
            raise ValueError(f"{uri} has no seek table")
        entries = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.start, self.entries = np.concatenate(([0], np.cumsum(entries[:, 0]))), entries
        self.zstd, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(n))

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed, plain, check = self.entries[k]
            data = self.zstd.decompress(self._at(self.start[k], packed), max_output_size=int(plain))
            if len(data) != plain or _checksum(data) != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = k, data
        return self.last[1]


def _write(folder: str, text: str, path: str, end_id: int, frame_bytes: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, before, shard = tokens.Encoder(path, end_id), TaskContext.get().partitionId(), 0, None
        uri = f"{folder}/shard-{task:06d}-{uuid.uuid4().hex}.tokz"
        for piece in kernel.chunks(batches, text, tokens.BATCH):
            shard = shard or Shard(uri, frame_bytes)
            rows = []
            for ids in encoder(piece.column(piece.schema.get_field_index(text)).to_pylist()):
                rows.append((task, uri, *shard.add(ids), before, len(ids) // 4))
                before += len(ids) // 4
            cols = [pa.array(c, pa.string() if n == "file" else pa.int64()) for n, c in zip(INDEX, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*piece.select(keep).columns, *cols], [*keep, *INDEX])
        if shard:
            shard.close()

    return run


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, path: str | None = None, end_id: int = tokens.END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the ids of all documents in ascending ``key`` order; returns the stored index.

    One row per document: the columns of ``docs`` but the text, and ``shard`` (in key
    order), ``file``, ``frame``, ``frame_offset`` (bytes), ``shard_before`` (ids of the
    shard before the document) and ``n_tokens``.  Input columns of these names are
    replaced.  ``folder`` must be one that all executors see; by default it lies in
    the shared folder of the session.

    A null text is the end id alone.  A null key comes first.  Rows of one key keep an
    order of their own, by text; a key of any number of rows is spread over shards.
    A document lies in one frame, however long.  An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    keep = [c for c in docs.columns if c != text and c not in INDEX]
    order: list[Column] = [F.col(key), F.xxhash64(text), F.monotonically_increasing_id()]
    tie = ["__tie0", "__tie1"]
    keyed = docs.select(*keep, text, order[1].alias(tie[0]), order[2].alias(tie[1]))
    dealt = keyed.repartitionByRange(partitions(spark), key, *tie).sortWithinPartitions(key, *tie).drop(*tie)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, _KINDS.get(c, T.LongType())) for c in INDEX])
    return settle(dealt.mapInArrow(_write(folder, text, path or tokens.vocabulary(), end_id, frame_bytes, keep), schema))


def _read(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            ids = []
            for file, frame, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "frame_offset", "n_tokens")), strict=True):
                if file != name:
                    name, reader = file, Reader(file)
                ids.append(reader.frame(frame)[at : at + 4 * n])
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, tokens.binary(ids)], [*keep, "ids"])

    return run


def read(index: DataFrame) -> DataFrame:
    """Ids of the documents of an index, or of any part of it, with ``start`` (ids of all documents before).

    Columns of the index named ``start`` or ``ids`` are replaced.  Shard totals are one row a shard (bounded by the partitions of the writer) and are broadcast.
    """
    totals = index.groupBy("shard").agg(F.max(F.col("shard_before") + F.col("n_tokens")).alias("__n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    keep = [c for c in index.columns if c not in INDEX and c not in ("start", "ids")]
    start = (F.col("__base") + F.col("shard_before")).alias("start")
    rows = index.join(F.broadcast(base), "shard").select(*keep, start, "n_tokens", "file", "frame", "frame_offset")
    keep += ["start", "n_tokens"]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(_read(keep), schema)
