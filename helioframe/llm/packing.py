"""Concatenate-and-cut packing of token ids into sequences of one length.

First pass: each task encodes its documents, keeps a running count of ids, and the
encoded rows are stored together with the task's number.  The totals of the tasks
(one row each) are summed up into global offsets.  Second pass: a task adds its
offset and cuts each document at the multiples of the sequence length, which gives
the boundary records; no document is moved or held together with another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from helioframe.llm import kernel, tokens
from helioframe.llm.common import settle, ship

_OWN = ["pack_task", "pack_before", "pack_ids"]
PIECE = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _encode(text: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, before = tokens.Encoder(path, end_id), TaskContext.get().partitionId(), 0
        for piece in kernel.chunks(batches, text, tokens.BATCH):
            at = piece.schema.get_field_index(text)
            ids = encoder(piece.column(at).to_pylist())
            ends = before + np.cumsum([len(i) // 4 for i in ids])
            starts = np.concatenate(([before], ends[:-1]))
            before = int(ends[-1])
            cols = [c for k, c in enumerate(piece.columns) if k != at]
            names = [n for k, n in enumerate(piece.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([task] * piece.num_rows, pa.int64()), pa.array(starts, pa.int64()), tokens.binary(ids)], [*names, *_OWN]
            )

    return run


def _cut(length: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.asarray(batch.column("pack_base")) + np.asarray(batch.column("pack_before"))
            row, out = [], {c: [] for c in PIECE}
            for i, blob in enumerate(batch.column("pack_ids").to_pylist()):
                n, at, g = len(blob) // 4, 0, int(first[i])
                while at < n:
                    take = min(length - (g + at) % length, n - at)
                    row.append(i)
                    for c, v in zip(PIECE, (at, take, blob[4 * at : 4 * (at + take)], n, (g + at) // length, (g + at) % length), strict=True):
                        out[c].append(v)
                    at += take
            rows = batch.select(keep).take(pa.array(row, pa.int64()))
            made = [pa.array(out[c], pa.binary() if c == "ids" else pa.int64()) for c in PIECE]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*keep, *PIECE])

    return run


def pack(docs: DataFrame, text: str = "text", length: int = 2048, path: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Boundary records: one row per piece of a document that lies in one sequence.

    Adds to the columns of ``docs`` (without the text) ``start`` and ``length`` (ids of
    the document before and in the piece), ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset`` (place in the sequence, gapless).
    Input columns of these names are replaced.  Every sequence but the last is full.

    A null or empty text is the end id alone.  Repeated rows are packed each.  A text
    longer than a sequence spans several.  An empty table gives no pieces.

    The offsets that are broadcast hold 16 bytes for each task of the first pass.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text and c not in PIECE and c not in _OWN]
    docs = docs.select(*keep, text)
    head = [f for f in docs.schema.fields if f.name != text]
    encoded = T.StructType(head + [T.StructField("pack_task", T.LongType()), T.StructField("pack_before", T.LongType()), T.StructField("pack_ids", T.BinaryType())])
    stored = settle(docs.mapInArrow(_encode(text, path or tokens.vocabulary(), end_id), encoded))
    totals = stored.groupBy("pack_task").agg(F.sum(F.octet_length("pack_ids") / 4).cast("long").alias("n"))
    before = W.orderBy("pack_task").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("pack_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pack_base"))
    placed = stored.join(F.broadcast(base), "pack_task").select(*keep, "pack_base", "pack_before", "pack_ids")
    kinds = {"ids": T.BinaryType()}
    return placed.mapInArrow(_cut(length, keep), T.StructType(head + [T.StructField(c, kinds.get(c, T.LongType())) for c in PIECE]))
