"""Collapse of cumulative chat snapshots, then rendering.

A log that stores a conversation after every turn holds each of its beginnings as a
conversation of its own.  The rolling hash of the turns so far names a beginning;
conversations whose whole hash names a beginning of a longer one are dropped by an
anti-join, and of equal ones the least id stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import settle, ship


def prefix_hashes(turns: list[dict]) -> list[bytes]:
    """128-bit hash of the first 1, 2, ... turns; each extends the one before."""
    out, last = [], b""
    for t in turns:
        h = hashlib.blake2b(last, digest_size=16)
        for value in (t["role"], t["text"]):
            data = b"" if value is None else value.encode("utf-8", "surrogatepass")
            h.update((-1 if value is None else len(data)).to_bytes(8, "little", signed=True) + data)
        last = h.digest()
        out.append(last)
    return out


def render(turns: list[dict]) -> str:
    """One header line and the text of each turn; a marker inside a text is broken by a backslash."""
    return "".join(f"<|{t['role'] or ''}|>\n{(t['text'] or '').replace('<|', '<' + chr(92) + '|')}\n" for t in turns) + "<|end|>"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns").to_pylist()
        cols = [
            batch.column("conv"),
            pa.array([prefix_hashes(t) for t in turns], pa.list_(pa.binary())),
            batch.column("lone"),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["conv", "prefixes", "lone"])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns").to_pylist()
        cols = [batch.column("conv"), pa.array([len(t) for t in turns], pa.int64()), batch.column("n_copies"), pa.array([render(t) for t in turns], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["conv", "n_turns", "n_copies", "rendered"])


def collapse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations: ``conv_id`` (under the name of the input), ``n_turns``, ``n_copies``, ``rendered``.

    ``n_copies`` counts the conversations with exactly these turns.  Turns are taken in
    order of their number, rows of one number by role and text.  A conversation is one
    output row, so its turns meet in one task; conversations never do.  Only hashes are
    stored and compared; the maximal conversations alone are gathered again and rendered.

    A row without a conversation id is a conversation of one turn with a null id, which
    stays behind an equal one that has an id.  Null roles and texts differ from empty
    ones in comparing and are empty in rendering; other columns are ignored.  Repeated
    rows are turns.  An empty table gives no rows.
    """
    ship(messages.sparkSession)
    rows = messages.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    named, lone = rows.where("conv IS NOT NULL"), rows.where("conv IS NULL")
    kind = messages.schema[conv].dataType.simpleString()
    turn_kind = rows.schema["t"].dataType.simpleString()
    gathered = named.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn("lone", F.lit(None).cast(turn_kind))
    both = gathered.unionByName(lone.select("conv", F.array("t").alias("turns"), F.col("t").alias("lone")))
    hashed = settle(both.mapInArrow(_hash, f"conv {kind}, prefixes array<binary>, lone {turn_kind}"))
    whole = hashed.groupBy(F.element_at("prefixes", -1).alias("whole")).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_copies"), F.first("lone", ignorenulls=True).alias("lone")
    )
    begun = hashed.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("whole")).distinct()
    kept = settle(whole.join(begun, "whole", "left_anti").select("conv", "n_copies", "lone"))
    back = named.join(kept.where("conv IS NOT NULL").select("conv", "n_copies"), "conv")
    turns = back.groupBy("conv", "n_copies").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    turns = turns.unionByName(kept.where("conv IS NULL").select("conv", "n_copies", F.array("lone").alias("turns")))
    out = turns.mapInArrow(_render, f"conv {kind}, n_turns long, n_copies long, rendered string")
    return out.withColumnRenamed("conv", conv)
