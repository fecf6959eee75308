"""Language identification by cross-parsing against suffix automata.

A language is a bounded sample of its labelled text, kept as a suffix automaton.  A
text is parsed greedily into the longest pieces that occur in that sample; the number
of pieces, times the logarithm of the sample's length, over the text's length is the
cross-parsing entropy.  The language with the least of it wins.

Every letter of the samples has a number of its own, whatever its script.  The
transitions of all automata share one array: a state is a place in it, its transition
by a symbol lies that many entries further on and names the state it belongs to.  A
missing transition starts the next piece; many stretches of many texts walk side by side.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm import kernel
from helioframe.llm.common import ship

#: Bound of the training sample: pieces of text for a language, and characters of a piece.
PIECES, PIECE_CHARS = 64, 512
#: Characters of all languages together; with many languages each one's sample is shorter.
TOTAL_CHARS = 1 << 18
#: Symbols: 0 anything but letters, 1 a letter that no sample has, 2 padding, then the letters of the samples.
OTHER, STRANGE, PADDING, LETTERS = 0, 1, 2, 3
#: Entries of the array of transitions for each transition.
ROOM = 4
#: Letters of a stretch; a new piece starts at each stretch.
STRETCH = 1024
UNKNOWN = "und"

Sample = tuple[tuple[str, str], ...]


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Sample:
    """Training text of each language: one short piece from each of ``PIECES`` groups of its rows.

    The rows are grouped by a hash of their text, and the piece starts at a place that
    the hash tells, so nothing but text and label takes part.  At most ``PIECES`` rows a
    language reach the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    h = F.xxhash64(text)
    room = F.greatest(F.length(text) - PIECE_CHARS, F.lit(0)) + 1
    piece = F.substring(F.col(text), (F.pmod(F.shiftright(h, 8), room) + 1).cast("int"), F.lit(PIECE_CHARS))
    few = rows.groupBy(F.col(lang).alias("lang"), F.pmod(h, F.lit(PIECES)).alias("g")).agg(F.min_by(piece, h).alias("piece"))
    got: dict[str, list] = {}
    for r in few.collect():
        got.setdefault(r["lang"], []).append((r["g"], r["piece"]))
    most = max(1024, min(PIECES * PIECE_CHARS, TOTAL_CHARS // max(1, len(got))))
    return tuple((k, "\n".join(p for _, p in sorted(v))[:most]) for k, v in sorted(got.items()))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of ``codes`` from state 0."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def lay_out(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Array of transitions of some states, and the place of each state in it.

    The entry at place + symbol holds the state's own place (upper half) and the place of
    the next state, or else the place of another state, or -1.  Places are distinct.
    """
    used = bytearray(width + max(1024, ROOM * sum(map(len, rows)), ROOM * len(rows)))
    places, taken = [0] * len(rows), set()
    rng, size = random.Random(3), len(used)
    for s in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
        symbols = list(rows[s]) or [0]
        first, tries = symbols[0], 0
        at = width + int(rng.random() * (size - width))
        while at - first in taken or any(used[k] for c in symbols if (k := at - first + c) < len(used)):
            tries += 1
            at = width + int(rng.random() * (size - width)) if tries < 256 else at + 1
        places[s] = at - first
        taken.add(at - first)
        if at - first + width > len(used):
            used.extend(bytes(at - first + width - len(used)))
        for c in rows[s]:
            used[at - first + c] = 1
    table = np.full(max([len(used), *(p + width for p in places)]), -1, dtype=np.int64)
    for p, row in zip(places, rows, strict=True):
        for c, to in row.items():
            table[p + c] = p << 32 | places[to]
    return table, np.array(places, dtype=np.int64)


class Model:
    """The automata of all languages, and where each symbol starts a piece in each of them."""

    def __init__(self, texts: Sample):
        self.names = [k for k, _ in texts]
        letters = sorted({c for _, t in texts for c in t.lower() if c.isalpha()})
        self.width = LETTERS + len(letters)
        self.codes = _letters().astype(np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(LETTERS, self.width)
        rows, roots = [], []
        for _, t in texts:
            roots.append(len(rows))
            step = suffix_automaton(self.encode(t).tolist())
            rows += [{c: to + roots[-1] for c, to in row.items()} for row in step]
            rows.append({})  # after a symbol that the sample lacks, a piece of its own
        self.table, places = lay_out(rows, self.width)
        self.starts = np.zeros((len(roots), self.width), dtype=np.int64)
        for k, r in enumerate(roots):
            self.starts[k] = places[(roots[k + 1] if k + 1 < len(roots) else len(rows)) - 1]
            self.starts[k, list(rows[r])] = places[list(rows[r].values())]
        self.weight = np.array([math.log2(max(2, len(t))) for _, t in texts])

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text; a run of anything but letters is one symbol."""
        c = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]
        keep = c != OTHER
        keep[1:] |= c[:-1] != OTHER
        return c[keep]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each text in each language, and its letters."""
        codes = [self.encode(t) for t in texts]
        letters = np.array([int((c != OTHER).sum()) for c in codes], dtype=np.int64)
        rows = np.array([-(-len(c) // STRETCH) for c in codes], dtype=np.int64)
        lanes = np.full((int(rows.sum()), STRETCH), PADDING, dtype=np.int32)
        flat, at = lanes.reshape(-1), 0
        for c, r in zip(codes, rows.tolist(), strict=True):
            flat[at : at + len(c)] = c
            at += r * STRETCH
        k, n = len(self.names), len(lanes)
        found = np.zeros((len(texts), k), dtype=np.int64)
        if n and k:
            by_step = np.ascontiguousarray(lanes.T)
            count = np.ones((k, n), dtype=np.int64)  # the piece still open at the end of a stretch
            state = self.starts[:, by_step[0]]
            for t in range(1, STRETCH):
                symbol = by_step[t]
                entry = self.table.take(state + symbol)
                ends = entry >> 32 != state
                state = np.where(ends, self.starts.take(symbol, axis=1), entry & 0xFFFFFFFF)
                count += ends & (symbol != PADDING)
            np.add.at(found, np.repeat(np.arange(len(texts)), rows), count.T)
        return found, letters


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=2)
def model(texts: Sample) -> Model:
    return Model(texts)


def _predict(text: str, keep: list[str], texts: Sample):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(texts)
        for piece in kernel.chunks(batches, text):
            body = [t or "" for t in piece.column(piece.schema.get_field_index(text)).to_pylist()]
            found, letters = m.pieces(body)
            names, scores = [UNKNOWN] * len(body), np.zeros(len(body))
            if m.names:
                cost = found * m.weight
                order = np.sort(cost, axis=1)
                margin = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9) if len(m.names) > 1 else np.ones(len(body))
                best = cost.argmin(axis=1)
                names = [m.names[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
                scores = np.where(letters > 0, margin, 0.0)
            cols = piece.select(keep).columns
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, texts: Sample, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: how far the second language lies behind).

    Returns the columns of ``docs`` but the text; input columns of the two names are
    replaced.  Every text is parsed from end to end.

    A null text or one without a letter is ``und`` with score 0, as is every text if
    nothing was learned.  Ties go to the first language in order of name, with score 0.
    An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, text).mapInArrow(_predict(text, keep, texts), schema)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: a quarter, by the checksum of their key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))
