"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the words of the benchmark, with document frequencies
counted over all passages of the corpus.  A distributed randomised SVD of the passage
matrix (every benchmark item, and as background every piece of the corpus that holds a
word of the benchmark) gives the latent space; every passage of every text is folded into
it and compared with every item by cosine.  An item longer than a passage is searched by
overlapping parts of a passage's length.  What is near is then checked on the words of
the whole item, in a region as long as the item asks for: the longest common subsequence,
and the item's most telling words (its answer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm import kernel
from helioframe.llm.common import settle, ship

#: Words of a piece, and pieces of a passage: passages of 32 and 64 words start at every piece.
PIECE, PASSAGES = 16, (2, 4)
RANK, EXTRA, POWER = 128, 16, 2
#: Words of the passages that are multiplied at once (few, so that their matrix stays small), and words of a block of sums.
SLICE, SUMS = 1 << 11, 256
#: Words of the longest passage, which are also those of a part of an item, and from part to part.
LONGEST, STRIDE = max(PASSAGES) * PIECE, max(PASSAGES) * PIECE // 2
#: Parts of items compared at once; a larger benchmark is taken in several rounds.
ROUND = 4096
#: Parts of an item that must be found: cosine, common subsequence, telling words.
COSINE, SUBSEQUENCE, ANSWER = 0.6, 0.6, 0.6
MARGIN, TELLING = 24, 5
#: Of an item longer than a passage, words up to four times as frequent as the fifth are telling too.
TIED = np.log(4.0)

MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.DoubleType())])


@dataclass
class Space:
    """Words (sorted hashes), their folded vectors, the items, and the vectors of their parts."""

    vocabulary: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    item_ids: list[int]
    item_words: list[np.ndarray]
    owner: np.ndarray  # item and first word of each part
    offset: np.ndarray
    parts: np.ndarray


def _lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Column of each word, or -1."""
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at, -1)


def part_starts(n: int) -> range:
    """First words of the parts of an item of ``n`` words: every word is in one, most are in two."""
    return range(0, max(1, n - STRIDE), STRIDE)


def _pieces(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Piece of each word, and the pieces at which each text starts."""
    n = np.diff(w.bounds)
    first = np.concatenate(([0], np.cumsum(-(-n // PIECE))))
    inner = np.arange(int(n.sum())) - np.repeat(w.bounds[:-1], n)
    return np.repeat(first[:-1], n) + inner // PIECE, first


def _count(vocabulary: np.ndarray, text: str):
    """Passage frequencies of the words of one task, and the words of its passages, one row a chunk of texts."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("cols", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in kernel.chunks(batches, text):
            w = kernel.words(batch.column(batch.schema.get_field_index(text)).to_pylist(), kernel.FOLD)
            piece, first = _pieces(w)
            col = _lookup(vocabulary, w.hashes)
            hit = col >= 0
            pairs = np.unique(piece[hit] * len(vocabulary) + col[hit])
            passages += int(first[-1])
            if len(pairs):
                owner, cols = pairs // len(vocabulary), pairs % len(vocabulary)
                total += np.bincount(cols, minlength=len(vocabulary))
                sizes = np.diff(np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))))
                row = [[2], [0], [len(sizes)], [cols.astype("<i4").tobytes()], [sizes.astype("<i4").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)
        seen = np.flatnonzero(total)
        none = [None] * (len(seen) + 1)
        rows = [[0] * len(seen) + [1], [*seen.tolist(), 0], [*total[seen].tolist(), passages], none, none]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def _product(idf: np.ndarray, right: np.ndarray, gram: bool):
    """Of the rows of one task: A' (A X), or (A X)' (A X), in blocks of ``SUMS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, narrow = np.zeros((right.shape[1],) * 2 if gram else right.shape), right.astype(np.float32)
        for batch in batches:
            for blob, lengths, weight in zip(*(batch.column(c).to_pylist() for c in ("cols", "sizes", "weight")), strict=True):
                cols, sizes = np.frombuffer(blob, "<i4"), np.frombuffer(lengths, "<i4")
                ends = np.cumsum(sizes)
                a = 0
                while a < len(sizes):  # whole passages, some at a time, to bound the memory
                    begin = int(ends[a] - sizes[a])
                    b = max(a + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
                    c, size = cols[begin : ends[b - 1]], sizes[a:b]
                    first, owner = ends[a:b] - size - begin, np.repeat(np.arange(b - a), size)
                    value = idf[c]
                    value = value * (weight / np.maximum(np.sqrt(np.add.reduceat(value * value, first)), 1e-12))[owner]
                    own, place = np.unique(c, return_inverse=True)
                    dense = np.zeros((b - a, len(own)), dtype=np.float32)
                    dense[owner, place] = value
                    image = dense @ narrow[own]
                    if gram:
                        out += image.T @ image
                    else:
                        out[own] += dense.T @ image
                    a = b
        task, block = TaskContext.get().partitionId(), range(0, len(out), SUMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int64()), pa.array([task] * len(block), pa.int64()), pa.array([out[k : k + SUMS].tobytes() for k in block], pa.binary())],
            ["block", "task", "part"],
        )

    return run


def _add(parts: pa.Table) -> pa.Table:
    """Sum of one block over all tasks, in their order."""
    parts = parts.sort_by("task")
    total = np.zeros(len(parts.column("part")[0].as_py()) // 8)
    for part in parts.column("part"):
        total += np.frombuffer(part.as_py())
    return pa.table({"block": parts.column("block").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of the weighted, normalised passage matrix.

    ``rows`` stay distributed; each holds some passages: ``cols`` (their words, one passage
    after another) and ``sizes`` as 32-bit integers, and a ``weight``.  As many tasks as
    there are cores send one block of sums each, of the size of the benchmark's vocabulary
    times the rank; their total comes to the driver.
    """
    wide = min(rank + EXTRA, len(idf))
    x = np.random.default_rng(7).standard_normal((len(idf), wide))
    rows = rows.select("cols", "sizes", "weight").coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def total(right, gram):
        parts = rows.mapInArrow(_product(idf, right, gram), "block long, task long, part binary")
        summed = parts.groupBy("block").applyInArrow(_add, "block long, part binary").orderBy("block").collect()
        return np.concatenate([np.frombuffer(r["part"]) for r in summed]).reshape((wide, wide) if gram else right.shape)

    for _ in range(POWER):
        x, _ = np.linalg.qr(total(x, False))
    value, vector = np.linalg.eigh(total(x, True))
    order = np.argsort(value)[::-1][:rank]
    return x @ vector[:, order[value[order] > 1e-9 * max(value.max(), 1e-12)]]


def fit(docs: DataFrame, items: list[tuple[int, str]], text: str = "text", rank: int = RANK) -> Space | None:
    """Latent space of some benchmark items over the corpus; None if no item has a word."""
    ship(docs.sparkSession)
    w = kernel.words([t for _, t in items], kernel.FOLD)
    per_item = [w.hashes[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    kept = [(i, h) for (i, _), h in zip(items, per_item, strict=True) if len(h)]
    if not kept:
        return None
    vocabulary = np.unique(w.hashes)
    counted = settle(docs.select(text).mapInArrow(_count(vocabulary, text), "kind int, key long, n long, cols binary, sizes binary"))
    frequency = np.zeros(len(vocabulary))
    passages = counted.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    for r in counted.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).toLocalIterator():  # one row a word of the benchmark
        frequency[r["key"]] = r["n"]
    idf = np.log((2.0 + passages) / (1.0 + frequency))
    words = [_lookup(vocabulary, h) for _, h in kept]
    owner, offset = np.array([(i, at) for i, x in enumerate(words) for at in part_starts(len(x))]).T
    parts = [words[i][at : at + LONGEST] for i, at in zip(owner, offset, strict=True)]
    cols = [np.unique(x) for x in parts]
    background = counted.where("kind = 2")
    n = background.agg(F.sum("n")).first()[0] or 0
    # The items weigh as much as the whole background, so that their own words shape the space.
    weight = float(np.sqrt(max(n, len(parts)) / len(parts)))
    own = [(np.concatenate(cols).astype("<i4").tobytes(), np.array([len(c) for c in cols], "<i4").tobytes(), weight)]
    own = docs.sparkSession.createDataFrame(own, "cols binary, sizes binary, weight double")
    rows = background.select("cols", "sizes", F.lit(1.0).alias("weight")).unionByName(own)
    basis = idf[:, None] * randomised_svd(rows, idf, rank)
    vectors = np.array([basis[x].sum(axis=0) for x in parts])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Space(vocabulary, idf, basis.astype(np.float32), [i for i, _ in kept], words, owner, offset, vectors.astype(np.float32))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each element of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = row & where.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


class _Search:
    def __init__(self, space: Space):
        self.s = space
        self.telling = []
        for words in space.item_words:
            distinct = np.unique(words)
            order = distinct[np.argsort(-space.idf[distinct], kind="stable")]
            if len(words) > LONGEST:  # words that its own paraphrases lack are the rarest, so all that are nearly as rare count
                keys = order[space.idf[order] >= space.idf[order[:TELLING][-1]] - TIED]
            else:
                keys = order[:TELLING]
            self.telling.append(frozenset(keys.tolist()))

        self.any_telling = np.zeros(len(space.vocabulary), dtype=bool)
        self.any_telling[[c for t in self.telling for c in t]] = True

    @staticmethod
    def _starts(marked, first, size):
        """Starts of the passages that hold a marked piece of their text."""
        begin = first[np.searchsorted(first, marked, "right") - 1]
        return np.unique(np.concatenate([np.maximum(marked - k, begin) for k in range(size)]))

    def __call__(self, texts: list[str | None]) -> list[list[dict]]:
        """Matches of each text; a passage without any telling word has no answer and is not folded."""
        s = self.s
        w = kernel.words(texts, kernel.FOLD)
        out: list[list[dict]] = [[] for _ in texts]
        piece, first = _pieces(w)
        n = int(first[-1])
        if not n:
            return out
        col = _lookup(s.vocabulary, w.hashes)
        last = np.repeat(first[1:], np.diff(first))  # the piece after the text's last one
        hit = np.flatnonzero(col >= 0)
        marked = np.unique(piece[hit[self.any_telling[col[hit]]]])
        if not len(marked):
            return out
        starts = [self._starts(marked, first, size) for size in PASSAGES]
        need = np.zeros(n + max(PASSAGES), dtype=bool)
        for k in range(max(PASSAGES)):
            need[starts[-1] + k] = True
        row = np.cumsum(need) - 1
        hit = hit[need[piece[hit]]]
        sums = np.zeros((int(need.sum()), s.basis.shape[1]), dtype=np.float32)
        cuts = np.flatnonzero(np.append(True, piece[hit][1:] != piece[hit][:-1]))
        for a in range(0, len(cuts), 2048):  # some pieces at a time, to bound the memory
            part = cuts[a : a + 2048]
            end = cuts[a + 2048] if a + 2048 < len(cuts) else len(hit)
            sums[row[piece[hit[part]]]] = np.add.reduceat(s.basis[col[hit[part[0] : end]]], part - part[0], axis=0)
        best: dict[tuple[int, int], float] = {}
        for size, start in zip(PASSAGES, starts, strict=True):
            for a in range(0, len(start), 4096):
                st = start[a : a + 4096]
                vec = sums[row[st]]
                for k in range(1, size):  # the passage ends with its text
                    more = st + k < last[st]
                    vec[more] += sums[row[st[more] + k]]
                vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), np.float32(1e-12))
                for b in range(0, len(s.parts), ROUND):  # more than one only for an item of many parts
                    cos = vec @ s.parts[b : b + ROUND].T
                    for p, i in zip(*np.nonzero(cos >= COSINE), strict=True):
                        key = (int(st[p]), b + int(i))
                        best[key] = max(best.get(key, 0.0), float(cos[p, i]))
        return self._check(w, col, first, best, out)

    def _region(self, begin: int, end: int, at: int, part: int) -> tuple[int, int]:
        """Words of a text (``begin`` to ``end``) to check if the passage at ``at`` is near a part of an item.

        Around a short item that is the longest passage and a margin.  A long item would
        start its part's offset earlier (known to ``LONGEST`` words, so that its parts agree
        on few regions); half its words more on both sides leave room for words put in.
        """
        n = len(self.s.item_words[self.s.owner[part]])
        if n <= LONGEST:
            lo, hi = at - MARGIN, at + LONGEST + MARGIN
        else:
            lo = begin + (at - begin - int(self.s.offset[part])) // LONGEST * LONGEST - MARGIN - n // 2
            hi = lo + LONGEST + 2 * (MARGIN + n // 2) + n
        return max(begin, lo), min(end, hi)

    def _check(self, w, col, first, best, out):
        """Passages near an item that hold its words, one match for each text and item."""
        found: dict[tuple[int, int], dict] = {}
        near: dict[tuple[int, int, int, int], float] = {}
        for (p, part), cos in best.items():
            doc = int(np.searchsorted(first, p, "right")) - 1
            begin, end = int(w.bounds[doc]), int(w.bounds[doc + 1])
            key = (doc, int(self.s.owner[part]), *self._region(begin, end, begin + int(p - first[doc]) * PIECE, part))
            near[key] = max(near.get(key, 0.0), cos)
        for (doc, i, lo, hi), cos in sorted(near.items()):
            words, keys = self.s.item_words[i], self.telling[i]
            region = col[lo:hi].tolist()
            answer = len(keys.intersection(region)) / len(keys)
            if answer < ANSWER:
                continue
            lcs = common_subsequence(words.tolist(), region) / len(words)
            old = found.get((doc, i))
            if lcs >= SUBSEQUENCE and (old is None or (lcs, cos) > (old["lcs"], old["cosine"])):
                found[doc, i] = {"item_id": self.s.item_ids[i], "cosine": round(cos, 4), "lcs": lcs, "answer": answer}
        for (doc, _), m in sorted(found.items()):
            out[doc].append(m)
        return out


def rounds(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Items in order, as many at a time as have ``ROUND`` parts (one item alone may have more)."""
    some, n = [], 0
    for item in items:
        w = kernel.words([item[1]], kernel.FOLD)
        more = len(part_starts(len(w.hashes)))
        if some and n + more > ROUND:
            yield some
            some, n = [], 0
        some.append(item)
        n += more
    if some:
        yield some


def _flag(text: str, spaces: list[Space]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [_Search(s) for s in spaces]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
        for piece in kernel.chunks(batches, text):
            texts = piece.column(piece.schema.get_field_index(text)).to_pylist()
            found = [sum(parts, []) for parts in zip(*(s(texts) for s in searches), strict=True)] if searches else [[] for _ in texts]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, kind)], [*piece.schema.names, "matches"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add ``matches`` to each row: the benchmark items that its text holds or paraphrases.

    A match needs a passage with a cosine of ``COSINE`` to the item in the latent space,
    a common subsequence of ``SUBSEQUENCE`` of the item's words, and ``ANSWER`` of its
    most telling words, one of them in the passage itself.  Words are compared without ASCII case and signs.  The benchmark
    is the query set: it is held by every task, in rounds of ``ROUND`` parts of items.  An
    item may have any number of words; its share is always of the whole item.

    A null or blank text matches nothing, nor does an item without words; equal items
    are each reported.  An input column ``matches`` is replaced, all others stay.  An
    empty table or benchmark gives no matches.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c != "matches"]
    docs = docs.select(*own)
    items = [(r[0], r[1]) for r in benchmark.select(F.col(item).cast("long"), item_text).orderBy(item, item_text).toLocalIterator()]
    spaces = [fit(docs, some, text) for some in rounds(items)]
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(MATCH))])
    return docs.mapInArrow(_flag(text, [s for s in spaces if s]), schema)
