"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q that repeats ``repeats`` times or more
and that no neighbouring word extends.  A run whose period lies in [B, 2B), B a power of
two, holds an aligned block of B words that occurs again q words later.  So at each scale
B the aligned blocks are held against the 2B - 1 words that start B words after them:

    sum over j of (block[j] - text[d + j]) ** 2
        = sum of block ** 2 + sum of text ** 2 - 2 * (correlation of both at d)

The correlation is an exact integer number theoretic transform, modulo as many primes as
the largest possible sum needs; a sum of zero is an occurrence at distance d.  Distances
are seeds: each is extended to both sides word by word, and kept if it is long enough.

Texts of a batch are numbered with distinct words, so no occurrence joins two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm import kernel
from helioframe.llm.common import ship

REPEATS, SHORTEST = 4, 6
#: Primes with a root of unity of order 2 ** 26 or more, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3), (1811939329, 13))
#: Longest transforms are 2 ** 26, so blocks of 2 ** 25 words are the largest.
LARGEST_SCALE = 25
#: Numbers that one call transforms.
SLAB = 1 << 18


def _twiddles(size: int, prime: int, generator: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each halving, longest first."""
    out, half = [], size // 2
    while half:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        root = pow(root, -1, prime) if inverse else root
        w = np.ones(half, dtype=np.uint64)
        n = 1
        while n < half:  # the next n powers are the first n times root ** n
            w[n : 2 * n] = w[:n] * np.uint64(pow(root, n, prime)) % np.uint64(prime)
            n *= 2
        out.append(w)
        half //= 2
    return out


class _Transform:
    """Cyclic convolution of rows of ``size`` integers modulo one prime."""

    def __init__(self, size: int, prime: int, generator: int):
        self.p, self.size = np.uint64(prime), size
        self.down = _twiddles(size, prime, generator, False)
        self.up = _twiddles(size, prime, generator, True)[::-1]
        self.scale = np.uint64(pow(size, -1, prime))

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Values in bit-reversed order; the inverse takes them in that order."""
        rows = len(x)
        for w in self.down:
            x = x.reshape(rows, -1, 2, len(w))
            a, b = x[:, :, 0], x[:, :, 1]
            x = np.stack(((a + b) % self.p, (a + self.p - b) % self.p * w % self.p), axis=2)
        return x.reshape(rows, self.size)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        rows = len(x)
        for w in self.up:
            x = x.reshape(rows, -1, 2, len(w))
            a, b = x[:, :, 0], x[:, :, 1] * w % self.p
            x = np.stack(((a + b) % self.p, (a + self.p - b) % self.p), axis=2)
        return x.reshape(rows, self.size) * self.scale % self.p

    def convolve(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.inverse(self.forward(a) * self.forward(b) % self.p)


_transforms: dict[tuple[int, int], _Transform] = {}


def _transform(size: int, prime: int, generator: int) -> _Transform:
    if (size, prime) in _transforms:
        return _transforms[size, prime]
    made = _Transform(size, prime, generator)
    if size <= 1 << 14:  # longer tables are made for the few texts that need them
        _transforms[size, prime] = made
    return made


def matches(blocks: np.ndarray, texts: np.ndarray, largest: int) -> np.ndarray:
    """Where each block occurs in its own text: booleans, row by row, for each offset.

    ``blocks`` has B columns and ``texts`` 2B - 1, of integers from 0 to ``largest``.
    """
    rows, size = blocks.shape
    found = np.ones((rows, size), dtype=bool)
    left, bound = size * largest * largest + 1, 1
    for prime, generator in PRIMES:
        p, t = np.uint64(prime), _transform(2 * size, prime, generator)
        a, b = np.zeros((rows, 2 * size), dtype=np.uint64), np.zeros((rows, 2 * size), dtype=np.uint64)
        a[:, :size] = blocks[:, ::-1] % p
        b[:, : 2 * size - 1] = texts % p
        both = t.convolve(a, b)[:, size - 1 : 2 * size - 1]
        sums = np.zeros((rows, 2 * size), dtype=np.uint64)
        np.cumsum(b[:, : 2 * size - 1] ** 2 % p, axis=1, out=sums[:, 1:])
        squares = (a**2 % p).sum(axis=1, keepdims=True) + sums[:, size:] - sums[:, :size]
        found &= squares % p == 2 * both % p
        bound *= prime
        if bound >= left:  # the sum is below the product of the primes: zero is zero
            return found
    raise ValueError("a batch of words too large for the primes")


def _extend(x: np.ndarray, a: int, d: int, size: int) -> tuple[int, int]:
    """Largest stretch around ``x[a : a + size + d]`` in which words ``d`` apart are equal."""
    i, step, n = a + size, 64, len(x) - d
    while i < n:
        m = min(step, n - i)
        off = x[i : i + m] != x[i + d : i + d + m]
        j = int(off.argmax())
        if off[j]:
            i += j
            break
        i, step = i + m, 2 * step
    end, i, step = i + d, a, 64
    while i:
        m = min(step, i)
        off = (x[i - m : i] != x[i - m + d : i + d])[::-1]
        j = int(off.argmax())
        if off[j]:
            i -= j
            break
        i, step = i - m, 2 * step
    return i, end


def runs_of(x: np.ndarray, longest: int, repeats: int = REPEATS, shortest: int = SHORTEST) -> np.ndarray:
    """Runs in a row of word numbers: start, length, period, in order of start and period.

    ``longest`` bounds the length of a run.  ``repeats`` of three or more.
    """
    n, out = len(x), []
    if n == 0:
        return np.zeros((0, 3), dtype=np.int64)
    x = x.astype(np.int64)
    largest, stride = int(x.max()) + 1, 2 * n + 2
    key = np.sort(x * stride + np.arange(n))
    last = np.zeros(largest, dtype=np.int64)
    last[x] = np.arange(n)
    reach = last[x] - np.arange(n)  # least distance from a block's words to their last occurrences
    for scale in range(LARGEST_SCALE + 1):
        size = 1 << scale
        if repeats * size > longest:
            break
        at = np.flatnonzero(reach >= size)
        at = at[at < n // size]
        at = _may_recur(x, key, stride, at, size) * size
        reach = np.minimum(reach[0 : len(reach) - 1 : 2], reach[1::2])
        out += _at_scale(x, at, size, largest, out, repeats, shortest)
    found = np.array(out, dtype=np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _may_recur(x: np.ndarray, key: np.ndarray, stride: int, at: np.ndarray, size: int) -> np.ndarray:
    """Blocks each of whose words occurs again ``size`` to ``2 * size - 1`` words later; no other block can."""
    for low in range(0, size, 8):  # most blocks fall on their first words
        if not len(at):
            break
        p = (at[:, None] * size + np.arange(low, min(low + 8, size))).ravel()
        first = x[p] * stride + p + size
        i = np.searchsorted(key, first)
        ok = (i < len(key)) & (key[np.minimum(i, len(key) - 1)] < first + size)
        at = at[ok.reshape(len(at), -1).all(axis=1)]
    return at


def _at_scale(x, at, size, largest, before, repeats, shortest) -> list[tuple[int, int, int]]:
    """Runs with a period from ``size`` to ``2 * size - 1``, from the blocks that start at ``at``."""
    starts, dists = [], []
    padded = np.append(x, np.full(3 * size, largest))  # no word has the number ``largest``
    rows = max(1, SLAB // (2 * size))
    for i in range(0, len(at), rows):
        some = at[i : i + rows]
        near, far = some[:, None] + np.arange(size), some[:, None] + size + np.arange(2 * size - 1)
        row, d = np.nonzero(matches(padded[near].astype(np.uint64), padded[far].astype(np.uint64), largest))
        starts.append(some[row])
        dists.append(d + size)
    if not starts:
        return []
    a, d = np.concatenate(starts), np.concatenate(dists)
    if before:  # inside a run of a smaller period every distance is a multiple of that period
        known = np.array(sorted((s, s + length) for s, length, _ in before))
        reach = np.maximum.accumulate(known[:, 1])
        i = np.searchsorted(known[:, 0], a, "right") - 1
        open_ = (i < 0) | (reach[np.maximum(i, 0)] < a + d + size)
        a, d = a[open_], d[open_]
    out, done = [], (0, 0)
    order = np.lexsort((a, d))
    for start, dist in zip(a[order].tolist(), d[order].tolist(), strict=True):
        if done[0] == dist and start < done[1]:
            continue  # the stretch before went on over this block
        s, e = _extend(x, start, dist, size)
        done = dist, e - dist
        if e - s >= max(shortest, repeats * dist):
            out.append((s, e - s, dist))
    return out


def _numbers(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their numbers (never shared by two texts), and where each text starts."""
    words, ids, used = [], [], 0
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").split()  # at the six ASCII white space bytes
        number = {x: i for i, x in enumerate(dict.fromkeys(w), used)}
        ids.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
        used += len(number)
        words.append(w)
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    return words, np.concatenate([*ids, np.zeros(0, np.int64)]), bounds


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(repeats: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernel.chunks(batches, "text"):
            words, x, bounds = _numbers(piece.column("text").to_pylist())
            found = runs_of(x, int(np.diff(bounds).max(initial=0)), repeats, shortest)
            doc = np.searchsorted(bounds, found[:, 0], "right") - 1
            cut = np.searchsorted(doc, np.arange(len(words) + 1))
            drop = np.zeros(len(x) + 1, dtype=np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 0] + found[:, 1], -1)
            keep = np.cumsum(drop)[:-1] == 0
            left = [b" ".join(compress(w, keep[bounds[i] : bounds[i + 1]].tolist())) for i, w in enumerate(words)]
            found[:, 0] -= bounds[doc]
            runs = pa.ListArray.from_arrays(
                pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], fields=list(_RUN))
            )
            cols = [piece.column("key"), pa.array(np.diff(bounds)), runs, pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", repeats: int = REPEATS, shortest: int = SHORTEST) -> DataFrame:
    """``key``, ``n_words``, ``runs`` and the ``collapsed`` text of each row.

    ``runs`` are structs of ``start`` (word number), ``length`` and ``period``, by start
    and period: stretches of ``shortest`` words and ``repeats`` (three at least) periods
    or more.  ``collapsed`` holds the words of the text, joined by one space, without
    those that a run repeats, its first period stays.

    A null, empty or blank text has no words and no run.  Runs may overlap.  A row
    without a key and repeated rows are returned like any other; other columns are
    ignored.  An empty table gives an empty table.  A text is searched whole; texts
    over 4 x 2 ** 26 words are beyond the longest transform and periods over 2 ** 26
    words are not searched.
    """
    if repeats < 3:
        raise ValueError("a run must repeat three times or more")
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _find(repeats, shortest), f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return out.withColumnRenamed("key", key)


def digest(found: DataFrame) -> DataFrame:
    """Longest run and checksums of the result of ``find_runs``, in place of the runs and texts."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda r: F.concat(r, F.lit("\n"))), "")
    own = [c for c in found.columns if c not in ("n_words", "runs", "collapsed")]
    length, period = -F.col("best.l"), F.col("best.p")
    return found.withColumn("best", best).select(
        *own, F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
