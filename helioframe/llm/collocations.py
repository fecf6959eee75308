"""Frequent phrases by set-oriented mining (SETM) and their association scores.

An occurrence relation holds, for each position of the corpus, which phrase of k words
starts there.  It is stored sorted by piece and position, cut into chunks of text.  To go
from k to k + 1 words:

1. merge-join the relation with itself on piece and adjacent position (both sides are in
   that order, so a chunk is joined with itself by one shift),
2. count each chunk's groups, then the groups of all chunks,
3. semi-join the relation with the groups that are frequent enough.

Chunks send each of their groups once, with its count, to the bucket of its hash, and get
back which are frequent, so a phrase that fills the corpus weighs as much in a shuffle as
one that a chunk holds once.  Groups travel as packed columns of numbers.  A frequent
phrase is numbered by its bucket; numbers and words, not hashes, are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from helioframe.llm import kernel
from helioframe.llm.common import drop_stored, settle, ship

LONGEST, SUPPORT = 5, 100
#: A phrase goes if a longer one holds it and has this share of its count, in per cent.
COVERED = 100
TOP = 2000
#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK = 1 << 23
#: Groups that a bucket counts, about.
BUCKET = 1 << 20
#: Parts of a language's candidates, so that a large one is ranked by several tasks.
PARTS = 32

#: Every sign that ends a piece becomes a full stop, a tab a space, a capital A-Z small.
_FOLD = bytes(
    ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def _pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed byte plane by byte plane."""
    kind = "<u8" if len(values) and int(values.max()) >= 1 << 32 else "<u4"
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), int(kind[2:])).T
    return kind[2:].encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    size = int(data[:1])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    planes = planes.reshape(size, len(planes) // size)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.int64)


def _pack_words(words: list[bytes]) -> bytes:
    """Words hold no line ends."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _unpack_words(data: bytes, n: int) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n") if n else []


def words_of(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number of the word at each position (-1 where a piece ends), the words and their counts."""
    data = b".".join((t or "").encode("utf-8", "surrogatepass") for t in texts)
    number: dict[bytes, int] = {b".": 0}
    tokens = data.translate(_FOLD).replace(b".", b" . ").split()
    ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int32, len(tokens)) - 1
    return ids, list(number)[1:], np.bincount(ids[ids >= 0], minlength=len(number) - 1)


#: ``a`` and ``b``: the words of a chunk, or the pairs of shorter phrases; ``words`` is their sum of counts.
_RELATION = "chunk long, lang string, ids binary, n long, words long, a binary, b binary, counts binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [f for f, _ in fields])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def done(lang: str) -> pa.RecordBatch:
        ids, words, counts = words_of(held.pop(lang))
        return _rows(_RELATION, [((part << 32) + n, lang, _pack(ids + 1), len(words), int(counts.sum()), _pack_words(words), None, _pack(counts))])

    for piece in kernel.chunks(batches, "text", CHUNK):
        for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
            size = len(text or "")
            if held.get(lang) and sizes[lang] + size > CHUNK:
                yield done(lang)
                n += 1
            if lang not in held:
                held[lang], sizes[lang] = [], 0
            held[lang].append(text)
            sizes[lang] += size
    for lang in list(held):
        yield done(lang)
        n += 1


_MESSAGE = "bucket int, chunk long, lang string, local binary, a binary, b binary, counts binary"


def _send(buckets: int):
    """Groups of a chunk, one message for each bucket that is to count some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = _unpack(r["counts"])
                if r["b"] is None:
                    words = _unpack_words(r["a"], r["n"])
                    lang = r["lang"].encode()
                    at = np.fromiter((zlib.crc32(w, zlib.crc32(lang)) for w in words), np.int64, len(words)) % buckets
                else:
                    first, second = _unpack(r["a"]), _unpack(r["b"])
                    at = (kernel.mix(first.astype(np.uint64) * np.uint64(kernel.BYTE_BASE) + second.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(buckets + 1))
                out = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[k] : cuts[k + 1]]
                    body = (_pack_words([words[i] for i in own.tolist()]), None) if r["b"] is None else (_pack(first[own]), _pack(second[own]))
                    out.append((k, r["chunk"], r["lang"], _pack(own), *body, _pack(counts[own])))
                yield _rows(_MESSAGE, out)

    return run


_ANSWER = "chunk long, lang string, local binary, id binary, a binary, b binary, counts binary"


def _groups(messages: list[dict]) -> tuple[np.ndarray, int, object]:
    """Number of the group of each message's entries, the count of groups, and how to name them."""
    if messages[0]["b"] is None:
        keys = [(m["lang"].encode() + b"\t", _unpack_words(m["a"], 1)) for m in messages]
        coded = pa.array([lang + w for lang, words in keys for w in words], pa.large_binary()).dictionary_encode()
        return coded.indices.to_numpy(), len(coded.dictionary), coded.dictionary
    first, second = (np.concatenate([_unpack(m[c]) for m in messages]) for c in "ab")
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))
    group = np.empty(len(first), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return group, int(new.sum()), (f[new], s[new])


def _count(support: int, buckets: int):
    """Frequent groups of a bucket: what each chunk is told, and one row without a chunk that lists them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        messages = table.to_pylist()
        group, n, names = _groups(messages)
        counts = np.concatenate([_unpack(m["counts"]) for m in messages])
        sums = np.bincount(group, counts, minlength=n).astype(np.int64)  # exact below 2 ** 53
        good = sums >= support
        ids = (np.cumsum(good) - 1) * buckets + key[0].as_py()
        out, at = [], 0
        for m in messages:
            local = _unpack(m["local"])
            own = group[at : at + len(local)]
            at += len(local)
            told = good[own]
            if told.any():
                out.append((m["chunk"], m["lang"], _pack(local[told]), _pack(ids[own[told]]), None, None, None))
        if good.any():
            kept = np.flatnonzero(good)
            if messages[0]["b"] is None:
                for lang in {m["lang"] for m in messages}:
                    mine = [(i, w) for i, w in zip(kept.tolist(), names.take(pa.array(kept)).to_pylist(), strict=True) if w.rpartition(b"\t")[0] == lang.encode()]
                    if mine:
                        at = np.array([i for i, _ in mine])
                        out.append((None, lang, None, _pack(ids[at]), _pack_words([w.rpartition(b"\t")[2] for _, w in mine]), None, _pack(sums[at])))
            else:
                out.append((None, None, None, _pack(ids[kept]), _pack(names[0][kept]), _pack(names[1][kept]), _pack(sums[kept])))
        return pa.Table.from_batches([_rows(_ANSWER, out)])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frequent groups, one a row."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, counts = _unpack(r["id"]), _unpack(r["counts"])
            words = r["b"] is None
            phrase = pa.array([w.decode("utf-8", "replace") for w in _unpack_words(r["a"], 1)] if words else [None] * len(ids), pa.string())
            pair = [pa.nulls(len(ids), pa.int64())] * 2 if words else [pa.array(_unpack(r[c])) for c in "ab"]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r["lang"]] * len(ids), pa.string()), phrase, *pair, pa.array(counts)], ["id", "lang", "phrase", "first", "second", "a"])


def longer(ids: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step: phrase at each position, the pairs of shorter phrases it consists of, and their counts.

    ``ids`` numbers the phrase at each position, ``local`` are the frequent ones; a pair
    is two places in ``local``.
    """
    place = np.full(int(ids.max(initial=-1)) + 2, -1, dtype=np.int64)  # the last entry answers for -1
    place[local] = np.arange(len(local))
    at = place[ids]
    adjacent = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    pair, inverse, counts = np.unique(at[adjacent] * len(local) + at[adjacent + 1], return_inverse=True, return_counts=True)
    new = np.full(len(ids), -1, dtype=np.int64)
    new[adjacent] = inverse
    return new, np.stack((pair // max(1, len(local)), pair % max(1, len(local)))), counts


def _extend(key: tuple, relation: pa.Table, told: pa.Table) -> pa.Table:
    rows = relation.to_pylist()
    if not rows or told.num_rows == 0:
        return pa.Table.from_batches([_rows(_RELATION, [])])
    local, number = (np.concatenate([_unpack(v) for v in told.column(c).to_pylist()]) for c in ("local", "id"))
    order = np.argsort(local)
    local, number = local[order], number[order]
    new, pairs, counts = longer(_unpack(rows[0]["ids"]) - 1, local)
    row = (rows[0]["chunk"], rows[0]["lang"], _pack(new + 1), len(counts), int(counts.sum()), _pack(number[pairs[0]]), _pack(number[pairs[1]]), _pack(counts))
    return pa.Table.from_batches([_rows(_RELATION, [row] if len(counts) else [])])


def _counted(relation: DataFrame, support: int) -> DataFrame:
    """Answers to the chunks and the frequent groups, stored."""
    total = relation.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET), min(total >> 14, relation.sparkSession.sparkContext.defaultParallelism))
    sent = relation.select("chunk", "lang", "n", "a", "b", "counts").mapInArrow(_send(buckets), _MESSAGE)
    return settle(sent.groupBy("bucket").applyInArrow(_count(support, buckets), _ANSWER))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT) -> list[DataFrame]:
    """For each length, the phrases that occur ``support`` times or more in a language.

    Stored tables of ``id``, ``lang``, ``n`` (words of the language), ``phrase``, ``a``
    (its count), ``last`` word, ``pre`` and ``suf`` (counts of its first 1, 2, ... and
    of its last 1, 2, ... words), and from two words on ``first`` and ``second``, the
    ids of the phrases without its last and its first word.
    """
    ship(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    relation = settle(base.mapInArrow(_first, _RELATION))
    totals = relation.groupBy("lang").agg(F.sum("words").alias("n"))
    totals = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    out: list[DataFrame] = []
    while True:
        answers = _counted(relation, support)
        listed = answers.where("chunk IS NULL").mapInArrow(_listed, "id long, lang string, phrase string, first long, second long, a long")
        if not out:
            none = F.array().cast("array<long>")
            found = listed.withColumn("part", _part("phrase")).join(totals, ["lang", "part"])
            found = found.select("id", "lang", "n", "phrase", "a", F.col("phrase").alias("last"), none.alias("pre"), none.alias("suf"))
        else:
            x, y = (out[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in out[-1].columns]) for side in "xy")
            named = listed.select("id", "first", "second", "a").join(x, F.col("first") == F.col("x_id")).join(y, F.col("second") == F.col("y_id"))
            found = named.select(
                "id", "first", "second", F.col("x_lang").alias("lang"), F.col("x_n").alias("n"), F.concat_ws(" ", "x_phrase", "y_last").alias("phrase"), "a",
                F.col("y_last").alias("last"), F.concat("x_pre", F.array("x_a")).alias("pre"), F.concat("y_suf", F.array("y_a")).alias("suf"),
            )
        out.append(settle(found))
        if len(out) == longest:
            drop_stored(relation, answers)
            return out
        told = answers.where("chunk IS NOT NULL").select(F.col("chunk").alias("of"), "local", "id")
        both = relation.select("chunk", "lang", "ids").groupBy("chunk").cogroup(told.groupBy("of"))
        longer_ = settle(both.applyInArrow(_extend, _RELATION))
        drop_stored(relation, answers)
        relation = longer_


def _part(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def scored() -> Column:
    """The lowest-scoring cut of a phrase: ``score``, ``k``, ``l``, ``r``; exact at any size.

    The products are decimals of 38 digits; counts up to 10 ** 17 fit.
    """
    d = lambda c: c.cast(T.DecimalType(38, 0))
    cut = lambda k: F.struct(k.alias("k"), F.get("pre", k - 1).alias("l"), F.get("suf", F.size("pre") - k).alias("r"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("pre")), cut)

    def score(c: Column) -> Column:
        over, under = d(F.lit(1000)) * d(F.col("a")) * d(F.col("n")), d(c["l"]) * d(c["r"])
        return F.struct(_div(over, under).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))

    return F.array_min(F.transform(cuts, score))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """The best phrases of two to ``longest`` words of each language.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends, and those into words at
    spaces and tabs, with A-Z lower-cased; a phrase lies within one piece.  A candidate
    occurs ``support`` times or more.  With ``a`` its count, ``l`` and ``r`` those of its
    parts and ``n`` the words of the language, a cut scores floor(1000 a n / (l r)); the
    lowest counts, of equal ones the first.  A candidate within a longer one of
    ``covered`` per cent of its count or more is left out: as counts only fall with
    length, it is enough to look at those longer by one word.  Returns ``lang``, ``rank``,
    ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ordered by score, count and phrase.

    A null text has no words; a null language is ``und``.  Repeated rows count each
    time.  An empty table, or one without frequent phrases, gives an empty table.  Other
    columns are ignored.  The number of phrases per language is the ``top`` asked for.
    """
    levels = frequent_phrases(docs, text, lang, longest, support)
    parts = []
    for short, long in zip(levels[1:], [*levels[2:], None], strict=True):
        if long is not None:
            inside = long.select(F.col("first").alias("id"), F.col("a").alias("most")).union(long.select("second", "a"))
            short = short.join(inside.groupBy("id").agg(F.max("most").alias("most")), "id", "left")
            short = short.where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True)))
        parts.append(short.select("lang", "phrase", "a", "n", scored().alias("s")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = [F.desc("s.score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", _part("phrase")).orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "s.l", "s.r", "n", F.col("s.score").cast("long").alias("score"))
