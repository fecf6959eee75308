"""Near-duplicate classes by ProbMinHash of weighted word shingles.

A text is the set of its five-word shingles, weighted by 1 + ln(count).  Each shingle's
arrivals form a Poisson process with its weight as rate; an arrival falls on one of the
signature's components and the earliest one there is kept.  A shingle stops once its
next arrival is later than every component's.  Equal components of two signatures
estimate the probability Jaccard similarity; bands of components give candidates.

No group is expanded into pairs.  Equal texts are one node.  A bucket links its members
to its least node; what stays apart in a bucket is then compared block by block, on
signatures inside a task.  Every link is checked exactly on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm import kernel
from helioframe.llm.common import settle, ship

WIDTH, SIMILARITY = 5, 0.8
#: Bands of rows each: a pair of similarity 0.8 shares no band with a chance of 3e-6.
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Signatures below this estimate are not compared on the texts (0.8 is 3.2 deviations above).
ESTIMATE = 0.7
BLOCK = 2048
#: Bits of the filter that texts pass before they travel (8 MB at any size), and of one row of it.
FILTER_BITS, FILTER_ROW = 1 << 26, 4096
#: Components that an outsider is compared with in a round, and rounds before all pairs are.
NEAREST, NEAREST_ROUNDS = 4, 2
_STEP = 0x9E3779B97F4A7C15


def profiles(texts: list[str | None], width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text, sorted, and their weights; a text under ``width`` words is one shingle."""
    w = kernel.words(texts)
    shingles = kernel.windows(w.hashes, width)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(shingles[a : b - width + 1])
        else:
            own = kernel.windows(w.hashes[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
        out.append((own[at], 1 + np.log(np.diff(np.append(at, len(own))))))
    return out


def signatures(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shingle kept by each component; one row a text (texts without shingles give zeros)."""
    n = len(parts)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in parts])
    h, rate = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.full(n * SIZE, np.inf)
    kept = np.zeros(n * SIZE, dtype=np.uint64)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        u = kernel.mix(h + np.uint64((2 * turn + 1) * _STEP & kernel.M))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        v = kernel.mix(h + np.uint64((2 * turn + 2) * _STEP & kernel.M))
        cell = doc * SIZE + ((v >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        kept[cell[won]] = h[won]
        alive = time < first.reshape(n, SIZE).max(axis=1)[doc]
        h, rate, doc, time, turn = h[alive], rate[alive], doc[alive], time[alive], turn + 1
    return kept.reshape(n, SIZE)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard: the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    both = np.union1d(a[0], b[0])
    if not len(both):
        return 0.0
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])] = a[1]
    y[np.searchsorted(both, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    common = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ratio, ratio[common], "left")
    above, below = np.append(np.cumsum(x[::-1])[::-1], 0.0), np.append(0.0, np.cumsum(y))
    return float((1 / (above[at] / x[common] + below[at] / y[common])).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernel.lean()
    for big in kernel.chunks(batches, "text", 1 << 19):
        for a in range(0, big.num_rows, 1000):
            piece = big.slice(a, 1000)
            parts = profiles(piece.column("text").to_pylist())
            kept = signatures(parts)
            has = np.array([len(p[0]) > 0 for p in parts])
            grid = kernel.mix(kept).reshape(len(parts), BANDS, ROWS)
            band = kernel.mix((grid * kernel.powers(kernel.SECOND_BASE, ROWS)).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            bands = [row.view(np.int64).tolist() if ok else [] for row, ok in zip(band, has, strict=True)]
            small = (kernel.mix(kept) >> np.uint64(48)).astype("<u2")
            cols = [pa.array(bands, pa.list_(pa.int64())), pa.array([r.tobytes() for r in small], pa.binary())]
            yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("node"), *cols], ["key", "node", "bands", "signature"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact check; rows come in order of ``a``, whose profile is made once a run."""
    last: tuple[bytes | None, object] = (None, None)
    for batch in batches:
        for piece in kernel.chunks(iter([batch]), "text_b", 1 << 19):
            a, b = piece.column("a"), piece.column("b")
            good = []
            right = profiles(piece.column("text_b").to_pylist())
            left = piece.column("text_a")
            for i, node in enumerate(a.to_pylist()):
                if node != last[0]:
                    last = node, profiles([left[i].as_py()])[0]
                good.append(similarity(last[1], right[i]) >= SIMILARITY - 1e-12)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(good)], ["a", "b", "linked"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` with ``linked``, from the texts of the nodes."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return settle(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary, linked boolean"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Least node of each linked node's component, ``node`` and ``label``.

    Each round takes the least label among the neighbours and then the label of that
    label, so long chains halve; rounds are stored, and end when none changes.
    ``known`` are the labels of earlier links, all of which are among ``links``.
    """
    edges = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    if known is not None:
        start = label.join(known.withColumnRenamed("label", "old"), "node", "left")
        label = start.select("node", F.least("label", "old").alias("label"))
    label = settle(label)
    while True:
        far = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("far"))
        near = label.join(far, "node").select("node", F.col("label").alias("old"), F.least("label", "far").alias("label"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = settle(near.join(up, "label").select("node", "old", F.least("label", "up").alias("label")))
        label = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return label


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of a bucket against its outsiders: each outsider's nearest partners, by signature."""
    a, b = [], []
    for j, share, hit in _apart(left, right):
        hit = hit[np.argsort(-share[hit], kind="stable")]
        of = left.column("label").take(pa.array(hit)).to_pylist()
        for i in sorted({x: k for k, x in reversed(list(enumerate(of)))}.values())[:NEAREST]:
            pair = left.column("node")[int(hit[i])].as_py(), right.column("node")[j].as_py()
            a.append(min(pair))
            b.append(max(pair))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _apart(left: pa.Table, right: pa.Table):
    """For each outsider: its place, its agreement with the members, and the near ones of other components."""
    if left.num_rows and right.num_rows:
        sig = lambda t: np.frombuffer(b"".join(t.column("signature").to_pylist()), "<u2").reshape(t.num_rows, SIZE)
        members, outsiders = sig(left), sig(right)
        names = {x: i for i, x in enumerate(set(left.column("label").to_pylist()) | set(right.column("label").to_pylist()))}
        of = np.array([names[x] for x in left.column("label").to_pylist()])
        for j, (s, label) in enumerate(zip(outsiders, right.column("label").to_pylist(), strict=True)):
            same = members == s
            share = same.mean(axis=1)
            hit = np.flatnonzero((share >= ESTIMATE) & (of != names[label]))
            # A pair is met in each band that it shares; the first of them answers for it.
            first = same[hit].reshape(len(hit), BANDS, ROWS).all(axis=2).argmax(axis=1)
            hit = hit[first == left.column("band")[0].as_py()]
            if len(hit):
                yield j, share, hit


def _links(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of a bucket against its outsiders: the links between components, checked on the texts."""
    a, b, made = [], [], {}

    def profile(table: pa.Table, i: int):
        node = table.column("node")[i].as_py()
        if node not in made:
            made[node] = profiles([table.column("text")[i].as_py()])[0]
        return node, made[node]

    linked = set()
    for j, _, hit in _apart(left, right):
        mine = right.column("label")[j].as_py()
        for i in hit.tolist():
            pair = frozenset((mine, left.column("label")[i].as_py()))
            if pair not in linked:  # one link joins two components
                (u, p), (v, q) = profile(left, i), profile(right, j)
                if similarity(p, q) >= SIMILARITY - 1e-12:
                    linked.add(pair)
                    a.append(min(u, v))
                    b.append(max(u, v))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _rest(buckets: DataFrame, nodes: DataFrame, label: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Pairs of a bucket that lie in different components and may be similar.

    In each bucket that still holds several components, the members outside of its
    least member's component are compared with all its members, in blocks.  Without
    ``texts`` the nearest partners are returned, unchecked; with them the links.
    """
    placed = settle(buckets.join(label, "node", "left").select("h", "band", "node", F.coalesce("label", "node").alias("label")))
    split = placed.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", "node").alias("main"), F.count("*").alias("n"))
    open_ = split.where("lo != hi").select("h", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(open_, "h").join(nodes.select("node", "signature"), "node")
    cols = ["h", "band", "block", "part", "node", "label", "signature"]
    if texts is not None:
        rows, cols = rows.join(texts, "node"), [*cols, "text"]
    rows = settle(rows)
    outside = rows.where("label != main")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    here = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A bucket's outsiders go to each block of its members, split so that a task holds one block of each.
    there = outside.withColumn("block", F.explode(all_blocks)).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    here = here.withColumn("part", F.explode(all_blocks))
    both = here.select(*cols).groupBy("h", "block", "part").cogroup(there.select(*cols).groupBy("h", "block", "part"))
    return both.applyInArrow(_nearest if texts is None else _links, "a binary, b binary").distinct()


def _passing(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose ``node`` may be one of ``nodes``: all that are, and others by the filter's chance.

    The filter has a fixed number of bits; the fuller it is the more rows pass, and the
    join that follows is right in any case.
    """

    def bit(node: str):
        h = F.pmod(F.xxhash64(node), F.lit(FILTER_BITS))
        return F.floor(h / FILTER_ROW).cast("int").alias("row"), F.floor(h % FILTER_ROW / 64).cast("int").alias("word"), (h % 64).cast("int").alias("bit")

    words = nodes.select(*bit("node")).groupBy("row", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    held = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))  # FILTER_ROW / 64 entries at most
    held = held.select("row", F.transform(F.sequence(F.lit(0), F.lit(FILTER_ROW // 64 - 1)), lambda w: F.coalesce(F.try_element_at("of", w), F.lit(0).cast("long"))).alias("words"))
    own = rows.select("*", *bit("node")).join(F.broadcast(held), "row")  # FILTER_BITS / 8 bytes
    hit = F.call_function("shiftrightunsigned", F.get("words", F.col("word")), F.col("bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    return own.where(hit).select(*rows.columns)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``text_key`` (md5 of the text) and ``class_id``.

    A class is a connected component of texts linked by a similarity of ``SIMILARITY``
    or more; ``class_id`` is its least key.  Equal texts are always of one class.

    A null text is in a class of its own (``text_key`` null, ``class_id`` its key).
    Texts without a word match only equal texts; texts of one to four words have one
    shingle.  Rows without a key take part; a class of such rows alone has a null id.
    Repeated rows are each returned.  An empty table gives an empty table.  Other
    columns are ignored.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(key).alias("key"), F.unhex(F.md5(text)).alias("node"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    signed = settle(base.where("text is not null").mapInArrow(_sign, f"key {kind}, node binary, bands array<long>, signature binary"))
    nodes = settle(signed.groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    rows = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = rows.groupBy("h").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader != last").select("h", "leader")
    buckets = settle(rows.join(shared, "h").distinct())
    pairs = settle(buckets.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    met = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    texts = settle(_passing(base.where("text is not null"), met).join(met, "node").groupBy("node").agg(F.first("text").alias("text")))

    # One leader for each member, then whatever of the stars is not connected by that.
    one = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts)
    label = components(one.where("linked"))
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    apart = ~F.coalesce(F.col("label_a"), F.col("a")).eqNullSafe(F.coalesce(F.col("label_b"), F.col("b")))
    left = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b").join(one.select("a", "b"), ["a", "b"], "left_anti")
    est = nodes.select("node", "signature")
    two = verified(_likely(left, est), texts)
    links = one.where("linked").union(two.where("linked")).select("a", "b")
    seen = settle(one.union(two).select("a", "b"))

    # What is still apart in a bucket: nearest partners first, as most texts are then
    # connected, and at last every pair that is left, inside the tasks.
    label, members = components(links, label), buckets.select("h", "band", "node")
    for _ in range(NEAREST_ROUNDS):
        more = verified(_rest(members, est, label).join(seen, ["a", "b"], "left_anti"), texts)
        new = more.where("linked").select("a", "b")
        if new.isEmpty():
            break
        links, seen = settle(links.union(new)), settle(seen.union(more.select("a", "b")))
        label = components(links, label)
    last = settle(_rest(members, est, label, texts))
    if not last.isEmpty():
        label = components(links.union(last), label)

    named = nodes.select("node", "key").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = settle(named.groupBy("label").agg(F.min("key").alias("class_id")))
    classes = settle(named.join(ids, "label").select("node", "class_id"))
    text_key = F.lower(F.hex("node")).alias("text_key")
    found = signed.select("key", "node").join(classes, "node").select(F.col("key").alias(key), text_key, "class_id")
    alone = base.where("text is null").select(F.col("key").alias(key), F.lit(None).cast("string").alias("text_key"), F.col("key").alias("class_id"))
    return found.unionByName(alone)


def _likely(pairs: DataFrame, signatures_: DataFrame) -> DataFrame:
    """Pairs whose signatures agree often enough to be worth the texts."""
    a = signatures_.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    b = signatures_.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_agree, "a binary, b binary")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SIZE) for c in ("sig_a", "sig_b"))
        near = pa.array((x == y).mean(axis=1) >= ESTIMATE)
        yield batch.select(["a", "b"]).filter(near)


def first_of_class(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: the row of least key stays for each class.

    Of rows that repeat both key and text one stays.  Rows with a null text all stay.
    """
    found = near_duplicates(docs, key, text)
    kept = found.where(F.col("text_key").isNotNull()).groupBy("class_id").agg(F.min_by("text_key", F.struct(F.col(key).isNull(), key, "text_key")).alias("__key"), F.min(key).alias("__id"))
    mine = docs.withColumn("__text", F.md5(text))
    on = (F.col("__text") == F.col("__key")) & F.col(key).eqNullSafe(F.col("__id"))
    own = mine.join(kept.select("__key", "__id"), on, "left_semi").dropDuplicates(["__text"]).drop("__text")
    return own.unionByName(docs.where(F.col(text).isNull()))
