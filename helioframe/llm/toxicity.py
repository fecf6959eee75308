"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned, not written down: words that occur in far more labelled toxic
texts than their share, by a signed likelihood ratio.  Features are densities of its
words (also behind obfuscation), how near they are to the second person, and rates of
capitals, punctuation and disguised spelling.

Labelled texts get the features of a lexicon learned from the other folds, so that the
trees see a word as they will see it in a new text.  The calibration is fitted to
predictions of trees that did not see the text either.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm import kernel
from helioframe.llm.common import settle, ship

#: Labelled texts that are learned from (those of least hash), and words of the lexicon.
SAMPLE, LEXICON = 20_000, 2_000
#: Signed square roots of the likelihood ratio: sure words, likely words.
SURE, LIKELY = 4.5, 3.3
LEAST_TEXTS = 3
FOLDS, NEAR = 4, 5
TREES = {"maxIter": 40, "maxDepth": 3, "stepSize": 0.2, "minInstancesPerNode": 3, "seed": 7}
#: Words whose kind a worker keeps.
KEPT_WORDS = 100_000

#: The second person in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro vuestra"
).split()
#: Signs that stand for letters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, ".": None, "-": None, "_": None})

FEATURES = [
    "sure_density", "likely_density", "hidden_density", "weight_density", "log_hits", "log_distinct_hits", "near_person", "person_density",
    "shouted_words", "capitals", "exclamations", "questions", "exclamation_runs", "symbols", "disguised_words", "drawn_out_words", "log_words",
]

_SURE, _LIKELY, _HIDDEN, _PERSON, _SHOUT, _DISGUISED, _DRAWN = (1 << i for i in range(7))
_HIT = _SURE | _LIKELY | _HIDDEN
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][\d@$!|*._]+[^\W\d_]")
_DRAW = re.compile(r"([^\W\d_])\1\1")


def plain(token: str) -> str:
    """A token as a word of the lexicon: small letters, no signs around it."""
    return _EDGE.sub("", token).lower()


def revealed(token: str) -> str:
    """The word behind look-alike signs, dots between letters and drawn-out letters."""
    return re.sub(r"([^\W\d_])\1{2,}", r"\1", plain(token.translate(LOOK_ALIKE)))


class _Reader:
    """Features of a block of texts for one lexicon, a dictionary from words to weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.kind, self.person = lexicon, {}, set(SECOND_PERSON)
        self.number = {w: i for i, w in enumerate(sorted(lexicon))}
        self.weight = np.array([lexicon[w] for w in sorted(lexicon)] + [0.0])

    def look(self, token: str) -> tuple[int, int]:
        word, flags = plain(token), 0
        hit = self.number.get(word, -1)
        if hit >= 0:
            flags |= _SURE if self.lexicon[word] >= SURE else _LIKELY
        disguised, drawn = bool(_INNER.search(token)), bool(_DRAW.search(token.lower()))
        if hit < 0 and (disguised or drawn):
            hit = self.number.get(revealed(token), -1)
            flags |= _HIDDEN if hit >= 0 else 0
        if word in self.person:
            flags |= _PERSON
        if len(word) > 1 and token.isupper() and word.isalpha():
            flags |= _SHOUT
        return flags | (_DISGUISED if disguised else 0) | (_DRAWN if drawn else 0), hit

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        if len(self.kind) > KEPT_WORDS:
            self.kind.clear()
        for token in set().union(*split) - self.kind.keys():
            self.kind[token] = self.look(token)
        n = np.array([len(w) for w in split], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(n)))
        both = np.array([self.kind[t] for w in split for t in w], dtype=np.int64).reshape(-1, 2)
        flags, hit = both[:, 0], both[:, 1]
        doc = np.repeat(np.arange(len(texts)), n)
        count = lambda mask: np.bincount(doc[mask], minlength=len(texts)).astype(float)
        hits = (flags & _HIT) > 0
        people = np.concatenate(([0], np.cumsum((flags & _PERSON) > 0)))
        at = np.flatnonzero(hits)
        low, high = np.maximum(at - NEAR, bounds[doc[at]]), np.minimum(at + NEAR + 1, bounds[doc[at] + 1])
        near = np.zeros(len(flags), dtype=bool)
        near[at[people[high] > people[low]]] = True
        distinct = np.unique(np.stack((doc[hits], hit[hits])), axis=1)[0] if len(at) else np.zeros(0, dtype=np.int64)
        weight = np.bincount(doc, self.weight[hit], minlength=len(texts)) if len(doc) else np.zeros(len(texts))
        words, found = np.maximum(n, 1), count(hits)
        signs = np.array([_signs(t or "") for t in texts], dtype=float).reshape(-1, 6)
        bit = lambda b: count((flags & b) > 0) / words
        return np.column_stack([
            bit(_SURE), bit(_LIKELY), bit(_HIDDEN), weight / words, np.log1p(found), np.log1p(np.bincount(distinct, minlength=len(texts))),
            count(near) / np.maximum(found, 1), bit(_PERSON), bit(_SHOUT), signs[:, 0] / np.maximum(signs[:, 1], 1),
            signs[:, 2] / words, signs[:, 3] / words, signs[:, 4] / words, signs[:, 5] / words, bit(_DISGUISED), bit(_DRAWN), np.log1p(n),
        ])


#: Bytes by class: 1 capitals, 2 small letters, 3 symbols; letters beyond ASCII count as small.
_CLASS = bytes(1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b > 191 else 3 if chr(b) in "#*$%&|<>@^~" else 0 for b in range(256))


def _signs(text: str) -> tuple[int, ...]:
    """Capitals, letters, exclamation and question marks, runs of exclamation marks, symbols."""
    kinds = text.encode("utf-8", "replace").translate(_CLASS)
    upper = kinds.count(1)
    return upper, upper + kinds.count(2), text.count("!"), text.count("?"), text.count("!!"), kinds.count(3)


def _features(lexicons: list[dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[int, _Reader] = {}
        for piece in kernel.chunks(batches, "text"):
            fold = piece.column("fold").to_numpy()
            out = np.zeros((piece.num_rows, len(FEATURES)))
            texts = piece.column("text").to_pylist()
            for f in np.unique(fold).tolist():
                if f not in readers:
                    readers[f] = _Reader(lexicons[f])
                at = np.flatnonzero(fold == f)
                out[at] = readers[f]([texts[i] for i in at])
            values = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(out.ravel()))
            names = [c for c in piece.schema.names if c not in ("text", "fold")]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], values], [*names, "values"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a block that hold a word, by fold and label."""
    for piece in kernel.chunks(batches, "text"):
        groups: dict[tuple[int, int], dict[str, int]] = {}
        for text, fold, label in zip(*(piece.column(c).to_pylist() for c in ("text", "fold", "label")), strict=True):
            mine = groups.setdefault((fold, int(label)), {})
            for w in {plain(t) for t in (text or "").split()} - {""}:
                mine[w] = mine.get(w, 0) + 1
        for (fold, label), words in groups.items():
            n = len(words)
            cols = [pa.array(list(words)), pa.array(np.full(n, fold), pa.int32()), pa.array(np.full(n, label), pa.int32()), pa.array(list(words.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["word", "fold", "label", "texts"])


def ratio(t: Column, c: Column, toxic: float, clean: float) -> Column:
    """Signed square root of the likelihood ratio of ``t`` of ``toxic`` against ``c`` of ``clean`` texts."""
    t, c, toxic, clean = t.cast("double"), c.cast("double"), F.lit(float(toxic)), F.lit(float(clean))
    p = (t + c) / (toxic + clean)
    part = lambda k, want: F.when(k > 0, k * F.log(k / want)).otherwise(0.0)
    g = 2 * (part(t, toxic * p) + part(c, clean * p) + part(toxic - t, toxic * (1 - p)) + part(clean - c, clean * (1 - p)))
    return F.signum(t / toxic - c / clean) * F.sqrt(F.greatest(g, F.lit(0.0)))


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Weights of words: a lexicon for each fold, from the others, and one from all; at most ``LEXICON`` words each.

    ``sample`` has ``text``, ``fold`` and ``label``.
    """
    counts = sample.select("text", "fold", "label").mapInArrow(_counts, "word string, fold int, label int, texts long")
    cells = [(f, y) for f in range(FOLDS) for y in (0, 1)]
    sums = [F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("texts"))), F.lit(0)).alias(f"n_{f}_{y}") for f, y in cells]
    words = settle(counts.groupBy("word").agg(*sums))
    sizes = {(r["fold"], int(r["label"])): r["count"] for r in sample.groupBy("fold", "label").count().collect()}  # FOLDS x 2 rows
    out: list[dict[str, float]] = []
    for left in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left]
        total = lambda y: sum((F.col(f"n_{f}_{y}") for f in folds), F.lit(0))
        toxic, clean = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
        if not toxic or not clean:
            out.append({})
            continue
        z = ratio(total(1), total(0), toxic, clean)
        best = words.where(total(1) >= LEAST_TEXTS).select("word", z.alias("z")).where(F.col("z") >= LIKELY)
        out.append({r["word"]: r["z"] for r in best.orderBy(F.desc("z"), "word").limit(LEXICON).collect()})
    return out


class Model:
    """Lexicons, trees and calibration; without both labels a constant score."""

    def __init__(self, constant: float | None = None, lexicons=None, trees=None, steps=None):
        self.constant, self.lexicons, self.trees, self.steps = constant, lexicons, trees, steps

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` without the text, with ``score`` from 0 to 1.

        A null, empty or blank text has no words and gets the score of such features.
        Repeated rows get equal scores.  An empty table gives an empty table.  Columns
        named ``score``, ``values``, ``fold`` or like a column of the trees are replaced.
        """
        inner = ("score", "values", "fold", "raw", "features", "rawPrediction", "probability", "prediction")
        own = [c for c in docs.columns if c not in (*inner, text)]
        if self.constant is not None:
            return docs.select(*own, F.lit(float(self.constant)).alias("score"))
        ship(docs.sparkSession)
        rows = docs.select(*own, F.col(text).alias("text"), F.lit(FOLDS).alias("fold"))
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in own] + ["values array<double>"])
        raw = _raw(self.trees, rows.mapInArrow(_features(self.lexicons), schema), *own)
        done = self.steps.transform(raw)
        return done.select(*own, F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def _raw(trees, rows: DataFrame, *own: str) -> DataFrame:
    """Uncalibrated probabilities as ``raw``."""
    scored = trees.transform(rows.select(*own, array_to_vector("values").alias("features")))
    return scored.select(*own, F.get(vector_to_array("probability"), F.lit(1)).alias("raw"))


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``text`` and ``label`` of at most ``SAMPLE`` labelled rows, those of least hash, with their ``fold``.

    Equal texts are in one fold.  Rows without a key or a label of 0 or 1 are left out; of
    rows that repeat a key, one is taken.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("double").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")  # SAMPLE rows at most
    one = rows.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return settle(one.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")))


def fit(sample: DataFrame) -> Model:
    """A model from ``text``, ``label`` and ``fold`` of a bounded sample (see ``labelled``)."""
    ship(sample.sparkSession)
    n, share = sample.agg(F.count("*"), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        return Model(constant=share or 0.0)
    lexicons = learn_lexicons(sample)
    keyed = sample.select("label", (F.col("fold") % 2).alias("half"), "text", "fold")
    rows = settle(keyed.mapInArrow(_features(lexicons), "label double, half int, values array<double>"))
    rows = settle(rows.coalesce(max(1, math.ceil(n / 5000))))
    forest = GBTClassifier(labelCol="label", featuresCol="features", **TREES)
    vectors = rows.select("label", "half", array_to_vector("values").alias("features")).cache()
    trees = forest.fit(vectors)
    halves = {(r["half"], r["label"]) for r in rows.select("half", "label").distinct().collect()}
    if len(halves) == 4:
        parts = [_raw(forest.fit(vectors.where(F.col("half") != h)), rows.where(F.col("half") == h), "label") for h in (0, 1)]
        seen = parts[0].unionByName(parts[1])
    else:  # a half without both labels cannot teach the other
        seen = _raw(trees, rows, "label")
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(settle(seen))
    vectors.unpersist()
    return Model(None, lexicons, trees, steps)
