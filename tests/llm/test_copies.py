"""Substring and near-duplicate removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from helioframe.llm import near, substring


def brute_repeats(texts, span=35):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    at = {}
    for d, w in enumerate(words):
        for i in range(len(w) - span + 1):
            at.setdefault(tuple(w[i : i + span]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + span))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for w, g in zip(words, gone, strict=True)]


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "Über", "x,", "y."]) + str(rng.randint(0, 400))
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 80)]
    out = []
    for _ in range(40):
        t = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(t))
            t[cut:cut] = rng.choice(shared)
        out.append(rng.choice([" ", "\n", "  \t"]).join(t))
    return [*out, out[3], out[3], "rep " * 90, "a b " * 60, None, ""]


@pytest.mark.parametrize("period", [7, 21, 31])
def test_repeats_equal_brute_force(spark, period):
    texts = planted(period)
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_removed string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(rows, period=period).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_odd_rows(odd, empty):
    got = substring.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    want = dict(zip([(r["doc_id"], r["text"]) for r in odd.collect()], brute_repeats([r["text"] for r in odd.collect()]), strict=True))
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"], r["text"]]
    assert substring.remove_repeats(empty).count() == 0


def test_covers_are_difference_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_similarity(a, b):
    x, y = ({h: w for h, w in zip(*p, strict=True)} for p in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))


def near_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 99999)}"
            out.append(" ".join(t))
    return [*out, *out[:5], "one two", "one two", "one two three", "", "", None, None]


def test_similarity_and_its_estimate():
    rng = random.Random(3)
    texts = ["a b c d e f " * 3 + t for t in near_texts(3)[:20]]
    parts = near.profiles(texts)
    sigs = near.signatures(parts)
    for _ in range(40):
        i, j = rng.randrange(20), rng.randrange(20)
        want = brute_similarity(parts[i], parts[j])
        assert abs(near.similarity(parts[i], parts[j]) - want) < 1e-9
        assert abs((sigs[i] == sigs[j]).mean() - want) < 0.16


def test_classes_equal_brute_force(spark):
    texts = near_texts(8)
    parts, group = near.profiles(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or (len(parts[i][0]) and len(parts[j][0]) and brute_similarity(parts[i], parts[j]) >= 0.8):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(rows).collect()}
    assert [got[i] for i in range(len(texts))] == group
    kept = near.first_of_class(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for g in group})


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Outsiders meet every block: labels that keep all apart give a link of each pair."""
    node = [bytes([i]) * 16 for i in range(9)]
    sig = np.zeros(near.SIZE, "<u2").tobytes()
    monkeypatch.setattr(near, "BLOCK", 2)
    buckets = spark.createDataFrame([(1, 0, n) for n in node], "h long, band int, node binary")
    texts = spark.createDataFrame([(n, "one two three four five six") for n in node], "node binary, text string")
    nodes = spark.createDataFrame([(n, sig) for n in node], "node binary, signature binary")
    label = spark.createDataFrame([(n, n) for n in node], "node binary, label binary")
    pairs = {(bytes(r["a"]), bytes(r["b"])) for r in near._rest(buckets, nodes, label, texts).collect()}
    assert pairs == {(a, b) for a in node for b in node if a < b}


def test_near_duplicates_of_an_empty_table(empty):
    assert near.near_duplicates(empty).count() == 0
