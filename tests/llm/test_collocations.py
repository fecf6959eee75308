"""Frequent phrases and their scores against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.llm import collocations as C


def brute(rows, support, longest=5, top=2000, covered=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if a >= support and len(p) > 1}
        rows = []
        for p, a in good.items():
            longer = [q for q in good if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * good[q] >= covered * a for q in longer):
                continue
            cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rows.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "a", "é", "日本", "x-1", "b c", "z\x1c"])
    gap = lambda: rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b"])
    texts = ["".join(word() + gap() for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "de", None])) for t in texts]
    return [*rows, rows[0], rows[0], (None, "en"), ("", None), ("new york city " * 40, "xx"), ("...,,,", "en")]


@pytest.mark.parametrize(("seed", "support", "covered"), [(0, 5, 100), (1, 3, 100), (2, 3, 60)])
def test_phrases_equal_brute_force(spark, monkeypatch, seed, support, covered):
    rows = made(seed)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = C.collocations(df.withColumn("a", F.lit("clash")).withColumn("chunk", F.lit(1)), support=support, covered=covered).collect()
    want = brute(rows, support, covered=covered)
    assert sorted(tuple(r) for r in got) == want and len(want) > 20
    few = C.collocations(df, support=support, covered=covered, top=4).collect()
    assert sorted(tuple(r) for r in few) == [r for r in want if r[1] <= 4]


def test_long_texts_are_chunks_of_their_own(monkeypatch):
    ids, words, counts = C.words_of(["A b.a B", None, "b a"])
    assert words == [b"a", b"b"] and counts.tolist() == [3, 3]
    assert ids.tolist() == [0, 1, -1, 0, 1, -1, -1, 1, 0]
    new, pairs, n = C.longer(ids, np.array([0, 1]))
    assert sorted(zip(*pairs.tolist(), n.tolist(), strict=True)) == [(0, 1, 2), (1, 0, 1)]
    assert (new >= 0).tolist() == [True, False, False, True, False, False, False, True, False]


def test_scores_past_64_bits(spark):
    a, n, l, r = 10**13 + 7, 10**15 + 3, 10**13 + 9, 10**13 + 11
    row = spark.createDataFrame([(a, n, [l], [r])], "a long, n long, pre array<long>, suf array<long>")
    got = row.select(C.scored().alias("s")).first()["s"]
    assert (got["score"], got["k"], got["l"], got["r"]) == (1000 * a * n // (l * r), 1, l, r)
    tie = spark.createDataFrame([(100, 1000, [200, 100], [100, 200])], "a long, n long, pre array<long>, suf array<long>")
    assert tie.select(C.scored().alias("s")).first()["s"]["k"] == 1


def test_odd_rows_and_empty_table(odd, empty):
    assert C.collocations(empty).collect() == []
    assert C.collocations(odd, support=2).where("phrase = 'one two three' AND a = 2 AND lang = 'und'").count() == 1
