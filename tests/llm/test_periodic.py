"""Periodic runs against brute force."""

import hashlib
import random

import numpy as np
import pytest

from helioframe.llm import periodic


def brute_runs(words, repeats=4, shortest=6):
    """Every maximal stretch of each period, smallest periods only."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(shortest, repeats * q) and not any(a <= s and e <= a + b for a, b, p in out if p < q):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(rng):
    words = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 4)):
        root = [rng.choice("ab") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33]))]
        long = (root * 12)[: rng.randint(len(root), 6 * len(root) + 3)]
        at = rng.randint(0, len(words))
        words[at:at] = long
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [planted(rng) for _ in range(3)]
        words, x, bounds = periodic._numbers([" ".join(t) for t in texts])
        found = periodic.runs_of(x, max(map(len, texts)))
        for i, t in enumerate(texts):
            mine = [(s - bounds[i], n, q) for s, n, q in found.tolist() if bounds[i] <= s < bounds[i + 1]]
            assert mine == brute_runs(t)


def test_small_alphabets_equal_brute_force():
    rng = random.Random(9)
    for size in (1, 2, 3):
        for n in (0, 1, 5, 6, 7, 40, 200, 333):
            t = [rng.choice("abc"[:size]) for _ in range(n)]
            _, x, _ = periodic._numbers([" ".join(t)])
            assert [tuple(r) for r in periodic.runs_of(x, n).tolist()] == brute_runs(t)
            assert [tuple(r) for r in periodic.runs_of(x, n, 3, 4).tolist()] == brute_runs(t, 3, 4)


@pytest.mark.parametrize("largest", [3, 5000, 40_000_000])
def test_matches_are_exact(largest):
    rng = np.random.default_rng(largest)
    for size in (1, 2, 8, 64):
        blocks = rng.integers(0, largest, (20, size))
        texts = rng.integers(0, largest, (20, 2 * size - 1))
        for i in range(0, 20, 2):
            d = int(rng.integers(0, size))
            texts[i, d : d + size] = blocks[i]
        texts[1, :size] = blocks[1]
        texts[1, size - 1] += 1  # a mismatch by one in the last place
        want = [[bool((texts[i, d : d + size] == blocks[i]).all()) for d in range(size)] for i in range(20)]
        assert periodic.matches(blocks.astype(np.uint64), texts.astype(np.uint64), largest).tolist() == want


def test_digest_and_odd_rows(spark, odd, empty):
    assert periodic.find_runs(empty).count() == 0
    loop = " ".join(f"v{i % 5000}" for i in range(40_000))
    rows = odd.select("doc_id", "text").where("doc_id is not null")
    rows = rows.union(spark.createDataFrame([(20, loop), (21, "x " * 7 + "y"), (None, None)], "doc_id long, text string"))
    found = periodic.find_runs(rows).collect()
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(repr(r["doc_id"]) for r in rows.collect())
    by = {r["doc_id"]: r for r in found}
    assert [tuple(r) for r in by[20]["runs"]] == [(0, 40_000, 5000)] and by[20]["collapsed"] == " ".join(f"v{i}" for i in range(5000))
    assert by[21]["runs"][0]["length"] == 7 and by[21]["collapsed"] == "x y" and by[7]["runs"] == []
    for r in periodic.digest(periodic.find_runs(rows)).collect():
        runs = [tuple(x) for x in by[r["doc_id"]]["runs"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(by[r["doc_id"]]["collapsed"].encode()).hexdigest()
