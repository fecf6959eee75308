"""Quality rules and sharding: counts against plain loops, laws of the result."""

import hashlib
import re
import zlib

from pyspark.sql import functions as F

from helioframe.llm import quality, sharding


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_loops(spark, docs, odd):
    base = "a b c d e f g h i j "
    extra = spark.createDataFrame([(50, base * 5 + "x y z"), (51, base[:16]), (52, "a " * 40), (53, base * 2 + "q " + base)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    got = quality.judge(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        want = counts(r["text"])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["quality_prob"] <= 1


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), carry_text=False)
    known = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed and toxic = 0").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in known}
    assert n[1, True] > 0.97 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))


def test_quality_columns_and_empty(odd, empty):
    out = quality.judge(odd)
    assert [c for c in odd.columns if c != "n_words"] == out.columns[: len(odd.columns) - 1]
    assert quality.judge(empty).count() == 0
    assert out.where("text is null and kept").count() == 0


def brute_shards(rows, shards=8):
    by = {}
    for d, t, s in rows:
        crc, size = zlib.crc32((t or "").encode()), len((t or "").encode()) + 1
        by.setdefault(s, []).append((hashlib.md5(f"7:{'' if d is None else d}:{crc}:{size}".encode()).hexdigest(), crc, size, d))
    order = []
    for s, v in by.items():
        order += [((k + 0.5) / len(v), s or "", k, r[3], r[1]) for k, r in enumerate(sorted(v, key=lambda r: r[:3]))]
    n, out = len(order), []
    for at, (_, _, _, d, crc) in enumerate(sorted(order)):
        s = at * shards // n
        out.append((-1 if d is None else d, crc, s, at - -(-s * n // shards)))
    return sorted(out)


def test_shards_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(None, None, None), (900, "x", None), (900, "x", None)], "doc_id long, text string, source string"))
    got = sharding.interleave(rows.repartition(3)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == brute_shards([tuple(r) for r in rows.collect()])


def test_shards_match_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE", 50)  # several slices
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 6)).alias("source"), F.lit("z").alias("law"))
    got = sharding.interleave(rows).cache()
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 8
    spread = got.groupBy("source").pivot("shard").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in spread)
    for s in range(8):
        assert sorted(r["slot"] for r in got.where(F.col("shard") == s).select("slot").collect()) == list(range(sizes[0] if len(set(sizes)) == 1 else got.where(F.col("shard") == s).count()))
    assert sharding.interleave(rows.limit(0)).count() == 0


def test_rows_without_a_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE", 8)  # several runs of slices
    long = "very long " * 30_000
    rows = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id"), F.when(F.col("id") == 5, long).otherwise("")).alias("text"), F.lit(None).cast("string").alias("source"))
    got = sharding.interleave(rows).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(8) for i in range(75)]
    assert max(r["size"] for r in got) == len(long) + 7
