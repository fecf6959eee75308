"""Language, extraction, decontamination and chat operators."""

import random

import numpy as np
from pyspark.sql import functions as F

from helioframe.llm import chat, dom, extraction, labelled_pages, language, latent

SF = "/root/testdata/sf0.01"


def test_suffix_automaton_reads_exactly_the_substrings():
    rng = random.Random(1)
    codes = [rng.randint(2, 4) for _ in range(60)]
    step = language.suffix_automaton(codes)
    have = {tuple(codes[i:j]) for i in range(60) for j in range(i + 1, 61)}

    def reads(w):
        s = 0
        for c in w:
            if c not in step[s]:
                return False
            s = step[s][c]
        return True

    for _ in range(500):
        w = tuple(rng.randint(2, 4) for _ in range(rng.randint(1, 7)))
        assert reads(w) == (w in have)


def test_pieces_equal_greedy_parsing():
    samples = (("aa", "the cat sat on the mat"), ("bb", "der hund und die katze"))
    m = language.Model(samples)
    text = "the hat und der mat!! 12 xyz die"
    coded = [m.encode(t).tolist() for _, t in samples]
    z = m.encode(text).tolist()
    want = []
    for x in coded:
        subs = {tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        n = at = 0
        while at < len(z):
            k = at + 1
            while k < len(z) and tuple(z[at : k + 1]) in subs:
                k += 1
            at, n = k, n + 1
        want.append(n)
    assert m.pieces([text])[0][0].tolist() == want


def test_languages_of_many_scripts(spark):
    """Three alphabets of two languages each, and two languages that share 900 Han signs."""
    rng = random.Random(12)
    scripts = {"latin": [chr(97 + i) for i in range(26)], "greek": [chr(0x3B1 + i) for i in range(25) if i != 17], "cyrillic": [chr(0x430 + i) for i in range(32)], "han": [chr(0x4E00 + 7 * i) for i in range(900)]}
    words = {}
    for name, signs in scripts.items():
        most = 2 if name == "han" else 7
        for k in (1, 2):
            words[f"{name}{k}"] = ["".join(rng.choice(signs) for _ in range(rng.randint(1, most))) for _ in range(300)]
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    learned = spark.createDataFrame([(text(k, 80), k) for k in words for _ in range(60)], "text string, lang string")
    texts = language.sample(learned)
    asked = spark.createDataFrame([(text(k, 25), k) for k in words for _ in range(20)], "text string, lang string")
    got = language.identify(asked, texts).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert len(got) == 8 and all(r["right"] == 1 for r in got), got
    m = language.model(texts)
    assert len(set(m.encode("".join(scripts["han"])).tolist())) >= 500


def test_transitions_share_one_array():
    rng = random.Random(5)
    rows = [{c: rng.randrange(60) for c in rng.sample(range(40), rng.randint(0, 6))} for _ in range(60)]
    table, places = language.lay_out(rows, 40)
    assert len(set(places.tolist())) == 60
    for p, row in zip(places.tolist(), rows):
        for c in range(40):
            e = int(table[p + c])
            assert (e & 0xFFFFFFFF == places[row[c]]) if e >> 32 == p else c not in row


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = language.sample(docs.where(~language.held_out(F.col("doc_id"))))
    assert all(len(t) <= language.PIECES * language.PIECE_CHARS for _, t in texts)
    out = language.identify(docs.withColumn("score", F.lit("x")), texts).where(language.held_out(F.col("doc_id")))
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] and right[2] <= 1


def test_language_odd_rows(odd, empty):
    texts = language.sample(odd)
    got = {(r["doc_id"], r["n_words"]): r for r in language.identify(odd, texts).collect()}
    assert len(got) == 8 and all(r["lang_pred"] == "und" and r["score"] == 0 for (d, _), r in got.items() if d in (1, 2, 3))
    assert language.identify(empty, texts).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, ()).collect()} == {"und"}
    assert language.sample(empty) == ()


def test_reader_of_broken_markup():
    page = dom.read("a<p>one &amp; <b>two<br>three<p>four<script>if (a<b) '</p>'</script><ul><li>x<li>y</ul></div><!-- no --><td>z")
    assert [t for _, t in page.runs] == ["a", "one & two three", "four", "x", "y", "z"]
    assert dom.read(None).runs == [] and dom.read("<<a href='x>y").runs


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    page = dom.read("<div class=x><p>one</p><ul><li>two</li></ul></div><p>three</p>")
    known = {f: i for i, f in enumerate(sorted({x for names in extraction.features(page) for x in names}))}
    rng = np.random.default_rng(2)
    weight, edge = rng.normal(size=len(known)), rng.normal(size=(3, 2, 2))
    forest = extraction.Forest([page, page], known)
    p, _ = extraction.marginals(forest, weight, edge)
    n = len(page.tag)
    own = [sum(weight[known[x]] for x in names) for names in extraction.features(page)]
    total, hit = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(own[k] for k in range(n) if y[k]) + sum(edge[extraction.kind(page, k), y[page.parent[k]], y[k]] for k in range(1, n))
        total += np.exp(s)
        hit += np.exp(s) * np.array(y)
    assert np.allclose(p[:n], hit / total) and np.allclose(p[n:], hit / total)


def test_extraction_on_unseen_pages(spark):
    trained = extraction.train(tuple(labelled_pages.pages()))
    wrong = n = 0
    for h in labelled_pages.pages(120, seed=77):
        page = dom.read(h)
        y = extraction.labels(page)
        want = [t for k, t in page.runs if y[k]]
        got = extraction.extract_text([h], trained)[0].split("\n")
        wrong += len(set(want) ^ set(got))
        n += len(page.runs)
    assert wrong < 0.01 * n
    rows = spark.createDataFrame([(1, None, "u", "old"), (2, "", "u", None), (3, "bare text", None, None), (4, "<article><h1>T</h1><p>Some words, here.</p></article><footer>no</footer>", "u", "x")], "page_id long, html string, url string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extract(rows).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("bare text", 9), 4: ("T\nSome words, here.", 19)}
    assert extraction.extract(rows.limit(0)).count() == 0


def test_benchmark_passages_and_paraphrases(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items, rng = bench.collect(), random.Random(4)
    texts = [r["text"] for r in docs.where("doc_id < 200").collect()]
    made, want = [], {}
    for k, r in enumerate(items):
        w = r["text"].split()
        for j in rng.sample(range(len(w)), len(w) // 10):
            w[j] = f"swapped{j}"
        made.append((10_000 + k, " ".join(rng.choice(texts).split()[:60] + w + rng.choice(texts).split()[:60])))
        want[10_000 + k] = r["item_id"]
    out = latent.find_items(docs.union(spark.createDataFrame(made, docs.schema)).withColumn("matches", F.lit(1)), bench)
    got = {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in out.select("doc_id", "matches").collect()}
    plain = lambda t: " ".join(t.split())
    holds = {r["doc_id"]: {i["item_id"] for i in items if plain(i["text"]) in plain(r["text"])} for r in docs.collect()}
    assert all(holds[d] <= got[d] for d in holds)
    assert sum(len(got[d] - holds[d]) for d in holds) <= 2
    assert sum(i in got[d] for d, i in want.items()) >= 0.9 * len(want)
    assert all(r["matches"] == [] for r in latent.find_items(odd, bench).collect())
    assert latent.find_items(empty, bench).count() == 0
    assert all(r["matches"] == [] for r in latent.find_items(odd, bench.limit(0)).collect())


def test_long_benchmark_items(spark):
    rng = random.Random(8)
    common = [f"word{i}" for i in range(400)]
    prose = lambda n, tag: [rng.choice(common) if rng.random() < 0.7 else f"{tag}{rng.randint(0, 300)}" for _ in range(n)]
    words = {k: prose(n, f"i{k}x") for k, n in enumerate((20, 64, 65, 113, 150, 187, 300, 1000))}

    def swapped(w, part):
        at = set(rng.sample(range(len(w)), int(len(w) * part)))
        return [f"new{j}" if j in at else x for j, x in enumerate(w)]

    rows, want = [], {}
    for k, w in words.items():
        stretched = [y for x in w for y in ([x, "between"] if rng.random() < 0.3 else [x])]
        for j, body in enumerate((w, swapped(w, 0.1), stretched)):
            rows.append((100 * j + k, " ".join([*prose(70 + 7 * k, "d"), *body, *prose(90, "d")])))
            want[100 * j + k] = [k]
        rows.append((300 + k, " ".join(w[: len(w) // 2] + prose(len(w), "d"))))  # half an item is none
        want[300 + k] = []
    rows += [(1000 + k, " ".join(prose(900, "d"))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in words.items()], "item_id long, text string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in latent.find_items(docs, bench).collect()}
    assert got == {d: want.get(d, []) for d, _ in rows}


def test_rounds_of_a_benchmark_are_bounded_by_parts(monkeypatch):
    items = [(k, " ".join(["w"] * n)) for k, n in enumerate((10, 64, 65, 500, 97, 0))]
    assert [list(latent.part_starts(n)) for n in (0, 1, 64, 65, 96, 97)] == [[0], [0], [0], [0, 32], [0, 32], [0, 32, 64]]
    monkeypatch.setattr(latent, "ROUND", 4)
    assert [[i for i, _ in some] for some in latent.rounds(items)] == [[0, 1, 2], [3], [4, 5]]


def test_references_end_at_tags():
    text = lambda html: [t for _, t in dom.read(html).runs]
    assert text("<p><b>&</b>amp; &a<i>mp; &lt;b&gt;</i></p>") == ["&amp; &amp; <b>"]
    assert text("<p>a&nbsp;&amp;amp; b</p>") == ["a &amp; b"]


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert latent.common_subsequence(a, b) == row[-1]


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello <|x|>"), ("user", None), (None, "bye")]
    rows = [(c, i, *t) for c, n in ((1, 1), (2, 2), (3, 4), (9, 4), (5, 4)) for i, t in enumerate(turns[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (None, 0, "user", ""), (None, 0, "user", None), (7, 0, "user", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.collapse(t.repartition(3)).collect()}
    assert set(got) == {3, 6, 7, None} and got[3][:2] == (4, 3)
    assert got[3][2] == "<|user|>\nhi\n<|assistant|>\nhello <\\|x|>\n<|user|>\n\n<||>\nbye\n<|end|>"
    assert chat.collapse(t.limit(0)).count() == 0


def test_latent_space_is_of_all_passages(spark):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(40)]
    rows = [(d, " ".join(names[i] for i in (rng.integers(0, 40, 80) ** 2 // 40))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    space = latent.fit(docs, [(0, " ".join(names[:25])), (1, " ".join(names[25:]))], rank=40)
    column = {h: k for k, h in enumerate(space.vocabulary.tolist())}
    at = {n: column[int(latent.kernel.words([n]).hashes[0])] for n in names}
    pieces = [sorted({at[x] for x in t.split()[a : a + 16]}) for _, t in rows for a in range(0, 80, 16)]
    items = [sorted({at[x] for x in names[:25]}), sorted({at[x] for x in names[25:]})]
    whole = np.zeros((len(pieces) + 2, 40))
    for k, p in enumerate([*pieces, *items]):
        whole[k, p] = space.idf[p]
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    whole[-2:] *= np.sqrt(len(pieces) / 2)
    value, vector = np.linalg.eigh(whole.T @ whole)
    want = vector[:, ::-1][:, value[::-1] > 1e-9 * value.max()]
    got = space.basis / space.idf[:, None]
    assert got.shape == want.shape
    assert np.allclose(np.abs((got * want).sum(axis=0)), 1, atol=1e-4)
