"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm import chat, collocations, extraction, language, latent, near, packing, periodic, quality, sharding, substring, token_files, toxicity
from helioframe.llm.common import table, word_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT k, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) AS u(i)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT k, p FROM dup, unnest(range(i, i + 35)) AS u(p)),
lost AS (SELECT k, list(p) AS ps, count(*) AS n FROM gone GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, p: NOT list_contains(ps, p)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (k)
"""


@query
def op2_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_token_output(spark, sf_dir):
    index = token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_files.read(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    dealt = sharding.interleave(docs, shards=8)
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of a text's bytes: the table of the reflected polynomial, then one step a byte.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, CAST(i AS BIGINT))) AS tab)"""


def crc_sql(text: str) -> str:
    byte = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    step = "xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce({byte}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


SQL["op3_sharding"] = f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, {crc_sql("coalesce(text, '')")} AS crc32 FROM documents, crc),
s AS (SELECT *, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc32 || ':' || (strlen(t) + 1)) AS mix FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mix, t) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM s),
g AS (SELECT *, row_number() OVER (ORDER BY (k + CAST(0.5 AS DOUBLE)) / n, source NULLS FIRST, k) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, crc32 AS text_crc32, 'rows' AS law, CAST(pos * 8 // total AS INTEGER) AS shard,
       CAST(pos - ((pos * 8 // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM g
"""


@query
def op1_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "quality_prob")


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    texts = language.sample(docs.where(~language.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.identify(rows, texts)


@query
def op6_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).select("page_id", "url", "text", "n_chars")


@query
def op9_chat_collapse(spark, sf_dir):
    return chat.collapse(table(spark, sf_dir, "conversations"))


SQL["op9_chat_collapse"] = r"""
WITH m AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations),
g AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS ts FROM m GROUP BY conv_id, lone),
whole AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM g GROUP BY ts),
begun AS (SELECT DISTINCT list_slice(ts, 1, i) AS ts FROM g, unnest(range(1, len(ts))) AS u(i))
SELECT conv_id, CAST(len(ts) AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
       array_to_string(list_transform(ts, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || replace(coalesce(x.t, ''), '<|', '<\|') || chr(10)), '') || '<|end|>' AS rendered
FROM whole ANTI JOIN begun USING (ts)
"""


@query
def op4_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = latent.find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.cosine", "m.lcs", "m.answer")


@query
def op7_near_duplicates(spark, sf_dir):
    found = near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id")


@query
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.find_runs(with_periods(docs)))


def with_periods(docs):
    """A tenth of the texts, chosen by the checksum of ``doc_id``, with a periodic rest."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumns({"g": F.floor(h / 10), "w": F.when(h % 10 == 0, word_list(F.col("text")))})
    n = F.size("w").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    words = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", at(i)))
    return chosen.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


SQL["op11_periodic_runs"] = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, ({crc_sql("CAST(doc_id AS VARCHAR)")}) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents, crc),
e AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1 AS INTEGER)]) ELSE ws END AS ws FROM f),
w AS (SELECT k, n, unnest(range(n)) AS i, unnest(ws) AS x FROM t),
same AS (SELECT l.k, l.i, r.i - l.i AS q FROM w l JOIN w r ON l.k = r.k AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
isle AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS z FROM same),
long AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM isle GROUP BY k, q, z HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM long b WHERE NOT EXISTS (SELECT 1 FROM long c WHERE c.k = b.k AND c.q < b.q AND c.s <= b.s AND c.s + c.l >= b.s + b.l)),
gone AS (SELECT k, list(DISTINCT i) AS gs FROM (SELECT k, unnest(range(s + q, s + l)) AS i FROM run) GROUP BY k),
best AS (SELECT k, count(*) AS n_runs, first(s ORDER BY l DESC, s, q) AS s, first(l ORDER BY l DESC, s, q) AS l, first(q ORDER BY l DESC, s, q) AS q,
  string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY k)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gs IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(gs, j - 1)) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN best USING (k) LEFT JOIN gone USING (k)
"""


@query
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM w, unnest(range(1, 6)) AS u(k), unnest(range(1, len(ws) - k + 2)) AS v(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r FROM c, unnest(range(1, c.k)) AS u(j)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.ws, 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.ws, j + 1, c.k), ' ')),
s AS (SELECT lang, k, phrase, a, j, l, r, CAST(n AS BIGINT) AS n, CAST((1000::HUGEINT * a * n) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut JOIN total USING (lang)),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS z FROM s),
one AS (SELECT * FROM low b WHERE z = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a
  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one) WHERE rank <= 2000
"""


@query
def op12_toxicity(spark, sf_dir):
    held = lambda c: F.crc32(c.cast("string")) % 3 == 1
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled(docs, labels.where(~held(F.col("doc_id")))))
    scored = model.score(docs.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
