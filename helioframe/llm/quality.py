"""Quality rules as weak supervision (DataFrame functions only).

Each rule votes good, votes bad, or abstains.  Expectation-maximisation estimates,
without labels, how often each rule is right about good and about bad texts; a text's
posterior probability of being good combines the votes by those accuracies, in place
of asking that every rule passes.

Rows meet only as counts: texts with equal votes are one pattern, there are at most
3 ** rules patterns, and each iteration is an aggregate over the pattern table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import settle, word_list

SYMBOLS = "#*$%&|<>"

#: Words of abuse (any case, counted as whole words).
ABUSE = ["idiot", "pathetic", "loser", "scum", "worthless", "clown", "disgusting", "moron", "stupid", "trash"]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further counts that only the rules read.
EXTRA = ["n_lines", "n_distinct", "n_abuse", "n_upper", "n_lower", "n_bang"]

WINDOW = 8
ROUNDS = 20
#: What is held before any text is seen, and its weight against the texts: a fifth is bad
#: (as much as all texts), a rule seldom accuses a good text (as much as all that it votes
#: on) and finds a share of the bad ones (a fiftieth of that).  Without it, flaws that
#: seldom meet in one text would look like chance to the estimate.
PRIOR_BAD, FALSE_ALARM, FOUND, FOUND_WEIGHT = 0.2, 0.002, 0.3, 0.02


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of ``width`` words found twice or more in the text.

    Windows are hashed at each position.  If the hashes are not all distinct, they are
    sorted with their places; a window is repeated if a neighbour in that order has its
    hash, and the sorted places of repeated windows give the length of their union.
    """

    def union(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def again(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return _apply(F.array_sort(F.transform(hit, lambda x: x["i"])), union)

    def places(h: Column) -> Column:
        return _apply(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
    found = _apply(hashed, lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, width))))
    union_of = _apply(found, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), places(h)).otherwise(0))
    return F.when(F.size(words) > width, union_of).otherwise(0)


def _apply(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``BASE`` and ``EXTRA``; a null text has none of anything."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c not in BASE + EXTRA]
    d = docs.select(*own, body.alias("__t")).withColumn("__w", word_list(F.col("__t")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    letters = F.array_join("__w", "")
    abuse = "(?i)(?<![\\p{L}\\p{N}])(?:" + "|".join(ABUSE) + ")(?![\\p{L}\\p{N}])"
    d = d.withColumns({"__l": lines, "__c": letters, "__h": repeated_words(F.col("__w"))})
    return d.select(
        *own,
        F.size("__w").cast("long").alias("n_words"),
        F.length("__c").cast("long").alias("word_chars"),
        F.regexp_count("__c", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.col("__h").cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        F.regexp_count("__t", F.lit(abuse)).cast("long").alias("n_abuse"),
        F.regexp_count("__c", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("__c", F.lit("\\p{Ll}")).cast("long").alias("n_lower"),
        F.regexp_count("__c", F.lit("!!")).cast("long").alias("n_bang"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _between(value: Column, good: float, bad: float) -> Column:
    """Good below one bound, bad above the other, no vote between."""
    return F.when(value <= good, 1).when(value >= bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 none."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    cased = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    twice = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    long_enough = F.col("n_words") >= 40
    return {
        "symbols": _between(F.col("n_symbols") / chars, 0.01, 0.05),
        "repeats": _between(F.col("n_repeat_words") / n, 0.1, 0.3),
        "lines": F.when((twice >= 0.3) & (F.col("n_dup_lines") >= 3), -1).when(twice <= 0.1, 1).otherwise(0),
        "length": F.when(F.col("n_words") < 20, -1).when(long_enough, 1).otherwise(0),
        "word_length": F.when((mean < 2.5) | (mean > 12), -1).when((mean >= 3) & (mean <= 10), 1).otherwise(0),
        "capitals": _between(F.col("n_upper") / cased, 0.15, 0.4),
        "shouting": _between(F.col("n_bang") / n, 0.02, 0.15),
        "variety": F.when(long_enough & (F.col("n_distinct") / n < 0.2), -1).when(long_enough & (F.col("n_distinct") / n > 0.35), 1).otherwise(0),
        "abuse": F.when((F.col("n_abuse") >= 2) | (F.col("n_abuse") / n >= 0.01), -1).when(F.col("n_abuse") == 0, 1).otherwise(0),
    }


def estimate(patterns: DataFrame, names: list[str]) -> DataFrame:
    """Accuracies of the rules from counted vote patterns (columns ``names`` and ``n``).

    One row: ``p_bad``, and for each rule ``<rule>_if_bad`` and ``<rule>_if_good``, the
    chance of a bad vote among its votes on bad and on good texts.  Starts from 'bad if
    any rule says so'; each round is one aggregate of the pattern table.
    """
    weight = F.col("n").cast("double")
    bad = F.when(F.least(*[F.col(v) for v in names], F.lit(0)) < 0, F.lit(0.9)).otherwise(F.lit(0.1))
    some = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    share = lambda hit, of, prior, w: (some(hit) + w * prior) / (some(of) + w)
    spark, rows = patterns.sparkSession, patterns.withColumn("__bad", bad)
    for _ in range(ROUNDS):
        sums = [share(weight * F.col("__bad"), weight, PRIOR_BAD, some(weight) + 2).alias("p_bad")]
        for v in names:
            voted, against = F.when(F.col(v) != 0, weight), F.when(F.col(v) < 0, weight)
            sums.append(share(against * F.col("__bad"), voted * F.col("__bad"), FOUND, FOUND_WEIGHT * some(voted) + 2).alias(f"{v}_if_bad"))
            sums.append(share(against * (1 - F.col("__bad")), voted * (1 - F.col("__bad")), FALSE_ALARM, some(voted) + 2).alias(f"{v}_if_good"))
        got = rows.agg(*sums)
        got = spark.createDataFrame([got.first()], got.schema)  # a round never recomputes the one before
        rows = patterns.crossJoin(F.broadcast(got)).withColumn("__bad", posterior_bad(names))
    return got


def posterior_bad(names: list[str]) -> Column:
    """From the votes and the columns of ``estimate``."""
    odds = F.log(F.col("p_bad") / (1 - F.col("p_bad")))
    for v in names:
        b, g = F.col(f"{v}_if_bad"), F.col(f"{v}_if_good")
        odds = odds + F.when(F.col(v) < 0, F.log(b / g)).when(F.col(v) > 0, F.log((1 - b) / (1 - g))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", keep_from: float = 0.5, carry_text: bool = True) -> DataFrame:
    """Counts, ``base_failed``, ``quality_prob`` and ``kept`` for each row.

    Input columns of these names are replaced, all others are kept.  A text is kept if
    it passes the base rule and its probability of being good is at least ``keep_from``.
    The counts are stored once, with the text only if ``carry_text``.

    A null, empty or blank text has no words and fails the base rule.  Texts under eight
    words have no repeated window.  Equal rows get equal verdicts.  An empty table
    gives an empty table.
    """
    voted = rules()
    names = list(voted)
    added = [*BASE, *EXTRA, "base_failed", "quality_prob", "kept", *names]
    own = [c for c in docs.columns if c not in added]
    measured = measure(docs.select(*own), text).withColumns(voted)
    own = own if carry_text else [c for c in own if c != text]
    counts = settle(measured if carry_text else measured.drop(text))
    patterns = settle(counts.where(~base_failed()).groupBy(*names).agg(F.count("*").alias("n")))
    got = estimate(patterns, names)  # one row
    good = 1 - posterior_bad(names)
    out = counts.crossJoin(F.broadcast(got)).withColumns({"base_failed": base_failed(), "quality_prob": F.round(good, 6)})
    kept = ~F.col("base_failed") & (good >= keep_from)
    return out.withColumn("kept", kept).select(*own, *BASE, "base_failed", "quality_prob", "kept")
