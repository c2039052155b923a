"""Quality rules by weak supervision: each rule votes good, bad or abstains, EM estimates how far to trust each rule, the posterior decides.

The label model has for each rule and each class (good, bad) the probabilities of all three outcomes. So a rule that can vote only one way is estimated like the others, by how often it votes at all in either class; its abstaining counts as well. What is estimated are these probabilities and the share of good documents; a rule is never turned round: a good vote never speaks for bad, nor a bad one for good.

Main path: DataFrame functions only. The rules' votes are counted by pattern, at most 3**8 = 6561 whatever the corpus; EM runs over those counts.

Null or empty texts have no words and fail the base rule. A very long text is counted whole. Ties: a posterior of exactly the threshold is kept. Repeated rows are scored each; a null doc_id stays. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WS, let, words, written

#: Vote columns: 1 good, 0 bad, -1 abstains.
RULES = ("v_length", "v_repeat", "v_symbols", "v_lines", "v_case", "v_variety", "v_stops", "v_prose")
EM_ROUNDS, PRIOR_GOOD, SMOOTH = 60, 0.8, 5.0
OUTCOMES = (-1, 0, 1)
#: Where EM begins, by the votes that a rule has: probabilities of abstaining, a bad and a good vote in bad and in good documents. A rule for one defect is taken to be precise: there is another optimum in which common defects are good text. SMOOTH documents of each class have these before a rule's outcomes are counted.
FIRST = {
    (True, True): ((0.6, 0.32, 0.08), (0.6, 0.08, 0.32)),
    (True, False): ((0.7, 0.3, 0.0), (0.999, 0.001, 0.0)),
    (False, True): ((0.999, 0.0, 0.001), (0.7, 0.0, 0.3)),
    (False, False): ((1.0, 0.0, 0.0), (1.0, 0.0, 0.0)),
}
#: No vote adds more to the log-odds.
MOST_WEIGHT = 6.0


def repeated_words(w: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more. Windows are compared by a 64-bit hash within the document."""

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(gaps, F.lit(3), lambda s, x: s + x)

    def twice(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))
        pairs = let(placed, lambda s: F.array_distinct(F.flatten(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a.k == b.k, F.array(a.p, b.p)).otherwise(F.array().cast("array<int>"))))))
        return let(F.sort_array(pairs), covered)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 3, F.size(h) - 2), lambda c, i: F.xxhash64(h[i], h[i + 1], c))

    counted = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(twice(keys))))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(counted)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, one pass over whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS[1:]}"))
    split = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    bare = lambda gone: F.length(F.col("text")) - F.length(F.translate(F.col("text"), gone, ""))
    return split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"{WS}+", "")).cast("long").alias("word_chars"),
        bare("#*$%&|<>").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        bare(UPPER).alias("upper"),
        bare(LOWER).alias("lower"),
        bare(".!?").alias("stops"),
        bare("!").alias("bangs"),
    ).select("*", F.col("l.n").alias("n_lines"), F.col("l.dup").cast("long").alias("n_dup_lines")).drop("l")


def votes(f: DataFrame) -> DataFrame:
    """The features with one vote column for each rule."""
    n = F.greatest("n_words", F.lit(1))
    by = lambda good, bad: F.when(bad, 0).when(good, 1).otherwise(-1).cast("int")
    c = F.col
    rate, symbols, dup, long = c("n_repeat_words") / n, c("n_symbols") / n, F.when(c("n_dup_lines") < 2, 0.0).otherwise(c("n_dup_lines") / F.greatest("n_lines", F.lit(1))), c("word_chars") / n
    never = F.lit(False)
    calm = (rate <= 0.15) & (symbols <= 0.05) & (dup <= 0.1) & (c("upper") * 6 <= c("lower")) & (c("bangs") * 20 <= n) & long.between(2, 12)
    rough = (rate > 0.4) | (symbols > 0.2) | (dup > 0.3) | (c("upper") > c("lower")) | (c("bangs") * 4 > n) | (long > 20)
    # A rule for one defect abstains where the defect is absent: that alone does not make a text good.
    return f.withColumns({
        "v_length": by(never, c("n_words") < 20),
        "v_repeat": by(never, rate > 0.4),
        "v_symbols": by(never, symbols > 0.2),
        "v_lines": by(never, dup > 0.3),
        "v_case": by(never, c("upper") > c("lower")),
        "v_variety": by((c("n_words") >= 50) & (c("n_distinct") * c("n_distinct") >= 8 * n), (c("n_words") >= 50) & (c("n_distinct") * c("n_distinct") < 1.5 * n)),
        "v_stops": by((c("stops") * 60 >= n) & (c("bangs") * 20 <= n), c("bangs") * 4 > n),
        "v_prose": by(calm, rough),
    })


def fit(counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float, float]]]:
    """EM over vote patterns and their counts: the prior log-odds of good, and for each rule what abstaining, a bad and a good vote add to the log-odds."""
    prior, m = PRIOR_GOOD, max((len(p) for p, _ in counts), default=len(RULES))
    first = [FIRST[tuple(any(p[j] == o for p, _ in counts) for o in (0, 1))] for j in range(m)]
    begin = [[f[c] for f in first] for c in (0, 1)]
    p = begin

    def weights() -> list[tuple[float, float, float]]:
        out = []
        for j in range(m):
            w = [math.log(p[1][j][k] / p[0][j][k]) if p[0][j][k] > 0 else 0.0 for k in range(3)]
            out.append((max(-MOST_WEIGHT, min(MOST_WEIGHT, w[0])), max(-MOST_WEIGHT, min(0.0, w[1])), min(MOST_WEIGHT, max(0.0, w[2]))))
        return out

    for _ in range(EM_ROUNDS if counts else 0):
        w, good, total = weights(), 0.0, 0
        sums = [[[SMOOTH * x for x in begin[c][j]] for j in range(m)] for c in (0, 1)]
        for pattern, k in counts:
            x = math.log(prior / (1 - prior)) + sum(w[j][v + 1] for j, v in enumerate(pattern))
            q = 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
            good, total = good + k * q, total + k
            for j, v in enumerate(pattern):
                sums[1][j][v + 1] += k * q
                sums[0][j][v + 1] += k * (1 - q)
        prior = min(0.99, max(0.01, good / total))
        p = [[tuple(x / sum(s) for x in s) for s in sums[c]] for c in (0, 1)]
    return math.log(prior / (1 - prior)), weights()


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, posterior (P(good) by the label model) and kept (posterior >= threshold and the base rule holds)."""
    voted = written(votes(features(docs)).drop("upper", "lower", "stops", "bangs"), "quality-votes")
    counts = sorted((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*RULES).count().collect())  # 3**8 patterns at most
    prior, weights = fit(counts)
    odds = F.lit(prior)
    for rule, (none, bad, good) in zip(RULES, weights, strict=True):
        odds = odds + F.when(F.col(rule) == 1, good).when(F.col(rule) == 0, bad).otherwise(none)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
