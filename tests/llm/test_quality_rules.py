import math
import random
import re

import pytest

from amperia.llm.quality_rules import RULES, features, fit, op8_quality_rules, quality_rules, votes

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def corpus(seed, n):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        w = prose(r, r.choice([0, 1, 2, 3, 4, 49, 50, 51, 120]), r.choice([2, 8, 1000]))
        parts = [x + r.choice([" ", "  ", "\n", "\t", "\r\n", "\xa0", " # ", " $|< "]) for x in w]
        rows.append((d, "".join(parts) * r.choice([1, 1, 1, 2])))
    return rows


def test_counts_as_brute_force(table):
    rows = [*corpus(1, 250), (900, None), (901, ""), (902, "a a a a"), (903, "a b a b a"), (904, "a b c a b c"), (905, "x\nx\n x\nx"), (906, "😀 " * 60), (907, "w " * 30_000)]
    got = {r.doc_id: r for r in op8_quality_rules(table(rows)).collect()}
    assert got.keys() == {d for d, _ in rows}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def drawn(rules, n, good_share, seed):
    """Counts of vote patterns: rules are (outcomes of abstaining, bad, good) in bad and in good documents."""
    r, counts = random.Random(seed), {}
    for _ in range(n):
        c = r.random() < good_share
        pattern = tuple(r.choices((-1, 0, 1), rule[c])[0] for rule in rules)
        counts[pattern] = counts.get(pattern, 0) + 1
    return sorted(counts.items())


def check_weights(rules, weights):
    for rule, got in zip(rules, weights, strict=True):
        for k in range(3):
            if rule[0][k] > 0:
                assert got[k] == pytest.approx(math.log(rule[1][k] / rule[0][k]), abs=0.35), (rule, got)


def test_expectation_maximisation_finds_two_sided_rules():
    rules = [((0.3, 0.7 * a, 0.7 * (1 - a)), (0.3, 0.7 * (1 - a), 0.7 * a)) for a in (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6)]
    prior, weights = fit(drawn(rules, 40_000, 0.7, 2))
    assert prior == pytest.approx(math.log(0.7 / 0.3), abs=0.2)
    check_weights(rules, weights)


def test_expectation_maximisation_finds_one_sided_rules():
    """Rules that only ever vote bad, or only good, among others: how much a vote and abstaining say is found for each."""
    one = lambda bad, good: ((1 - bad, bad, 0.0), (1 - good, good, 0.0))
    rules = [one(0.5, 0.02), one(0.3, 0.01), one(0.4, 0.1), one(0.2, 0.05), ((0.9, 0.0, 0.1), (0.5, 0.0, 0.5)), ((0.2, 0.6, 0.2), (0.3, 0.1, 0.6)), ((0.5, 0.4, 0.1), (0.4, 0.1, 0.5)), one(0.6, 0.05)]
    prior, weights = fit(drawn(rules, 60_000, 0.8, 3))
    assert prior == pytest.approx(math.log(4), abs=0.2)
    check_weights(rules, weights)


def test_a_rule_is_never_turned_round():
    rules = [((0.2, 0.2, 0.6), (0.2, 0.6, 0.2)), *[((0.2, 0.7, 0.1), (0.2, 0.1, 0.7))] * 4]
    _, weights = fit(drawn(rules, 5000, 0.7, 4))
    assert weights[0][1] == weights[0][2] == 0
    assert fit([])[1] == [(0.0, 0.0, 0.0)] * len(RULES)


def brute_votes(t):
    """The votes, worked out again from the text."""
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, repeat, _ = brute(t)
    m, upper, lower, stops, bangs = max(1, n), sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t), sum(c in ".!?" for c in t), t.count("!")
    dup_share = dup / max(1, len(lines)) if dup >= 2 else 0
    kinds = len(set(w))
    calm = repeat / m <= 0.15 and symbols / m <= 0.05 and dup_share <= 0.1 and upper * 6 <= lower and bangs * 20 <= m and 2 <= chars / m <= 12
    rough = repeat / m > 0.4 or symbols / m > 0.2 or dup_share > 0.3 or upper > lower or bangs * 4 > m or chars / m > 20
    both = lambda good, bad: 0 if bad else 1 if good else -1
    return (
        both(False, n < 20), both(False, repeat / m > 0.4), both(False, symbols / m > 0.2), both(False, dup_share > 0.3), both(False, upper > lower),
        both(n >= 50 and kinds**2 >= 8 * m, n >= 50 and kinds**2 < 1.5 * m), both(stops * 60 >= m and bangs * 20 <= m, bangs * 4 > m), both(calm, rough),
    )


def test_the_whole_query_as_a_plain_version(table):
    """Votes, counts of patterns, posterior and verdict of every document, by loops over texts."""
    r = random.Random(7)
    rows = [*corpus(5, 150), *((2000 + d, ". ".join(" ".join(prose(r, 9, 4000)).capitalize() for _ in range(r.randint(3, 12)))) for d in range(150)), (3000, None), (3001, "")]
    given = {d: brute_votes(t) for d, t in rows}
    counts = {}
    for v in given.values():
        counts[v] = counts.get(v, 0) + 1
    prior, weights = fit(sorted(counts.items()))
    for x in quality_rules(table(rows)).collect():
        assert tuple(x[c] for c in RULES) == given[x.doc_id]
        p = 1 / (1 + math.exp(-(prior + sum(w[v + 1] for w, v in zip(weights, given[x.doc_id])))))
        assert x.posterior == pytest.approx(p, abs=1e-9)
        assert x.kept == (not brute(dict(rows)[x.doc_id])[5] and p >= 0.5)


def test_labelled_documents(spark):
    from amperia.llm.common import documents, labels

    at = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in labels(spark, at).collect()}
    kept = [(good[r.doc_id], r.kept) for r in op8_quality_rules(documents(spark, at)).collect() if good.get(r.doc_id) is not None]
    assert sum(k for g, k in kept if g) > 0.9 * sum(g for g, _ in kept) and not any(k for g, k in kept if not g)


def test_posterior_keeps_prose_and_drops_junk(table):
    r = random.Random(3)
    clean = [(d, " ".join(" ".join(prose(r, 12, 3000)).capitalize() + "." for _ in range(8))) for d in range(150)]
    junk = [(1000 + d, " ".join(r.choice(["$$$", "###", "BUY", "NOW!!!", "&&|<>"]) + str(r.randrange(10**6)) for _ in range(90))) for d in range(50)]
    got = {x.doc_id: x.kept for x in op8_quality_rules(table([*clean, *junk])).collect()}
    assert all(got[d] for d, _ in clean) and not any(got[d] for d, _ in junk)


def test_votes(table):
    got = votes(features(table([(1, "short"), (2, "A! " * 60)]))).collect()
    assert {v for r in got for v in (r[c] for c in RULES)} <= {-1, 0, 1}
    assert {r.doc_id: r.v_length for r in got} == {1: 0, 2: -1}


def test_main_path_is_native(table):
    plan = op8_quality_rules(table([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
