import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from amperia.llm.ngram_join import bit_sketch, hamming, meetings, ngram_join, one_of_each, op2_ngram_join, runs_of_tokens, shingle_sets

from .conftest import prose


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id: (set size, smallest doc_id of its component), by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}

    def top(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x) >= 4 * len(y) and 5 * len(y) >= 4 * len(x) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    return {d: (len(sets[d]), top(d)) for d in ids}


def result(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs).collect()}


def edited(r, w, times):
    w = list(w)
    for _ in range(times):
        at = r.randrange(len(w))
        kind = r.random()
        if kind < 0.4:
            w[at] = f"new{r.random()}"
        elif kind < 0.7:
            w.insert(at, f"more{r.random()}")
        elif len(w) > 2:
            del w[at]
    return w


def families(seed, n_families, copies, sizes):
    r, rows = random.Random(seed), []
    for _ in range(n_families):
        base = prose(r, r.choice(sizes))
        for _ in range(copies):
            w = edited(r, base, r.randint(0, max(1, len(base) // 40)))
            rows.append((len(rows) * 7 % 1009 + 1000 * (len(rows) // 1009), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, [3, 4, 5, 6, 7, 9, 12]), (2, [20, 35, 60, 90]), (3, [200, 400, 900])])
def test_same_components_as_all_pairs(table, seed, sizes):
    rows = families(seed, 18, 8, sizes)
    assert result(table(rows)) == brute(rows)


def test_pairs_at_the_threshold(table):
    """Sets of many sizes whose similarity is 0.8 exactly, or just below."""
    rows = []
    for n in range(4, 40, 3):
        for k, extra in enumerate((0, 1)):
            shared = [f"s{n}.{k}.{i}" for i in range(8 * n + 4)]  # 8 n shingles in common, n of either set's own
            rows += [(len(rows), " ".join([*shared, *(f"a{n}.{k}.{i}" for i in range(n + extra))])), (len(rows) + 1, " ".join([*shared, *(f"b{n}.{k}.{i}" for i in range(n))]))]
    want = brute(rows)
    assert len({c for _, c in want.values()}) == len(rows) - 12
    assert result(table(rows)) == want


def test_chains_and_hot_groups(table):
    """A chain in which each text is like the next only, a large group of near copies and of exact copies, and a passage that all others hold."""
    r = random.Random(5)
    chain, w = [], prose(r, 120)
    for k in range(40):
        chain.append(list(w))
        w[3 * k % 117 : 3 * k % 117 + 2] = [f"c{k}", f"d{k}"]
    base = prose(r, 60)
    near = [edited(r, base, 1) for _ in range(700)]
    passage = [f"p{k}" for k in range(60)]
    apart = [[*passage, *prose(r, 40, 10**6)] for _ in range(60)]
    texts = [*chain, *near, *[base] * 300, *apart]
    r.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert result(table(rows)) == brute(rows)


def test_words_and_case(table):
    rows = [(5, "One two\tTHREE four"), (3, "one\n two three\x0bFOUR "), (4, "one two three four five"), (8, "É two three four"), (9, "é two three four"), (2, None), (1, "  ")]
    assert result(table(rows)) == {5: (1, 3), 3: (1, 3), 4: (1, 4), 8: (1, 8), 9: (1, 9), 2: (0, 2), 1: (0, 1)}


def test_one_document_of_each_group_stays(table):
    rows = families(7, 10, 5, [30, 80])
    want = brute(rows)
    assert {r.doc_id for r in one_of_each(table(rows)).collect()} == {d for d, (_, c) in want.items() if c == d}


def test_bit_sketches_bound_the_symmetric_difference():
    r = random.Random(9)
    texts = [" ".join(prose(r, r.randint(5, 300), 60)) for _ in range(80)]
    sets = list(shingle_sets(__import__("pyarrow").array(texts)))
    for a, b in zip(sets, sets[1:]):
        assert hamming(bit_sketch(a), bit_sketch(b)) <= len(np.setxor1d(a, b))


def test_rows_without_an_id_have_no_component(table):
    text = "the same words stand in each of these three rows"
    got = op2_ngram_join(table([(1, text), (None, text), (2, text), (None, "other words stand in this row of mine")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("2", "1"), ("None", "None"), ("None", "None")]


def test_a_token_of_a_third_of_all_rows_is_spread_over_partitions_and_keeps_one_leader(spark):
    r = random.Random(5)
    rows = [(7, d) for d in r.sample(range(10**6), 4000)] + [(r.randrange(3000), r.randrange(10**6)) for _ in range(8000)]
    rows += rows[:200]  # rows that repeat
    dealt = spark.createDataFrame(rows, "token long, doc_id long").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert runs_of_tokens(dealt).filter("token = 7").select(F.spark_partition_id()).distinct().count() > 1
        found = {tuple(x) for x in meetings(dealt).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    least = {}
    for t, d in rows:
        least[t] = min(d, least.get(t, d))
    assert found == {(t, least[t], d) for t, d in rows if d != least[t]}


def test_no_tokens_no_meetings(spark):
    assert meetings(spark.createDataFrame([], "token long, doc_id long")).count() == 0
    assert meetings(spark.createDataFrame([(1, 1), (1, 1), (2, 3)], "token long, doc_id long")).count() == 0
