import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from amperia.llm.mixing import first_words, mix, mixed, n_words, op4_mixing, sainte_lague

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes):
    """Shares by weight; whoever is above three times its size stops there, the rest is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest, w = total - sum(fixed.values()), sum(x for s, x in weight.items() if s not in fixed)
        share = {s: rest * x / w for s, x in weight.items() if s not in fixed}
        over = {s for s, x in share.items() if x > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def corpus(seed, n, sources, long=60):
    r = random.Random(seed)
    pick = lambda: r.choices(sources, [2.0**-k for k in range(len(sources))])[0]
    return [(d, " ".join(prose(r, r.randint(0, long))), pick()) for d in range(n)]


@pytest.mark.parametrize("sources", [["a", "b", "c"], ["z", None, "B", "a", "é", "😀", "￿"], ["only"]])
def test_targets_and_amounts(table, sources):
    rows = [*corpus(1, 1500, sources), (9001, None, sources[0]), (9002, " \n", sources[-1])]
    sizes, text = defaultdict(int), {d: t for d, t, _ in rows}
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    got = op4_mixing(table(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size(text[r.doc_id]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(64, 0.01 * t)
    assert sorted(map(tuple, op4_mixing(table(rows, 7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_the_mix_holds_what_was_taken(table):
    rows = corpus(3, 300, ["a", "b", None])
    docs = table(rows)
    taken = {r.doc_id: r.taken for r in mix(docs.select("doc_id", "source", "text")).collect()}
    held, text = defaultdict(int), {d: t for d, t, _ in rows}
    for r in mixed(docs).collect():
        held[r.doc_id] += size(r.text)
        assert text[r.doc_id].startswith(r.text)
    assert dict(held) == {d: n for d, n in taken.items() if n}


def test_highest_quotients(spark):
    """Seats given all at once are those given one by one."""
    r = random.Random(4)
    for _ in range(8):
        votes = [r.choice([0, 1, 5, 30, 500, 7000]) * r.randint(1, 9) for _ in range(r.randint(1, 14))]
        seats, won = r.choice([0, 1, 3, 40, 1000]), [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            k = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
            won[k] += 1
        rows = spark.createDataFrame([(0, k, v, seats) for k, v in enumerate(votes)], "g int, k int, votes long, seats long")
        got = {x.k: x.out for x in sainte_lague(rows, ["g"], ["k"], "votes", "seats", "out").collect()}
        assert got == dict(enumerate(won)), votes


def test_words(spark):
    texts = [None, "", " ", "a", " a\tb\n", "a\xa0b c", "\x0b x \x0c y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n_words(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {t: size(t) for t in texts}
    df = spark.createDataFrame([(" a  b\nc d ", k) for k in range(1, 5)], "t string, n int").select(first_words(F.col("t"), F.col("n")).alias("x"))
    assert [r.x for r in df.collect()] == [" a", " a  b", " a  b\nc", " a  b\nc d"]
