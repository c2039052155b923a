import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from amperia.llm.common import documents, labels
from amperia.llm.flat import slices
from amperia.llm.toxicity import DISCOUNT, Calibration, Models, count_grams, grams, op1_toxicity, plain

from .conftest import prose


def brute_gains(train, text):
    """Class-conditional interpolated Kneser-Ney over bytes with plain dictionaries: log P(byte | toxic) - log P(byte | ordinary)."""
    clean = lambda t: b"    " + bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in t.encode())
    top = [Counter(), Counter()]
    for t, label in train:
        s = clean(t)
        for k in range(len(s) - 4):
            top[label][s[k : k + 5]] += 1
    levels = {5: top}
    for k in (4, 3):
        levels[k] = [Counter(), Counter()]
        for c in (0, 1):
            for g in levels[k + 1][c]:
                levels[k][c][g[1:]] += 1
    both = {g for c in (0, 1) for g in levels[3][c]}
    pair, single = Counter(g[1:] for g in both), Counter()
    for g in pair:
        single[g[1:]] += 1
    total = sum(single.values()) + 0.5 * 256

    def p(g, k, c):
        if k == 1:
            return (single[g[-1:]] + 0.5) / total
        counts = pair if k == 2 else levels[k][c]
        own = {x: n for x, n in counts.items() if x[:-1] == g[-k:-1]}
        if not own:
            return p(g, k - 1, c)
        n = sum(own.values())
        return max(counts[g[-k:]] - DISCOUNT, 0) / n + DISCOUNT * len(own) / n * p(g, k - 1, c)

    s = clean(text)
    return [math.log(max(p(s[k : k + 5], 5, 1), 1e-9)) - math.log(max(p(s[k : k + 5], 5, 0), 1e-9)) for k in range(len(s) - 4)]


def test_models_as_brute_force(spark):
    r = random.Random(1)
    train = [(" ".join(r.choice(["bad", "vile", "good", "fair", "Tree", "ébène"][(0 if y else 2) :]) for _ in range(8)), y) for y in (0, 1, 1, 0, 0)]
    rows = spark.createDataFrame(train, "text string, label int")
    models = Models(count_grams(rows))
    for text in ("bad tree", "A good\tébène", "zzz", "vile"):
        (_, _, data, at), = slices(pa.array([text]))
        assert models.gain(grams(plain(data, at), at)) == pytest.approx(brute_gains(train, text), abs=2e-3)


def test_broadcast_has_the_same_tables(spark):
    import pickle

    models = Models(count_grams(spark.createDataFrame([("some text", 1), ("other words", 0)], "text string, label int")))
    again = pickle.loads(pickle.dumps(models))
    assert all(np.array_equal(a, b) for k in ("seen", "over", "kinds") for a, b in zip(getattr(models, k), getattr(again, k)))


def test_held_out_documents(spark):
    """Trained without the held-out fold, scores tell its labels apart."""
    docs, known = documents(spark, "/root/testdata/sf0.01"), labels(spark, "/root/testdata/sf0.01")
    scores = {r.doc_id: r for r in op1_toxicity(docs, known).collect()}
    toxic = {r.doc_id: r.toxic for r in known.collect()}
    for d, r in scores.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
    rows = [(scores[d].score, y, scores[d].predicted) for d, y in toxic.items() if d in scores and scores[d].held_out and y is not None]
    ones, zeros = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    right = np.mean([y == p for _, y, p in rows])
    print(f"held out: {len(rows)} rows, AUC {auc:.3f}, accuracy {right:.3f}")
    assert auc > 0.9 and right > 0.9


def test_held_out_labels_are_never_used(table, label_table):
    r = random.Random(2)
    rows = [(d, " ".join(prose(r, 30) + ["vile"] * (d % 2))) for d in range(120)]
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    docs = table(rows)
    scores = [{x.doc_id: x.score for x in op1_toxicity(docs, label_table([(d, 0, (d + flip * held(d)) % 2) for d in range(120)])).collect()} for flip in (0, 1)]
    assert scores[0] == scores[1]


def test_calibration_is_monotone_and_calibrated():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 4))
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = Calibration(x, y).score(x)
    for lo, hi in ((0, 0.2), (0.4, 0.6), (0.8, 1)):
        at = (p >= lo) & (p < hi)
        assert y[at].mean() == pytest.approx(p[at].mean(), abs=0.06)
    assert Calibration(np.zeros((0, 4)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0, 0]


def test_grams_that_fold_alike_are_kept_apart(spark):
    """Two grams with the same remainder by 1,048,573, one common in one class, the other never seen."""
    r, seen = random.Random(4), {}
    while True:
        w = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
        other = seen.setdefault(int.from_bytes(w.encode(), "big") % 1_048_573, w)
        if other != w:
            break
    train = [(" ".join([other] * 50), 0), (f"{w[:4]} {w[1:4]}", 1), (f"{w[:4]}x", 0)]
    models = Models(count_grams(spark.createDataFrame(train, "text string, label int")))
    for text in (w, other, f"{w} {other}"):
        (_, _, data, at), = slices(pa.array([text]))
        assert models.gain(grams(plain(data, at), at)) == pytest.approx(brute_gains(train, text), abs=2e-3)


def test_scores_are_the_same_without_broadcast(table, label_table, monkeypatch):
    r = random.Random(5)
    rows = [(d, " ".join(prose(r, r.randint(0, 30)) + ["vile"] * (d % 2))) for d in range(150)]
    rows += [(1, rows[1][1]), (700, rows[3][1]), (None, rows[5][1]), (701, None), (702, ""), (703, "\U0001f600 new é")]
    docs, known = table(rows), label_table([(d, 0, d % 2) for d in range(150)])
    scores = []
    for most in (4_000_000, 0):
        monkeypatch.setattr("amperia.llm.toxicity.MOST_GRAMS", most)
        scores.append(sorted((-1 if x.doc_id is None else x.doc_id, x.score, x.ratio) for x in op1_toxicity(docs, known).collect()))
    assert len(scores[0]) == len(rows)
    assert np.allclose(scores[0], scores[1], atol=1e-4)


def test_only_the_calibration_sample_is_held_back(table, label_table, monkeypatch):
    from amperia.llm import toxicity

    learnt = []
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 20)
    monkeypatch.setattr(toxicity, "count_grams", lambda rows: learnt.append(rows.count()) or count_grams(rows))
    toxicity.fit(table([(d, "some words") for d in range(600)]), label_table([(d, 0, d % 2) for d in range(600)]))
    learnable = sum(zlib.crc32(str(d).encode()) % 3 != 1 for d in range(600))
    assert learnable - 60 < learnt[0] < learnable


def test_planted_words_separate(table, label_table):
    r = random.Random(2)
    docs = table([(d, " ".join(prose(r, 30) + ["vile"] * (d % 2))) for d in range(480)])
    scores = {x.doc_id: x.score for x in op1_toxicity(docs, label_table([(d, 0, d % 2) for d in range(480)])).collect()}
    assert min(s for d, s in scores.items() if d % 2) > max(s for d, s in scores.items() if d % 2 == 0)
