import random
import zlib

import numpy as np
import pyarrow as pa

from amperia.llm.common import documents, labels
from amperia.llm.flat import slices
from amperia.llm.quality_classifier import DIMS, WINDOW, Lookup, Network, index_vectors, op9_quality_classifier, own_index, pooled, tokens, vectors_of

from .conftest import prose


def test_vectors_are_means_of_neighbours(table):
    """Learnt vectors and weights against sums word by word; words that stand once have none."""
    r = random.Random(5)
    texts = [" ".join(f"v{int(9000 * r.random() ** 2)}" for _ in range(r.randint(0, 900))) for _ in range(60)]
    got = vectors_of(table(list(enumerate(texts)))).value
    index, sums, seen, every, total = index_vectors().astype(int), {}, {}, np.zeros(DIMS), 0
    for t in texts:
        for _, _, data, at in slices(pa.array([t])):
            shape, _, h = tokens(data, at)
            own = own_index(h).astype(int) + index[shape]
            for k, w in enumerate(h.view(np.int64)):
                near = sum(own[j] for j in range(max(0, k - WINDOW), min(len(h), k + WINDOW + 1)) if j != k)
                total += 1
                every = every + near
                for key in (int(w), ("shape", int(shape[k]))):
                    sums[key], seen[key] = sums.get(key, 0) + near, seen.get(key, 0) + 1
    often = [w for w in sums if not isinstance(w, tuple) and seen[w] > 1]
    assert set(got.find.keys.tolist()) == set(often) and len(often) > 3000
    assert np.allclose(got.centre, every / total, atol=1e-5)
    for w, s in sums.items():
        v = s / seen[w] - every / total
        v = v / np.linalg.norm(v)
        if isinstance(w, tuple):
            assert np.allclose(got.shapes[w[1]], v, atol=1e-3)
        elif w in often:
            k = got.find.find(np.array([w]))[0]
            assert np.allclose(got.words[k] / 127, v, atol=5e-3) and np.isclose(got.weight[k], np.log((total + 1) / (seen[w] + 1)), atol=1e-4)


def test_the_lookup_finds_every_key_and_no_other():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000) // 4096 * 4096)  # they all share their last bits
    got = Lookup(keys)
    assert (got.find(keys) == np.arange(len(keys))).all() and (got.find(keys + 1) == -1).all()
    assert (Lookup(keys[:0]).find(keys) == -1).all()


def test_a_text_is_pooled_alike_wherever_it_stands(table, monkeypatch):
    r = random.Random(2)
    texts = [*(" ".join(prose(r, r.randint(0, 50))) for _ in range(20)), None, "", "\n\n", "one", " ".join(prose(r, 3000, 2000))]
    t = vectors_of(table(list(enumerate(texts)))).value
    together = pooled(pa.array(texts), t)
    for chunk in (1 << 13, 7, 64):
        monkeypatch.setattr("amperia.llm.quality_classifier.CHUNK", chunk)
        for k, x in enumerate(texts):
            assert np.allclose(together[k], pooled(pa.array([x], pa.string()), t)[0], atol=1e-3)


def test_held_out_documents(spark):
    docs, known = documents(spark, "/root/testdata/sf0.01"), labels(spark, "/root/testdata/sf0.01")
    scores = {r.doc_id: r for r in op9_quality_classifier(docs, known).collect()}
    good = {r.doc_id: r.quality for r in known.collect()}
    for d, r in scores.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    rows = [(scores[d].score, y, scores[d].predicted) for d, y in good.items() if d in scores and scores[d].held_out and y is not None]
    ones, zeros = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    right = np.mean([y == p for _, y, p in rows])
    print(f"held out: {len(rows)} rows, AUC {auc:.3f}, accuracy {right:.3f}")
    assert auc > 0.9 and right > 0.85


def test_held_out_labels_are_never_used(table, label_table):
    r = random.Random(3)
    rows = [(d, " ".join(prose(r, 40) if d % 2 else ["zz", "qq"] * 20)) for d in range(150)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    docs = table(rows)
    scores = [{x.doc_id: x.score for x in op9_quality_classifier(docs, label_table([(d, (d + flip * held(d)) % 2, 0) for d in range(150)])).collect()} for flip in (0, 1)]
    assert max(abs(scores[0][d] - scores[1][d]) for d in scores[0]) < 1e-6
    assert all((s >= 0.3) == (d % 2 == 1) for d, s in scores[0].items())


def test_temperature_calibrates():
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 4))
    y = (r.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    p = Network(x[:4000], y[:4000]).score(x[4000:])
    for lo, hi in ((0, 0.25), (0.35, 0.65), (0.75, 1)):
        at = (p >= lo) & (p < hi)
        assert abs(y[4000:][at].mean() - p[at].mean()) < 0.1


def test_the_network_is_two_layers_and_learns_what_one_cannot():
    """The scores are those of the two layers, computed by hand."""
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 5))
    n = Network(x, (x[:, 0] * x[:, 1] > 0).astype(int))
    z = (x - n.shift) / n.scale
    odds = [sum(np.tanh(sum(z[k, i] * n.w[0][i, j] for i in range(5)) + n.w[1][j]) * n.w[2][j] for j in range(len(n.w[2]))) + n.w[3][0] for k in range(20)]
    assert np.allclose(n.score(x[:20]), 1 / (1 + np.exp(-np.array(odds) / n.temperature)))
    assert ((n.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9
