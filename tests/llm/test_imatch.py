import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from amperia.llm.imatch import GROUPS, LEAST_SHARE, MOST_SHARE, lexicon, op7_fingerprints

from .conftest import prose


def corpus(seed, n):
    r = random.Random(seed)
    rows = [(d * 13 % 4099 - 50, " ".join(prose(r, r.randint(0, 300), 3000))) for d in range(n)]
    return [*rows, (5001, None), (5002, ""), (5003, "é"), (5004, "x" * 999), (5005, "😀" * 7)]


def next_of(rows):
    order = sorted(rows)
    return {d: ((t or ""), (u or "")) for (d, t), (_, u) in zip(order, order[1:] + order[:1])}


def test_edited_texts(table):
    rows = corpus(1, 900)
    got = {r.doc_id: r for r in op7_fingerprints(table(rows)).collect()}
    assert len(got) == len(rows)
    for d, (t, u) in next_of(rows).items():
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1


def test_equal_and_near_texts(table):
    r = random.Random(2)
    rows = corpus(2, 300)
    base = prose(r, 250, 3000)
    near = list(base)
    near[40] = "changed"
    far = prose(r, 250, 3000)
    at = 10_000
    rows += [(at, " ".join(base)), (at + 1, " ".join(base)), (at + 2, " ".join(near)), (at + 3, " ".join(far)), (at + 4, " ".join(far[:240]))]
    got = {r.doc_id: r for r in op7_fingerprints(table(rows)).collect()}
    assert got[at].fingerprint == got[at + 1].fingerprint and got[at].near_next == 1
    assert got[at + 1].near_next > 0.7
    assert got[at + 2].near_next < 0.3 < 0.6 < got[at + 3].near_next
    assert got[5001].fingerprint == got[5002].fingerprint and got[5001].near_next == 1
    assert got[5002].near_next == 0


def test_near_copies_of_long_texts(table):
    """Texts with 2,000 to 20,000 terms of the band, each followed by a copy with one word changed, then by a text of other terms."""
    r = random.Random(4)
    vocabulary = [f"t{k}" for k in range(40_000)]
    rows = [(d, " ".join(r.sample(vocabulary, 2000))) for d in range(100)]
    sizes = (2000, 3000, 5000, 10_000, 20_000)
    for k, n in enumerate(sizes):
        for j in range(4):
            base = r.sample(vocabulary, n)
            near = list(base)
            near[n // 3] = "changed"
            rows += [(1000 * (k + 1) + 10 * j, " ".join(base)), (1000 * (k + 1) + 10 * j + 1, " ".join(near))]
    got = {x.doc_id: x for x in op7_fingerprints(table(rows)).collect()}
    for d, x in got.items():
        assert d < 1000 or sum(h != "-" for h in x.fingerprint.split()) > 4, d
        if d >= 1000:
            assert x.near_next > 0.7 if d % 10 == 0 else x.near_next < 0.5, (d, x.near_next)


def test_lexicon_is_the_band(table):
    r = random.Random(3)
    rows = [(d, " ".join({"all", f"own{d}", *(f"t{k}" for k in range(200) if r.random() < k / 200)})) for d in range(500)]
    docs = table(rows).select("doc_id", "text")
    held = {x for slot in lexicon(docs) for x in slot}
    df = {}
    for _, t in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    want = [w for w, n in df.items() if max(1, LEAST_SHARE * 500) < n <= MOST_SHARE * 500]
    hashes = docs.sparkSession.createDataFrame([(w,) for w in want], "w string").select(F.xxhash64("w")).collect()
    assert held == {h[0] for h in hashes}


def test_repeated_ids(table):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "g h i")]
    assert op7_fingerprints(table(rows)).count() == 4


def test_main_path_is_native(table):
    plan = op7_fingerprints(table([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def spark_hash(*values):
    """xxhash64 of ints, longs and strings in turn, each seeded by the one before."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else v, seed=h).intdigest()
    return signed(h)


def plain_prints(texts):
    """Fingerprints of texts, with the terms of each subset in place of its hash: lexicon, subsets and fallbacks by loops."""
    n, low = len(texts), {c: c + 32 for c in range(65, 91)}
    kinds = [{w for w in re.split("[.,;:!?\\x20\\x09-\\x0D]+", t.translate(low)) if w} for t in texts]
    df = Counter(w for k in kinds for w in k)
    lex = {w: spark_hash(w) for w, k in df.items() if max(1, 0.002 * n) < k <= max(2, 0.2 * n)}
    shares = [2 * GROUPS[-1]]
    while shares[-1] < len(lex):
        shares.append(2 * shares[-1])
    number, long = (lambda k: k.to_bytes(4, "little", signed=True)), (lambda t: t.to_bytes(8, "little", signed=True))

    def one(text):
        own = {w for w in re.split("[.,;:!?\\x20\\x09-\\x0D]+", text.translate(low)) if w}
        known = sorted(lex[w] for w in own if w in lex)
        out = []
        for k, share in enumerate((*GROUPS, *shares)):
            for j in range(8):
                if k < len(GROUPS):
                    held = [t for t in known if (spark_hash(number(k), long(t)) >> (8 * j)) & 255 < 256 // share]
                else:
                    held = [t for t in known if spark_hash(number(-1), long(t)) & 63 == 0 and spark_hash(number(k), long(t)) & (share // 64 - 1) == j]
                out.append(tuple(held) if 1 <= len(held) <= 3 else None)
        return out if any(x is not None for x in out) else [("known", *known) if known else ("text", text)]

    return one


def plain_likeness(a, b):
    if len(a) != len(b):
        return 0.0
    both = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in both) / max(1, len(both))


def test_fingerprints_and_likenesses_as_a_plain_version(table):
    r = random.Random(9)
    texts = [" ".join(r.choice(["", "Ab", "x."]) + f"t{int(700 * r.random() ** 2)}" + r.choice(["", ",", "!"]) for _ in range(r.choice([0, 1, 2, 5, 20, 90, 400]))) for _ in range(110)]
    texts += [texts[5], texts[50], "only these words stand here", ""]
    one = plain_prints(texts)
    got = {x.doc_id: x for x in op7_fingerprints(table(list(enumerate(texts)), 4)).collect()}
    prints = [one(t) for t in texts]
    for d, t in enumerate(texts):
        after, half = texts[(d + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_edited == pytest.approx(plain_likeness(prints[d], one(edited)))
        assert got[d].near_next == pytest.approx(plain_likeness(prints[d], prints[(d + 1) % len(texts)]))
        for e in range(d):
            assert (got[d].fingerprint == got[e].fingerprint) == (prints[d] == prints[e])
