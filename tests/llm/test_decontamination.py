import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from amperia.llm import decontamination
from amperia.llm.common import ship
from amperia.llm.decontamination import Automaton, _words, decontaminate, hits, op13_decontamination, without


def words(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, bench, window=10):
    """docs: id, text; bench: item, text. Every window at every place."""
    out = []
    for d, t in docs:
        ws, hit, items = words(t), set(), set()
        for i, b in bench:
            item = words(b)
            k = min(window, len(item))
            for x in {tuple(item[j : j + k]) for j in range(len(item) - k + 1)} if item else ():
                for p in range(len(ws) - k + 1):
                    if tuple(ws[p : p + k]) == x:
                        hit |= set(range(p, p + k))
                        items |= {str(i)} if i is not None else set()
        out.append((d, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed, n_docs, n_items, vocabulary=6):
    """Words of a small vocabulary, so that many windows nearly match; items of 0 to 40 words; passages put into documents."""
    r = random.Random(seed)
    say = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz"[:vocabulary]) + r.choice(["", "", "é", "7"]) for _ in range(n)]
    items = [say(r.choice([0, 1, 4, 7, 9, 10, 11, 25, 40])) for _ in range(n_items)]
    items = [i if len(i) > 3 else [w + "only" for w in i] for i in items]
    docs = []
    for k in range(n_docs):
        text = say(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            item = r.choice(items)
            a = r.randint(0, len(item))
            text[r.randint(0, len(text)) : 0] = item[a : a + r.randint(0, 20)]
        docs.append((k, "".join(w.upper() + r.choice([" ", "\n", " - ", "\x00", "_"]) if r.random() < 0.5 else w + " " for w in text)))
    return docs, [(k, " ".join(i)) for k, i in enumerate(items)]


@pytest.fixture(scope="module")
def bench_table(spark):
    ship(spark)
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").repartition(2)


def digests(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_automaton_same_as_brute_force(seed):
    window = seed % 5 + 3
    docs, bench = corpus(seed, 15, 12, vocabulary=2 + seed % 5)
    found = Automaton([(str(i), [w.encode() for w in words(t)]) for i, t in bench], window)
    for want, (_, t) in zip(brute(docs, bench, window), docs, strict=True):
        n, spans, items = found.read(t.encode())
        assert (n, sum(b - a for a, b in spans), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()) == want[1:5]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_query_same_as_brute_force(table, bench_table):
    docs, bench = corpus(99, 60, 30)
    docs += [(1001, None), (1002, ""), (1003, " -\x00\n"), (None, docs[0][1]), (5, docs[5][1])]
    bench += [(500, None), (501, "..."), (None, bench[3][1] + " more words that have no id and stand here once again now"), (3, bench[4][1])]
    assert digests(op13_decontamination(table(docs), bench_table(bench))) == sorted(brute(docs, bench), key=str)


def test_blocks_and_pieces_add_up(table, bench_table):
    """Items in many blocks, long ones in pieces: the same spans and items."""
    docs, bench = corpus(7, 40, 25)
    bench.append((77, " ".join(t for _, t in bench)))
    docs += [(900, bench[-1][1]), (901, None)]
    find = lambda most: sorted((r.row.doc_id, r.n_words, r.spans, r.items) for r in hits(table(docs), bench_table(bench), ["doc_id"], most=most).collect())
    assert find(40) == find(1 << 19)
    assert decontamination.automata(bench_table(bench), most=40).count() > 5


def test_no_items_and_no_documents(table, bench_table):
    got = op13_decontamination(table([(1, "some words"), (2, None)]), bench_table([])).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == {(1, 2, 0, 0, False), (2, 0, 0, 0, False)}
    assert op13_decontamination(table([]), bench_table([(1, "a b")])).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    t = "ab cd\n" * 50 + "x" * 999 + " é" * 30
    whole = [w for ws in _words(t.encode()) for w in ws]
    monkeypatch.setattr(decontamination, "CHUNK", 7)
    parts = list(_words(t.encode()))
    assert [w for ws in parts for w in ws] == whole == [w.encode() for w in words(t)] and len(parts) > 20
    found = Automaton([("1", [b"cd", b"ab", b"cd"])])
    assert found.read(t.encode())[1] == [[1, 100]]


def test_texts_without_spans(table, bench_table):
    item = "one two three four five six seven eight nine ten eleven twelve"
    own = [f"own{k}" for k in range(30)]
    text = " ".join(own[:15]) + f" - ({item.upper()})! " + " ".join(own[15:]) + "\nend."
    assert without("a b, c. d", [[1, 3]]) == "a . d" and without("é b", [[0, 1]]) == " b"
    docs = table([(1, text), (2, item), (3, None), (4, "own words only"), (None, text)]).withColumn("row", F.lit("own")).withColumn("spans", F.lit(1))
    got = {str(r.doc_id): r for r in decontaminate(docs, bench_table([(1, item)])).collect()}
    assert set(got) == {"1", "3", "4", "None"} and got["3"].text is None and got["4"].text == "own words only"
    assert got["1"].text == got["None"].text == " ".join(own[:15]) + " - ()! " + " ".join(own[15:]) + "\nend."
    assert all(r.row == "own" and r.spans == 1 for r in got.values())
    kept = {str(r.doc_id): r.text for r in decontaminate(docs, bench_table([(1, item)]), most_words=12, most_coverage=1.0).collect()}
    assert kept["1"] == text and kept["2"] == item
