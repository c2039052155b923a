import hashlib
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from amperia.llm.common import written
from amperia.llm.line_dedup import drop_lines, keep_bitmaps, line_keys, op5_line_dedup, streamed, with_parts

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def result(docs):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op5_line_dedup(docs).collect()}


def hashed(want):
    return {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in want.items()}


def corpus(seed, n):
    r = random.Random(seed)
    shared = [f"A line that Many documents share, {k}" for k in range(12)] + ["nineteen characters", "exactly twenty chars", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "éééééééééééééééééééé"]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(r.randint(0, 150)):
            x = r.choice(shared) if r.random() < 0.6 else f"own words of document {d}, line {r.random()}"
            lines.append(r.choice(["", " ", "\t", "\r", "\x0b"]) + (x.upper() if r.random() < 0.3 else x) + r.choice(["", "  ", "\r", "\xa0"]))
        rows.append((d * 31 % 997, "\n".join(lines)))
    return rows


def test_same_lines_as_brute_force(table):
    rows = [*corpus(1, 60), (2001, None), (2002, ""), (2003, "\n\n"), (2004, "exactly twenty chars"), (2005, "\n".join(["x" * 30] * 200))]
    assert result(table(rows)) == hashed(brute(rows))


def test_a_line_of_every_document_stays_in_the_last(table):
    rows = [(d, f"this line stands everywhere\nown {d}") for d in range(2000)]
    got = result(table(rows, 11))
    assert got == hashed(brute(rows))
    assert sum(k for _, k, _ in got.values()) == 1999


def test_two_documents_are_too_few(table):
    rows = [(1, "a line in two documents only"), (2, "A LINE in two documents only \n a line in two documents only")]
    assert {k for _, k, _ in result(table(rows)).values()} == {0}


def test_bitmaps_are_sparse_and_give_the_text(table):
    rows = corpus(2, 40)
    docs = table(rows)
    maps = keep_bitmaps(docs)
    want = brute(rows)
    sizes = {r.doc_id: (r.n_dropped, len(r.keep)) for r in maps.collect()}
    assert {d: n for d, (n, _) in sizes.items()} == {d: n for d, (_, n, _) in want.items() if n}
    assert all(k <= -(-want[d][0] // 64) for d, (_, k) in sizes.items())
    assert {r.doc_id: r.text for r in drop_lines(docs, maps, counts=False).collect()} == {d: t for d, (_, _, t) in want.items()}


def test_rows_with_one_doc_id_are_one_document(table):
    line = "a line of twenty characters or more"
    docs = table([(1, line), (1, line), (1, f"{line}\nx"), (2, line)])
    assert {k for _, k, _ in result(docs).values()} == {0}
    more = docs.union(table([(3, line)]))
    assert {(r.doc_id, r.n_dropped) for r in op5_line_dedup(more).collect()} == {(1, 1), (2, 1), (3, 0)}


def test_main_path_is_native(table):
    plan = op5_line_dedup(table([(1, "x")]).withColumn("th", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_lines_are_split_and_added_up(table, monkeypatch):
    """Ranges of the hash that hold very frequent lines are split by document; a document's rows stay together."""
    monkeypatch.setattr("amperia.llm.line_dedup.LEAST_HEAVY", 20)
    monkeypatch.setattr("amperia.llm.line_dedup.RANGES", 64)
    rows = [*corpus(4, 90), *((5000 + d, f"this line stands everywhere\nand so does this other one\nown {d}\nTHIS line stands everywhere") for d in range(400)), (None, "this line stands everywhere")]
    docs = table(rows, 7)
    assert with_parts(line_keys(docs)).filter("parts > 3").count() > 800
    got = result(docs)
    want = hashed(brute([((-1 if d is None else d), t) for d, t in rows]))
    assert {(-1 if d is None else d): v for d, v in got.items()} == want


def test_sorted_range_partitions_decide(table):
    """One range exchange of all lines and one sort below the windows; no exchange of lines by their hashes alone."""
    docs = table(corpus(5, 30))
    plan = streamed(with_parts(written(line_keys(docs), "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(h1" not in plan and plan.count("Sort [h1") == 1


def test_text_ends_below_the_lines(table):
    """The hash of a text is computed before its lines are rows, which carry neither the text nor the array."""
    plan = line_keys(table([(1, "x")]))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, x in enumerate(plan) if "Generate posexplode" in x)
    assert "".join(plan).count("split(") == 1
    assert "text" not in "".join(plan[: at + 1]) and "xxhash64(text" in plan[at + 1] and "[2]" in plan[at]


def test_work_is_linear_in_the_lines_of_a_text(table):
    def seconds(n):
        docs = table([(d, "\n".join(f"a line of {'all documents' if k % 2 else f'document {d}'}, {k}" for k in range(n))) for d in range(3)], 1)
        began = time.perf_counter()
        assert op5_line_dedup(docs).agg(F.sum("n_dropped")).first()[0] == n // 2 * 2
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 2 * seconds(100_000) + 5


def test_columns_of_any_name_pass_through(table):
    names = ("_id", "_th", "_keep", "_n", "of", "row", "keep", "th", "h1", "part", "n_lines", "n_dropped")
    docs = table([(1, "a line of twenty characters or more"), (2, "a line of twenty characters or more"), (3, "a line of twenty characters or more"), (None, None)])
    for c in names:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    got = drop_lines(docs, keep_bitmaps(docs), counts=False)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, ""), (2, ""), (3, "a line of twenty characters or more"), (None, "")}
    assert all(r[c] == f"own {c}" for r in got.collect() for c in names)
    assert {(r.doc_id, r.n_dropped) for r in drop_lines(docs, keep_bitmaps(docs)).collect()} == {(1, 1), (2, 1), (3, 0), (None, 0)}
