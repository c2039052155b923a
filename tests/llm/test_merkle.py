import hashlib
import random
import zlib

from pyspark.sql import functions as F

from amperia.llm.merkle import height, manifest, op12_merkle


def h(x):
    return hashlib.sha256((x if isinstance(x, bytes) else x.encode())).hexdigest()


def leaf(row):
    return h(b"".join(b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in row))


def lowered(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    """The levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([h("".join(level[k : k + 16])) for k in range(0, len(level), 16)])
    return levels


def path(levels, i):
    """Siblings before and after the node, level by level."""
    out = []
    for level in levels[:-1]:
        run = i // 16 * 16
        out.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return out


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], r[3], r[2], r[4], r[1]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, leaf(x)))
        trees[s] = tree([leaf(x) for x in by[s]])
    top = tree([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, x in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            proof = h("".join("".join(a + b) for a, b in steps))
            tampered = x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0
            at = leaf((*x[:4], lowered(x[4]))) if tampered else leaf(x)
            for a, b in steps:
                at = h("".join([*a, at, *b]))
            out.append((x[0], leaf(x), trees[s][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return out


def rows_of(seed, counts):
    r, out, k = random.Random(seed), [], 0
    for source, n in counts.items():
        for _ in range(n):
            k += 1
            text = r.choice([None, "", "lower only", "Some Upper ÄÖ é😀", f"Text {k} \n of {r.random()}"])
            out.append((k * 7919 % 100_003, text, r.choice([None, "en", "é"]), source, r.choice([None, -3, 5])))
    return out


def same(df, want):
    got = [tuple(x) for x in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def make(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)


def test_same_as_plain_trees(spark):
    rows = rows_of(1, {"one": 1, "two": 2, "sixteen": 16, "more": 17, None: 40, "": 256, "é": 257, "Z": 300})
    want = brute(rows)
    same(op12_merkle(make(spark, rows)), want)
    assert {x[-1] for x in want} == {True, False}


def test_blocks_of_many_rounds_and_many_sources(spark):
    """Blocks of 16 nodes: three rounds for a source, two above the sources."""
    rows = rows_of(2, {"hot": 700, **{f"s{k}": k % 5 + 1 for k in range(40)}})
    found = manifest(make(spark, rows), levels=1)
    same(found.withColumn("verified", F.col("folded_root") == F.col("root")), brute(rows))


def test_one_row_no_row_repeated_and_null_rows(spark):
    for rows in ([(5, "A", None, "s", 1)], [(None, None, None, None, None)] * 3 + [(4, "B", "x", None, 2)] * 20, [(1, "same", "x", "s", 4), (1, "Other", "x", "s", 5), (1, "same", "x", "s", 4)]):
        same(op12_merkle(make(spark, rows)), brute(rows))
    assert op12_merkle(make(spark, [])).count() == 0


def test_long_text_and_clashing_columns(spark):
    rows = [(k, "Long " * 300_000 if k == 3 else "x", "l", "s", 1) for k in range(20)]
    docs = make(spark, rows)
    for c in ("of", "h", "pos", "n", "_at", "_part", "other", "root", "block", "leaf", "beside"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    same(op12_merkle(docs), brute(rows))


def test_a_change_anywhere_changes_the_root(spark):
    rows = rows_of(3, {"a": 30, "b": 3})
    root = op12_merkle(make(spark, rows)).first().root
    changed = [*rows[:-1], (*rows[-1][:4], 99)]
    assert op12_merkle(make(spark, changed)).first().root != root


def test_heights():
    assert [height(n) for n in (0, 1, 2, 16, 17, 256, 257, 4096, 4097)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
