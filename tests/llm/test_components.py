import random

from amperia.llm.components import components, merged


def brute(edges):
    comp = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return comp


def graph(seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    path = [(1000 + k, 1001 + k) for k in range(60)]
    star = [(5000, 2000 + k) for k in range(100)]
    return [*edges, *path, *star, (7, 7), (9000, 9000)]


def table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_as_brute_force(spark):
    edges = graph(1)
    r = random.Random(3)
    r.shuffle(edges)
    want = brute([(a, b) for a, b in edges if a != b])
    assert {x.node: x.comp for x in components(table(spark, edges)).collect()} == want
    assert components(table(spark, [])).count() == 0


def test_merged_components(spark):
    first, more = graph(4), [(5, 1000), (1020, 2003), (77777, 299), (88888, 88889)]
    comps = components(table(spark, first))
    want = brute([(a, b) for a, b in first + more if a != b])
    assert {x.node: x.comp for x in merged(comps, table(spark, more)).collect()} == want
    assert {x.node: x.comp for x in merged(table(spark, []).toDF("node", "comp"), table(spark, more)).collect()} == brute(more)
