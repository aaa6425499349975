import random

from pyspark.sql import functions as F

from factloom.operators import hierarchy

SCHEMA = "doc bigint, child int, parent int, lab string, path string, extra int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def make(spark, links):
    return spark.createDataFrame([(d, c, p, "x", "clash", 1) for d, c, p in links], SCHEMA)


def test_paths_and_descendants(spark):
    df = make(spark, [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 4, 2), (2, 1, 9), (2, 5, None), (None, 1, 2), (3, None, 1)])
    r = hierarchy.resolve(df, ["doc"], "child", "parent", "lab", 0)
    got = {(x["doc"], x["child"]): (x["path"], x["depth"], x["top"]) for x in r.collect()}
    assert got == {(1, 1): ([1], 0, 1), (1, 2): ([1, 2], 1, 1), (1, 3): ([1, 2, 3], 2, 1), (1, 4): ([1, 2, 4], 2, 1), (2, 1): ([9, 1], 1, 9), (2, 5): ([5], 0, 5)}
    assert rows(hierarchy.descendants(r, ["doc"], "child"), "doc", "ancestor", "descendant", "distance") == [(1, 1, 2, 1), (1, 1, 3, 2), (1, 1, 4, 2), (1, 2, 3, 1), (1, 2, 4, 1), (2, 9, 1, 1)]


def test_rounds(spark):
    df = make(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 3), (1, 5, 4), (1, 6, 6), (1, 7, 0), (2, 1, 2), (2, 2, 0)])
    assert rows(hierarchy.cycles(df, ["doc"], "child", "parent", 0), "doc", "child") == [(1, 1), (1, 2), (1, 3), (1, 6)]
    r = hierarchy.resolve(df, ["doc"], "child", "parent", None, 0)
    assert rows(r.filter("leads_to_cycle"), "doc", "child") == [(1, 4), (1, 5)]
    assert r.filter("cyclic AND path IS NOT NULL").count() == 0


def test_long_tail_into_a_round(spark):
    df = make(spark, [(1, i, i + 1) for i in range(1, 60)] + [(1, 60, 58)])
    assert rows(hierarchy.cycles(df, ["doc"], "child", "parent", 0), "child") == [(58,), (59,), (60,)]


def test_empty_and_several_parents(spark):
    empty = make(spark, [])
    assert hierarchy.cycles(empty, ["doc"], "child", "parent", 0).count() == 0
    assert hierarchy.resolve(empty, ["doc"], "child", "parent", None, 0).count() == 0
    two = hierarchy.resolve(make(spark, [(1, 2, 5), (1, 2, 3), (1, 2, 3)]), ["doc"], "child", "parent", None, 0).collect()
    assert [x["path"] for x in two] == [[3, 2]]


def test_against_walking(spark):
    rng = random.Random(5)
    links = [(d, c, rng.randint(0, 30)) for d in range(6) for c in range(1, 31) if rng.random() < 0.9]
    up = {(d, c): p for d, c, p in links}
    expected = set()
    for d, c in up:
        at, n = up[d, c], 0
        while (d, at) in up and at != c and n < 99:
            at, n = up[d, at], n + 1
        if at == c:
            expected.add((d, c))
    assert set(rows(hierarchy.cycles(make(spark, links), ["doc"], "child", "parent", 0), "doc", "child")) == expected


def test_joined_rounds_give_the_same(spark):
    rng = random.Random(9)
    links = [(d, c, rng.randint(0, 40)) for d in range(5) for c in range(1, 41) if rng.random() < 0.9]
    links += [(7, i, i + 1) for i in range(1, 70)] + [(8, i, i - 1) for i in range(1, 70)]
    df = make(spark, links).withColumn("lab", F.concat(F.lit(" L"), "child"))
    cols = ["doc", "child", "path", "labels", "depth", "top", "cyclic", "leads_to_cycle"]
    in_tasks = hierarchy.resolve(df, ["doc"], "child", "parent", "lab", 0)
    joined = hierarchy.resolve(df, ["doc"], "child", "parent", "lab", 0, in_task=10)
    assert sorted(map(repr, rows_of(in_tasks, cols))) == sorted(map(repr, rows_of(joined, cols)))
    assert rows(hierarchy.cycles(df, ["doc"], "child", "parent", 0), "doc", "child") == rows(hierarchy.cycles(df, ["doc"], "child", "parent", 0, in_task=10), "doc", "child")
    one = hierarchy.resolve(df.filter("doc = 8"), [], "child", "parent", "lab", 0)
    assert max(len(r.path) for r in one.collect()) == 69


def rows_of(df, cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
