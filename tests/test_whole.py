"""Queries that once did less than their whole job, compared with exact results."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import graph, kb
from factloom.plans import catalog, facts, parses

from .conftest import DATA


def exact(w, v, gamma):
    """(doc, node) to score: the fixed point of each document's walk, by solving its equations."""
    matrix, starts, out = defaultdict(list), {(r.doc_id, r.i): r.r for r in v.collect()}, {}
    for r in w.collect():
        matrix[r.doc_id].append((r.i, r.j, r.w))
    for d, entries in matrix.items():
        ids = sorted({x for i, j, _ in entries for x in (i, j)})
        at = {x: k for k, x in enumerate(ids)}
        m = np.eye(len(ids))
        for i, j, x in entries:
            m[at[i], at[j]] -= (1 - gamma) * x
        out |= dict(zip([(d, x) for x in ids], np.linalg.solve(m, [gamma * starts.get((d, x), 0.0) for x in ids]).tolist()))
    return out


def test_scores_of_tuples_are_those_of_the_settled_walk(spark):
    edges = graph.merged_edges(facts.tuples(spark, DATA))
    w = graph.level1(edges)
    scores, by = exact(w, graph.start(w), 0.3), defaultdict(list)
    for r in edges.collect():
        by[r.doc_id, r.src].append(scores[r.doc_id, r.dst])
    got = {(r.doc_id, r.src): r.score for r in catalog.queries()["score_tuples"](spark, DATA).collect()}
    assert got.keys() == by.keys() and all(abs(got[k] - np.mean(x)) < 6e-7 for k, x in by.items())


def test_settled_walk_of_a_star_and_of_nothing(spark):
    w = spark.createDataFrame([(1, "hub", f"n{i}", 1.0) for i in range(9)] + [(1, f"n{i}", "hub", 1 / 9) for i in range(9)], "doc_id bigint, i string, j string, w double")
    v = spark.createDataFrame([(1, "n0", 1.0)], "doc_id bigint, i string, r double")
    want = exact(w, v, 0.1)
    for in_task in (500_000, 0):
        got = {(r.doc_id, r.i): r.r for r in graph.settle(w, v, 0.1, in_task=in_task).collect()}
        assert got.keys() == want.keys() and sum(abs(got[k] - want[k]) for k in want) < 1e-10
    assert graph.settle(w.limit(0), v.limit(0), 0.1).count() == 0


def test_propagation_is_that_of_settled_walks(spark):
    """All of propagation in plain Python from its matrices on, with the gammas of joint_optimize."""
    t, k = facts.tuples(spark, DATA), facts.table(spark, DATA, "kb")
    w1, cand = graph.level1(graph.merged_edges(t)), graph.candidates(t)
    w2 = graph.level2(cand, kb.relatedness(k))
    r1, pairs = exact(w1, graph.start(w1), 0.1), [(r.doc_id, r.noun, r.uri, r.final_score) for r in cand.collect()]
    seed = {(d, n): r1[d, n] for d, n, _, _ in pairs if (d, n) in r1}
    total = defaultdict(float)
    for (d, _), x in seed.items():
        total[d] += x
    schema = "doc_id bigint, i string, r double"
    r2 = exact(w2, spark.createDataFrame([(d, f"N:{n}", x / total[d]) for (d, n), x in seed.items()], schema), 0.2)
    best = defaultdict(float)
    for d, n, u, f in pairs:
        best[d, n] = max(best[d, n], r2.get((d, f"E:{u}"), 0.0) * f)
    want = exact(w1, spark.createDataFrame([(d, i, x * best.get((d, i), 1.0)) for (d, i), x in r1.items()], schema), 0.1)
    got = {(r.doc_id, r.i): r.r for r in graph.propagate(t, k, 0.1, 0.2)[0].collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-9


E = "struct<word:string,word_index:array<int>,prep:string,reference:string,ne_type:string,entity:array<struct<uri:string,final_score:double>>>"


def test_pruning_and_independent_set_take_what_propagation_gives(spark, tmp_path):
    el = lambda w, i, entity=None: (w, [i], None, None, None, entity)
    saw = lambda i, s, o: (1, 0, i, 0, s, el("saw", 20), o, None)
    # Tom_A has the greater score of its own, but only Tom_B is related to what Ann and Bob mean
    tom = el("Tom", 0, [("Tom_A", 0.51), ("Tom_B", 0.5)])
    rows = [saw(1, tom, el("Ann", 2, [("Ann_X", 0.9)])), saw(2, tom, el("Bob", 4, [("Bob_X", 0.9)])), saw(3, el("Eve", 6), el("the hat", 2))]
    schema = f"doc_id bigint, sent_id int, tuple_id bigint, loaded_at int, subject {E}, predicate {E}, direct_object {E}, indirect_object {E}, adverbial array<{E}>, run string, clause_type string, negation boolean"
    spark.createDataFrame([(*r, [], "raw", "SVO", None) for r in rows], schema).write.parquet(str(tmp_path / "tuples.parquet"))
    spark.createDataFrame([("Tom_B", "knows", "Ann_X"), ("Tom_B", "met", "Bob_X")], "head string, rel string, tail string").write.parquet(str(tmp_path / "kb.parquet"))
    q = catalog.queries()
    pruned = {(r.src, r.dst) for r in q["pruned_entities"](spark, str(tmp_path)).collect()}
    assert pruned == {("Tom", "Entity:Tom_B"), ("Ann", "Entity:Ann_X"), ("Bob", "Entity:Bob_X")}
    t, k = facts.tuples(spark, str(tmp_path)), facts.table(spark, str(tmp_path), "kb")
    means = {(r.src, r.dst) for r in graph.resolve(t, k).filter("relation = 'means'").collect()}
    assert ("Tom", "Entity:Tom_B") in means and ("Tom", "Entity:Tom_A") not in means
    weight = {r.i: r.r for r in graph.propagate(t, k)[0].collect()}
    pairs = [(r.a, r.b) for r in graph.collisions(t).collect()]
    assert pairs == [("Ann", "the hat")]
    assert {r.id for r in q["greedy_independent_set"](spark, str(tmp_path)).collect()} == {max(pairs[0], key=weight.get)} == {"the hat"}


def _written(t):
    """What whole tuples should be read back as."""
    has = lambda e: e is not None and e.word is not None
    out = []
    for r in t.collect():
        roles = [r.subject, r.predicate, r.direct_object, r.indirect_object]
        advs = [(a.prep, a.word, list(a.word_index or [])) for a in r.adverbial or [] if has(a)]
        out.append((r.doc_id, f"sentence {'unknown' if r.sent_id is None else r.sent_id}", [e.word if has(e) else None for e in roles], bool(r.negation), [e.reference if has(e) else None for e in (roles[0], *roles[2:])], [list(e.word_index or []) if has(e) else None for e in roles], advs))
    return sorted(map(repr, out))


def _read(df):
    roles = ["subject", "predicate", "direct_object", "indirect_object"]
    return sorted(repr((r.doc_id, r.sentence, [r[x] for x in roles], r.negation, [r[f"{x}_reference"] for x in (roles[0], *roles[2:])], [r[f"{x}_index"] for x in roles], [(a.prep, a.word, a.word_index) for a in r.adverbial])) for r in df.collect())


def test_whole_tuples_are_read_back_from_text(spark, tmp_path):
    q = parses.read_back
    assert _read(q(spark, DATA)) == _written(facts.tuples(spark, DATA))
    el = lambda w, index=(), prep=None, reference=None: (w, list(index), prep, reference, None, None)
    rows = [
        (1, None, 1, 0, el("?a; b|c (d)", [1, 2, 3], None, "x (y); \\s|z"), el(" was  \\b", [4, 5]), el("!#"), el("======", [6]), [el("noon", [8], "at"), el("last night", [9, 10]), el("the rain", [13, 14], "because of"), el("soon"), None, el(None)], "raw", "SVO", True),
        (1, 0, 2, 0, None, el("tab\there\nnow"), None, None, [el("", [1], ""), el("x y", [1, 2, 3], "in"), el(" z ", (), " ")], "raw", "SVO", None),
    ]
    schema = f"doc_id bigint, sent_id int, tuple_id bigint, loaded_at int, subject {E}, predicate {E}, direct_object {E}, indirect_object {E}, adverbial array<{E}>, run string, clause_type string, negation boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "tuples.parquet"))
    got, want = _read(q(spark, str(tmp_path))), _written(facts.tuples(spark, str(tmp_path)))
    assert got == want


def test_independent_sets_by_task_and_by_joins(spark):
    rng = random.Random(3)
    pairs = [(d, f"n{a}", f"n{b}") for d in range(4) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.12] + [(9, "x", "x")]
    weights = [(d, f"n{i}", rng.choice([0.1, 0.2, 0.2, 0.5, None])) for d in range(4) for i in range(25)]
    p = spark.createDataFrame(pairs, "doc_id bigint, a string, b string")
    w = spark.createDataFrame(weights, "doc_id bigint, id string, weight double")
    by = {(d, i): x or 0.0 for d, i, x in weights}
    want = set()
    for d in range(4):
        ids = {x for e in pairs if e[0] == d for x in e[1:]}
        for i in sorted(ids, key=lambda i: (-by[d, i], i)):
            if not any((d, o) in want for e in pairs if e[0] == d and i in e[1:] for o in e[1:] if o != i):
                want.add((d, i))
    sets = {}
    for trials in (0, 3):
        for in_task in (10**6, 0):
            sets[trials, in_task] = {(r.doc_id, r.id) for r in graph.independent_set(p, w, trials, in_task=in_task).collect()}
        assert sets[trials, 0] == sets[trials, 10**6]
    assert sets[0, 0] == want
    for d in range(4):
        total = lambda s: sum(by[x] for x in s if x[0] == d)
        assert total(sets[3, 0]) >= total(want) - 1e-9
    assert not any((d, a) in sets[3, 0] and (d, b) in sets[3, 0] for d, a, b in pairs)


def test_collisions_resolved_by_places_are_those_of_pairs(spark):
    rng = random.Random(12)

    def el():
        word = rng.choice(["map", "Map", "old map", "hall", None])
        return None if rng.random() < 0.1 else (word, rng.choice([None, [rng.randint(-1, 4) for _ in range(rng.randint(0, 3))]]), rng.choice([None, None, "in", "In", "at"]), None, None, None)

    rows = [(rng.randint(1, 3), rng.choice([None, 0, 1, 1]), i, "raw", "SVO", None, el(), el(), el(), None, rng.choice([None, [el(), el()], []])) for i in range(90)]
    schema = f"doc_id bigint, sent_id int, tuple_id bigint, run string, clause_type string, negation boolean, subject {E}, predicate {E}, direct_object {E}, indirect_object {E}, adverbial array<{E}>"
    t = spark.createDataFrame(rows, schema)
    ids = graph.nodes(t).filter("type <> 'Entity'").select("doc_id", F.col("node_id").alias("id"), (F.pmod(F.xxhash64("node_id"), F.lit(5)) / 10).alias("weight"))
    pairs = {(r.doc_id, x) for r in graph.collisions(t).collect() for x in (r.a, r.b)}
    for trials in (0, 2):
        by_places, by_pairs = ({(r.doc_id, r.id): r.taken for r in graph.resolved_collisions(t, ids, trials, in_task=n).collect()} for n in (10**6, 0))
        assert by_places == by_pairs and by_places.keys() == pairs and any(by_places.values()) and not all(by_places.values())
    assert graph.resolved_collisions(t.limit(0), ids).count() == 0
