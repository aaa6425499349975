import random

import pyarrow as pa
from pyspark.sql import Row

from factloom.operators import algebra, graph, kb

E = "struct<word:string,word_index:array<int>,prep:string,reference:string,ne_type:string,entity:array<struct<uri:string,final_score:double>>>"
SCHEMA = f"doc_id bigint, sent_id int, tuple_id bigint, run string, clause_type string, negation boolean, subject {E}, predicate {E}, direct_object {E}, indirect_object {E}, adverbial array<{E}>, k string, e int"


def el(word, index=(), prep=None, reference=None, entity=None):
    return (word, list(index), prep, reference, None, entity)


def tup(i, s, p, o=None, io=None, adv=None, doc=1, sent=0, run="raw"):
    return (doc, sent, i, run, "SVO", None, s, p, o, io, adv, "clash", 0)


def make(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_triples_and_elements(spark):
    t = make(
        spark,
        tup(1, el("Tom 's cat"), el("sat"), None, None, [el("mat", prep="on"), None, el(None)]),
        tup(2, el("Tom"), el("gave"), el("book"), el("Ann")),
        tup(3, el("Tom"), el("told"), None, el("Ann")),
        tup(4, None, el("is"), None, None, None),
    )
    got = sorted((r.tuple_id, r.ord, r.s, r.o, r.label) for r in algebra.triples(t).collect())
    assert got == [(1, 0, "Tom 's cat", "mat", "on"), (2, 0, "Tom", "book", "dobj"), (2, 1, "Tom", "Ann", "iobj"), (3, 0, "Tom", "Ann", "iobj"), (3, 1, "Tom", None, None), (4, 0, None, None, None)]
    assert algebra.elements(t).count() == 3 + 4 + 3 + 1
    assert algebra.triple_key(algebra.triples(t)).filter("tuple_id = 1").first()["ks"] == "tom's cat"
    assert algebra.triples(t.limit(0)).count() == 0


def test_equality_and_references(spark):
    a = make(spark, tup(1, el("Tom"), el("saw"), el("Ann"), None, [el("noon", prep="at")]), tup(2, el("he", reference="Tom"), el("left")), tup(3, el("x"), el(None)))
    b = make(spark, tup(11, el("tom"), el("SAW"), el("ann"), None, [el("Noon", prep="AT")]), tup(12, el("Tom"), el("left")), tup(13, el("Tom"), el("saw"), el("Ann")))
    assert [(r.left_id, r.right_id) for r in algebra.equal_pairs(a, b).collect()] == [(1, 11)]
    assert sorted((r.left_id, r.right_id) for r in algebra.compared(a, b).collect()) == [(1, 11), (2, 12)]
    assert sorted((r.left_id, r.right_id) for r in algebra.compared(a, b, strict=False).collect()) == [(1, 11), (1, 13), (2, 12)]


def test_merge_keeps_copies_of_the_first_run_only(spark):
    one = lambda i, w: tup(i, el(w), el("is"))
    a, b = make(spark, one(1, "a"), one(2, "A"), one(3, "b")), make(spark, one(11, "a"), one(12, "c"), one(13, "c"))
    got = sorted((r.first_id, r.n_merged) for r in algebra.merge_runs(a, b).collect())
    assert got == [(1, 2), (2, 1), (3, 1), (12, 2)]
    again = sorted((r.first_id, r.n_merged) for r in algebra.merge_runs(a, a.limit(0)).collect())
    assert again == [(1, 1), (2, 1), (3, 1)]


def test_evaluation(spark):
    t = make(spark, *[tup(i, el(f"s{i}"), el("p"), el("o")) for i in range(4)])
    own = algebra.evaluate(t, t).first()
    assert (own.recall, own.precision, own.f1) == (1.0, 1.0, 1.0)
    found = make(spark, *[tup(i, el(f"S{i}"), el("p"), el("O")) for i in (0, 1, 2, 8, 9)])
    r = algebra.evaluate(t, found).first()
    assert (r.correct, r.gold, r.extracted, r.recall, r.precision, r.f1) == (3, 4, 5, 0.75, 0.6, 0.666667)
    none = algebra.evaluate(t.limit(0), t.limit(0)).first()
    assert none.recall is None and none.f1 is None


def test_collision_of_the_readme_case(spark):
    s, p = el("Jordan 's individual accolades", range(4)), el("include", [4])
    t = make(spark, tup(1, s, p, el("fourteen NBA All", [5, 6, 7])), tup(2, s, p, el("fourteen NBA All - Star Game selections", range(5, 12))), tup(3, el("be", [-1]), el("x", [-1])))
    assert [(r.left_id, r.left_role, r.right_id) for r in algebra.overlaps(t).collect()] == [(1, "direct_object", 2)]
    pairs = graph.collisions(t)
    kept = graph.independent_set(pairs, spark.createDataFrame([(1, "fourteen NBA All", 0.1)], "doc_id bigint, id string, weight double")).collect()
    assert [r.id for r in kept] == ["fourteen NBA All"]
    assert graph.join_optimize(t, spark.createDataFrame([], "head string, rel string, tail string")).count() >= 1


def test_overlaps_of_a_hot_sentence_are_made_by_blocks_and_not_shuffled(spark):
    rng, rows = random.Random(5), []
    word = lambda: el(rng.choice(["a", "A", "b", "c d"]), rng.choices([-1, 0, 1, 2, 3, 70, 150, None], k=rng.randrange(5)), rng.choice([None, "in", "IN", "at"])) if rng.random() < 0.9 else rng.choice([None, el(None, [1])])
    for doc, sent, n in ((1, 0, 40), (1, 1, 3), (2, 0, 25), (None, 0, 4), (3, None, 4), (4, 7, 1)):
        rows += [tup(len(rows) + i, word(), word(), word(), word(), rng.choice([None, [word() for _ in range(3)]]), doc=doc, sent=sent) for i in range(n)]
    rows += [tup(r[2], word(), *r[7:11], doc=r[0], sent=r[1]) for r in rows[:9]] + [tup(None, el("x", [0]), el("y", [1]), doc=1, sent=0)]  # ids that recur, and none
    for inserted in (False, True):
        e = [(r.doc_id, r.sent_id, r.tuple_id, r.role, r.ord, r.word.lower(), r.prep and r.prep.lower(), {i for i in r.word_index if i is not None and (inserted or i >= 0)}) for r in algebra.elements(make(spark, *rows)).collect() if None not in (r.doc_id, r.sent_id, r.tuple_id)]
        expected = {(*a[:5], *b[2:5]) for a in e for b in e if a[:2] == b[:2] and a[2] < b[2] and a[7] & b[7] and (a[5] != b[5] or None not in (a[6], b[6]) and a[6] != b[6])}
        assert len(expected) > 2000
        for size in (200, 7):
            got = algebra.overlaps(make(spark, *rows), not inserted, size)
            assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    above, below = algebra.overlaps(make(spark, *rows))._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert "Exchange" not in above and "Exchange" in below
    assert algebra.overlaps(make(spark, *rows[:1]).limit(0)).count() == 0
    t = pa.table({"doc_id": [1] * 60, "sent_id": [0] * 60, "lo": [0] * 60, "hi": [1] * 60, "side": pa.array([i % 2 for i in range(60)], pa.int8()), "tuple_id": list(range(60)), "es": pa.array([[{"role": 0, "ord": 0, "w": str(i), "p": None, "ix": [0, 1]}] for i in range(60)], pa.list_(pa.struct([("role", pa.int8()), ("ord", pa.int32()), ("w", pa.string()), ("p", pa.string()), ("ix", pa.list_(pa.int32()))])))})
    parts = [b.num_rows for b in algebra._overlapping_pairs(t, most=100)]
    assert sum(parts) == 900 and len(parts) > 10  # held a part at a time
    whole = sum(b.num_rows for b in algebra._overlap_chunks(iter(t.to_batches(max_chunksize=7)), rows=10))
    assert whole == 900


def test_independent_set_is_the_greedy_one(spark):
    rng = random.Random(7)
    edges = [(d, f"n{a}", f"n{b}") for d in (1, 2) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.15]
    weight = {(d, f"n{i}"): round(rng.random(), 1) for d in (1, 2) for i in range(25)}
    ids = {(d, x) for d, *e in edges for x in e}
    taken, blocked = set(), set()
    for d, i in sorted(ids, key=lambda x: (-weight[x], x[1])):
        if (d, i) not in blocked:
            taken.add((d, i))
            blocked |= {(d, b if a == i else a) for dd, a, b in edges if dd == d and i in (a, b)}
    got = graph.independent_set(spark.createDataFrame(edges, "doc_id bigint, a string, b string"), spark.createDataFrame([(*k, w) for k, w in weight.items()], "doc_id bigint, id string, weight double"))
    assert {(r.doc_id, r.id) for r in got.collect()} == taken


def test_walk_numbers(spark):
    w = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "a", 1.0)], "doc_id bigint, i string, j string, w double")
    v = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0)], "doc_id bigint, i string, r double")
    got = {r.i: round(r.r, 5) for r in graph.settle(w, v, 0.5).collect()}
    assert got == {"a": 0.66667, "b": 0.33333}


def test_graph_pieces(spark):
    ent = [("Tom_A", 0.9), ("Tom_B", 0.4), (None, 1.0)]
    t = make(spark, tup(1, el("Tom", [0], entity=ent), el("saw", [1]), el("the cat", [2]), None, [el("roof", [4], prep="on"), el("today", [5])]), tup(2, el("he", [7], reference="Tom"), el("left", [8]), sent=1))
    assert sorted((r.src, r.dst, r.relation) for r in graph.merged_edges(t).collect()) == [("1:0:1", "Tom", "subj"), ("1:0:1", "roof", "on"), ("1:0:1", "the cat", "dobj"), ("1:1:2", "he", "subj")]
    assert sorted(r.node_id for r in graph.nodes(t).filter("type = 'Entity'").collect()) == ["Entity:Tom_A", "Entity:Tom_B"]
    assert [(r.src, r.dst) for r in graph.reference_edges(t).collect()] == [("he", "Tom")]
    sem = graph.semantic_edges(t)
    assert sorted((r.src, r.dst, r.relation) for r in sem.collect()) == [("1:0:1#0", "Tom:0-0", "subj"), ("1:0:1#0", "the cat:0-2", "dobj"), ("1:0:1#1", "Tom:0-0", "subj"), ("1:0:1#1", "on roof:0-4", "on"), ("1:0:1#2", "Tom:0-0", "subj"), ("1:1:2#0", "he:1-7", "subj")]
    assert graph.merge_triples(sem).count() == 4
    scores, best = graph.propagate(t, spark.createDataFrame([("Tom_B", "r", "X")], "head string, rel string, tail string"))
    assert [(r.noun, r.uri) for r in best.collect()] == [("Tom", "Tom_A")] and scores.count() == 6
    assert [r.dst for r in graph.prune_entities(graph.means_edges(t), best).collect()] == ["Entity:Tom_A"]
    assert graph.prune_entities(graph.means_edges(t), best.limit(0)).count() == 2
    back = graph.collect_tuples(graph.merged_edges(t)).filter("predicate_id = '1:0:1'").first()
    assert (back.subject, back.direct_object, back.adverbial) == ("Tom", "the cat", ["on roof"])
    mentions = spark.createDataFrame([(1, 1, "cat", None, "ANIMAL"), (2, 1, "", "Tom", "PERSON"), (3, 1, None, None, "X")], "mention_id bigint, doc_id bigint, surface_form string, word string, ne_type string")
    things = spark.createDataFrame([("The_Cat", "the cat"), ("Cat", "cat"), ("N", None)], "uri string, label string")
    linked = {r.word: (r.ne_type, r.uri) for r in graph.link(t, mentions, things).collect()}
    assert linked["the cat"] == ("ANIMAL", "The_Cat") and linked["Tom"] == ("PERSON", None) and "he" not in linked


def test_kb(spark):
    k = spark.createDataFrame([("a", "r", "b"), ("c", "r", "b"), ("a", "r", "d"), ("a", "r", "b"), ("b", "q", "e"), (None, "r", "b"), ("x", None, "b")], "head string, rel string, tail string")
    things = spark.createDataFrame([("b",), ("b",), (None,), ("c",)], "uri string")
    rel = {(r.u1, r.u2): r.score for r in kb.relatedness(k).collect()}
    assert rel[("a", "b")] == 0.5
    assert sorted((r.uri, r.neighbour) for r in kb.neighbours(k, things).collect()) == [("a", "b"), ("b", "c"), ("c", "b"), ("e", "b")]
    assert {(r.u1, r.u2): r.n_paths for r in kb.path_counts(k).collect()} == {("a", "e"): 1, ("c", "e"): 1}
    assert kb.relatedness(k.limit(0)).count() == 0
    assert [r.rels for r in kb.relations(k).filter("head = 'a' AND tail = 'b'").collect()] == [["r"]]
    assert kb.page_urls(things).collect() and Row
