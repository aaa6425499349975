"""Predicate-centric fact graphs of documents: nodes, edges, collisions, random walks, resolution.

Graphs are tables keyed by ``doc_id``: nodes(doc_id, node_id, name, type) and edges(doc_id, src, dst, relation). No
document's graph above a fixed size is ever held in one task: its walks are joins of sparse matrices. Independent sets
are rounds of joins.

Node ids: a predicate is '<doc>:<sentence>:<tuple>' (with '#<ordinal>' of its triple in a semantic graph), an entity
'Entity:<uri>', a noun its word (merged) or '<prep word>:<sentence>-<first index>' (semantic). Several relations between
two nodes are kept as several edges. Null words give no node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import algebra, kb
from factloom.runtime import cut, small

PRONOUNS = {"PERSON": ["he", "him", "his", "she", "her"], "OTHER": ["it", "its"]}


def pronoun_type(word: Column) -> Column:
    """PERSON or OTHER for pronouns, else null."""
    w = F.lower(word)
    return F.when(w.isin(PRONOUNS["PERSON"]), "PERSON").when(w.isin(PRONOUNS["OTHER"]), "OTHER")


def predicate_id() -> Column:
    return F.concat_ws(":", "doc_id", "sent_id", "tuple_id")


def noun_id() -> Column:
    """Sentence-scoped id of a noun element."""
    word = F.concat_ws(" ", F.when(F.col("prep") != "", F.col("prep")), "word")
    return F.concat(word, F.lit(":"), F.col("sent_id"), F.lit("-"), F.coalesce(F.array_min("word_index"), F.lit(-1)))


def merged_edges(t: DataFrame) -> DataFrame:
    """Edges of the graph in which equal words share a noun node; adverbials without preposition have no edge."""
    name = {"subject": "subj", "direct_object": "dobj", "indirect_object": "iobj"}
    relation = F.coalesce(*[F.when(F.col("role") == r, n) for r, n in name.items()], F.when(F.col("role") == "adverbial", F.col("prep")))
    e = algebra.elements(t.filter("predicate.word IS NOT NULL")).filter("role <> 'predicate'")
    return e.select("doc_id", predicate_id().alias("src"), F.col("word").alias("dst"), relation.alias("relation")).filter("relation IS NOT NULL").distinct()


def nodes(t: DataFrame) -> DataFrame:
    """Predicate, noun and entity nodes of the merged graph."""
    e = algebra.elements(t)
    pred = e.filter("role = 'predicate'").select("doc_id", predicate_id().alias("node_id"), F.col("word").alias("name"), F.lit("Predicate").alias("type"))
    used = e.filter("role <> 'predicate' AND (role <> 'adverbial' OR prep IS NOT NULL)")
    noun = used.select("doc_id", F.col("word").alias("node_id"), F.col("word").alias("name"), F.lit("Noun").alias("type"))
    ent = used.select("doc_id", F.explode("entity").alias("x")).filter("x.uri IS NOT NULL").select("doc_id", F.concat(F.lit("Entity:"), "x.uri").alias("node_id"), F.col("x.uri").alias("name"), F.lit("Entity").alias("type"))
    return pred.unionByName(noun).unionByName(ent).distinct()


def means_edges(t: DataFrame) -> DataFrame:
    """Edges from nouns to the entities they may mean."""
    used = algebra.elements(t).filter("role <> 'predicate' AND (role <> 'adverbial' OR prep IS NOT NULL)")
    rows = used.select("doc_id", F.col("word").alias("src"), F.explode("entity").alias("x")).filter("x.uri IS NOT NULL")
    return rows.select("doc_id", "src", F.concat(F.lit("Entity:"), "x.uri").alias("dst"), F.lit("means").alias("relation")).distinct()


def reference_edges(t: DataFrame) -> DataFrame:
    """``same_as`` edges from nouns to the noun their reference names, where the document has that noun."""
    used = algebra.elements(t).filter("role <> 'predicate'").select("doc_id", "word", "reference")
    a = used.filter("reference IS NOT NULL AND reference <> '' AND reference <> word").select("doc_id", F.col("word").alias("src"), F.col("reference").alias("dst")).distinct()
    there = used.select("doc_id", F.col("word").alias("dst")).distinct()
    return a.join(there, ["doc_id", "dst"], "left_semi").select("doc_id", "src", "dst", F.lit("same_as").alias("relation"))


def semantic_edges(t: DataFrame) -> DataFrame:
    """Edges of the semantic graph: one predicate node for each triple, nouns by sentence and first index."""
    e = algebra.elements(t.filter("subject.word IS NOT NULL AND predicate.word IS NOT NULL"))
    named = e.filter("role <> 'predicate'").withColumn("id", noun_id())
    per = named.groupBy("doc_id", "sent_id", "tuple_id").agg(
        F.max(F.when(F.col("role") == "subject", F.col("id"))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("role") != "subject", F.struct(F.when(F.col("role") == "direct_object", 0).when(F.col("role") == "indirect_object", 1).otherwise(2).alias("k"), "ord", "id", F.when(F.col("role") == "direct_object", "dobj").when(F.col("role") == "indirect_object", "iobj").otherwise(F.col("prep")).alias("label"))))).alias("os"),
    )
    lone = ~F.exists("os", lambda x: x["k"].isin(0, 2))
    parts = F.transform("os", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label")))
    bare = F.when(lone, F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label")))).otherwise(F.array().cast("array<struct<id:string,label:string>>"))
    rows = per.select("doc_id", "s", predicate_id().alias("p"), F.posexplode(F.concat(parts, bare)).alias("i", "x")).withColumn("src", F.concat("p", F.lit("#"), "i"))
    subj = rows.select("doc_id", "src", F.col("s").alias("dst"), F.lit("subj").alias("relation"))
    obj = rows.filter("x.label IS NOT NULL").select("doc_id", "src", F.col("x.id").alias("dst"), F.col("x.label").alias("relation"))
    return subj.unionByName(obj).distinct()


def merge_triples(edges: DataFrame) -> DataFrame:
    """Fold the predicate nodes of one tuple's triples into one."""
    return edges.select("doc_id", F.substring_index("src", "#", 1).alias("src"), "dst", "relation").distinct()


def collisions(t: DataFrame) -> DataFrame:
    """Undirected collision edges between nouns or predicates of the merged graph, as ``a`` < ``b``."""
    named = algebra.elements(t).withColumn("id", F.when(F.col("role") == "predicate", predicate_id()).otherwise(F.col("word")))
    pairs = algebra.overlapping(named, ["id"]).select("doc_id", F.col("a.id").alias("x"), F.col("b.id").alias("y")).filter("x <> y")
    return pairs.select("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link(t: DataFrame, mentions: DataFrame, things: DataFrame, compat: bool = False) -> DataFrame:
    """``word``, ``ne_type``, ``uri`` of each element but pronouns: by exact lookup, else without a leading 'the'
    (``compat``: without the first three letters of any word that begins so). Type and uri are looked up on their own."""
    e = algebra.elements(t).filter("role <> 'predicate'").filter(pronoun_type(F.col("word")).isNull())
    short = F.when(F.col("word").rlike("^[tT]he"), F.trim(F.substr("word", F.lit(4)))) if compat else F.when(F.col("word").rlike(r"^[tT]he\s"), F.trim(F.regexp_replace("word", r"^[tT]he\s+", "")))
    e = e.select("doc_id", "sent_id", "tuple_id", "role", "ord", "word", short.alias("short"))
    m = mentions.select("doc_id", F.coalesce(F.when(F.col("surface_form") != "", F.col("surface_form")), F.col("word")).alias("w"), "mention_id", "ne_type").filter("w IS NOT NULL AND ne_type IS NOT NULL")
    ne = m.groupBy("doc_id", "w").agg(F.min_by("ne_type", F.struct("mention_id", "ne_type")).alias("t"))
    uri = things.filter("label IS NOT NULL").groupBy(F.col("label").alias("w")).agg(F.min("uri").alias("u"))
    out = e.join(ne.select("doc_id", F.col("w").alias("word"), F.col("t").alias("t1")), ["doc_id", "word"], "left").join(ne.select("doc_id", F.col("w").alias("short"), F.col("t").alias("t2")), ["doc_id", "short"], "left")
    out = out.join(uri.select(F.col("w").alias("word"), F.col("u").alias("u1")), "word", "left").join(uri.select(F.col("w").alias("short"), F.col("u").alias("u2")), "short", "left")
    return out.select("doc_id", "sent_id", "tuple_id", "role", "ord", "word", F.coalesce("t1", "t2").alias("ne_type"), F.coalesce("u1", "u2").alias("uri"))


def annotated_edges(t: DataFrame, linked: DataFrame) -> DataFrame:
    """The graph of tuples whose elements have been linked (``link``): its edges, and from each of its nouns a ``means``
    edge to each entity that its elements were linked to."""
    edges = merged_edges(t)
    nouns = edges.select("doc_id", F.col("dst").alias("src")).distinct()
    means = linked.filter("uri IS NOT NULL").select("doc_id", F.col("word").alias("src"), F.concat(F.lit("Entity:"), "uri").alias("dst"), F.lit("means").alias("relation")).distinct()
    return edges.unionByName(means.join(nouns, ["doc_id", "src"], "left_semi").select("doc_id", "src", "dst", "relation"))


def level1(edges: DataFrame) -> DataFrame:
    """Sparse column-normalized adjacency of predicates and nouns: ``doc_id``, ``i``, ``j``, ``w``."""
    both = edges.select("doc_id", F.col("src").alias("i"), F.col("dst").alias("j")).unionByName(edges.select("doc_id", F.col("dst").alias("i"), F.col("src").alias("j"))).distinct()
    return normalized(both.withColumn("w", F.lit(1.0)))


def normalized(w: DataFrame) -> DataFrame:
    """Columns divided by their sums. A join, not a window: a hot column is no single group of rows."""
    sums = w.groupBy("doc_id", "j").agg(F.sum("w").alias("_s"))
    return w.join(sums, ["doc_id", "j"]).filter("_s > 0").select("doc_id", "i", "j", (F.col("w") / F.col("_s")).alias("w"))


def settle(w: DataFrame, v: DataFrame, gamma: float, tolerance: float = 1e-10, most: int = 1000, in_task: int = 500_000) -> DataFrame:
    """Where the random walk with restart ends, r = (1 - gamma) W r + gamma v: ``doc_id``, ``i``, ``r``.

    Second-order Richardson steps: on bipartite graphs the plain walk's error only shrinks by 1 - gamma a step. They need
    real eigenvalues in [-1, 1], as column-normalized symmetric matrices have and ``level2``'s block of candidates.
    Ends once each document's scores are proven to be within ``tolerance`` of the exact ones in sum: with residual d,
    the result's error is at most (1 - gamma) |d| / gamma. Fails rather than giving scores that are not.

    Documents of up to ``in_task`` entries are walked many at a time within a task; a larger one, by joins. ``w`` is read
    twice and should be held.
    """
    v = v.select("doc_id", "i", "r")
    parts = int(w.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = w.groupBy("doc_id").count().filter(F.col("count") > in_task).select("doc_id")
    some = large.limit(1).count() > 0
    if some:
        large, v = small(cut(large)), cut(v)
    rest = lambda x: x.join(large, "doc_id", "left_anti") if some else x
    rows = rest(w.select("doc_id", "i", "j", "w")).unionByName(rest(v.select("doc_id", "i", F.lit(None).cast("string").alias("j"), F.col("r").alias("w"))))
    kind = v.schema["doc_id"].dataType.simpleString()
    settled = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(lambda batches: _settled_chunks(batches, gamma, tolerance, most), f"doc_id {kind}, i string, r double")
    if some:
        settled = settled.unionByName(_settle_joined(w.join(large, "doc_id", "left_semi"), v.join(large, "doc_id", "left_semi"), gamma, tolerance, most))
    return cut(settled)


def _settled_chunks(batches: Iterator[pa.RecordBatch], gamma: float, tolerance: float, most: int, rows: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Whole documents, about ``rows`` rows at a time."""
    for t in _whole_documents(batches, rows):
        yield _settled(t, gamma, tolerance, most)


def _whole_documents(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= rows:
            t = pa.concat_tables(held)
            whole = pc.index(t["doc_id"], t["doc_id"][-1]).as_py()
            if whole:
                yield t.slice(0, whole)
            held = [t.slice(whole)]
    if held and sum(t.num_rows for t in held):
        yield pa.concat_tables(held)


def _settled(t: pa.Table, gamma: float, tolerance: float, most: int) -> pa.RecordBatch:
    """Rows (doc_id, i, j, w) of matrices and, with null j, of restart weights."""
    docs = t["doc_id"].combine_chunks().dictionary_encode()
    names = pa.chunked_array([*t["i"].chunks, *t["j"].chunks], pa.string()).combine_chunks().dictionary_encode()
    width, x = len(names.dictionary), t["w"].to_numpy()
    code = pc.fill_null(names.indices, -1).to_numpy().astype(np.int64)
    i, j, doc = code[: len(t)], code[len(t) :], docs.indices.to_numpy().astype(np.int64)
    entry = j >= 0
    ids, at = np.unique(np.concatenate([doc * width + i, (doc * width + j)[entry]]), return_inverse=True)
    to, by, of = at[: len(t)][entry], at[len(t) :], ids // width
    c = 1 - gamma
    omega = 2 / (1 + (1 - c * c) ** 0.5)
    v = gamma * np.bincount(at[: len(t)][~entry], x[~entry], len(ids))
    now = last = v / gamma
    for _ in range(most):
        r = v + c * np.bincount(to, x[entry] * now[by], len(ids))
        if np.bincount(of, np.abs(r - now)).max() * c / gamma <= tolerance:
            return pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(of)), names.dictionary.take(pa.array(ids % width)), pa.array(r)], ["doc_id", "i", "r"])
        now, last = (r - last) * omega + last, now
    raise RuntimeError(f"the walk has not settled after {most} steps")


def _settle_joined(w: DataFrame, v: DataFrame, gamma: float, tolerance: float, most: int, every: int = 5) -> DataFrame:
    """``settle`` of documents that are too large for a task: each step a join."""
    c = 1 - gamma
    omega = 2 / (1 + (1 - c * c) ** 0.5)
    parts = int(w.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = w.select("doc_id", "i").unionByName(w.select("doc_id", F.col("j").alias("i"))).unionByName(v.select("doc_id", "i")).distinct()
    # each node has a row to itself beside the matrix: a step carries its values on in the same join
    own = ids.select("doc_id", "i", F.col("i").alias("j"), F.lit(0.0).alias("w"), F.lit(True).alias("own"))
    w = w.select("doc_id", "i", "j", "w", F.lit(False).alias("own")).unionByName(own).repartition(parts, "doc_id", "j").sortWithinPartitions("doc_id", "j").persist()
    state = v.select("doc_id", "i", F.col("r").alias("v"), F.col("r").alias("now"), F.col("r").alias("last"))
    kept = lambda x: F.coalesce(F.sum(F.when(F.col("own"), F.col(x))), F.lit(0.0))
    for k in range(1, most + 1):
        rows = w.join(state.select("doc_id", F.col("i").alias("j"), "v", "now", "last"), ["doc_id", "j"])
        moved = F.sum(F.when(F.col("own"), F.col("v") * gamma).otherwise(F.col("w") * F.col("now") * c))
        step = rows.groupBy("doc_id", "i").agg(moved.alias("r"), kept("v").alias("v"), kept("now").alias("now"), kept("last").alias("last"))
        state = step.select("doc_id", "i", "v", ((F.col("r") - F.col("last")) * omega + F.col("last")).alias("now"), F.col("now").alias("last"), "r")
        if k % every == 0:
            state = cut(state)
            gap = state.groupBy("doc_id").agg(F.sum(F.abs(F.col("r") - F.col("last"))).alias("d")).agg(F.max("d")).first()[0]
            if gap is None or gap * c / gamma <= tolerance:
                w.unpersist()
                return state.select("doc_id", "i", "r")
    w.unpersist()
    raise RuntimeError(f"the walk has not settled after {most} steps")


def start(w: DataFrame) -> DataFrame:
    """Equal restart weights over each document's nodes, summing to 1."""
    ids = w.select("doc_id", "i").distinct()
    n = ids.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return ids.join(n, "doc_id").select("doc_id", "i", (1.0 / F.col("_n")).alias("r"))


def candidates(t: DataFrame) -> DataFrame:
    """``doc_id``, ``noun``, ``uri``, ``final_score``: each uri once per noun, with the score it has where it first stands,
    in order of tuples, roles and places."""
    rank = F.array_position(F.array(*map(F.lit, algebra.ROLES)), F.col("role"))
    used = algebra.elements(t).filter("role <> 'predicate'").select("doc_id", F.col("word").alias("noun"), "sent_id", "tuple_id", rank.alias("rank"), "ord", F.posexplode("entity").alias("at", "x")).filter("x.uri IS NOT NULL AND x.final_score IS NOT NULL")
    first = F.struct("sent_id", "tuple_id", F.when(F.col("rank") == 0, 9).otherwise(F.col("rank")).alias("rank"), "ord", "at")
    return used.groupBy("doc_id", "noun", F.col("x.uri").alias("uri")).agg(F.min_by("x.final_score", first).alias("final_score"))


def level2(cand: DataFrame, related: DataFrame) -> DataFrame:
    """Sparse column-normalized matrix of nouns (ids 'N:') and candidates ('E:'). Only pairs of candidates with a KB
    relation are joined: all other pairs have relatedness 0."""
    down = cand.select("doc_id", F.concat(F.lit("E:"), "uri").alias("i"), F.concat(F.lit("N:"), "noun").alias("j"), F.col("final_score").alias("w"))
    a = cand.select("doc_id", F.col("noun").alias("n1"), F.col("uri").alias("u1"))
    b = cand.select("doc_id", F.col("noun").alias("n2"), F.col("uri").alias("u2"))
    pairs = a.join(related, "u1").join(b, ["doc_id", "u2"]).filter("n1 <> n2").select("doc_id", "u1", "u2", "score").distinct()
    up = lambda x, y: pairs.select("doc_id", F.concat(F.lit("E:"), x).alias("i"), F.concat(F.lit("E:"), y).alias("j"), F.col("score").alias("w"))
    return normalized(down.unionByName(up("u1", "u2")).unionByName(up("u2", "u1")))


def _chosen(t: DataFrame, kb_table: DataFrame, gamma1: float, gamma2: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """First-level matrix and scores, candidates, and the entity chosen for each noun."""
    w1 = cut(level1(merged_edges(t)))
    r1 = settle(w1, start(w1), gamma1)
    cand = cut(candidates(t))
    w2 = cut(level2(cand, kb.relatedness(kb_table)))
    seed = r1.join(cand.select("doc_id", F.col("noun").alias("i")).distinct(), ["doc_id", "i"])
    total = seed.groupBy("doc_id").agg(F.sum("r").alias("_s"))
    v2 = seed.join(total, "doc_id").filter("_s > 0").select("doc_id", F.concat(F.lit("N:"), "i").alias("i"), (F.col("r") / F.col("_s")).alias("r"))
    r2 = settle(w2, v2, gamma2)
    scored = cand.join(r2.withColumn("uri", F.expr("substring(i, 3)")).filter("i LIKE 'E:%'").select("doc_id", "uri", "r"), ["doc_id", "uri"]).withColumn("score", F.round(F.col("r") * F.col("final_score"), 12)).filter("score > 0")
    best = cut(scored.groupBy("doc_id", "noun").agg(F.max(F.struct(F.col("score"), F.col("uri"))).alias("b")).select("doc_id", "noun", "b.uri", "b.score"))
    return w1, r1, cand, best


def best_entities(t: DataFrame, kb_table: DataFrame, gamma1: float = 0.3, gamma2: float = 0.1) -> DataFrame:
    """The entity that propagation chooses for each noun: ``doc_id``, ``noun``, ``uri``, ``score``."""
    return _chosen(t, kb_table, gamma1, gamma2)[3]


def propagate(t: DataFrame, kb_table: DataFrame, gamma1: float = 0.3, gamma2: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Node scores (``doc_id``, ``i``, ``r``) and the entity chosen for each noun (``doc_id``, ``noun``, ``uri``,
    ``score``). All walks are settled. A document without candidates keeps its first-level scores."""
    w1, r1, cand, best = _chosen(t, kb_table, gamma1, gamma2)
    factor = cand.select("doc_id", F.col("noun").alias("i")).distinct().join(best.select("doc_id", F.col("noun").alias("i"), "score"), ["doc_id", "i"], "left").select("doc_id", "i", F.coalesce("score", F.lit(0.0)).alias("f"))
    v3 = r1.join(factor, ["doc_id", "i"], "left").select("doc_id", "i", (F.col("r") * F.coalesce("f", F.lit(1.0))).alias("r"))
    return settle(w1, v3, gamma1), best


def prune_entities(means: DataFrame, best: DataFrame) -> DataFrame:
    """Of a noun's ``means`` edges only the one to its chosen entity; all of them where none was chosen."""
    chosen = best.select("doc_id", F.col("noun").alias("src"), F.concat(F.lit("Entity:"), "uri").alias("_to"))
    return means.join(chosen, ["doc_id", "src"], "left").filter(F.col("_to").isNull() | (F.col("_to") == F.col("dst"))).drop("_to")


def independent_set(pairs: DataFrame, weights: DataFrame, trials: int = 0, seed: int = 1, in_task: int = 1_000_000) -> DataFrame:
    """The greedy independent set of each document's conflict graph, heaviest first, ties by id: ``doc_id``, ``id``. With
    ``trials``, so many sets are made besides in which nodes are drawn one after another with a chance by their weights,
    from ``seed``, and of all the heaviest is given (of equals the first; the greedy one is the first of all).

    ``pairs``: doc_id, a, b, held and without repeats; ``weights``: doc_id, id, weight (null: 0). Documents of up to ``in_task`` pairs are done many
    at a time within a task; larger ones by rounds of joins, in which every node that comes before all its remaining
    neighbours is taken and these are dropped: the same set as taking nodes one by one, in few rounds.
    """
    pairs = pairs.filter("a <> b").select("doc_id", "a", "b")
    ids = pairs.select("doc_id", F.col("a").alias("id")).unionByName(pairs.select("doc_id", F.col("b").alias("id"))).distinct()
    nodes = _ranked(ids, weights, trials, seed)
    large = pairs.groupBy("doc_id").count().filter(F.col("count") > in_task).select("doc_id")
    some = large.limit(1).count() > 0
    if some:
        large, nodes = small(cut(large)), cut(nodes)
    rest = lambda x: x.join(large, "doc_id", "left_anti") if some else x
    none = F.lit(None)
    rows = rest(pairs.select("doc_id", "a", "b", none.cast("double").alias("w"), none.cast("array<double>").alias("keys"))).unionByName(rest(nodes.select("doc_id", F.col("id").alias("a"), none.cast("string").alias("b"), "w", "keys")))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pairs.schema["doc_id"].dataType.simpleString()
    out = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_independent_chunks, f"doc_id {kind}, id string")
    if some:
        big, best = pairs.join(large, "doc_id", "left_semi"), None
        for k in range(trials + 1):
            chosen = _independent_joined(big, nodes.join(large, "doc_id", "left_semi").select("doc_id", "id", F.struct(F.col("keys")[k].alias("key"), "id").alias("rank"))).join(nodes.select("doc_id", "id", "w"), ["doc_id", "id"]).withColumn("k", F.lit(k))
            best = chosen if best is None else best.unionByName(chosen)
        total = best.groupBy("doc_id", "k").agg(F.round(F.sum("w"), 9).alias("s")).groupBy("doc_id").agg(F.max(F.struct("s", (-F.col("k")).alias("k")))["k"].alias("k")).select("doc_id", (-F.col("k")).alias("k"))
        out = out.unionByName(best.join(total, ["doc_id", "k"], "left_semi").select("doc_id", "id"))
    return cut(out)


def _independent_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_documents(batches, 300_000):
        docs = t["doc_id"].combine_chunks().dictionary_encode()
        doc = docs.indices.to_numpy(zero_copy_only=False)
        names = pa.chunked_array([*t["a"].chunks, *t["b"].chunks], pa.string()).combine_chunks().dictionary_encode()
        code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = code[: len(t)], code[len(t) :]
        width = len(names.dictionary)
        node = np.flatnonzero(b < 0)
        own = doc[node] * width + a[node]
        order = np.argsort(own)
        node, own = node[order], own[order]
        edge = np.flatnonzero(b >= 0)
        x, y = np.searchsorted(own, doc[edge] * width + a[edge]), np.searchsorted(own, doc[edge] * width + b[edge])
        ends = np.concatenate([x, y])
        by = np.argsort(ends, kind="stable")
        start = np.searchsorted(ends[by], np.arange(len(own) + 1))
        other = np.concatenate([y, x])[by]
        weight = t["w"].combine_chunks().take(pa.array(node)).to_numpy(zero_copy_only=False)
        keys = np.array(t["keys"].combine_chunks().take(pa.array(node)).to_pylist(), float).reshape(len(node), -1)
        texts = names.dictionary.to_pylist()
        text = [texts[c] for c in a[node]]
        best, top = np.zeros(len(own), bool), np.full(len(docs.dictionary), -np.inf)
        for k in range(keys.shape[1]):
            taken, gone = np.zeros(len(own), bool), np.zeros(len(own), bool)
            for n in sorted(range(len(own)), key=lambda n: (keys[n, k], text[n])):
                if not gone[n]:
                    taken[n] = True
                    gone[other[start[n] : start[n + 1]]] = True
            sums = np.round(np.bincount(doc[node][taken], weight[taken], len(top)), 9)
            better = (sums > top)[doc[node]]
            best[better] = taken[better]
            top = np.maximum(top, sums)
        yield pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(doc[node][best])), names.dictionary.take(pa.array(a[node][best]))], ["doc_id", "id"])


def _independent_joined(pairs: DataFrame, rank: DataFrame) -> DataFrame:
    """The set for one order of nodes, by joins."""
    ra, rb = rank.select("doc_id", F.col("id").alias("a"), F.col("rank").alias("ra")), rank.select("doc_id", F.col("id").alias("b"), F.col("rank").alias("rb"))
    left = cut(pairs.join(ra, ["doc_id", "a"]).join(rb, ["doc_id", "b"]).select("doc_id", F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("first"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("second")).distinct())
    alive = cut(rank.select("doc_id", "id"))
    chosen = None
    while True:
        blocked = left.select("doc_id", F.col("second").alias("id")).distinct()
        take = cut(alive.join(blocked, ["doc_id", "id"], "left_anti"))
        chosen = take if chosen is None else cut(chosen.unionByName(take))
        gone = left.join(take.withColumnRenamed("id", "first"), ["doc_id", "first"], "left_semi").select("doc_id", F.col("second").alias("id")).distinct()
        alive = cut(alive.join(take, ["doc_id", "id"], "left_anti").join(gone, ["doc_id", "id"], "left_anti"))
        if not alive.limit(1).count():
            return chosen
        left = cut(left.join(alive.withColumnRenamed("id", "first"), ["doc_id", "first"], "left_semi").join(alive.withColumnRenamed("id", "second"), ["doc_id", "second"], "left_semi"))


def resolved_collisions(t: DataFrame, weights: DataFrame, trials: int = 0, seed: int = 1, in_task: int = 1_000_000) -> DataFrame:
    """Every node of each document's conflict graph (``collisions``) and whether it is in its independent set (see
    ``independent_set``): ``doc_id``, ``id``, ``taken``.

    A sentence with many tuples has a number of collisions that grows with their square. So documents with up to
    ``in_task`` places of elements are resolved from these, without their pairs: what a taken element keeps out is known at
    its places in the sentence. Only larger documents are resolved by pairs.
    """
    e = algebra.elements(t).filter("sent_id IS NOT NULL").withColumn("id", F.when(F.col("role") == "predicate", predicate_id()).otherwise(F.col("word")))
    places = e.select("doc_id", "id", "sent_id", F.explode(F.array_distinct("word_index")).alias("ix"), "tuple_id", F.lower("word").alias("w"), F.lower("prep").alias("p")).filter("ix >= 0")
    places = cut(places)
    large = places.groupBy("doc_id").count().filter(F.col("count") > in_task).select("doc_id")
    some = large.limit(1).count() > 0
    if some:
        large = small(cut(large))
    rest = places.join(large, "doc_id", "left_anti") if some else places
    nodes = _ranked(rest.select("doc_id", "id").distinct(), weights, trials, seed)
    none = F.lit(None)
    rows = rest.select("*", none.cast("double").alias("weight"), none.cast("array<double>").alias("keys")).unionByName(nodes.withColumnRenamed("w", "weight"), allowMissingColumns=True)
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = t.schema["doc_id"].dataType.simpleString()
    out = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_resolved_chunks, f"doc_id {kind}, id string, taken boolean")
    if some:
        pairs = cut(collisions(t.join(large, "doc_id", "left_semi")))
        kept = independent_set(pairs, weights, trials, seed).withColumn("taken", F.lit(True))
        ids = pairs.select("doc_id", F.col("a").alias("id")).unionByName(pairs.select("doc_id", F.col("b").alias("id"))).distinct()
        out = out.unionByName(ids.join(kept, ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("taken", F.lit(False)).alias("taken")))
    return cut(out)


def _ranked(ids: DataFrame, weights: DataFrame, trials: int, seed: int) -> DataFrame:
    """``doc_id``, ``id``, ``w`` and for the greedy set and each trial the key by which nodes are ordered, ``keys``."""
    nodes = ids.join(weights, ["doc_id", "id"], "left").select("doc_id", "id", F.round(F.coalesce("weight", F.lit(0.0)), 9).alias("w"))
    clock = lambda k: -F.log((F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "doc_id", "id"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))) / F.greatest("w", F.lit(1e-5))
    return nodes.select("doc_id", "id", "w", F.array(-F.col("w"), *[clock(k) for k in range(trials)]).alias("keys"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, -1 for null."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _alike(*columns: np.ndarray) -> np.ndarray:
    """A number for each combination of values."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out * (c.max(initial=0) + 2) + c + 1, return_inverse=True)[1]
    return out


def _times(*columns: np.ndarray) -> np.ndarray:
    """How many rows have the same combination of values as each row."""
    code = np.unique(_alike(*columns), return_inverse=True)[1]
    return np.bincount(code)[code] if len(code) else code


def _colliding(g: np.ndarray, node: np.ndarray, u: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each place of an element whether another tuple's element collides with it there, by counting those that don't:
    it collides with other words, and with the same word of another node where both prepositions are known and differ."""
    out = _times(g) - _times(g, w) - _times(g, u) + _times(g, w, u) > 0
    known = p >= 0
    gw, n, v, q = _alike(g, w)[known], node[known], u[known], p[known]
    rest = _times(gw) - _times(gw, q) - _times(gw, n) - _times(gw, v) + _times(gw, q, n) + _times(gw, q, v) + _times(gw, n, v) - _times(gw, q, n, v)
    out[known] |= rest > 0
    return out


MANY = -9


def _taken_in_order(order: list[int], start: list[int], g: list[int], u: list[int], w: list[int], p: list[int]) -> np.ndarray:
    """Nodes taken one by one unless a taken one collides with them. At each place the words taken are held with their tuple
    (or MANY), and for each word the prepositions with their nodes and tuples."""
    taken = np.zeros(len(start) - 1, bool)
    words: dict[int, dict[int, int]] = {}
    preps: dict[tuple[int, int], dict[int, dict[int, int]]] = {}
    for n in order:
        mine = range(start[n], start[n + 1])
        free = True
        for k in mine:
            there = words.get(g[k])
            if there is None:
                continue
            if any(x != w[k] and t != u[k] for x, t in there.items()):
                free = False
                break
            if p[k] >= 0 and any(q != p[k] and any(m != n and t != u[k] for m, t in by.items()) for q, by in preps.get((g[k], w[k]), {}).items()):
                free = False
                break
        if not free:
            continue
        taken[n] = True
        for k in mine:
            there = words.setdefault(g[k], {})
            there[w[k]] = u[k] if there.get(w[k], u[k]) == u[k] else MANY
            if p[k] >= 0:
                by = preps.setdefault((g[k], w[k]), {}).setdefault(p[k], {})
                by[n] = u[k] if by.get(n, u[k]) == u[k] else MANY
    return taken


def _resolved_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_documents(batches, 300_000):
        docs = t["doc_id"].combine_chunks().dictionary_encode()
        doc = docs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = t["id"].combine_chunks().dictionary_encode()
        name = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = _alike(doc, name)  # the node of each row
        is_node = t["keys"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(is_node)
        rows = rows[np.argsort(of[rows])]  # one row for each node, in order
        place = np.flatnonzero(~is_node)
        place = place[np.argsort(of[place], kind="stable")]
        code = lambda c: _codes(t[c])[place]
        node, u, w, p = of[place], code("tuple_id"), code("w"), code("p")
        g = _alike(doc[place], code("sent_id"), code("ix"))
        collides = np.zeros(len(rows), bool)
        collides[node[_colliding(g, node, u, w, p)]] = True
        start = np.searchsorted(node, np.arange(len(rows) + 1)).tolist()
        held = [x.tolist() for x in (g, u, w, p)]
        keys = np.array(t["keys"].combine_chunks().take(pa.array(rows)).to_pylist(), float).reshape(len(rows), -1)
        weight = t["weight"].combine_chunks().take(pa.array(rows)).to_numpy(zero_copy_only=False)
        texts = names.dictionary.to_pylist()
        text = [texts[c] for c in name[rows]]
        where = doc[rows]
        ids = np.flatnonzero(collides).tolist()
        best, top = np.zeros(len(rows), bool), np.full(len(docs.dictionary), -np.inf)
        for k in range(keys.shape[1]):
            key = keys[:, k].tolist()
            taken = _taken_in_order(sorted(ids, key=lambda n: (key[n], text[n])), start, *held)
            sums = np.round(np.bincount(where[taken], weight[taken], len(top)), 9)
            better = (sums > top)[where]
            best[better] = taken[better]
            top = np.maximum(top, sums)
        yield pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(where[collides])), names.dictionary.take(pa.array(name[rows][collides])), pa.array(best[collides])], ["doc_id", "id", "taken"])


def refine(edges: DataFrame) -> DataFrame:
    """Edges of predicates with a subject; edges of others, and so nodes that nothing points to, are dropped."""
    with_subject = edges.filter("relation = 'subj'").select("doc_id", "src").distinct()
    return edges.join(with_subject, ["doc_id", "src"], "left_semi")


def collect_tuples(edges: DataFrame) -> DataFrame:
    """Graph to tuples: any relation but subj, dobj and iobj is an adverbial. One role edge each; of several the
    smallest word counts."""
    e = edges.filter("relation <> 'means'")
    role = lambda r: F.min(F.when(F.col("relation") == r, F.col("dst")))
    adv = F.array_sort(F.collect_list(F.when(~F.col("relation").isin("subj", "dobj", "iobj"), F.concat_ws(" ", "relation", "dst"))))
    return e.groupBy("doc_id", "src").agg(role("subj").alias("subject"), role("dobj").alias("direct_object"), role("iobj").alias("indirect_object"), adv.alias("adverbial")).filter("subject IS NOT NULL").withColumnRenamed("src", "predicate_id")


def score_tuples(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score of each predicate's nouns."""
    return edges.join(scores.select("doc_id", F.col("i").alias("dst"), "r"), ["doc_id", "dst"]).groupBy("doc_id", "src").agg(F.round(F.avg("r"), 6).alias("score"))


def resolve(t: DataFrame, kb_table: DataFrame, gamma1: float = 0.1, gamma2: float = 0.2, trials: int = 0) -> DataFrame:
    """Edges of every document's graph with collisions and entities resolved: scores by propagation, an independent set of
    the collision graph, removal of what loses (a noun with the predicates that point to it), then the remaining graph
    refined, its nouns with the ``means`` edges to the entities chosen by propagation."""
    t = cut(t)
    scores, best = propagate(t, kb_table, gamma1, gamma2)
    edges = cut(merged_edges(t))
    lost = resolved_collisions(t, scores.select("doc_id", F.col("i").alias("id"), F.col("r").alias("weight")), trials).filter("NOT taken").select("doc_id", "id")
    with_noun = edges.join(lost.withColumnRenamed("id", "dst"), ["doc_id", "dst"], "left_semi").select("doc_id", "src").distinct()
    rest = cut(refine(edges.join(lost.withColumnRenamed("id", "src"), ["doc_id", "src"], "left_anti").join(with_noun, ["doc_id", "src"], "left_anti")))
    means = prune_entities(means_edges(t), best).join(rest.select("doc_id", F.col("dst").alias("src")).distinct(), ["doc_id", "src"], "left_semi")
    return rest.unionByName(means)


def restore(t: DataFrame, edges: DataFrame) -> DataFrame:
    """The tuples of ``t`` that a graph still holds, with all fields of the elements that still have their edge; of an
    element's entities, those its noun still means (all of them where it means none)."""
    edges = cut(edges)
    roles = edges.filter("relation <> 'means'").select("doc_id", F.col("src").alias("_p"), F.col("dst").alias("word"), F.col("relation").alias("_r"))
    label = F.create_map(*[F.lit(x) for kv in {"subject": "subj", "direct_object": "dobj", "indirect_object": "iobj"}.items() for x in kv])
    one = t.select("doc_id", "tuple_id", predicate_id().alias("_p"), F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(0).alias("ord"), F.col(r).alias("e")) for r in algebra.ROLES if r != "predicate"])).alias("x"))
    many = t.select("doc_id", "tuple_id", predicate_id().alias("_p"), F.posexplode("adverbial").alias("ord", "e")).select("doc_id", "tuple_id", "_p", F.struct(F.lit("adverbial").alias("role"), "ord", "e").alias("x"))
    held = one.unionByName(many).filter("x.e.word IS NOT NULL").select("doc_id", "tuple_id", "_p", "x", F.col("x.e.word").alias("word"), F.coalesce(label[F.col("x.role")], F.col("x.e.prep")).alias("_r"))
    held = held.join(roles, ["doc_id", "_p", "word", "_r"], "left_semi")
    meant = edges.filter("relation = 'means'").select("doc_id", F.col("src").alias("word"), F.expr("substring(dst, 8)").alias("uri")).groupBy("doc_id", "word").agg(F.collect_set("uri").alias("_uris"))
    known = held.join(meant, ["doc_id", "word"], "left").withColumn("_e", F.when(F.col("_uris").isNotNull(), F.filter("x.e.entity", lambda y: F.array_contains("_uris", y["uri"]))).otherwise(F.col("x.e.entity")))
    role = lambda r: F.max(F.when(F.col("x.role") == r, F.col("x.e").withField("entity", F.col("_e")))).alias(r)  # noqa: E731  # one row each
    adv = F.transform(F.array_sort(F.collect_list(F.when(F.col("x.role") == "adverbial", F.struct("x.ord", F.col("x.e").withField("entity", F.col("_e")).alias("e"))))), lambda y: y["e"]).alias("adverbial")
    back = known.groupBy("doc_id", "tuple_id").agg(*[role(r) for r in algebra.ROLES if r != "predicate"], adv)
    rest = t.drop(*[r for r in algebra.ROLES if r != "predicate"], "adverbial")
    return rest.join(back, ["doc_id", "tuple_id"]).filter("subject IS NOT NULL").select(*t.columns)


def join_optimize(t: DataFrame, kb_table: DataFrame, gamma1: float = 0.1, gamma2: float = 0.2, trials: int = 0) -> DataFrame:
    """Resolve collisions and entities of every document and give back its tuples, as words."""
    return collect_tuples(resolve(t, kb_table, gamma1, gamma2, trials))
