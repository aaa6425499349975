"""Queries over tuples, knowledge base and fact graphs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import algebra, graph, kb
from factloom.runtime import cut, scratch, ship, table
from factloom.sources import sinks

COLUMNS = ["doc_id", "sent_id", "tuple_id", "run", "clause_type", "negation", "subject", "predicate", "direct_object", "indirect_object", "adverbial"]


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.once(table(spark, sf_dir, "tuples").select(*COLUMNS))


def _run(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    return tuples(spark, sf_dir).filter(F.col("run") == run)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.elements(tuples(spark, sf_dir)).select("doc_id", "sent_id", "tuple_id", "role", "ord", "word", "prep")


def refine_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = algebra.elements(tuples(spark, sf_dir))
    return e.groupBy(algebra.refine_word(F.col("word")).alias("refined")).agg(F.count("*").alias("n"))


def pronoun_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = algebra.elements(tuples(spark, sf_dir))
    return e.groupBy("role", graph.pronoun_type(F.col("word")).alias("kind")).agg(F.count("*").alias("n"))


def to_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.triples(tuples(spark, sf_dir))


def tuple_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tuples(spark, sf_dir).filter("subject.word IS NOT NULL AND predicate.word IS NOT NULL")
    key = t.select("doc_id", "tuple_id", algebra.role_key().alias("k"), F.array_join(F.array_sort(algebra.adverbial_keys()), "\u0003").alias("a"))
    return key.groupBy("doc_id", "k", "a").agg(F.min("tuple_id").alias("first_id"), F.count("*").alias("n")).select("doc_id", "first_id", "n")


def tuple_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples(spark, sf_dir).groupBy(algebra.hash_key().alias("key")).agg(F.count("*").alias("n"))


def equal_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.equal_pairs(_run(spark, sf_dir, "raw"), _run(spark, sf_dir, "decomposition"))


def compare_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.compared(_run(spark, sf_dir, "raw"), _run(spark, sf_dir, "decomposition"))


def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.merge_runs(_run(spark, sf_dir, "raw"), _run(spark, sf_dir, "decomposition")).withColumn("adv", F.array_join("adv", "\u0003"))


def lexical_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.lexically_valid(tuples(spark, sf_dir), table(spark, sf_dir, "documents")).select("doc_id", "tuple_id")


def overlap_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of elements only what is compared is read and shuffled."""
    slim = lambda e: F.struct(*[e[f].alias(f) for f in ("word", "word_index", "prep")])
    roles = [slim(F.col(r)).alias(r) for r in algebra.ROLES]
    return algebra.overlaps(algebra.once(table(spark, sf_dir, "tuples").select("doc_id", "sent_id", "tuple_id", *roles, F.transform("adverbial", slim).alias("adverbial"))))


def triple_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.evaluate(_run(spark, sf_dir, "decomposition"), _run(spark, sf_dir, "raw"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(tuples(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merged_edges(tuples(spark, sf_dir))


def means_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.means_edges(tuples(spark, sf_dir))


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reference_edges(tuples(spark, sf_dir))


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.semantic_edges(tuples(spark, sf_dir))


def merge_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_triples(graph.semantic_edges(tuples(spark, sf_dir)))


def collision_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collisions(tuples(spark, sf_dir))


def refine_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.refine(graph.merged_edges(tuples(spark, sf_dir)))


def collect_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collect_tuples(graph.merged_edges(tuples(spark, sf_dir))).withColumn("adverbial", F.array_join("adverbial", "||"))


def mention_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "mentions").select("mention_id", "doc_id", "surface_form", "word", "ne_type").dropDuplicates(["mention_id"])
    return graph.link(tuples(spark, sf_dir), mentions, table(spark, sf_dir, "kb_things"))


def annotated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements linked by the mentions of their document, then the graph built from them."""
    return graph.annotated_edges(tuples(spark, sf_dir), mention_link(spark, sf_dir))


def graph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written and read again."""
    t, folder = tuples(spark, sf_dir), scratch(spark)
    sinks.write_graph(graph.nodes(t), graph.merged_edges(t).unionByName(graph.means_edges(t)), folder)
    nodes, edges = sinks.read_graph(spark, folder)
    named = edges.join(nodes.select("doc_id", F.col("node_id").alias("dst"), "name", "type").filter("type <> 'Predicate'"), ["doc_id", "dst"])
    return named.select("doc_id", "src", "relation", "name", "type")


def stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's result written and read again."""
    return sinks.write_stage(algebra.triples(tuples(spark, sf_dir)), scratch(spark))


def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.candidates(tuples(spark, sf_dir))


def best_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.candidates(tuples(spark, sf_dir)).filter("final_score >= 0.5")
    return c.groupBy("doc_id", "noun").agg(F.max(F.struct("final_score", "uri")).alias("b")).select("doc_id", "noun", "b.uri", "b.final_score")


def level1_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.level1(graph.merged_edges(tuples(spark, sf_dir))).withColumn("w", F.round("w", 6))


def level2_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.level2(graph.candidates(tuples(spark, sf_dir)), kb.relatedness(table(spark, sf_dir, "kb"))).withColumn("w", F.round("w", 6))


def restart_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = cut(graph.level1(graph.merged_edges(tuples(spark, sf_dir))))
    return graph.settle(w, graph.start(w), 0.3).withColumn("r", F.round("r", 6))


def entity_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_entities(tuples(spark, sf_dir), table(spark, sf_dir, "kb")).withColumn("score", F.round("score", 6))


def pruned_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tuples(spark, sf_dir)
    return graph.prune_entities(graph.means_edges(t), graph.best_entities(t, table(spark, sf_dir, "kb")))


def score_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(graph.merged_edges(tuples(spark, sf_dir)))
    w = cut(graph.level1(edges))
    return graph.score_tuples(edges, graph.settle(w, graph.start(w), 0.3))


def greedy_independent_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(tuples(spark, sf_dir))
    scores, _ = graph.propagate(t, table(spark, sf_dir, "kb"))
    weights = scores.select("doc_id", F.col("i").alias("id"), F.col("r").alias("weight"))
    return graph.resolved_collisions(t, weights).filter("taken").select("doc_id", "id")


def joint_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.join_optimize(tuples(spark, sf_dir), table(spark, sf_dir, "kb")).withColumn("adverbial", F.array_join("adverbial", "||"))


def joint_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved tuples whole, by sentence: words, places, references and the entity each noun means."""
    t = tuples(spark, sf_dir)
    back = graph.restore(t, graph.resolve(t, table(spark, sf_dir, "kb")))
    seen = lambda r: [F.col(f"{r}.word").alias(r), F.array_join(F.transform(f"{r}.word_index", lambda i: i.cast("string")), " ").alias(f"{r}_index"), F.col(f"{r}.reference").alias(f"{r}_reference"), F.array_join(F.array_sort(F.transform(f"{r}.entity", lambda e: e["uri"])), " ").alias(f"{r}_uris")]
    adv = F.array_join(F.transform("adverbial", lambda a: F.concat_ws(" ", a["prep"], a["word"])), "||").alias("adverbial")
    return back.select("doc_id", "sent_id", "tuple_id", "negation", F.col("predicate.word").alias("predicate"), *seen("subject"), *seen("direct_object"), *seen("indirect_object"), adv)


def kb_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.neighbours(table(spark, sf_dir, "kb"), table(spark, sf_dir, "kb_things"))


def kb_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours asked for in two rounds, the second of which finds the first one's answers remembered."""
    kb_table, things = table(spark, sf_dir, "kb"), table(spark, sf_dir, "kb_things")
    first = kb.remember(spark.createDataFrame([], "uri string, neighbour string"), kb_table, things, things.filter("uri < 'M'"))
    return kb.remember(cut(first), kb_table, things, things)


def kb_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.relations(table(spark, sf_dir, "kb")).withColumn("rels", F.array_join("rels", ","))


def kb_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.head_counts(table(spark, sf_dir, "kb"))


def kb_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.tail_counts(table(spark, sf_dir, "kb"))


def kb_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.path_counts(table(spark, sf_dir, "kb"))


def kb_relatedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.relatedness(table(spark, sf_dir, "kb"))


def kb_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.page_urls(table(spark, sf_dir, "kb_things"))


# Fixed tuples in which runs agree, as the tables hold none that do: run, sentence, subject, predicate, direct object,
# indirect object and adverbials, each 'word', 'word/preposition' or 'word@reference'.
CASES = [
    ("raw", 1, "Ann", "met", "Bob", "", ["noon/at", "Vienna/in"]), ("decomposition", 1, "ann", "Met", "bob", "", ["vienna/in", "noon/at"]), ("decomposition", 1, "Ann", "met", "Bob", "", ["the park/in"]),
    ("raw", 2, "She@Ann", "sold", "the map", "him@Bob", []), ("decomposition", 2, "Ann", "sold", "the map", "Bob", []), ("decomposition", 2, "Ann", "sold", "the map", "", []),
    ("raw", 3, "the town 's hall", "opened", "", "", ["1874/in"]), ("decomposition", 3, "the town's hall", "opened", "", "", ["1874/in"]), ("decomposition", 3, "the hall", "opened", "", "", ["1874/in"]),
    ("raw", 4, "the map", "was", "old", "", []), ("raw", 4, "the map", "was", "old", "", []), ("decomposition", 4, "The map", "was", "old", "", ["then/by"]), ("decomposition", 4, "the map", "was", "old", "", []), ("decomposition", 4, "the map", "was", "old", "", ["fact/in"]),
    ("raw", 5, "It@the map", "burned", "", "", []), ("decomposition", 5, "the map", "burned", "It@the map", "", []), ("decomposition", 5, "he@Ann", "left", "", "", []),
]
ELEMENT = "struct<word:string,word_index:array<int>,prep:string,reference:string,ne_type:string,entity:array<struct<uri:string,final_score:double>>>"


def _case(text: str) -> tuple | None:
    word, _, prep = text.partition("/")
    word, _, reference = word.partition("@")
    return (word, [0], prep or None, reference or None, None, None) if word else None


def _case_rows() -> list[tuple]:
    return [(7, s, i, run, "SVO", False, _case(a), _case(b), _case(c), _case(d), [_case(x) for x in e]) for i, (run, s, a, b, c, d, e) in enumerate(CASES, 1)]


def case_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = f"doc_id bigint, sent_id int, tuple_id bigint, run string, clause_type string, negation boolean, {', '.join(f'{r} {ELEMENT}' for r in algebra.ROLES)}, adverbial array<{ELEMENT}>"
    ship(spark.sparkContext)
    return spark.createDataFrame(_case_rows(), schema)


def equal_tuples_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tuples(spark, sf_dir)
    return algebra.equal_pairs(t.filter("run = 'raw'"), t.filter("run = 'decomposition'"))


def compare_tuples_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tuples(spark, sf_dir)
    return algebra.compared(t.filter("run = 'raw'"), t.filter("run = 'decomposition'"))


def merge_runs_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tuples(spark, sf_dir)
    return algebra.merge_runs(t.filter("run = 'raw'"), t.filter("run = 'decomposition'")).withColumn("adv", F.array_join("adv", "\u0003"))


def triple_eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tuples(spark, sf_dir)
    return algebra.evaluate(t.filter("run = 'decomposition'"), t.filter("run = 'raw'"))


def reference_edges_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reference_edges(case_tuples(spark, sf_dir))


_NAMES = [
    "elements", "refine_word", "pronoun_type", "to_triples", "tuple_dedup", "tuple_hash", "equal_tuples", "compare_tuples", "merge_runs", "lexical_validate", "overlap_collisions", "triple_eval",
    "graph_nodes", "graph_edges", "means_edges", "reference_edges", "semantic_edges", "merge_triples", "collision_edges", "refine_graph", "collect_tuples", "mention_link", "annotated_graph", "graph_roundtrip", "stage_roundtrip", "entity_candidates", "best_entity",
    "level1_matrix", "level2_matrix", "restart_walk", "entity_argmax", "pruned_entities", "score_tuples", "greedy_independent_set", "joint_optimize", "joint_tuples",
    "kb_neighbours", "kb_memo", "kb_relations", "kb_heads", "kb_tails", "kb_paths", "kb_relatedness", "kb_pages",
    "equal_tuples_cases", "compare_tuples_cases", "merge_runs_cases", "triple_eval_cases", "reference_edges_cases",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES}


_T = "WITH RECURSIVE t AS (SELECT DISTINCT ON (tuple_id) * FROM tuples ORDER BY tuple_id, loaded_at)"
_E = _T + """, e AS (SELECT * FROM (
  SELECT doc_id, sent_id, tuple_id, run, 'subject' AS role, 0 AS ord, subject AS e FROM t UNION ALL SELECT doc_id, sent_id, tuple_id, run, 'predicate', 0, predicate FROM t
  UNION ALL SELECT doc_id, sent_id, tuple_id, run, 'direct_object', 0, direct_object FROM t UNION ALL SELECT doc_id, sent_id, tuple_id, run, 'indirect_object', 0, indirect_object FROM t
  UNION ALL SELECT doc_id, sent_id, tuple_id, run, 'adverbial', CAST(generate_subscripts(adverbial, 1) - 1 AS INT), unnest(adverbial) FROM t) WHERE e.word IS NOT NULL)"""
_REFINE = "replace(replace(replace({}, ' ''s', '''s'), ' - ', '-'), ' , ', ', ')"
_TR = _T + """, x AS (SELECT *, list_filter(coalesce(adverbial, []), lambda a: a.word IS NOT NULL) AS adv FROM t),
y AS (SELECT doc_id, sent_id, tuple_id, run, subject.word AS s, predicate.word AS p, list_concat(
  CASE WHEN direct_object.word IS NOT NULL THEN [{'o': direct_object.word, 'label': 'dobj'}] ELSE [] END,
  CASE WHEN indirect_object.word IS NOT NULL THEN [{'o': indirect_object.word, 'label': 'iobj'}] ELSE [] END,
  list_transform(adv, lambda a: {'o': a.word, 'label': a.prep}),
  CASE WHEN direct_object.word IS NULL AND len(adv) = 0 THEN [{'o': NULL::VARCHAR, 'label': NULL::VARCHAR}] ELSE [] END) AS l FROM x),
z AS (SELECT doc_id, sent_id, tuple_id, run, s, p, CAST(generate_subscripts(l, 1) - 1 AS INT) AS ord, unnest(l) AS x FROM y),
tr AS (SELECT doc_id, sent_id, tuple_id, run, ord, s, p, x.o AS o, x.label AS label FROM z)"""
_K = "CASE WHEN {0}.word IS NULL THEN chr(4) ELSE lower({0}.word) || chr(1) || coalesce(lower({0}.prep), chr(2)) END"
_RK = " || chr(3) || ".join(_K.format(r) for r in ("subject", "predicate", "direct_object", "indirect_object"))
_AK = "list_sort(list_transform(list_filter(coalesce(adverbial, []), lambda a: a.word IS NOT NULL), lambda a: lower(a.word) || chr(1) || coalesce(lower(a.prep), chr(2))))"
_KEYED = _T + f", k AS (SELECT doc_id, sent_id, tuple_id, run, {_RK} AS k, {_AK} AS a FROM t WHERE subject.word IS NOT NULL AND predicate.word IS NOT NULL)"
_PID = "concat_ws(':', doc_id, sent_id, tuple_id)"
_ME = _E + f""", has AS (SELECT tuple_id FROM e WHERE role = 'predicate'),
me AS (SELECT DISTINCT doc_id, {_PID} AS src, e.word AS dst, CASE role WHEN 'subject' THEN 'subj' WHEN 'direct_object' THEN 'dobj' WHEN 'indirect_object' THEN 'iobj' WHEN 'adverbial' THEN e.prep END AS relation
  FROM e SEMI JOIN has USING (tuple_id) WHERE role <> 'predicate'), ge AS (SELECT * FROM me WHERE relation IS NOT NULL)"""
_OV = _E + """, ix AS (SELECT doc_id, sent_id, tuple_id, role, ord, lower(e.word) AS w, lower(e.prep) AS pr, CASE WHEN role = 'predicate' THEN """ + _PID + """ ELSE e.word END AS id, unnest(list_distinct(e.word_index)) AS ix FROM e),
ov AS (SELECT DISTINCT a.doc_id, a.sent_id, a.tuple_id AS left_id, a.role AS left_role, a.ord AS left_ord, b.tuple_id AS right_id, b.role AS right_role, b.ord AS right_ord, a.id AS ai, b.id AS bi
  FROM ix a JOIN ix b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.ix = b.ix AND a.tuple_id < b.tuple_id
  WHERE a.ix >= 0 AND NOT (a.w = b.w AND a.pr IS NOT DISTINCT FROM b.pr) AND NOT (a.w = b.w AND (a.pr IS NULL) <> (b.pr IS NULL)))"""
_L1 = _ME + """, both_ways AS (SELECT doc_id, src AS i, dst AS j FROM ge UNION SELECT doc_id, dst, src FROM ge),
w AS (SELECT doc_id, i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, j) AS w FROM both_ways),
r0 AS (SELECT doc_id, i, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS r FROM (SELECT DISTINCT doc_id, i FROM w))"""
_KT = "WITH k AS (SELECT DISTINCT head, rel, tail FROM kb WHERE head IS NOT NULL AND rel IS NOT NULL AND tail IS NOT NULL)"
_REL = """h AS (SELECT rel, tail, count(*) AS n_heads FROM k GROUP BY ALL), tl AS (SELECT head, rel, count(*) AS n_tails FROM k GROUP BY ALL),
d AS (SELECT k.head, k.tail, sum(2.0::DOUBLE / (n_heads + n_tails)) AS w FROM k JOIN h USING (rel, tail) JOIN tl USING (head, rel) WHERE k.head <> k.tail GROUP BY ALL),
rel AS (SELECT least(head, tail) AS u1, greatest(head, tail) AS u2, round(max(w), 6) AS score FROM d GROUP BY ALL)"""
_CAND = """, x AS (SELECT doc_id, sent_id, tuple_id, CASE role WHEN 'subject' THEN 1 WHEN 'direct_object' THEN 3 WHEN 'indirect_object' THEN 4 ELSE 9 END AS rk, ord, generate_subscripts(e.entity, 1) AS pl, e.word AS noun, unnest(e.entity) AS x FROM e WHERE role <> 'predicate'),
cand AS (SELECT DISTINCT ON (doc_id, noun, x.uri) doc_id, noun, x.uri AS uri, x.final_score AS final_score FROM x WHERE x.uri IS NOT NULL AND x.final_score IS NOT NULL ORDER BY doc_id, noun, x.uri, sent_id NULLS FIRST, tuple_id, rk, ord, pl)"""
_C = _E + _CAND


def _settled(name: str, first: str, matrix: str, gamma: float, steps: int) -> str:
    """The settled walk as the sum of its steps without restart; what is left after ``steps`` is below 1e-11."""
    return f"""{name}t AS (SELECT doc_id, i, r, 0 AS k FROM {first} UNION ALL SELECT m.doc_id, m.i, sum(m.w * t.r * {1 - gamma}), t.k + 1 FROM {name}t t JOIN {matrix} m ON m.doc_id = t.doc_id AND m.j = t.i WHERE t.k < {steps} GROUP BY m.doc_id, m.i, t.k),
{name} AS (SELECT doc_id, i, {gamma} * sum(r) AS r FROM {name}t GROUP BY ALL)"""


_SIM = "({r}a = {r}b OR CASE WHEN coalesce({x}.reference, '') <> '' THEN lower({x}.reference) = {r}b ELSE coalesce(lower({y}.reference) = {r}a, FALSE) END)"


def _similar(x: str, y: str) -> str:
    wa, wb = _REFINE.format(f"lower({x}.word)"), _REFINE.format(f"lower({y}.word)")
    return f"({wa} = {wb} OR CASE WHEN coalesce({x}.reference, '') <> '' THEN lower({x}.reference) = {wb} ELSE coalesce(lower({y}.reference) = {wa}, FALSE) END)"


def _both(r: str) -> str:
    return f"((l.{r}.word IS NULL AND r.{r}.word IS NULL) OR (l.{r}.word IS NOT NULL AND r.{r}.word IS NOT NULL AND {_similar('l.' + r, 'r.' + r)}))"


_USED = "role <> 'predicate' AND (role <> 'adverbial' OR e.prep IS NOT NULL)"

_W2 = ", " + _KT.removeprefix("WITH ") + ", " + _REL + """, pr AS (SELECT DISTINCT a.doc_id, u1, u2, score FROM cand a JOIN rel ON a.uri = u1 JOIN cand b ON a.doc_id = b.doc_id AND b.uri = u2 WHERE a.noun <> b.noun),
wx AS (SELECT doc_id, 'E:' || uri AS i, 'N:' || noun AS j, final_score AS w FROM cand UNION ALL SELECT doc_id, 'E:' || u1, 'E:' || u2, score FROM pr UNION ALL SELECT doc_id, 'E:' || u2, 'E:' || u1, score FROM pr),
wy AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, j) AS s FROM wx), w2 AS (SELECT doc_id, i, j, w / s AS w FROM wy WHERE s > 0)"""


def _steps(gamma: float) -> int:
    return 80 if gamma >= 0.3 else 130 if gamma >= 0.2 else 270


def _chosen(gamma1: float, gamma2: float) -> str:
    return (
        _L1 + _CAND + _W2 + ", " + _settled("r1", "r0", "w", gamma1, _steps(gamma1)) + """, sd AS (SELECT DISTINCT r1.* FROM r1 JOIN cand ON cand.doc_id = r1.doc_id AND cand.noun = r1.i),
v2 AS (SELECT doc_id, 'N:' || i AS i, r / sum(r) OVER (PARTITION BY doc_id) AS r FROM sd), """ + _settled("r2", "v2", "w2", gamma2, _steps(gamma2)) + """,
sc AS (SELECT cand.doc_id, noun, uri, round(r * final_score, 12) AS score FROM cand JOIN r2 ON r2.doc_id = cand.doc_id AND r2.i = 'E:' || cand.uri),
bst AS (SELECT doc_id, noun, arg_max(uri, (score, uri)) AS uri, max(score) AS score FROM sc WHERE score > 0 GROUP BY doc_id, noun)"""
    )


_PRUNED = f""", mea AS (SELECT DISTINCT doc_id, src, x.uri AS uri FROM (SELECT doc_id, e.word AS src, unnest(e.entity) AS x FROM e WHERE {_USED}) WHERE x.uri IS NOT NULL),
pruned AS (SELECT mea.doc_id, src, 'Entity:' || mea.uri AS dst, 'means' AS relation FROM mea LEFT JOIN bst ON bst.doc_id = mea.doc_id AND bst.noun = mea.src WHERE bst.uri IS NULL OR bst.uri = mea.uri)"""


def _greedy(gamma1: float, gamma2: float) -> str:
    """Nodes of each document one by one in their order, with the list of those taken."""
    return (
        _chosen(gamma1, gamma2) + """, fa AS (SELECT DISTINCT cand.doc_id, cand.noun AS i, coalesce(bst.score, 0.0) AS f FROM cand LEFT JOIN bst USING (doc_id, noun)),
v3 AS (SELECT r1.doc_id, r1.i, r * coalesce(f, 1.0) AS r FROM r1 LEFT JOIN fa ON fa.doc_id = r1.doc_id AND fa.i = r1.i), """ + _settled("r3", "v3", "w", gamma1, _steps(gamma1)) + ", " + _OV.removeprefix(_E + ", ") + """,
cp AS (SELECT DISTINCT doc_id, least(ai, bi) AS a, greatest(ai, bi) AS b FROM ov WHERE ai <> bi), nb AS (SELECT doc_id, id, list(other) AS others FROM (SELECT doc_id, a AS id, b AS other FROM cp UNION SELECT doc_id, b, a FROM cp) GROUP BY ALL),
rk AS (SELECT nb.doc_id, id, others, row_number() OVER (PARTITION BY nb.doc_id ORDER BY round(coalesce(r, 0.0), 9) DESC, id) AS k FROM nb LEFT JOIN r3 ON r3.doc_id = nb.doc_id AND r3.i = nb.id),
gr AS (SELECT doc_id, 1 AS k, [id] AS taken FROM rk WHERE k = 1 UNION ALL SELECT rk.doc_id, gr.k + 1, CASE WHEN list_has_any(others, taken) THEN taken ELSE list_append(taken, id) END FROM gr JOIN rk ON rk.doc_id = gr.doc_id AND rk.k = gr.k + 1),
kept AS (SELECT doc_id, unnest(taken) AS id FROM (SELECT doc_id, arg_max(taken, k) AS taken FROM gr GROUP BY doc_id))"""
    )


_RESOLVED = _greedy(0.1, 0.2) + """, lost AS (SELECT doc_id, id FROM nb ANTI JOIN kept USING (doc_id, id)), dn AS (SELECT DISTINCT ge.doc_id, src FROM ge JOIN lost ON lost.doc_id = ge.doc_id AND lost.id = ge.dst UNION SELECT doc_id, id FROM lost),
st AS (SELECT ge.* FROM ge ANTI JOIN dn ON dn.doc_id = ge.doc_id AND dn.src = ge.src), rest AS (SELECT st.* FROM st WHERE EXISTS (SELECT 1 FROM st s WHERE s.doc_id = st.doc_id AND s.src = st.src AND s.relation = 'subj'))"""

ORACLE = {
    "elements": _E + " SELECT doc_id, sent_id, tuple_id, role, ord, e.word AS word, e.prep AS prep FROM e",
    "refine_word": _E + f" SELECT {_REFINE.format('e.word')} AS refined, count(*) AS n FROM e GROUP BY ALL",
    "pronoun_type": _E + " SELECT role, CASE WHEN lower(e.word) IN ('he', 'him', 'his', 'she', 'her') THEN 'PERSON' WHEN lower(e.word) IN ('it', 'its') THEN 'OTHER' END AS kind, count(*) AS n FROM e GROUP BY ALL",
    "to_triples": _TR + " SELECT * FROM tr",
    "tuple_dedup": _KEYED + " SELECT doc_id, min(tuple_id) AS first_id, count(*) AS n FROM k GROUP BY doc_id, k, a",
    "tuple_hash": _T + " SELECT concat_ws(';', coalesce(subject.word, ''), coalesce(predicate.word, ''), coalesce(direct_object.word, ''), coalesce(indirect_object.word, ''), nullif(array_to_string(list_transform(list_filter(coalesce(adverbial, []), lambda a: a.word IS NOT NULL), lambda a: a.word), ';'), '')) AS key, count(*) AS n FROM t GROUP BY ALL",
    "equal_tuples": _KEYED + """, c AS (SELECT run, doc_id, sent_id, k, a, min(tuple_id) AS id, count(*) AS n FROM k GROUP BY ALL)
SELECT l.doc_id, l.sent_id, l.id AS left_id, r.id AS right_id, l.n AS left_rows, r.n AS right_rows FROM c l JOIN c r ON l.run = 'raw' AND r.run = 'decomposition' AND l.doc_id = r.doc_id AND l.sent_id = r.sent_id AND l.k = r.k
WHERE len(l.a) = len(r.a) AND list_has_all(r.a, l.a)""",
    "compare_tuples": _T + f""", x AS (SELECT * REPLACE (list_filter(coalesce(adverbial, []), lambda a: a.word IS NOT NULL) AS adverbial) FROM t WHERE subject.word IS NOT NULL AND predicate.word IS NOT NULL)
SELECT l.doc_id, l.sent_id, l.tuple_id AS left_id, r.tuple_id AS right_id FROM x l JOIN x r ON l.run = 'raw' AND r.run = 'decomposition' AND l.doc_id = r.doc_id AND l.sent_id = r.sent_id
WHERE {_similar('l.subject', 'r.subject')} AND {_similar('l.predicate', 'r.predicate')} AND {_both('direct_object')} AND {_both('indirect_object')} AND len(l.adverbial) = len(r.adverbial)
AND NOT list_bool_or(list_concat([FALSE], list_transform(l.adverbial, lambda a: NOT list_bool_or(list_concat([FALSE], list_transform(r.adverbial, lambda b: {_similar('a', 'b')}))))))""",
    "merge_runs": _KEYED + """, s AS (SELECT *, CASE run WHEN 'raw' THEN 0 ELSE 1 END AS side FROM k WHERE run IN ('raw', 'decomposition')),
p AS (SELECT *, sum(1 - side) OVER (PARTITION BY doc_id, sent_id, k) AS n, row_number() OVER (PARTITION BY doc_id, sent_id, k, side ORDER BY tuple_id) - 1 AS j FROM s),
q AS (SELECT *, CAST(CASE side WHEN 0 THEN j ELSE j % greatest(n, 1) END AS INT) AS copy FROM p)
SELECT doc_id, sent_id, copy, arg_min(tuple_id, (side, tuple_id)) AS first_id, count(*) AS n_merged, array_to_string(list_sort(list_distinct(flatten(list(a)))), chr(3)) AS adv FROM q GROUP BY doc_id, sent_id, k, copy""",
    "lexical_validate": _T + """, d AS (SELECT doc_id, text, array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'), ' ') AS toks FROM documents)
SELECT t.doc_id, tuple_id FROM t JOIN d USING (doc_id) WHERE (contains(text, subject.word) OR contains(toks, subject.word))
AND (direct_object.word IS NULL OR contains(text, direct_object.word) OR contains(toks, direct_object.word)) AND (indirect_object.word IS NULL OR contains(text, indirect_object.word) OR contains(toks, indirect_object.word))""",
    "overlap_collisions": _OV + " SELECT DISTINCT doc_id, sent_id, left_id, left_role, left_ord, right_id, right_role, right_ord FROM ov",
    "triple_eval": _TR + f""", c AS (SELECT doc_id, sent_id, run, lower({_REFINE.format('s')}) AS ks, p, lower({_REFINE.format('o')}) AS ko, label FROM tr),
g AS (SELECT DISTINCT doc_id, sent_id, ks, p, ko, label FROM c WHERE run = 'decomposition'),
n AS (SELECT (SELECT count(*) FROM c WHERE run = 'raw' AND EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id AND g.sent_id = c.sent_id AND g.ks IS NOT DISTINCT FROM c.ks AND g.p IS NOT DISTINCT FROM c.p AND g.ko IS NOT DISTINCT FROM c.ko AND g.label IS NOT DISTINCT FROM c.label)) AS correct,
  (SELECT count(*) FROM c WHERE run = 'decomposition') AS gold, (SELECT count(*) FROM c WHERE run = 'raw') AS extracted)
SELECT correct, gold, extracted, round(correct / nullif(gold, 0), 6) AS recall, round(correct / nullif(extracted, 0), 6) AS precision, round(2.0 * correct / nullif(CASE WHEN correct > 0 THEN gold + extracted END, 0), 6) AS f1 FROM n""",
    "graph_nodes": _E + f""" SELECT DISTINCT * FROM (SELECT doc_id, {_PID} AS node_id, e.word AS name, 'Predicate' AS type FROM e WHERE role = 'predicate' UNION ALL SELECT doc_id, e.word, e.word, 'Noun' FROM e WHERE {_USED}
  UNION ALL SELECT doc_id, 'Entity:' || x.uri, x.uri, 'Entity' FROM (SELECT doc_id, unnest(e.entity) AS x FROM e WHERE {_USED}) WHERE x.uri IS NOT NULL)""",
    "graph_edges": _ME + " SELECT * FROM ge",
    "means_edges": _E + f" SELECT DISTINCT doc_id, src, 'Entity:' || x.uri AS dst, 'means' AS relation FROM (SELECT doc_id, e.word AS src, unnest(e.entity) AS x FROM e WHERE {_USED}) WHERE x.uri IS NOT NULL",
    "reference_edges": _E + """, u AS (SELECT doc_id, e.word AS word, e.reference AS ref FROM e WHERE role <> 'predicate')
SELECT DISTINCT a.doc_id, a.word AS src, a.ref AS dst, 'same_as' AS relation FROM u a SEMI JOIN u b ON a.doc_id = b.doc_id AND a.ref = b.word WHERE a.ref <> '' AND a.ref <> a.word""",
    "merge_triples": _E + f""", ok AS (SELECT tuple_id FROM t WHERE subject.word IS NOT NULL AND predicate.word IS NOT NULL),
n AS (SELECT doc_id, {_PID} AS src, role, e.prep AS prep, concat_ws(' ', nullif(e.prep, ''), e.word) || ':' || sent_id || '-' || coalesce(list_min(e.word_index), -1) AS id FROM e SEMI JOIN ok USING (tuple_id) WHERE role <> 'predicate')
SELECT DISTINCT doc_id, src, id AS dst, CASE role WHEN 'subject' THEN 'subj' WHEN 'direct_object' THEN 'dobj' WHEN 'indirect_object' THEN 'iobj' ELSE prep END AS relation FROM n WHERE role <> 'adverbial' OR prep IS NOT NULL""",
    "collision_edges": _OV + " SELECT DISTINCT doc_id, least(ai, bi) AS a, greatest(ai, bi) AS b FROM ov WHERE ai <> bi",
    "refine_graph": _ME + " SELECT g.doc_id, g.src, g.dst, g.relation FROM ge g WHERE EXISTS (SELECT 1 FROM ge s WHERE s.doc_id = g.doc_id AND s.src = g.src AND s.relation = 'subj')",
    "collect_tuples": _ME + """ SELECT doc_id, src AS predicate_id, min(dst) FILTER (relation = 'subj') AS subject, min(dst) FILTER (relation = 'dobj') AS direct_object, min(dst) FILTER (relation = 'iobj') AS indirect_object,
  coalesce(array_to_string(list_sort(list(relation || ' ' || dst) FILTER (relation NOT IN ('subj', 'dobj', 'iobj'))), '||'), '') AS adverbial FROM ge GROUP BY doc_id, src HAVING min(dst) FILTER (relation = 'subj') IS NOT NULL""",
    "mention_link": _E + """, m AS (SELECT DISTINCT ON (mention_id) mention_id, doc_id, coalesce(nullif(surface_form, ''), word) AS w, ne_type FROM mentions),
ne AS (SELECT doc_id, w, arg_min(ne_type, (mention_id, ne_type)) AS t FROM m WHERE w IS NOT NULL AND ne_type IS NOT NULL GROUP BY ALL), ur AS (SELECT label AS w, min(uri) AS u FROM kb_things WHERE label IS NOT NULL GROUP BY ALL),
x AS (SELECT doc_id, sent_id, tuple_id, role, ord, e.word AS word, CASE WHEN regexp_matches(e.word, '^[tT]he\\s') THEN trim(regexp_replace(e.word, '^[tT]he\\s+', '')) END AS short FROM e WHERE role <> 'predicate' AND lower(e.word) NOT IN ('he', 'him', 'his', 'she', 'her', 'it', 'its'))
SELECT x.doc_id, sent_id, tuple_id, role, ord, word, coalesce(a.t, b.t) AS ne_type, coalesce(c.u, d.u) AS uri FROM x LEFT JOIN ne a ON a.doc_id = x.doc_id AND a.w = word LEFT JOIN ne b ON b.doc_id = x.doc_id AND b.w = short LEFT JOIN ur c ON c.w = word LEFT JOIN ur d ON d.w = short""",
    "entity_candidates": _C + " SELECT * FROM cand",
    "best_entity": _C + " SELECT doc_id, noun, arg_max(uri, (final_score, uri)) AS uri, max(final_score) AS final_score FROM cand WHERE final_score >= 0.5 GROUP BY doc_id, noun",
    "level1_matrix": _L1 + " SELECT doc_id, i, j, round(w, 6) AS w FROM w",
    "level2_matrix": _C + _W2 + " SELECT doc_id, i, j, round(w, 6) AS w FROM w2",
    "restart_walk": _L1 + ", " + _settled("r1", "r0", "w", 0.3, 80) + " SELECT doc_id, i, round(r, 6) AS r FROM r1",
    "score_tuples": _L1 + ", " + _settled("r1", "r0", "w", 0.3, 80) + " SELECT ge.doc_id, src, round(avg(r), 6) AS score FROM ge JOIN r1 ON ge.doc_id = r1.doc_id AND ge.dst = r1.i GROUP BY ALL",
    "entity_argmax": _chosen(0.3, 0.1) + " SELECT doc_id, noun, uri, round(score, 6) AS score FROM bst",
    "pruned_entities": _chosen(0.3, 0.1) + _PRUNED + " SELECT * FROM pruned",
    "greedy_independent_set": _greedy(0.3, 0.1) + " SELECT doc_id, id FROM kept",
    "joint_optimize": _RESOLVED + """ SELECT doc_id, src AS predicate_id, min(dst) FILTER (relation = 'subj') AS subject, min(dst) FILTER (relation = 'dobj') AS direct_object, min(dst) FILTER (relation = 'iobj') AS indirect_object,
  coalesce(array_to_string(list_sort(list(relation || ' ' || dst) FILTER (relation NOT IN ('subj', 'dobj', 'iobj'))), '||'), '') AS adverbial FROM rest GROUP BY doc_id, src""",
    "joint_tuples": _RESOLVED + _PRUNED + f""", mn AS (SELECT pruned.doc_id, src, list(substr(dst, 8)) AS uris FROM pruned SEMI JOIN rest ON rest.doc_id = pruned.doc_id AND rest.dst = pruned.src GROUP BY ALL),
el AS (SELECT e.doc_id, e.sent_id, e.tuple_id, e.role, e.ord, e.e AS e, CASE WHEN mn.uris IS NULL THEN list_transform(e.e.entity, lambda y: y.uri) ELSE list_filter(list_transform(e.e.entity, lambda y: y.uri), lambda u: list_contains(mn.uris, u)) END AS uris
  FROM e SEMI JOIN rest ON rest.doc_id = e.doc_id AND rest.src = concat_ws(':', e.doc_id, e.sent_id, e.tuple_id) AND rest.dst = e.e.word AND rest.relation = CASE e.role WHEN 'subject' THEN 'subj' WHEN 'direct_object' THEN 'dobj' WHEN 'indirect_object' THEN 'iobj' WHEN 'adverbial' THEN e.e.prep END
  LEFT JOIN mn ON mn.doc_id = e.doc_id AND mn.src = e.e.word WHERE e.role <> 'predicate')
SELECT t.doc_id, t.sent_id, t.tuple_id, t.negation, t.predicate.word AS predicate, """ + ", ".join(
        f"max(el.e.word) FILTER (role = '{r}') AS {r}, max(array_to_string(el.e.word_index, ' ')) FILTER (role = '{r}') AS {r}_index, max(el.e.reference) FILTER (role = '{r}') AS {r}_reference, max(array_to_string(list_sort(uris), ' ')) FILTER (role = '{r}') AS {r}_uris" for r in ("subject", "direct_object", "indirect_object")
    ) + """, coalesce(string_agg(concat_ws(' ', el.e.prep, el.e.word), '||' ORDER BY ord) FILTER (role = 'adverbial'), '') AS adverbial
FROM t JOIN el USING (doc_id, tuple_id) GROUP BY ALL HAVING count(*) FILTER (role = 'subject') > 0""",
    "semantic_edges": _TR + f""", ix AS (SELECT tuple_id, 'subject' AS role, 0 AS o, subject AS e FROM x UNION ALL SELECT tuple_id, 'dobj', 0, direct_object FROM x UNION ALL SELECT tuple_id, 'iobj', 0, indirect_object FROM x
  UNION ALL SELECT tuple_id, 'adv', generate_subscripts(adv, 1), unnest(adv) FROM x),
el AS (SELECT tuple_id, role, o, e.prep AS prep, concat_ws(' ', nullif(e.prep, ''), e.word) AS w, coalesce(list_min(e.word_index), -1) AS m FROM ix WHERE e.word IS NOT NULL),
ok AS (SELECT tuple_id, doc_id, sent_id, {_PID} AS p FROM x WHERE subject.word IS NOT NULL AND predicate.word IS NOT NULL),
os AS (SELECT ok.*, w || ':' || sent_id || '-' || m AS id, CASE role WHEN 'adv' THEN prep ELSE role END AS label, row_number() OVER (PARTITION BY ok.tuple_id ORDER BY CASE role WHEN 'dobj' THEN 0 WHEN 'iobj' THEN 1 ELSE 2 END, o) - 1 AS i FROM ok JOIN el USING (tuple_id) WHERE role <> 'subject'),
ns AS (SELECT ok.tuple_id, ok.doc_id, ok.p, w || ':' || sent_id || '-' || m AS s FROM ok JOIN el USING (tuple_id) WHERE role = 'subject'),
n AS (SELECT tuple_id, count(*) AS n FROM tr GROUP BY tuple_id), sx AS (SELECT ns.*, unnest(range(n.n)) AS i FROM ns JOIN n USING (tuple_id))
SELECT DISTINCT doc_id, p || '#' || i AS src, s AS dst, 'subj' AS relation FROM sx UNION SELECT doc_id, p || '#' || i, id, label FROM os WHERE label IS NOT NULL""",
    "kb_neighbours": _KT + ", b AS (SELECT head AS uri, tail AS neighbour FROM k UNION ALL SELECT tail, head FROM k) SELECT uri, neighbour FROM b WHERE neighbour IN (SELECT uri FROM kb_things)",
    "kb_memo": _KT + ", b AS (SELECT head AS uri, tail AS neighbour FROM k UNION SELECT tail, head FROM k), n AS (SELECT * FROM b WHERE neighbour IN (SELECT uri FROM kb_things)) SELECT t.uri, n.neighbour FROM (SELECT DISTINCT uri FROM kb_things WHERE uri IS NOT NULL) t LEFT JOIN n USING (uri)",
    "kb_relations": _KT + " SELECT head, tail, array_to_string(list_sort(list(rel)), ',') AS rels FROM k GROUP BY ALL",
    "kb_heads": _KT + " SELECT rel, tail, count(*) AS n_heads FROM k GROUP BY ALL",
    "kb_tails": _KT + " SELECT head, rel, count(*) AS n_tails FROM k GROUP BY ALL",
    "kb_paths": _KT + " SELECT least(a.head, b.tail) AS u1, greatest(a.head, b.tail) AS u2, count(*) AS n_paths FROM k a JOIN k b ON a.tail = b.head WHERE a.head <> b.tail GROUP BY ALL",
    "kb_relatedness": _KT + ", " + _REL + " SELECT * FROM rel",
    "kb_pages": "SELECT DISTINCT uri, 'page:' || uri AS url FROM kb_things WHERE uri IS NOT NULL",
}


def _case_sql() -> str:
    """The fixed tuples as a table in SQL."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    kind = "STRUCT(word VARCHAR, word_index INT[], prep VARCHAR, reference VARCHAR, ne_type VARCHAR, entity STRUCT(uri VARCHAR, final_score DOUBLE)[])"
    el = lambda e: f"CAST(NULL AS {kind})" if e is None else f"CAST({{'word': {text(e[0])}, 'word_index': [0], 'prep': {text(e[2])}, 'reference': {text(e[3])}, 'ne_type': NULL, 'entity': NULL}} AS {kind})"
    rows = [f"({d}, {s}, {i}, '{run}', 'SVO', FALSE, {el(a)}, {el(b)}, {el(c)}, {el(x)}, CAST([{', '.join(map(el, adv))}] AS {kind}[]), TIMESTAMP '2020-01-01')" for d, s, i, run, _, _, a, b, c, x, adv in _case_rows()]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) v(doc_id, sent_id, tuple_id, run, clause_type, negation, subject, predicate, direct_object, indirect_object, adverbial, loaded_at))"


ORACLE |= {f"{n}_cases": ORACLE[n].replace("FROM tuples", f"FROM {_case_sql()}") for n in ("equal_tuples", "compare_tuples", "merge_runs", "triple_eval", "reference_edges")}
_LINKS, _LINKED = ORACLE["mention_link"].rsplit("\nSELECT x.doc_id", 1)
ORACLE["annotated_graph"] = _LINKS + ", lk AS (SELECT x.doc_id" + _LINKED + ")" + _ME.removeprefix(_E) + " SELECT * FROM ge UNION SELECT doc_id, word, 'Entity:' || uri, 'means' FROM lk WHERE uri IS NOT NULL AND EXISTS (SELECT 1 FROM ge WHERE ge.doc_id = lk.doc_id AND ge.dst = lk.word)"
ORACLE["graph_roundtrip"] = _ME + f""" SELECT doc_id, src, relation, dst AS name, 'Noun' AS type FROM ge
UNION SELECT doc_id, src, 'means', uri, 'Entity' FROM (SELECT doc_id, src, x.uri AS uri FROM (SELECT doc_id, e.word AS src, unnest(e.entity) AS x FROM e WHERE {_USED})) WHERE uri IS NOT NULL"""
ORACLE["stage_roundtrip"] = ORACLE["to_triples"]
