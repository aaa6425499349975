"""Queries over texts, annotated sentences and tuple extraction, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import algebra, nested, rewrite, trees
from factloom.plans import facts, golden, training
from factloom.runtime import table
from factloom.sources import annotations, tuple_text

KEYS = ["ann_id", "sent_id"]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = nested.once(table(spark, sf_dir, "annotations").select("ann_id", "payload", "loaded_at"), "ann_id", "loaded_at")
    return annotations.sentences(once, "ann_id", "payload")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.tokens(sentences(spark, sf_dir))


def conllu_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.tokens(annotations.from_conllu(annotations.to_conllu(sentences(spark, sf_dir)))).drop("ner")


def tokenize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.size(tx.tokenize(F.col("text"))), F.lit(0)).alias("n_tokens"))


def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.whitespace_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("sent_id", "sentence"))


def clean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kb_things").select("uri", tx.clean(F.col("label")).alias("name"))


def pos_tag_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).groupBy("pos").agg(F.count("*").alias("n"), F.count(F.when(tx.is_copula(F.col("word")), 1)).alias("n_copula"))


def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.children(sentences(spark, sf_dir))


def tree_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.relations(sentences(spark, sf_dir))


def tree_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trees.enriched(sentences(spark, sf_dir)).filter("pos LIKE 'VB%'")
    return e.select(*KEYS, "i", F.explode(trees.subjects()).alias("s")).select(*KEYS, "i", F.col("s.i").alias("subject_i"), F.col("s.word").alias("subject"))


def tree_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trees.enriched(sentences(spark, sf_dir))
    return e.select(*KEYS, "i", F.explode(trees.objects()).alias("o")).select(*KEYS, "i", F.col("o.i").alias("object_i"), F.col("o.word").alias("object"))


def conjunction_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.conjunction_chains(sentences(spark, sf_dir))


def conjunction_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.conjunction_span(sentences(spark, sf_dir))


def subtree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.subtrees(sentences(spark, sf_dir)).groupBy(*KEYS, "i").agg(F.count("*").alias("n"))


def subtree_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.subtrees(sentences(spark, sf_dir), ["conj", "cc", "punct"]).groupBy(*KEYS, "i").agg(F.count("*").alias("n"))


def trim_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.trimmed(sentences(spark, sf_dir))


def noun_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.noun_chunks(sentences(spark, sf_dir))


def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.kept_tokens(sentences(spark, sf_dir))


def phrase_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(spark, sf_dir)
    return trees.phrase_heads(trees.noun_chunks(s).withColumn("span_id", F.col("lo")), s)


def clause_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.clause_points(sentences(spark, sf_dir))


def clause_points_spacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.clause_points(sentences(spark, sf_dir), "spacy")


def clause_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.typed_verbs(sentences(spark, sf_dir)).groupBy("clause_type").agg(F.count("*").alias("n"))


def clause_type_spacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.typed_verbs(sentences(spark, sf_dir), "spacy").groupBy("clause_type").agg(F.count("*").alias("n"))


def negation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.typed_verbs(sentences(spark, sf_dir)).select(*KEYS, "i", "word", "negation")


def sv_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.head_tuples(sentences(spark, sf_dir), "SV")


def svo_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.head_tuples(sentences(spark, sf_dir), "SVO")


def svoo_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.head_tuples(sentences(spark, sf_dir), "SVOO")


def copula_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.head_tuples(sentences(spark, sf_dir), "SVc")


def extra_adverbial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.extra_adverbials(sentences(spark, sf_dir)).filter("nth > 1")


def adverbial_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.extra_adverbials(sentences(spark, sf_dir)).filter("prep IS NOT NULL")


def _flat(how: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: golden.flat(rewrite.extract(sentences(spark, sf_dir), how), KEYS)


def verb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.verb_chunks(sentences(spark, sf_dir))


def extract_from_conllu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser-free path: CoNLL-U in, tuples out, by clause type."""
    back = annotations.from_conllu(annotations.to_conllu(sentences(spark, sf_dir)))
    return rewrite.extract(back).groupBy("clause_type").agg(F.count("*").alias("n"))


def sentence_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with the number of its tuples; those without any are kept."""
    s = sentences(spark, sf_dir)
    per = rewrite.extract(s, "clauses").groupBy(*KEYS).agg(F.count("*").alias("n"))
    return s.select(*KEYS).join(per, KEYS, "left").select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"))


def lexical_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.clauses(sentences(spark, sf_dir), simplify=True)


def clause_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.clauses(sentences(spark, sf_dir))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = nested.once(table(spark, sf_dir, "annotations").select("ann_id", "payload", "loaded_at"), "ann_id", "loaded_at")
    m = nested.table_of(nested.shred(once, "ann_id", "payload", [training.COREF]), "ann_id", training.COREF)
    number = lambda c: F.col(c).cast("int").alias(c)
    return m.select("ann_id", "parent", "child", "text", number("startIndex"), number("endIndex"), number("sentNum"), (F.col("isRepresentativeMention") == "true").alias("main"))


def coref_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as token spans of the whole text, with the span of their cluster's representative."""
    sizes = sentences(spark, sf_dir).select("ann_id", (F.col("sent_id") + 1).alias("sentNum"), F.size("tokens").alias("n"))
    before = Window.partitionBy("ann_id").orderBy("sentNum").rowsBetween(Window.unboundedPreceding, -1)  # the sentences of one record
    starts = sizes.select("ann_id", "sentNum", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    m = _mentions(spark, sf_dir).join(starts, ["ann_id", "sentNum"])
    placed = m.select("ann_id", "parent", "main", "child", (F.col("base") + F.col("startIndex") - 1).alias("start"), (F.col("base") + F.col("endIndex") - 1).alias("end"))
    main = placed.filter("main").groupBy("ann_id", "parent").agg(F.min(F.struct("child", "start", "end")).alias("r"))
    return placed.join(main, ["ann_id", "parent"]).select("ann_id", "start", "end", F.col("r.start").alias("ref_start"), F.col("r.end").alias("ref_end")).distinct()


def pronoun_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single pronouns that refer to a mention which is none, with its text."""
    m = _mentions(spark, sf_dir)
    main = m.filter("main").groupBy("ann_id", "parent").agg(F.min(F.struct("child", "text")).alias("r")).select("ann_id", "parent", F.col("r.text").alias("reference"))
    pronoun = F.lower("text").isin("it", "he", "she", "him", "her", "they", "them") & (F.col("endIndex") - F.col("startIndex") == 1)
    return m.filter(pronoun & ~F.coalesce(F.col("main"), F.lit(False))).join(main, ["ann_id", "parent"]).select("ann_id", "sentNum", "startIndex", "text", "reference")


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples written in the text format and read again: one row per tuple line, whole."""
    t = facts.tuples(spark, sf_dir).select("doc_id", "sent_id", "tuple_id", "negation", *algebra.ROLES, "adverbial")
    texts = tuple_text.to_text(t, "doc_id", "sent_id", F.concat(F.lit("sentence "), F.coalesce(F.col("sent_id").cast("string"), F.lit("unknown"))), "tuple_id")
    back = tuple_text.parse(texts)
    nouns = [r for r in algebra.ROLES if r != "predicate"]
    return back.select("doc_id", "sentence", *[F.col(f"{r}.word").alias(r) for r in algebra.ROLES], "negation", *[F.col(f"{r}.reference").alias(f"{r}_reference") for r in nouns], *[F.col(f"{r}.word_index").alias(f"{r}_index") for r in algebra.ROLES], F.transform("adverbial", lambda a: F.struct(a["prep"].alias("prep"), a["word"].alias("word"), a["word_index"].alias("word_index"))).alias("adverbial"))


def tuple_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(spark, sf_dir)
    places = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    adv = F.transform("adverbial", lambda a: F.concat(F.coalesce(a["prep"], F.lit("-")), F.lit("|"), a["word"], F.lit("|"), places(a["word_index"])))
    index = {f"{r}_index": places(f"{r}_index") for r in algebra.ROLES}
    return back.withColumns(index).withColumn("adverbial", F.array_join(adv, "||"))


def tuple_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples as JSON, with the fields that the JSON then has."""
    j = tuple_text.to_json(facts.tuples(spark, sf_dir))
    got = lambda path, name: F.get_json_object("json", path).alias(name)
    return j.select("tuple_id", *[got(f"$.{r}.word", r) for r in algebra.ROLES], got("$.subject.reference", "reference"), got("$.clause_type", "clause_type"), got("$.negation", "negation"), got("$.sent_id", "sent_id"), got("$.adverbial[0].word", "first_adverbial"), got("$.adverbial[0].prep", "first_prep"))


def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.noun_phrases(sentences(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [
        "tokens", "conllu_roundtrip", "tokenize_count", "whitespace_tokens", "sentence_split", "clean_words", "pos_tag_hist", "tree_children", "tree_relations", "tree_subjects", "tree_objects", "conjunction_chain", "conjunction_span",
        "subtree_size", "subtree_pruned", "trim_clauses", "noun_chunks", "kept_tokens", "phrase_head", "clause_points", "clause_points_spacy", "clause_type_hist", "clause_type_spacy", "negation_flag", "sv_tuples", "svo_tuples", "svoo_tuples", "copula_svc",
        "extra_adverbial", "adverbial_attach", "verb_chunks", "extract_from_conllu", "sentence_tuples", "lexical_decomposition", "clause_rewrite", "coref_map", "pronoun_references", "tuple_text_roundtrip", "tuple_json", "noun_phrases",
    ]
    return {n: globals()[n] for n in names} | {"extract_raw": _flat("raw"), "extract_clauses": _flat("clauses"), "extract_simplified": _flat("simplified")}


_TOK = """WITH RECURSIVE a AS (SELECT ann_id, arg_min(payload, loaded_at) AS p FROM annotations GROUP BY ann_id),
rec AS (SELECT ann_id, coalesce(json_extract(d, '$.result'), d) AS d FROM (SELECT ann_id, TRY_CAST(p AS JSON) AS d FROM a) WHERE d IS NOT NULL),
sl AS (SELECT ann_id, json_extract(d, '$.sentences[*]') AS l FROM rec), st AS (SELECT ann_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS sent_id, unnest(l) AS s FROM sl),
tl AS (SELECT ann_id, sent_id, json_extract(s, '$.tokens[*]') AS l FROM st), tk AS (SELECT ann_id, sent_id, CAST(generate_subscripts(l, 1) AS INT) AS i, unnest(l) AS t FROM tl),
dl AS (SELECT ann_id, sent_id, list_concat(json_extract(s, '$.basicDependencies[*]'), json_extract(s, '$."basic-dependencies"[*]')) AS l FROM st),
dp AS (SELECT ann_id, sent_id, generate_subscripts(l, 1) AS o, unnest(l) AS x FROM dl),
dq AS (SELECT ann_id, sent_id, CAST(x->>'dependent' AS INT) AS i, arg_min(CAST(x->>'governor' AS INT), o) AS head, arg_min(lower(trim(x->>'dep')), o) AS dep FROM dp WHERE x->>'dependent' IS NOT NULL GROUP BY ALL),
tok AS (SELECT ann_id, sent_id, i, coalesce(t->>'word', t->>'originalText') AS word, t->>'pos' AS pos, t->>'ner' AS ner, head,
  CASE dep WHEN 'obj' THEN 'dobj' WHEN 'obl' THEN 'nmod' WHEN 'nsubj:pass' THEN 'nsubjpass' WHEN 'aux:pass' THEN 'auxpass' WHEN 'csubj:pass' THEN 'csubjpass' WHEN 'dative' THEN 'iobj' WHEN 'nmod:of' THEN 'nmod' WHEN 'prt' THEN 'compound:prt' WHEN '' THEN NULL ELSE dep END AS rel
  FROM tk LEFT JOIN dq USING (ann_id, sent_id, i))"""
_ON = "{0}.ann_id = {1}.ann_id AND {0}.sent_id = {1}.sent_id"


def _on(a: str, b: str) -> str:
    return _ON.format(a, b)


_SUBJ = _TOK + f""", su AS (SELECT ann_id, sent_id, head, min(i) AS s FROM tok WHERE rel IN ('nsubj', 'nsubjpass') GROUP BY ALL),
fs AS (SELECT v.ann_id, v.sent_id, v.i, v.word AS v, v.pos, v.rel, v.head, coalesce(o.s, CASE WHEN v.rel = 'conj' THEN u.s END) AS s FROM tok v LEFT JOIN su o ON {_on('v', 'o')} AND o.head = v.i LEFT JOIN su u ON {_on('v', 'u')} AND u.head = v.head),
sj AS (SELECT fs.ann_id, fs.sent_id, fs.i, x.i AS si, x.word AS subject FROM fs JOIN tok x ON {_on('fs', 'x')} AND (x.i = fs.s OR (x.head = fs.s AND x.rel = 'conj'))),
ob AS (SELECT o.ann_id, o.sent_id, o.head AS i, o.rel, x.i AS oi, x.word AS object FROM tok o JOIN tok x ON {_on('o', 'x')} AND (x.i = o.i OR (x.head = o.i AND x.rel = 'conj')) WHERE o.rel IN ('dobj', 'iobj')),
kr AS (SELECT ann_id, sent_id, head AS i, list(rel) AS r FROM tok WHERE rel IS NOT NULL GROUP BY ALL),
vb AS (SELECT fs.*, coalesce(k.r, []) AS r, coalesce(p.r, []) AS pr FROM fs LEFT JOIN kr k ON {_on('fs', 'k')} AND k.i = fs.i LEFT JOIN kr p ON {_on('fs', 'p')} AND p.i = fs.head WHERE fs.pos LIKE 'VB%'),
ty AS (SELECT *, CASE WHEN v IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being') AND rel = 'cop' THEN 'SVc'
  WHEN v IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being') AND rel IN ('aux', 'auxpass') THEN NULL
  WHEN v IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being') AND (s IS NOT NULL OR list_has_any(pr, ['nsubj', 'nsubjpass'])) AND list_has_any(r, ['ccomp', 'xcomp', 'expl'])
    THEN CASE WHEN list_contains(r, 'ccomp') THEN 'SVcC' WHEN list_contains(r, 'xcomp') THEN 'SVcX' ELSE 'SVb' END
  WHEN s IS NULL THEN NULL WHEN list_has_all(r, ['dobj', 'iobj']) THEN 'SVOO' WHEN list_has_all(r, ['dobj', 'xcomp']) THEN 'SVOC' WHEN list_contains(r, 'dobj') THEN 'SVO'
  WHEN list_contains(r, 'xcomp') THEN 'SVX' WHEN list_contains(r, 'ccomp') THEN 'SVC' ELSE 'SV' END AS clause_type, list_contains(CASE WHEN rel = 'cop' THEN pr ELSE r END, 'neg') AS negation FROM vb)"""
_DOWN = _TOK + f""", lk AS (SELECT ann_id, sent_id, i, nullif(head, 0) AS up, rel FROM tok WHERE head IS NOT NULL),
w AS (SELECT ann_id, sent_id, i AS node, i, rel, coalesce(rel IN ('conj', 'cc', 'punct'), FALSE) AS cut, 0 AS d FROM lk
  UNION ALL SELECT w.ann_id, w.sent_id, w.node, l.i, l.rel, cut OR coalesce(l.rel IN ('conj', 'cc', 'punct'), FALSE), d + 1 FROM w JOIN lk c ON {_on('w', 'c')} AND c.i = w.i JOIN lk l ON {_on('w', 'l')} AND l.i = c.up WHERE d < 250),
stuck AS (SELECT DISTINCT ann_id, sent_id, node FROM w WHERE d = 250), sb AS (SELECT * FROM w ANTI JOIN stuck USING (ann_id, sent_id, node))"""
_CHUNK = _TOK + """, cd AS (SELECT *, CASE WHEN regexp_matches(pos, '^(NN|PRP$)') THEN 'N' WHEN regexp_matches(pos, '^(DT|JJ|CD|PRP\\$|POS)') THEN 'M' ELSE 'x' END AS c FROM tok),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY ann_id, sent_id ORDER BY i) AS g FROM cd WHERE c <> 'x'),
hi AS (SELECT ann_id, sent_id, g, min(i) AS lo, max(i) FILTER (c = 'N') AS hi FROM isl GROUP BY ALL)
, ch AS (SELECT h.ann_id, h.sent_id, h.lo, h.hi, string_agg(coalesce(word, ''), ' ' ORDER BY i) AS words FROM hi h JOIN isl x ON h.ann_id = x.ann_id AND h.sent_id = x.sent_id AND h.g = x.g AND x.i <= h.hi WHERE h.hi IS NOT NULL GROUP BY ALL)"""


def _points(spacy: bool) -> str:
    labels = "'advcl', 'acl', 'acl:relcl', 'relcl', 'appos', 'ccomp', 'csubj'" + ("" if spacy else ", 'xcomp', 'nmod'")
    nj = "WHEN c.pos LIKE 'NN%' THEN 'NN' WHEN c.pos = 'JJ' THEN 'JJ'"
    return _SUBJ + f""", pt AS (SELECT c.*, p.pos AS pp, q.word AS prev, coalesce(k.r, []) AS r, coalesce(u.r, []) AS pr,
  EXISTS (SELECT 1 FROM tok m WHERE {_on('m', 'c')} AND m.i > c.head AND m.i < c.i AND m.word = ',') AS comma, EXISTS (SELECT 1 FROM tok g WHERE {_on('g', 'c')} AND g.head = c.i AND g.rel = 'case' AND g.pos = 'VBG') AS gc
  FROM tok c LEFT JOIN tok p ON {_on('c', 'p')} AND p.i = c.head LEFT JOIN tok q ON {_on('c', 'q')} AND q.i = c.i - 1 LEFT JOIN kr k ON {_on('c', 'k')} AND k.i = c.i LEFT JOIN kr u ON {_on('c', 'u')} AND u.i = c.head WHERE c.rel IN ({labels}))
SELECT ann_id, sent_id, i, rel, coalesce(CASE WHEN rel = 'appos' THEN CASE WHEN pp LIKE 'NN%' THEN 'APPOS' END
  WHEN rel = 'advcl' THEN CASE WHEN c.pos IN ('VBG', 'VBN') AND NOT list_has_any(r, ['nsubj', 'nsubjpass']) THEN 'PARADVCL' WHEN prev = 'to' THEN 'INFINITE' WHEN list_has_any(r, ['nsubj', 'nsubjpass']) THEN 'ADVCL' {nj if spacy else ''} END
  WHEN rel IN ('acl', 'acl:relcl', 'relcl') THEN CASE WHEN c.pos IN ('VBG', 'VBN') AND NOT list_has_any(r, ['nsubj', 'nsubjpass']) THEN 'PARACL' WHEN prev = 'to' THEN 'INFINITE' WHEN head < i THEN 'ACL' END
  WHEN rel = 'ccomp' THEN CASE WHEN list_has_any(r, ['nsubj', 'nsubjpass']) THEN CASE WHEN NOT list_contains(pr, 'dobj') THEN CASE WHEN pp LIKE 'NN%' THEN 'APPOSCL' ELSE 'OBJCL' END END {'' if spacy else nj} END
  WHEN rel = 'xcomp' THEN CASE WHEN c.pos IN ('VBG', 'VBN') AND i > head AND comma THEN 'PARADVCL' END WHEN rel = 'csubj' THEN 'SUBJCL'
  WHEN rel = 'nmod' THEN CASE WHEN gc AND pp LIKE 'NN%' THEN 'PARACL' WHEN gc AND pp LIKE 'VB%' THEN 'PARADVCL' END END, 'CORE') AS kind FROM pt c"""


_NM = _TOK + f""", n AS (SELECT c.ann_id, c.sent_id, c.head AS verb, CAST(row_number() OVER (PARTITION BY c.ann_id, c.sent_id, c.head ORDER BY c.i) AS INT) AS nth, c.i, c.word FROM tok c JOIN tok v ON {_on('c', 'v')} AND v.i = c.head WHERE c.rel = 'nmod' AND v.pos LIKE 'VB%'),
pn AS (SELECT n.ann_id, n.sent_id, verb, nth, n.i, (SELECT arg_min(k.word, k.i) FROM tok k WHERE {_on('k', 'n')} AND k.head = n.i AND k.rel = 'case') AS prep, n.word FROM n)"""
_CR = """WITH a AS (SELECT ann_id, arg_min(payload, loaded_at) AS p FROM annotations GROUP BY ann_id),
rec AS (SELECT ann_id, coalesce(json_extract(d, '$.result'), d) AS d FROM (SELECT ann_id, TRY_CAST(p AS JSON) AS d FROM a) WHERE d IS NOT NULL),
ck AS (SELECT ann_id, d, unnest(json_keys(d, '$.corefs')) AS parent FROM rec), cl AS (SELECT ann_id, parent, CAST(json_extract(d, '$.corefs."' || parent || '"') AS JSON[]) AS l FROM ck),
cm AS (SELECT ann_id, parent, generate_subscripts(l, 1) AS child, unnest(l) AS x FROM cl),
m AS (SELECT ann_id, parent, child, x->>'text' AS text, CAST(x->>'startIndex' AS INT) AS startIndex, CAST(x->>'endIndex' AS INT) AS endIndex, CAST(x->>'sentNum' AS INT) AS sentNum, (x->>'isRepresentativeMention') = 'true' AS main FROM cm)"""
_PARTS = "(1 + len(regexp_extract_all(regexp_replace(ltrim({0}.word, ' '), '([^ ]) $', '\\1'), ' +')))"
_PLACED = f"CASE WHEN {_PARTS} = len({{0}}.word_index) OR ({{0}}.prep IS NOT NULL AND {_PARTS} + 1 = len({{0}}.word_index)) THEN array_to_string({{0}}.word_index, ' ') ELSE '' END"
_PLACED_ADV = _PLACED.replace("({0}.prep IS NOT NULL AND", f"(({{0}}.prep IS NOT NULL OR {_PARTS} > 1) AND")
_ROUND = (
    "WITH t AS (SELECT DISTINCT ON (tuple_id) * FROM tuples ORDER BY tuple_id, loaded_at) SELECT doc_id, 'sentence ' || coalesce(CAST(sent_id AS VARCHAR), 'unknown') AS sentence, coalesce(negation, FALSE) AS negation, "
    + ", ".join(f"CASE WHEN {r}.word IS NOT NULL THEN concat_ws(' ', {r}.prep, {r}.word) END AS {r}, CASE WHEN {r}.word IS NOT NULL THEN {_PLACED.format(r)} END AS {r}_index" for r in algebra.ROLES)
    + ", " + ", ".join(f"CASE WHEN {r}.word IS NOT NULL THEN {r}.reference END AS {r}_reference" for r in algebra.ROLES if r != "predicate")
    + ", array_to_string(list_transform(list_filter(coalesce(adverbial, []), lambda a: a.word IS NOT NULL), lambda a: coalesce(a.prep, '-') || '|' || a.word || '|' || " + _PLACED_ADV.format("a") + "), '||') AS adverbial FROM t"
)

ORACLE = {
    "tokens": _TOK + " SELECT * FROM tok",
    "conllu_roundtrip": _TOK + " SELECT * EXCLUDE (ner) FROM tok",
    "tokenize_count": "SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')), 0) AS n_tokens FROM documents",
    "whitespace_tokens": "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY token",
    "sentence_split": "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, ';', ';' || chr(1)), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^ +| +$', '', 'g')), lambda s: s <> '') AS l FROM documents) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS sent_id, unnest(l) AS sentence FROM l",
    "clean_words": "SELECT uri, split_part(label, '(', 1) AS name FROM kb_things",
    "pos_tag_hist": _TOK + " SELECT pos, count(*) AS n, count(*) FILTER (word IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being')) AS n_copula FROM tok GROUP BY pos",
    "tree_children": _TOK + f" SELECT p.ann_id, p.sent_id, p.i, c.i AS child, c.word, c.rel FROM tok p JOIN tok c ON {_on('p', 'c')} AND c.head = p.i",
    "tree_relations": _TOK + f" SELECT p.ann_id, p.sent_id, p.i, CASE WHEN p.head = 0 THEN 'root' ELSE p.rel END AS incoming, coalesce((SELECT string_agg(coalesce(c.rel, ''), ',' ORDER BY coalesce(c.rel, '')) FROM tok c WHERE {_on('p', 'c')} AND c.head = p.i), '') AS outgoing FROM tok p",
    "tree_subjects": _SUBJ + f" SELECT sj.ann_id, sj.sent_id, sj.i, si AS subject_i, subject FROM sj JOIN tok v ON {_on('sj', 'v')} AND v.i = sj.i WHERE v.pos LIKE 'VB%'",
    "tree_objects": _SUBJ + f" SELECT ob.ann_id, ob.sent_id, ob.i, oi AS object_i, object FROM ob JOIN tok v ON {_on('ob', 'v')} AND v.i = ob.i WHERE ob.rel = 'dobj'",
    "conjunction_span": _SUBJ + f""", b AS (SELECT ann_id, sent_id, i, min(si) AS lo, max(si) AS hi FROM sj GROUP BY ALL HAVING count(*) > 1)
SELECT b.ann_id, b.sent_id, b.i, string_agg(coalesce(x.word, ''), ' ' ORDER BY x.i) AS subject FROM b JOIN tok v ON {_on('b', 'v')} AND v.i = b.i AND v.pos LIKE 'VB%' JOIN tok x ON {_on('b', 'x')} AND x.i BETWEEN lo AND hi GROUP BY ALL""",
    "conjunction_chain": _TOK + f""", w AS (SELECT ann_id, sent_id, i AS member, head AS i, 1 AS step FROM tok WHERE rel = 'conj' AND head IS NOT NULL
  UNION ALL SELECT w.ann_id, w.sent_id, member, t.head, step + 1 FROM w JOIN tok t ON {_on('w', 't')} AND t.i = w.i WHERE t.rel = 'conj' AND t.head IS NOT NULL AND step < 200)
SELECT ann_id, sent_id, i, member, step FROM w""",
    "subtree_size": _DOWN + " SELECT ann_id, sent_id, i, count(*) AS n FROM sb GROUP BY ALL",
    "subtree_pruned": _DOWN + " SELECT ann_id, sent_id, i, count(*) AS n FROM sb WHERE NOT cut GROUP BY ALL",
    "trim_clauses": _DOWN + f""", ct AS (SELECT ann_id, sent_id, i FROM tok t WHERE rel IN ('acl', 'advcl', 'acl:relcl', 'relcl') OR rel = 'nmod' AND EXISTS (SELECT 1 FROM tok g WHERE {_on('g', 't')} AND g.head = t.i AND g.rel = 'case' AND g.pos = 'VBG')), gone AS (SELECT DISTINCT ann_id, sent_id, node FROM sb JOIN ct USING (ann_id, sent_id, i))
SELECT t.ann_id, t.sent_id, coalesce(string_agg(coalesce(word, ''), ' ' ORDER BY t.i) FILTER (g.node IS NULL), '') AS text FROM tok t LEFT JOIN gone g ON {_on('t', 'g')} AND g.node = t.i GROUP BY t.ann_id, t.sent_id""",
    "noun_chunks": _CHUNK + " SELECT * FROM ch",
    "kept_tokens": _CHUNK + f""", hd AS (SELECT ch.ann_id, ch.sent_id, lo, ch.hi, min(t.i) FILTER (NOT coalesce(head BETWEEN lo AND ch.hi, FALSE)) AS h FROM ch JOIN tok t ON {_on('ch', 't')} AND t.i BETWEEN lo AND ch.hi WHERE ch.hi > lo GROUP BY ALL)
SELECT t.ann_id, t.sent_id, t.i, t.word FROM tok t LEFT JOIN hd ON {_on('hd', 't')} AND t.i BETWEEN lo AND hd.hi WHERE hd.lo IS NULL OR t.i IS NOT DISTINCT FROM hd.h OR coalesce(t.rel IN ('det', 'nmod:poss'), FALSE)""",
    "phrase_head": _CHUNK + f" SELECT ch.ann_id, ch.sent_id, lo AS span_id, CASE WHEN count(*) FILTER (NOT coalesce(head BETWEEN lo AND hi, FALSE)) = 1 THEN min(t.i) FILTER (NOT coalesce(head BETWEEN lo AND hi, FALSE)) END AS head_i FROM ch JOIN tok t ON {_on('ch', 't')} AND t.i BETWEEN lo AND hi GROUP BY ch.ann_id, ch.sent_id, lo, hi",
    "clause_points": _points(False),
    "clause_points_spacy": _points(True),
    "clause_type_hist": _SUBJ + " SELECT clause_type, count(*) AS n FROM ty GROUP BY clause_type",
    "negation_flag": _SUBJ + " SELECT ann_id, sent_id, i, v AS word, negation FROM ty",
    "sv_tuples": _SUBJ + f" SELECT ty.ann_id, ty.sent_id, ty.i, subject, v AS predicate, negation FROM ty JOIN sj ON {_on('ty', 'sj')} AND sj.i = ty.i WHERE clause_type = 'SV'",
    "svo_tuples": _SUBJ + f" SELECT ty.ann_id, ty.sent_id, ty.i, subject, v AS predicate, negation, object FROM ty JOIN sj ON {_on('ty', 'sj')} AND sj.i = ty.i JOIN ob ON {_on('ty', 'ob')} AND ob.i = ty.i AND ob.rel = 'dobj' WHERE clause_type = 'SVO'",
    "svoo_tuples": _SUBJ + f" SELECT ty.ann_id, ty.sent_id, ty.i, subject, v AS predicate, negation, d.object, x.object AS indirect_object FROM ty JOIN sj ON {_on('ty', 'sj')} AND sj.i = ty.i JOIN ob d ON {_on('ty', 'd')} AND d.i = ty.i AND d.rel = 'dobj' JOIN ob x ON {_on('ty', 'x')} AND x.i = ty.i AND x.rel = 'iobj' WHERE clause_type = 'SVOO'",
    "copula_svc": _SUBJ + f""", cp AS (SELECT p.ann_id, p.sent_id, p.i AS p, x.i AS o, x.word AS object FROM tok p JOIN tok x ON {_on('p', 'x')} AND (x.i = p.i OR (x.head = p.i AND x.rel = 'conj' AND NOT EXISTS (SELECT 1 FROM tok c WHERE {_on('c', 'x')} AND c.head = x.i AND c.rel = 'cop'))) WHERE NOT coalesce(x.pos LIKE 'VB%', FALSE))
SELECT ty.ann_id, ty.sent_id, ty.i, subject, v AS predicate, object, list_contains(pr, 'neg') AS negation FROM ty JOIN sj ON {_on('ty', 'sj')} AND sj.i = ty.head JOIN cp ON {_on('ty', 'cp')} AND cp.p = ty.head WHERE clause_type = 'SVc'""",
    "extra_adverbial": _NM + " SELECT * FROM pn WHERE nth > 1",
    "verb_chunks": _TOK + """, cd AS (SELECT ann_id, sent_id, string_agg(CASE WHEN pos LIKE 'VB%' THEN 'V' WHEN pos IN ('IN', 'TO', 'PR') THEN 'p' WHEN regexp_matches(pos, '^(NN|JJ|RB.*|PRP.*|DT)$') THEN 'w' ELSE 'x' END, '' ORDER BY i) AS c FROM tok GROUP BY ALL),
vc AS (SELECT t.ann_id, t.sent_id, t.i AS lo, CASE WHEN regexp_matches(substr(c, i), '^Vpp') THEN 3 WHEN regexp_matches(substr(c, i), '^Vp?w+p') THEN length(regexp_extract(substr(c, i), '^(Vp?w+)p', 1)) WHEN regexp_matches(substr(c, i), '^Vp') THEN 2 ELSE 1 END AS n FROM tok t JOIN cd USING (ann_id, sent_id) WHERE pos LIKE 'VB%')
SELECT vc.ann_id, vc.sent_id, lo, CAST(lo + n - 1 AS INT) AS hi, string_agg(coalesce(word, ''), ' ' ORDER BY i) AS words FROM vc JOIN tok t ON t.ann_id = vc.ann_id AND t.sent_id = vc.sent_id AND i BETWEEN lo AND lo + n - 1 WHERE n > 1 GROUP BY ALL""",
    "adverbial_attach": _NM + " SELECT * FROM pn WHERE prep IS NOT NULL",
    "coref_map": _TOK.replace("WITH RECURSIVE a AS", _CR + ", a2 AS", 1).replace("FROM a) WHERE d IS NOT NULL),\nsl", "FROM a2) WHERE d IS NOT NULL),\nsl", 1).replace("rec AS (SELECT ann_id, coalesce(json_extract(d, '$.result'), d) AS d FROM (SELECT ann_id, TRY_CAST(p AS JSON) AS d FROM a2) WHERE d IS NOT NULL),\n", "", 1) + """,
sz AS (SELECT ann_id, sent_id + 1 AS sentNum, count(*) AS n FROM tok GROUP BY ALL), bs AS (SELECT ann_id, sentNum, coalesce(sum(n) OVER (PARTITION BY ann_id ORDER BY sentNum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM sz),
pl AS (SELECT ann_id, parent, main, child, CAST(base + startIndex - 1 AS BIGINT) AS s, CAST(base + endIndex - 1 AS BIGINT) AS e FROM m JOIN bs USING (ann_id, sentNum)), mn AS (SELECT ann_id, parent, arg_min(s, child) AS rs, arg_min(e, child) AS re FROM pl WHERE main GROUP BY ALL)
SELECT DISTINCT ann_id, s AS start, e AS "end", rs AS ref_start, re AS ref_end FROM pl JOIN mn USING (ann_id, parent)""",
    "pronoun_references": _CR + """, mn AS (SELECT ann_id, parent, arg_min(text, child) AS reference FROM m WHERE main GROUP BY ALL)
SELECT ann_id, sentNum, startIndex, text, reference FROM m JOIN mn USING (ann_id, parent) WHERE lower(text) IN ('it', 'he', 'she', 'him', 'her', 'they', 'them') AND endIndex - startIndex = 1 AND NOT coalesce(main, FALSE)""",
    "tuple_text_roundtrip": _ROUND,
    "tuple_json": "SELECT DISTINCT ON (tuple_id) tuple_id, subject.word AS subject, predicate.word AS predicate, direct_object.word AS direct_object, indirect_object.word AS indirect_object, subject.reference AS reference, clause_type, CAST(negation AS VARCHAR) AS negation, CAST(sent_id AS VARCHAR) AS sent_id, adverbial[1].word AS first_adverbial, adverbial[1].prep AS first_prep FROM tuples ORDER BY tuple_id, loaded_at",
    "noun_phrases": _TOK + f""", ph AS (SELECT k.ann_id, k.sent_id, n.i AS noun, k.i FROM tok n JOIN tok k ON {_on('n', 'k')} AND k.head = n.i AND k.i <> n.i WHERE n.pos LIKE 'NN%' AND (k.rel IN ('amod', 'det', 'nummod', 'quantmod', 'nn', 'compound', 'nmod:poss')
    OR k.rel = 'nmod' AND EXISTS (SELECT 1 FROM tok c WHERE {_on('c', 'k')} AND c.head = k.i AND c.rel = 'case' AND c.word = 'of'))
  UNION SELECT c.ann_id, c.sent_id, ph.noun, c.i FROM ph JOIN tok c ON {_on('ph', 'c')} AND c.head = ph.i AND c.i <> ph.i AND coalesce(c.rel, '') NOT IN ('acl', 'advcl', 'acl:relcl', 'relcl', 'appos')),
al AS (SELECT * FROM ph UNION SELECT ann_id, sent_id, i, i FROM tok WHERE pos LIKE 'NN%')
SELECT al.ann_id, al.sent_id, noun AS i, string_agg(coalesce(word, ''), ' ' ORDER BY t.i) AS phrase FROM al JOIN tok t ON {_on('al', 't')} AND t.i = al.i GROUP BY al.ann_id, al.sent_id, noun""",
}

ORACLE["clause_type_spacy"] = _SUBJ + f""", ss AS (SELECT vb.*, rel = 'conj' AND (SELECT min(o.i) FROM tok o WHERE {_on('o', 'vb')} AND o.head = vb.head AND o.rel = 'dobj') > vb.i AS shared FROM vb),
sp AS (SELECT CASE WHEN v IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being') AND rel IN ('aux', 'auxpass') THEN NULL
  WHEN v IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being') AND s IS NOT NULL AND list_contains(r, 'ccomp') THEN 'SVcC' WHEN v IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being') AND s IS NOT NULL AND list_contains(r, 'xcomp') THEN 'SVcX'
  WHEN v IN ('is', 'am', 'are', 'was', 'were', 'be', 'been', 'being') AND list_has_all(r, ['attr', 'expl']) THEN 'SVb' WHEN s IS NOT NULL AND list_has_any(r, ['attr', 'acomp']) THEN 'SVc'
  WHEN s IS NOT NULL AND list_has_all(r, ['dobj', 'iobj']) THEN 'SVOO' WHEN s IS NOT NULL AND list_has_all(r, ['dobj', 'oprd']) THEN 'SVOC' WHEN s IS NOT NULL AND list_contains(r, 'dobj') OR shared THEN 'SVO'
  WHEN s IS NULL THEN NULL WHEN list_contains(r, 'xcomp') THEN 'SVX' WHEN list_contains(r, 'ccomp') THEN 'SVC' WHEN list_contains(r, 'oprd') THEN 'SVX' ELSE 'SV' END AS clause_type FROM ss)
SELECT clause_type, count(*) AS n FROM sp GROUP BY clause_type"""
ORACLE["svoo_tuples_cases"] = ORACLE["svoo_tuples"].replace(_TOK, golden.token_rows())
