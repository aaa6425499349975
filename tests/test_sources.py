import json

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import trees
from factloom.sources import annotations, sinks, tuple_text

TEXT = """He gave a talk .
he|0; gave|1; a|2 talk|3 (speech); ; at|4 noon|5||soon|6
?he; left; ; ;

## odd line
!x; y; z; w

======================
Next one .

======
Last ."""


def test_tuple_text(spark):
    rows = tuple_text.parse(spark.createDataFrame([(1, TEXT)], "id bigint, value string")).orderBy("doc", "sent", "ord").collect()
    assert [(r.doc, r.sent, r.sentence) for r in rows] == [(0, 0, "He gave a talk ."), (0, 0, "He gave a talk ."), (0, 1, "## odd line"), (1, 0, "Next one ."), (2, 0, "Last .")]
    first = rows[0]
    assert first.subject.word == "he" and first.subject.word_index == [0] and first.direct_object.word == "a talk" and first.direct_object.reference == "speech" and first.indirect_object is None
    assert [(a.prep, a.word, a.word_index) for a in first.adverbial] == [("at", "noon", [4, 5]), (None, "soon", [6])]
    assert rows[1].uncertain and not rows[1].negation and rows[2].negation and rows[3].subject is None
    assert tuple_text.parse(spark.createDataFrame([], "id bigint, value string")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text(TEXT)
    assert tuple_text.read(spark, str(tmp_path / "t.txt")).count() == 5
    (tmp_path / "c.conllu").write_text("# x\n1\tHe\the\tPRON\tPRP\t_\t2\tnsubj:pass\t_\t_\n2\tleft\t_\t_\tVBN\t_\t0\troot\t_\t_\n2.1\tx\n\n1\tGo\t_\t_\tVB\t_\t0\troot\t_\t_\n\n")
    rows = annotations.read_conllu(spark, str(tmp_path / "c.conllu")).orderBy("sent_id").collect()
    assert [[(t.i, t.word, t.pos, t.head, t.rel) for t in r.tokens] for r in rows] == [[(1, "He", "PRP", 2, "nsubjpass"), (2, "left", "VBN", 0, "root")], [(1, "Go", "VB", 0, "root")]]
    nodes = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id bigint, node_id string")
    edges = spark.createDataFrame([(1, "a", "b", "r")], "doc_id bigint, src string, dst string, relation string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 1
    assert sinks.write_stage(nodes, str(tmp_path / "s")).count() == 2
    sinks.write_tuple_text(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "x"))


def payload(words, deps):
    return json.dumps({"sentences": [{"tokens": [{"word": w, "pos": p} for w, p in words], "basicDependencies": [{"dep": r, "governor": h, "dependent": d} for d, h, r in deps]}]})


SENT = payload([("Tom", "NNP"), ("and", "CC"), ("Ann", "NNP"), ("did", "VBD"), ("not", "RB"), ("see", "VB"), ("the", "DT"), ("cat", "NN"), ("on", "IN"), ("roofs", "NNS"), ("in", "IN"), ("May", "NNP")], [(1, 6, "nsubj"), (2, 1, "cc"), (3, 1, "conj"), (4, 6, "aux"), (5, 6, "neg"), (6, 0, "ROOT"), (7, 8, "det"), (8, 6, "obj"), (9, 10, "case"), (10, 6, "nmod"), (11, 12, "case"), (12, 6, "obl")])


def test_sentences_and_trees(spark):
    df = spark.createDataFrame([(1, SENT), (2, "{"), (3, None), (4, payload([("x", None)], [])), (5, "3")], "ann_id bigint, payload string")
    s = annotations.sentences(df, "ann_id", "payload")
    assert sorted((r.ann_id, r.sent_id, len(r.tokens)) for r in s.collect()) == [(1, 0, 12), (4, 0, 1)]
    again = annotations.from_conllu(annotations.to_conllu(s))
    assert sorted(map(repr, annotations.tokens(again).drop("ner").collect())) == sorted(map(repr, annotations.tokens(s).drop("ner").collect()))
    assert sorted((r.subject, r.predicate, r.object, r.negation) for r in trees.head_tuples(s, "SVO").collect()) == [("Ann", "see", "cat", True), ("Tom", "see", "cat", True)]
    assert [r.subject for r in trees.conjunction_span(s).collect()] == ["Tom and Ann"]
    assert sorted((r.nth, r.prep, r.word) for r in trees.extra_adverbials(s).collect()) == [(1, "on", "roofs"), (2, "in", "May")]
    assert sorted((r.lo, r.words) for r in trees.noun_chunks(s).collect()) == [(1, "Tom"), (3, "Ann"), (7, "the cat"), (10, "roofs"), (12, "May")]
    sizes = {r.i: r["count"] for r in trees.subtrees(s).filter("ann_id = 1").groupBy("i").count().collect()}
    assert sizes[6] == 12 and sizes[8] == 2 and sizes[1] == 3
    pruned = {r.i: r["count"] for r in trees.subtrees(s, ["conj"]).filter("ann_id = 1").groupBy("i").count().collect()}
    assert pruned[6] == 11 and pruned[1] == 2 and 3 not in pruned
    assert [r.words for r in trees.verb_chunks(annotations.sentences(spark.createDataFrame([(1, payload([("He", "PRP"), ("got", "VBD"), ("rid", "NN"), ("of", "IN"), ("it", "PRP"), ("and", "CC"), ("went", "VBD"), ("up", "IN"), ("to", "TO"), ("sit", "VB")], []))], "ann_id bigint, payload string"), "ann_id", "payload")).orderBy("lo").collect()] == ["got rid", "went up to"]
    types = {r.word: r.clause_type for r in trees.typed_verbs(s).collect()}
    assert types == {"did": None, "see": "SVO"}


def test_annotator_hook(spark):
    df = spark.createDataFrame([(1, "go now"), (2, None)], "doc_id bigint, text string")

    def by_rule(text):
        return [[{"i": n, "word": w, "pos": "VB", "head": 0, "rel": "root", "ner": None} for n, w in enumerate(text.split(), 1)]]

    assert [len(r.tokens) for r in annotations.annotate(df, "doc_id", "text", by_rule).collect()] == [2]


def test_text_functions(spark):
    row = spark.createDataFrame([("One two. Three; four? No 3.5",)], "t string").select(tx.tokenize(F.col("t")).alias("a"), tx.split_sentences(F.col("t")).alias("b"), tx.clean(F.lit("x (y)")).alias("c")).first()
    assert row.a[:3] == ["One", "two", "."] and row.b == ["One two.", "Three;", "four?", "No 3.5"] and row.c == "x "
