"""Extraction from fixed sentences whose tuples and clauses are known.

The annotations of the tables come with no tuples, so full extraction is compared here with rows that it gave and
that were then read through by hand: they show change, and are no independent truth. Trees
are written word/tag(head,label).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import rewrite, trees
from factloom.runtime import ship
from factloom.sources.annotations import TOKEN

SENTENCES = """
Beethoven/NNP(2,nsubj) moved/VBD(0,root)
Beethoven/NNP(5,nsubj) was/VBD(5,cop) not/RB(5,neg) a/DT(5,det) composer/NN(0,root)
He/PRP(2,nsubj) gave/VBD(0,root) a/DT(4,det) talk/NN(2,dobj) at/IN(6,case) noon/NN(2,nmod) in/IN(8,case) Vienna/NNP(2,nmod)
He/PRP(2,nsubj) bought/VBD(0,root) a/DT(5,det) big/JJ(5,amod) house/NN(2,dobj) near/IN(8,case) old/JJ(8,amod) Vienna/NNP(5,nmod)
She/PRP(2,nsubj) gave/VBD(0,root) the/DT(4,det) boy/NN(2,iobj) a/DT(7,det) red/JJ(7,amod) book/NN(2,dobj) of/IN(9,case) maps/NNS(7,nmod) after/IN(12,case) the/DT(12,det) war/NN(2,nmod) in/IN(15,case) the/DT(15,det) hall/NN(2,nmod)
He/PRP(2,nsubj) said/VBD(0,root) that/IN(5,mark) she/PRP(5,nsubj) left/VBD(2,ccomp) Rome/NNP(5,dobj) and/CC(5,cc) met/VBD(5,conj) Tom/NNP(8,dobj)
The/DT(2,det) boy/NN(8,nsubjpass) who/WP(6,nsubj) was/VBD(6,cop) a/DT(6,det) thief/NN(2,acl:relcl) was/VBD(8,auxpass) arrested/VBN(0,root) when/WRB(11,advmod) it/PRP(11,nsubj) rained/VBD(8,advcl)
His/PRP$(2,nmod:poss) brother/NN(8,nsubj) ,/,(2,punct) an/DT(5,det) doctor/NN(2,appos) ,/,(2,punct) is/VBZ(8,cop) famous/JJ(0,root)
The/DT(2,det) boy/NN(7,nsubjpass) killed/VBN(2,acl) by/IN(6,case) the/DT(6,det) man/NN(3,nmod) found/VBN(0,root)
The/DT(2,det) man/NN(3,nsubj) went/VBD(0,root) in/IN(6,case) the/DT(6,det) room/NN(3,nmod) ,/,(3,punct) waving/VBG(3,advcl) his/PRP$(10,nmod:poss) arms/NNS(8,dobj)
Tom/NNP(4,nsubj) and/CC(1,cc) Ann/NNP(1,conj) played/VBD(0,root) chess/NN(4,dobj) and/CC(5,cc) cards/NNS(5,conj)
Beethoven/NNP(2,nsubj) began/VBD(0,root) studying/VBG(2,xcomp) composition/NN(3,dobj)
he/PRP(2,nsubj) moved/VBD(0,root) and/CC(2,cc) died/VBD(2,conj) in/IN(6,case) 1999/CD(2,nmod)
Aware/JJ(8,ccomp) of/IN(4,case) the/DT(4,det) danger/NN(1,nmod) ,/,(8,punct) he/PRP(8,nsubj) was/VBD(8,cop) careful/JJ(0,root)
"""
# Prepositions and copulas are heads in this dialect.
OTHER_DIALECT = """
He/PRP(2,nsubj) was/VBD(0,ROOT) not/RB(2,neg) a/DT(5,det) composer/NN(2,attr) in/IN(2,prep) Vienna/NNP(6,pobj)
She/PRP(2,nsubj) gave/VBD(0,ROOT) him/PRP(2,dative) books/NNS(2,dobj)
They/PRP(2,nsubj) became/VBD(0,ROOT) friends/NNS(2,oprd)
He/PRP(2,nsubj) wrote/VBD(0,ROOT) ,/,(2,punct) printed/VBD(2,conj) and/CC(4,cc) sold/VBD(4,conj) books/NNS(6,dobj)
She/PRP(2,nsubj) wrote/VBD(0,ROOT) and/CC(2,cc) printed/VBD(2,conj) books/NNS(2,dobj)
"""
# case | tuple | type | negation | subject | predicate | direct object | indirect object | adverbials | complement | its tuples | clause | parent clause
RAW = """
1 | 0 | SV |  | Beethoven | moved | - | - |  | - |  | 0 | -
2 | 0 | SVc | not | Beethoven | was | a composer | - |  | - |  | 0 | -
3 | 0 | SVO |  | He | gave | a talk | - | at noon & in Vienna | - |  | 0 | -
4 | 0 | SVO |  | He | bought | a big house | - |  | - |  | 0 | -
5 | 0 | SVOO |  | She | gave | a red book of maps | the boy | after the war & in the hall | - |  | 0 | -
6 | 0 | SVC |  | He | said | - | - |  | that she left Rome and met Tom | 1,2 | 0 | -
6 | 1 | SVO |  | she | left | Rome | - |  | - |  | 0 | -
6 | 2 | SVO |  | she | met | Tom | - |  | - |  | 0 | -
7 | 0 | SVc |  | who | was | a thief | - |  | - |  | 0 | -
7 | 1 | SV |  | The boy | was arrested | - | - |  | - |  | 0 | -
7 | 2 | SV |  | it | rained | - | - |  | - |  | 0 | -
8 | 0 | SVc |  | His brother | is | famous | - |  | - |  | 0 | -
9 | 0 | SV |  | The boy | found | - | - |  | - |  | 0 | -
10 | 0 | SV |  | The man | went | - | - | in the room | - |  | 0 | -
11 | 0 | SVO |  | Tom | played | chess | - |  | - |  | 0 | -
11 | 1 | SVO |  | Tom | played | cards | - |  | - |  | 0 | -
11 | 2 | SVO |  | Ann | played | chess | - |  | - |  | 0 | -
11 | 3 | SVO |  | Ann | played | cards | - |  | - |  | 0 | -
12 | 0 | SVO |  | Beethoven | began studying | composition | - |  | - |  | 0 | -
13 | 0 | SV |  | he | moved | - | - | in 1999 | - |  | 0 | -
13 | 1 | SV |  | he | died | - | - | in 1999 | - |  | 0 | -
14 | 0 | SVc |  | he | was | careful | - |  | - |  | 0 | -
"""
CLAUSES = """
1 | 0 | SV |  | Beethoven | moved | - | - |  | - |  | 0 | -
2 | 0 | SVc | not | Beethoven | was | a composer | - |  | - |  | 0 | -
3 | 0 | SVO |  | He | gave | a talk | - | at noon & in Vienna | - |  | 0 | -
4 | 0 | SVO |  | He | bought | a big house | - |  | - |  | 0 | -
5 | 0 | SVOO |  | She | gave | a red book of maps | the boy | after the war & in the hall | - |  | 0 | -
6 | 0 | SVC |  | He | said | - | - |  | she left Rome she met Tom | 1,2 | 0 | -
6 | 1 | SVO |  | she | met | Tom | - |  | - |  | 1 | 2
6 | 2 | SVO |  | she | left | Rome | - |  | - |  | 2 | 0
7 | 0 | SV |  | The boy | was arrested | - | - |  | - |  | 0 | -
7 | 1 | SVc |  | The boy | was | a thief | - |  | - |  | 1 | 0
7 | 2 | SV |  | it | rained | - | - |  | - |  | 2 | 0
8 | 0 | SVc |  | His brother | is | famous | - |  | - |  | 0 | -
8 | 1 | SVc |  | His brother | be | an doctor | - |  | - |  | 1 | 0
9 | 0 | SV |  | The boy | found | - | - |  | - |  | 0 | -
9 | 1 | SV |  | The boy | be killed | - | - | by the man | - |  | 1 | 0
10 | 0 | SV |  | The man | went | - | - | in the room | - |  | 0 | -
10 | 1 | SVO |  | The man | wave | his arms | - |  | - |  | 1 | 0
11 | 0 | SVO |  | Tom | played | chess | - |  | - |  | 0 | -
11 | 1 | SVO |  | Tom | played | cards | - |  | - |  | 0 | -
11 | 2 | SVO |  | Ann | played | chess | - |  | - |  | 0 | -
11 | 3 | SVO |  | Ann | played | cards | - |  | - |  | 0 | -
12 | 0 | SVO |  | Beethoven | began studying | composition | - |  | - |  | 0 | -
13 | 0 | SV |  | he | died | - | - | in 1999 | - |  | 0 | 1
13 | 1 | SV |  | he | moved | - | - | in 1999 | - |  | 1 | -
14 | 0 | SVc |  | he | was | careful | - |  | - |  | 0 | -
14 | 1 | SVc |  | he | be | aware of the danger | - |  | - |  | 1 | 0
"""
SIMPLIFIED = """
1 | 0 | SV |  | Beethoven | moved | - | - |  | - |  | 0 | -
2 | 0 | SVc | not | Beethoven | was | a composer | - |  | - |  | 0 | -
3 | 0 | SVO |  | He | gave | a talk | - | at noon & in Vienna | - |  | 0 | -
4 | 0 | SVO |  | He | bought | a big house near old Vienna | - |  | - |  | 0 | -
5 | 0 | SVOO |  | She | gave | a red book of maps | the boy | after the war & in the hall | - |  | 0 | -
6 | 0 | SVC |  | He | said | - | - |  | she left Rome she met Tom | 1,2 | 0 | -
6 | 1 | SVO |  | she | met | Tom | - |  | - |  | 1 | 2
6 | 2 | SVO |  | she | left | Rome | - |  | - |  | 2 | 0
7 | 0 | SV |  | The boy | was arrested | - | - |  | - |  | 0 | -
7 | 1 | SVc |  | The boy | was | a thief | - |  | - |  | 1 | 0
7 | 2 | SV |  | it | rained | - | - |  | - |  | 2 | 0
8 | 0 | SVc |  | His brother | is | famous | - |  | - |  | 0 | -
8 | 1 | SVc |  | His brother | be | an doctor | - |  | - |  | 1 | 0
9 | 0 | SV |  | The boy | found | - | - |  | - |  | 0 | -
9 | 1 | SV |  | The boy | be killed | - | - | by the man | - |  | 1 | 0
10 | 0 | SV |  | The man | went | - | - | in the room | - |  | 0 | -
10 | 1 | SVO |  | The man | wave | his arms | - |  | - |  | 1 | 0
11 | 0 | SVO |  | Tom | played | chess | - |  | - |  | 0 | -
11 | 1 | SVO |  | Tom | played | cards | - |  | - |  | 0 | -
11 | 2 | SVO |  | Ann | played | chess | - |  | - |  | 0 | -
11 | 3 | SVO |  | Ann | played | cards | - |  | - |  | 0 | -
12 | 0 | SVO |  | Beethoven | began studying | composition | - |  | - |  | 0 | -
13 | 0 | SV |  | he | died | - | - | in 1999 | - |  | 0 | 1
13 | 1 | SV |  | he | moved | - | - | in 1999 | - |  | 1 | -
14 | 0 | SVc |  | he | was | careful | - |  | - |  | 0 | -
14 | 1 | SVc |  | he | be | aware of the danger | - |  | - |  | 1 | 0
"""
OTHER_RAW = """
1 | 0 | SVc | not | He | was | a composer | - | in Vienna | - |  | 0 | -
2 | 0 | SVOO |  | She | gave | books | him |  | - |  | 0 | -
3 | 0 | SVX |  | They | became | friends | - |  | - |  | 0 | -
4 | 0 | SV |  | He | wrote | - | - |  | - |  | 0 | -
4 | 1 | SV |  | He | printed | - | - |  | - |  | 0 | -
4 | 2 | SVO |  | He | sold | books | - |  | - |  | 0 | -
5 | 0 | SVO |  | She | wrote | books | - |  | - |  | 0 | -
5 | 1 | SVO |  | She | printed | books | - |  | - |  | 0 | -
"""
OTHER_CLAUSES = """
1 | 0 | SVc | not | He | was | a composer | - | in Vienna | - |  | 0 | -
2 | 0 | SVOO |  | She | gave | books | him |  | - |  | 0 | -
3 | 0 | SVX |  | They | became | friends | - |  | - |  | 0 | -
4 | 0 | SVO |  | He | sold | books | - |  | - |  | 0 | 1
4 | 1 | SV |  | He | printed | - | - |  | - |  | 1 | 2
4 | 2 | SV |  | He | wrote | - | - |  | - |  | 2 | -
5 | 0 | SVO |  | She | printed | books | - |  | - |  | 0 | 1
5 | 1 | SVO |  | She | wrote | books | - |  | - |  | 1 | -
"""
# case | clause | parent clause | kind | side | mark | linking word | text
CLAUSE_TREE = """
1 | 0 | - | CORE | - | - | - | Beethoven moved
2 | 0 | - | CORE | - | - | - | Beethoven was not a composer
3 | 0 | - | CORE | - | - | - | He gave a talk at noon in Vienna
4 | 0 | - | CORE | - | - | - | He bought a big house near old Vienna
5 | 0 | - | CORE | - | - | - | She gave the boy a red book of maps after the war in the hall
6 | 0 | - | CORE | - | - | - | He said
6 | 1 | 2 | CONJ | right | - | left | she met Tom
6 | 2 | 0 | OBJCL | right | that | said | she left Rome
7 | 0 | - | CORE | - | - | - | The boy was arrested
7 | 1 | 0 | ACL | right | who | boy | The boy was a thief
7 | 2 | 0 | ADVCL | left | when | arrested | when it rained
8 | 0 | - | CORE | - | - | - | His brother is famous
8 | 1 | 0 | APPOS | left | - | - | His brother be an doctor
9 | 0 | - | CORE | - | - | - | The boy found
9 | 1 | 0 | ACL | left | - | - | The boy be killed by the man
10 | 0 | - | CORE | - | - | - | The man went in the room
10 | 1 | 0 | ADVCL | left | - | went | The man wave his arms
11 | 0 | - | CORE | - | - | - | Tom and Ann played chess and cards
12 | 0 | - | CORE | - | - | - | Beethoven began studying composition
13 | 0 | 1 | CONJ | right | - | moved | he died in 1999
13 | 1 | - | CORE | - | - | - | he moved in 1999
14 | 0 | - | CORE | - | - | - | he was careful
14 | 1 | 0 | ADVCL | left | - | - | he be aware of the danger
"""
SIMPLE_CLAUSE_TREE = """
1 | 0 | - | CORE | - | - | - | Beethoven moved
2 | 0 | - | CORE | - | - | - | Beethoven was not a composer
3 | 0 | - | CORE | - | - | - | He gave a talk at noon
4 | 0 | - | CORE | - | - | - | He bought a house
5 | 0 | - | CORE | - | - | - | She gave the boy a book after the war
6 | 0 | - | CORE | - | - | - | He said
6 | 1 | 2 | CONJ | right | - | left | she met Tom
6 | 2 | 0 | OBJCL | right | that | said | she left Rome
7 | 0 | - | CORE | - | - | - | The boy was arrested
7 | 1 | 0 | ACL | right | who | boy | The boy was a thief
7 | 2 | 0 | ADVCL | left | when | arrested | when it rained
8 | 0 | - | CORE | - | - | - | His brother is famous
8 | 1 | 0 | APPOS | left | - | - | His brother be an doctor
9 | 0 | - | CORE | - | - | - | The boy found
9 | 1 | 0 | ACL | left | - | - | The boy be killed by the man
10 | 0 | - | CORE | - | - | - | The man went in the room
10 | 1 | 0 | ADVCL | left | - | went | The man wave his arms
11 | 0 | - | CORE | - | - | - | Tom and Ann played chess and cards
12 | 0 | - | CORE | - | - | - | Beethoven began studying composition
13 | 0 | 1 | CONJ | right | - | moved | he died in 1999
13 | 1 | - | CORE | - | - | - | he moved in 1999
14 | 0 | - | CORE | - | - | - | he was careful
14 | 1 | 0 | ADVCL | left | - | - | he be aware of the danger
"""
TUPLE_COLUMNS = ["ann_id INT", "tuple_no INT", "clause_type", "negation", "subject", "predicate", "direct_object", "indirect_object", "adverbial", "complement", "complement_tuples", "clause_no INT", "parent_clause INT"]
CLAUSE_COLUMNS = ["ann_id INT", "clause_no INT", "parent_clause INT", "kind", "side", "mark", "linking_word", "text"]


def _tokens(line: str) -> list[tuple]:
    return [(i, word, pos, int(head), rel, None) for i, (word, pos, head, rel) in enumerate(re.findall(r"(\S+)/(\S+)\((\d+),(\S+)\)", line), 1)]


def sentences(spark: SparkSession, text: str = SENTENCES) -> DataFrame:
    ship(spark.sparkContext)
    rows = [(n, 0, _tokens(line)) for n, line in enumerate(text.strip().split("\n"), 1)]
    return spark.createDataFrame(rows, f"ann_id int, sent_id int, tokens array<{TOKEN}>")


def flat(t: DataFrame, keys: list[str]) -> DataFrame:
    """Tuples as ``rewrite.extract`` gives them, in columns of text and numbers."""
    word = lambda r: F.col(f"{r}.word").alias(r)
    adv = F.array_join(F.transform("adverbial", lambda a: F.concat_ws(" ", a["prep"], a["word"])), " & ").alias("adverbial")
    links = F.array_join(F.transform("complement_tuples", lambda n: n.cast("string")), ",").alias("complement_tuples")
    return t.select(*keys, "tuple_no", "clause_type", "negation", word("subject"), word("predicate"), word("direct_object"), word("indirect_object"), adv, "complement", links, "clause_no", "parent_clause")


def _extracted(how: str, text: str = SENTENCES, dialect: str = "corenlp") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat(rewrite.extract(sentences(spark, text), how, dialect), ["ann_id"])


def _clauses(simplify: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rewrite.clauses(sentences(spark), simplify).drop("sent_id")


def svoo_tuples_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.head_tuples(sentences(spark), "SVOO")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "extract_raw_cases": _extracted("raw"), "extract_clauses_cases": _extracted("clauses"), "extract_simplified_cases": _extracted("simplified"),
        "extract_spacy_cases": _extracted("raw", OTHER_DIALECT, "spacy"), "decompose_spacy_cases": _extracted("clauses", OTHER_DIALECT, "spacy"),
        "clause_rewrite_cases": _clauses(False), "lexical_decomposition_cases": _clauses(True), "svoo_tuples_cases": svoo_tuples_cases,
    }


def _table(text: str, columns: list[str]) -> str:
    """Written rows as a SELECT; '-' is null."""
    quote = lambda x: "NULL" if x == "-" else "'" + x.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(quote(x.strip()) for x in line.split("|")) + ")" for line in text.strip().split("\n"))
    names = ", ".join(f"c{k}" for k in range(len(columns)))
    kept = ", ".join("c3 = 'not' AS negation" if c == "negation" else f"CAST(c{k} AS INT) AS {c[:-4]}" if c.endswith(" INT") else f"c{k} AS {c}" for k, c in enumerate(columns))
    return f"SELECT {kept} FROM (VALUES {rows}) v({names})"


def token_rows(text: str = SENTENCES) -> str:
    """The sentences as a table of tokens in SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"({n}, 0, {i}, {quote(w)}, {quote(p)}, NULL, {h}, {quote(r)})" for n, line in enumerate(text.strip().split("\n"), 1) for i, w, p, h, r, _ in _tokens(line)]
    return f"WITH RECURSIVE tok AS (SELECT * FROM (VALUES {', '.join(rows)}) v(ann_id, sent_id, i, word, pos, ner, head, rel))"


ORACLE = {
    "extract_raw_cases": _table(RAW, TUPLE_COLUMNS), "extract_clauses_cases": _table(CLAUSES, TUPLE_COLUMNS), "extract_simplified_cases": _table(SIMPLIFIED, TUPLE_COLUMNS),
    "extract_spacy_cases": _table(OTHER_RAW, TUPLE_COLUMNS), "decompose_spacy_cases": _table(OTHER_CLAUSES, TUPLE_COLUMNS),
    "clause_rewrite_cases": _table(CLAUSE_TREE, CLAUSE_COLUMNS), "lexical_decomposition_cases": _table(SIMPLE_CLAUSE_TREE, CLAUSE_COLUMNS),
}
