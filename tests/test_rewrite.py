"""Golden trees: token/POS(head,rel)."""

import re

import pytest

from factloom.functions.text import stem
from factloom.operators.rewrite import ORDERS, Tree, decompose, facts, parent_numbers, sentence_facts


def tree(text):
    out = []
    for n, (word, pos, head, rel) in enumerate(re.findall(r"(\S+)/(\S+)\((\d+),(\S+)\)", text), 1):
        out.append({"i": n, "word": word, "pos": pos, "head": int(head), "rel": rel})
    return out


def found(tokens):
    t = Tree.of(tokens)
    return sorted("; ".join([t.text(f.subject), t.text(f.predicate), t.text(f.object), t.text(f.indirect), "||".join(t.text(a) for a in f.adverbials)]) + (" !" if f.negation else "") for f in facts(t))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Beethoven/NNP(2,nsubj) moved/VBD(0,root)", ["Beethoven; moved; ; ; "]),
        ("Beethoven/NNP(4,nsubj) was/VBD(4,cop) a/DT(4,det) composer/NN(0,root)", ["Beethoven; was; a composer; ; "]),
        ("He/PRP(2,nsubj) gave/VBD(0,root) a/DT(4,det) talk/NN(2,dobj) at/IN(7,case) the/DT(7,det) meeting/NN(2,nmod)", ["He; gave; a talk; ; at the meeting"]),
        ("Beethoven/NNP(2,nsubj) played/VBD(0,root) him/PRP(2,iobj) a/DT(5,det) piece/NN(2,dobj) of/IN(7,case) music/NN(5,nmod)", ["Beethoven; played; a piece of music; him; "]),
        ("Beethoven/NNP(2,nsubj) began/VBD(0,root) studying/VBG(2,xcomp) composition/NN(3,dobj)", ["Beethoven; began studying; composition; ; "]),
        ("hearing/NN(2,nsubj) began/VBD(0,root) to/TO(4,mark) deteriorate/VB(2,xcomp)", ["hearing; began to deteriorate; ; ; "]),
        ("he/PRP(4,nsubj) did/VBD(4,aux) not/RB(4,neg) move/VB(0,root)", ["he; move; ; ;  !"]),
        ("Tom/NNP(4,nsubj) and/CC(1,cc) Ann/NNP(1,conj) sang/VBD(0,root)", ["Ann; sang; ; ; ", "Tom; sang; ; ; "]),
        ("he/PRP(2,nsubj) moved/VBD(0,root) and/CC(2,cc) died/VBD(2,conj) in/IN(6,case) 1999/CD(2,nmod)", ["he; died; ; ; in 1999", "he; moved; ; ; in 1999"]),
        ("he/PRP(2,nsubj) moved/VBD(0,root) in/IN(4,case) 1999/CD(2,nmod) and/CC(2,cc) died/VBD(2,conj)", ["he; died; ; ; ", "he; moved; ; ; in 1999"]),
    ],
)
def test_tuples(text, expected):
    assert found(tree(text)) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("His/PRP$(2,nmod:poss) brother/NN(8,nsubj) ,/,(2,punct) an/DT(5,det) doctor/NN(2,appos) ,/,(2,punct) is/VBZ(8,cop) famous/JJ(0,root)", ["His brother be an doctor", "His brother is famous"]),
        ("The/DT(2,det) boy/NN(7,nsubjpass) killed/VBN(2,acl) by/IN(6,case) the/DT(6,det) man/NN(3,nmod) found/VBN(0,root)", ["The boy be killed by the man", "The boy found"]),
        ("The/DT(2,det) man/NN(3,nsubj) went/VBD(0,root) in/IN(6,case) the/DT(6,det) room/NN(3,nmod) ,/,(3,punct) waving/VBG(3,advcl) his/PRP$(10,nmod:poss) arms/NNS(8,dobj)", ["The man wave his arms", "The man went in the room"]),
        ("Aware/JJ(8,ccomp) of/IN(4,case) the/DT(4,det) danger/NN(1,nmod) ,/,(8,punct) he/PRP(8,nsubj) was/VBD(8,cop) careful/JJ(0,root)", ["he be aware of the danger", "he was careful"]),
        ("When/WRB(5,advmod) he/PRP(5,nsubj) was/VBD(5,cop) a/DT(5,det) child/NN(10,advcl) ,/,(10,punct) his/PRP$(8,nmod:poss) family/NN(10,nsubj) was/VBD(10,cop) poor/JJ(0,root)", ["When he was a child", "his family was poor"]),
        ("The/DT(2,det) boy/NN(8,nsubjpass) who/WP(6,nsubj) was/VBD(6,cop) a/DT(6,det) thief/NN(2,acl:relcl) was/VBD(8,auxpass) arrested/VBN(0,root)", ["The boy was a thief", "The boy was arrested"]),
        ("he/PRP(2,nsubj) returned/VBD(0,root) and/CC(2,cc) led/VBD(2,conj) them/PRP(4,dobj)", ["he led them", "he returned"]),
    ],
)
def test_decomposition(text, expected):
    assert sorted(c.text() for c in decompose(tree(text))) == expected


def test_inserted_word_has_no_place():
    clauses = decompose(tree("His/PRP$(2,nmod:poss) brother/NN(8,nsubj) ,/,(2,punct) an/DT(5,det) doctor/NN(2,appos) ,/,(2,punct) is/VBZ(8,cop) famous/JJ(0,root)"))
    appos = next(c for c in clauses if c.kind == "APPOS")
    assert [appos.origin[k] for k in appos.nodes()] == [0, 1, -1, 3, 4]
    assert [(f.kind, appos.text(f.object)) for f in facts(appos)] == [("SVc", "an doctor")]


def test_odd_trees():
    assert facts(Tree.of([])) == []
    assert decompose([]) == []
    loop = [{"i": 1, "word": "a", "pos": "VBD", "head": 2, "rel": "conj"}, {"i": 2, "word": None, "pos": None, "head": 1, "rel": "appos"}, {"i": 3, "word": "x", "pos": "NN", "head": None, "rel": None}]
    decompose(loop)
    facts(Tree.of(loop))


def test_stem():
    assert [stem(w) for w in ("waving", "running", "walking", "making", "studied", "opened", "falls")] == ["wave", "run", "walk", "make", "study", "open", "fall"]


def test_other_dialect():
    was = tree("He/PRP(2,nsubj) was/VBD(0,ROOT) not/RB(2,neg) a/DT(5,det) composer/NN(2,attr) in/IN(2,prep) Vienna/NNP(6,pobj)")
    gave = tree("She/PRP(2,nsubj) gave/VBD(0,ROOT) him/PRP(2,dative) books/NNS(2,dobj)")
    made = tree("They/PRP(2,nsubj) became/VBD(0,ROOT) friends/NNS(2,oprd)")
    from factloom.operators.rewrite import from_spacy

    assert found(from_spacy(was)) == ["He; was; a composer; ; in Vienna !"]
    assert found(from_spacy(gave)) == ["She; gave; books; him; "]
    assert found(from_spacy(made)) == ["They; became; friends; ; "]


def said(text, how, **options):
    word = lambda e: e and e["word"]
    return [(r["clause_type"], word(r["subject"]), word(r["predicate"]), word(r["direct_object"]), [f"{a['prep']} {a['word']}" for a in r["adverbial"]], r["complement_tuples"], r["parent_clause"]) for r in sentence_facts(tree(text), how, **options)]


def test_what_is_set_aside_comes_back():
    gave = "He/PRP(2,nsubj) gave/VBD(0,root) a/DT(4,det) talk/NN(2,dobj) at/IN(6,case) noon/NN(2,nmod) in/IN(8,case) Vienna/NNP(2,nmod) and/CC(8,cc) Graz/NNP(8,conj)"
    assert said(gave, "simplified") == [("SVO", "He", "gave", "a talk", ["at noon", "in Vienna", "in Graz"], [], None)]
    house = "He/PRP(2,nsubj) saw/VBD(0,root) a/DT(5,det) big/JJ(5,amod) house/NN(2,dobj) near/IN(8,case) old/JJ(8,amod) Vienna/NNP(5,nmod) in/IN(10,case) Austria/NNP(8,nmod)"
    assert said(house, "simplified") == [("SVO", "He", "saw", "a big house near old Vienna in Austria", [], [], None)]


def test_complements_are_linked():
    text = "He/PRP(2,nsubj) said/VBD(0,root) that/IN(5,mark) she/PRP(5,nsubj) left/VBD(2,ccomp) and/CC(5,cc) wept/VBD(5,conj)"
    for how, links in (("raw", [1, 2]), ("clauses", [1, 2]), ("simplified", [1, 2])):
        rows = said(text, how)
        assert rows[0][0] == "SVC" and rows[0][5] == links and {r[2] for r in rows[1:]} == {"left", "wept"}


@pytest.mark.parametrize("order", ORDERS)
def test_orders_hold_all_clauses(order):
    text = "Tom/NNP(5,nsubj) ,/,(1,punct) a/DT(4,det) baker/NN(1,appos) left/VBD(0,root) Rome/NNP(5,dobj) when/WRB(9,advmod) it/PRP(9,nsubj) rained/VBD(5,advcl) and/CC(5,cc) sold/VBD(5,conj) bread/NN(11,dobj)"
    clauses = decompose(tree(text), order=order)
    up = parent_numbers(clauses)
    assert {"when it rained"} < {c.text() for c in clauses} and len(clauses) == 4
    assert sum(n is None for n in up) == 1 and all(n is None or clauses[n] is not c for n, c in zip(up, clauses))
