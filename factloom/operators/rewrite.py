"""Clause rewriting and full tuple extraction on the dependency tree of one sentence.

No parser is at hand, so a rewritten clause is never parsed again: its tree is cut out of the tree of its sentence,
subjects are copied under the clause's head and an inserted "be" (original index -1) hangs on it. All steps change one
small tree in order, which set operations can't express; they run inside the row of a sentence, so nothing is shuffled.

Indices: nodes count from 1 within a tree; ``origin`` is the 0-based index in the sentence, -1 for an inserted word.
Defined results: sentences without tokens, and trees without verbs, give no tuples; tokens without head hang nowhere and
belong to no element; links that go round are followed once; a null word is an empty one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.functions.text import COPULAS, stem

# Labels that belong to a noun phrase, to a predicate, and that end an adverbial.
NOUN_PARTS = frozenset(["amod", "det", "nummod", "quantmod", "nn", "compound", "nmod:poss"])
SUBJ = ("nsubj", "nsubjpass")
AUX = ("aux", "auxpass")
CLAUSAL = frozenset(["acl", "advcl", "acl:relcl", "relcl"])
PRONOUN_LINKS = frozenset(["who", "that", "which"])
COORDINATION = frozenset(["conj", "cc", "punct"])


@dataclass
class Tree:
    """One clause: for each node its word, tag, head, label and place in the sentence."""

    word: dict[int, str]
    pos: dict[int, str]
    head: dict[int, int]
    rel: dict[int, str]
    origin: dict[int, int]
    kind: str = "CORE"
    mark: str | None = None
    side: str | None = None
    parent: Tree | None = None  # the clause it was split off,
    link: int | None = None  # the place of the word it hung on there,
    linking_word: str | None = None  # and that word, where the kind of clause has one
    complements: dict[int, Tree] = field(default_factory=dict)  # by the place of the verb they were split off
    shared_objects: bool = False  # a coordinated verb without object has that of its head, if it follows

    @classmethod
    def of(cls, tokens: list[dict], shared_objects: bool = False) -> Tree:
        ids = [t["i"] for t in tokens]
        return cls({t["i"]: t["word"] or "" for t in tokens}, {t["i"]: t["pos"] or "" for t in tokens}, {t["i"]: t["head"] if t["head"] is not None else -1 for t in tokens}, {t["i"]: t["rel"] or "" for t in tokens}, {i: i - 1 for i in ids}, shared_objects=shared_objects)

    def nodes(self) -> list[int]:
        return sorted(self.word)

    def kids(self, i: int, *labels: str) -> list[int]:
        return [k for k in self.nodes() if self.head[k] == i and k != i and (not labels or self.rel[k] in labels)]

    def below(self, i: int, without: frozenset[str] = frozenset()) -> list[int]:
        """The subtree in order; branches are pruned at labels in ``without`` (not at the start)."""
        seen, todo = {i}, [i]
        while todo:
            for k in self.kids(todo.pop()):
                if k not in seen and self.rel[k] not in without:
                    seen.add(k)
                    todo.append(k)
        return sorted(seen)

    def drop(self, gone: list[int], comma_after: bool = False) -> None:
        """Remove nodes and the comma before them (and after them)."""
        lo, hi = min(gone), max(gone)
        extra = {k for k in (lo - 1, *([hi + 1] if comma_after else [])) if self.word.get(k) == ","}
        for k in {*gone, *extra}:
            for part in (self.word, self.pos, self.head, self.rel, self.origin):
                part.pop(k, None)

    def subjects(self, i: int) -> list[int]:
        """The first subject with its conjuncts; for a conjunct without one, that of its head, and so on upwards."""
        own, at, seen = self.kids(i, *SUBJ)[:1], i, {i}
        while not own and self.rel.get(at) == "conj" and self.head[at] not in seen:
            at = self.head[at]
            seen.add(at)
            own = self.kids(at, *SUBJ)[:1]
        return own and [own[0], *self.kids(own[0], "conj")]

    def objects(self, i: int, label: str = "dobj") -> list[int]:
        own = self.kids(i, label)
        if not own and label == "dobj" and self.shared_objects and self.rel.get(i) == "conj":
            own = [o for o in self.kids(self.head[i], label)]
            own = own if own and min(own) > i else []
        return [x for o in own for x in (o, *self.kids(o, "conj"))]

    def written(self, parts: list[int]) -> list[int]:
        """Coordinated nodes with all words between them, each with the words of its phrase."""
        if not parts:
            return []
        full = sorted({x for p in parts for x in self.phrase(p)})
        return full if len(parts) == 1 else [k for k in self.nodes() if full[0] <= k <= full[-1]]

    def phrase(self, i: int) -> list[int]:
        """A noun with its determiners, modifiers, compounds and 'of' complements."""
        out = {i}
        for k in self.kids(i):
            of = self.rel[k] == "nmod" and any(self.word[c] == "of" for c in self.kids(k, "case"))
            if self.rel[k] in NOUN_PARTS or of:
                out.update(self.below(k, CLAUSAL | {"appos"}))
        return sorted(out)

    def text(self, parts: list[int] | None = None) -> str:
        return " ".join(self.word[k] for k in (self.nodes() if parts is None else parts))


BE = 0  # stands for an inserted word in an order of nodes


def clause(tree: Tree, order: list[int], top: int, subjects: list[int], kind: str, side: str, mark: str | None = None, words: dict[int, str] | None = None) -> Tree:
    """A new tree of the nodes in ``order`` (BE: inserted), with ``top`` on top and ``subjects`` hanging on it."""
    place = {k: n for n, k in enumerate(order, 1) if k != BE}
    new = Tree({}, {}, {}, {}, {}, kind, mark, side, complements=tree.complements, shared_objects=tree.shared_objects)
    lead = next((s for s in subjects if s in place), None)
    passive = tree.pos[top] == "VBN" and BE in order
    for n, k in enumerate(order, 1):
        if k == BE:
            new.word[n], new.pos[n], new.head[n], new.rel[n], new.origin[n] = "be", "VBZ", place[top], "auxpass" if passive else "cop", -1
            continue
        new.word[n], new.pos[n], new.origin[n] = (words or {}).get(k, tree.word[k]), tree.pos[k], tree.origin[k]
        if k == top:
            new.head[n], new.rel[n] = 0, "root"
        elif k == lead:
            new.head[n], new.rel[n] = place[top], "nsubjpass" if passive or any(tree.rel[c] == "auxpass" for c in tree.kids(top)) else "nsubj"
        else:
            new.head[n], new.rel[n] = place.get(tree.head[k], place[top]), tree.rel[k]
    return new


def kind_of(tree: Tree, i: int) -> str:
    """What a possible point of decomposition is."""
    rel, up, tag = tree.rel[i], tree.head[i], tree.pos[i]
    if up not in tree.word:
        return "CORE"
    subject, participle = bool(tree.kids(i, *SUBJ)), tag in ("VBG", "VBN")
    to = tree.word.get(i - 1) == "to"
    above = tree.pos[up]
    if rel == "appos":
        return "APPOS" if above.startswith("NN") else "CORE"
    if rel == "advcl":
        if participle and not subject:
            return "PARADVCL"
        if to:
            return "INFINITE"
        return "ADVCL" if subject else "NN" if tag.startswith("NN") else "JJ" if tag == "JJ" else "CORE"
    if rel in ("acl", "acl:relcl", "relcl"):
        if participle and not subject:
            return "PARACL"
        return "INFINITE" if to else "ACL" if up < i else "CORE"
    if rel == "ccomp":
        if subject:
            return "CORE" if tree.kids(up, "dobj") else "APPOSCL" if above.startswith("NN") else "OBJCL"
        return "NN" if tag.startswith("NN") else "JJ" if tag == "JJ" else "CORE"
    if rel == "xcomp" and participle and i > up and any(tree.word.get(k) == "," for k in range(up + 1, i)):
        return "PARADVCL"
    if rel == "csubj":
        return "SUBJCL"
    if rel == "nmod" and any(tree.pos[k] == "VBG" for k in tree.kids(i, "case")):
        return "PARACL" if above.startswith("NN") else "PARADVCL" if above.startswith("VB") else "CORE"
    return "CORE"


def split_appositive(tree: Tree, i: int) -> Tree | None:
    """'X, Y,' gives 'X be Y'. With several commas between them, the noun nearest before a comma is meant."""
    up = tree.head[i]
    sub = tree.below(i)
    commas = sum(1 for k in range(up + 1, i) if tree.word.get(k) == ",")
    if commas < 2:
        named = [k for k in [up, *tree.kids(up, "conj")] if k < sub[0]]
    else:
        before = [k for k in tree.nodes() if k < i]
        comma = next((k for k in reversed(before) if tree.word[k] == ","), 0)
        named = [k for k in before if k < comma and tree.pos[k].startswith("NN")][-1:]
    who = [k for k in tree.written(named) if k not in sub and tree.word[k] != ","]
    new = clause(tree, [*who, BE, *sub], i, named, "APPOS", "left") if who else None
    tree.drop(sub, comma_after=True)
    return new


def split_point(tree: Tree, i: int, kind: str) -> Tree | None:
    """Cut the clause at ``i`` out of ``tree`` and give it as a tree of its own; None if it is dropped or stays."""
    up = tree.head[i]
    sub = tree.below(i)
    if kind == "APPOS":
        return split_appositive(tree, i)
    if kind == "INFINITE":
        tree.drop([k for k in sub if k >= i - 1])
        return None
    if kind == "OBJCL":
        that = tree.word[sub[0]] == "that"
        rest = sub[1:] if that else sub
        new = clause(tree, rest, i, tree.subjects(i), "OBJCL", "right", "that" if that else None)
        tree.drop(sub)
        return new
    if kind == "ADVCL":
        new = clause(tree, sub, i, tree.subjects(i), "ADVCL", "left", tree.word[sub[0]])
        tree.drop(sub, comma_after=True)
        return new
    if kind in ("NN", "JJ"):
        subjects = tree.subjects(up)
        if not subjects:
            return None
        who = [k for k in tree.written(subjects) if k not in sub]
        new = clause(tree, [*who, BE, *sub], i, subjects, "ADVCL", "left", words={sub[0]: tree.word[sub[0]].lower()})
        tree.drop(sub, comma_after=True)
        return new
    if kind == "ACL":
        subjects = tree.kids(i, *SUBJ)
        linked = len(subjects) == 1 and tree.word[subjects[0]] in PRONOUN_LINKS
        if len(sub) + 1 > len(tree.word):
            return None
        if not subjects or linked:
            rest = [k for k in sub if k not in subjects and not (k == sub[0] and tree.word[k] in PRONOUN_LINKS)]
            named = [k for k in [up, *tree.kids(up, "conj")] if k < i]
            who = [k for k in tree.written(named) if k not in sub]
            new = clause(tree, [*who, *rest], i, named, "ACL", "right", tree.word[subjects[0]] if linked else None)
        else:
            new = clause(tree, sub, i, subjects, "ACL", "right", tree.word[sub[0]])
        tree.drop(sub, comma_after=tree.word.get(sub[0] - 1) == ",")
        return new
    if kind in ("PARADVCL", "PARACL"):
        verb = next((k for k in tree.kids(i, "case") if tree.pos[k] == "VBG"), i) if tree.rel[i] == "nmod" else i
        body = [k for k in sub if not (tree.head[k] == i and tree.rel[k] == "mark")]
        mark = None
        if kind == "PARADVCL":
            if verb == i and body[0] != i and tree.pos[body[0]] in ("IN", "TO"):
                mark, body = tree.word[body[0]].lower(), body[1:]
            objects = tree.objects(up)
            by_object = tree.pos[verb] != "VBN" and objects and tree.pos.get(i - 1) == "IN" and tree.word[i - 1] != "by"
            named = objects if by_object else tree.subjects(up)
            side = "ADVCL"
        else:
            named = [up, *tree.kids(up, "conj")]
            side = "ACL"
        who = [k for k in tree.written(named) if k not in sub]
        words = {verb: stem(tree.word[verb])} if tree.pos[verb] == "VBG" else {}
        order = [*who, *([BE] if tree.pos[verb] != "VBG" else []), *body]
        new = clause(tree, order, i, named, side, "left", mark, words) if who else None
        if new and verb != i:  # a preposition in -ing becomes the verb, what it governs its object
            n_i, n_v = order.index(i) + 1, order.index(verb) + 1
            new.head[n_v], new.rel[n_v], new.head[n_i], new.rel[n_i], new.pos[n_v] = 0, "root", n_v, "dobj", "VB"
            for k in new.nodes():
                if new.head[k] == n_i and new.rel[k] in SUBJ:
                    new.head[k] = n_v
        tree.drop(sub, comma_after=True)
        return new
    return None


LINKED = frozenset(["OBJCL", "ACL", "ADVCL", "PARADVCL"])  # kinds of clauses that name the word they hang on


def _linked(tree: Tree, i: int, kind: str) -> Iterator[Tree]:
    """The clause split off at ``i``, if there is one, with its link to ``tree``."""
    up = tree.head[i]
    place, word = tree.origin.get(up), tree.word.get(up)
    new = split_point(tree, i, kind)
    if new is not None:
        new.parent, new.link, new.linking_word = tree, place, word if kind in LINKED else None
        new.complements = {}
        if kind == "OBJCL" and place is not None:
            tree.complements[place] = new
        yield new


def _appositives(tree: Tree) -> Iterator[Tree]:
    """Appositives split off, last ones first, until there are none left."""
    while True:
        points = [i for i in reversed(tree.nodes()) if tree.rel[i] == "appos" and tree.head[i] in tree.word]
        if not points:
            return
        for i in points:
            if i in tree.word and tree.head[i] in tree.word:
                yield from _linked(tree, i, "APPOS")


def restructure(tree: Tree, strategy: str = "once") -> list[Tree]:
    """The sentence and the clauses split off it, breadth first. ``strategy``: 'once' goes through the points from left to
    right; 'multiple' begins again after each split, as points may have changed; 'appositives' splits all appositives off
    first and then goes on as 'once'."""
    out, todo = [], deque([tree])
    while todo:
        t = todo.popleft()
        new = [*_appositives(t)] if strategy == "appositives" else []
        tried: set[int] = set()
        again = True
        while again:
            again = False
            for i in t.nodes():
                if i not in t.word or t.head[i] == 0 or i in tried:
                    continue
                tried.add(i)
                kind = kind_of(t, i)
                if kind not in ("CORE", "APPOSCL", "SUBJCL"):
                    before = len(t.word)
                    new += _linked(t, i, kind)
                    if strategy == "multiple" and len(t.word) != before:
                        again, tried = True, set()
                        break
        out.append(t)
        todo += new
    return out


def decompose_compound(tree: Tree, every: bool = False) -> list[Tree]:
    """Coordinated verbs as clauses of their own, with subject, auxiliary and shared end copied; the rest last. With
    ``every``, also verbs that are coordinated without a conjunction between them."""
    out: list[Tree] = []

    def split(up: int, c: int) -> bool:
        sub = tree.below(c)
        subjects = tree.subjects(c)
        order = list(sub)
        if not tree.kids(c, *SUBJ):
            if not subjects:
                return False
            lead: list[int] = [k for k in tree.written(subjects) if k not in sub]
            if tree.pos[c] in ("VBG", "VBN") and not any(tree.word[k] in COPULAS for k in tree.kids(c, *AUX)):
                lead += [k for k in tree.kids(up, *AUX) if tree.word[k] in COPULAS][:1]
            tail = [] if tree.kids(c, "dobj") else [k for k in tree.below(up, COORDINATION) if k > c and k not in sub]
            order = [*lead, *order, *tail]
        new = clause(tree, order, c, subjects, "CONJ", "right")
        new.parent, new.link, new.linking_word = tree, tree.origin[up], tree.word[up]
        out.append(new)
        tree.drop(sub)
        return True

    for i in reversed(tree.nodes()):
        if i not in tree.word:
            continue
        up = tree.head[i]
        if not tree.pos.get(up, "").startswith("VB"):
            continue
        if tree.rel[i] == "cc":
            for c in tree.kids(up, "conj"):
                split(up, c)
            for k in tree.kids(up, "cc"):
                tree.drop([k])
        elif every and tree.rel[i] == "conj" and tree.pos[i].startswith("VB"):
            split(up, i)
    return [*out, tree]


@dataclass
class Fact:
    """A tuple of nodes of one tree."""

    kind: str
    subject: list[int]
    predicate: list[int]
    object: list[int] = field(default_factory=list)
    indirect: list[int] = field(default_factory=list)
    complement: list[int] = field(default_factory=list)
    adverbials: list[list[int]] = field(default_factory=list)
    negation: bool = False
    linked: Tree | None = None  # the clause that is the complement, if it was split off


def type_of(tree: Tree, v: int) -> str | None:
    out = {tree.rel[k] for k in tree.kids(v)}
    if tree.origin[v] in tree.complements:
        out.add("ccomp")
    if tree.word[v].lower() in COPULAS and tree.rel[v] in ("cop", "aux", "auxpass"):
        return "SVc" if tree.rel[v] == "cop" else None
    if not tree.subjects(v):
        return None
    if tree.word[v].lower() in COPULAS:
        for label, kind in (("ccomp", "SVcC"), ("xcomp", "SVcX"), ("expl", "SVb")):
            if label in out:
                return kind
    if "dobj" in out or tree.shared_objects and tree.objects(v):
        return "SVOO" if "iobj" in out else "SVOC" if "xcomp" in out else "SVO"
    return "SVX" if "xcomp" in out else "SVC" if "ccomp" in out else "SV"


def verb_span(tree: Tree, v: int) -> tuple[list[int], int]:
    """A verb with the particle and the verbs it governs without comma or subject of their own, and the last of them."""
    span, last, seen = {v}, v, {v}
    while True:
        for k in tree.kids(last, "compound:prt", "compound"):
            span.add(k)
        nxt = next((k for k in tree.kids(last, "xcomp") if k not in seen and k > last and tree.pos[k].startswith("VB") and not tree.kids(k, *SUBJ) and not any(tree.word.get(m) == "," for m in range(last, k))), None)
        if nxt is None:
            return sorted(span), last
        span.update(k for k in range(last, nxt + 1) if k in tree.word and (k in (last, nxt) or tree.head[k] in (last, nxt) and tree.rel[k] in ("mark", "aux")))
        seen.add(nxt)
        last = nxt


def predicate(tree: Tree, v: int, span: list[int]) -> list[int]:
    """The span with its auxiliaries (not did/do); a participle shares those of the verb it is coordinated with."""
    aux = [k for k in tree.kids(v, *AUX)]
    if not aux and (tree.pos[v] == "VBG" or tree.pos[v] == "VBN" and tree.rel[v] == "conj") and tree.head[v] in tree.word:
        aux = tree.kids(tree.head[v], *AUX)
    return sorted({*span, *(k for k in aux if tree.word[k].lower() not in ("did", "do", "does"))})


def adverbial(tree: Tree, n: int) -> list[list[int]]:
    """A prepositional dependent, and one more for each of its conjuncts, which share its preposition."""
    case = tree.kids(n, "case")
    if not case:
        return []
    if tree.word[case[0]].lower() in ("between", "among"):
        return [[k for k in tree.below(n, CLAUSAL)]]
    out = [[k for k in tree.below(n, COORDINATION | CLAUSAL)]]
    for c in tree.kids(n, "conj"):
        own = tree.below(c, COORDINATION | CLAUSAL)
        out.append(own if tree.kids(c, "case") else [case[0], *own])
    return [a for a in out if len(a) > 1]


def adverbials(tree: Tree, v: int) -> list[list[int]]:
    return [a for n in tree.kids(v, "nmod") for a in adverbial(tree, n)]


def facts(tree: Tree) -> list[Fact]:
    """All tuples of a clause, verbs in order. Existential, SVOC and SVcX clauses give none."""
    out: list[Fact] = []
    done: set[int] = set()
    for v in [k for k in tree.nodes() if tree.pos[k].startswith("VB")]:
        if v in done:
            continue
        kind = type_of(tree, v)
        if kind is None:
            continue
        span, last = verb_span(tree, v)
        done.update(span)
        negated = bool(tree.kids(v, "neg"))
        advs = adverbials(tree, v) + (adverbials(tree, last) if last != v else [])
        if tree.rel[v] == "conj" and tree.head[v] in tree.word:
            up = tree.head[v]
            shared = adverbials(tree, up)
            if shared and (max(max(a) for a in shared) < up or min(min(a) for a in shared) > v):
                advs = advs or shared
        if tree.kids(v, "conj"):  # what follows the last coordinated verb is shared by all
            for c in tree.kids(v, "conj"):
                own = adverbials(tree, c) if tree.pos[c].startswith("VB") and not tree.kids(c, *SUBJ) else []
                advs = advs or [a for a in own if min(a) > c]
        subjects = [tree.phrase(s) for s in tree.subjects(v)]
        verb = predicate(tree, v, span)
        if kind == "SVc":
            up = tree.head[v]
            if up not in tree.word:
                continue
            done.add(up)
            subjects = [tree.phrase(s) for s in tree.subjects(up)]
            comps = [k for k in [up, *tree.kids(up, "conj")] if not tree.pos[k].startswith("VB") and (k == up or not tree.kids(k, "cop"))]
            cop = [v, *(k for k in tree.kids(up, "aux") if tree.word[k].lower() not in ("did", "do", "does"))]
            for s in subjects:
                for c in comps:
                    what = tree.phrase(c)  # with an 'of' complement, which then is no adverbial
                    out.append(Fact("SVc", s, sorted(cop), what, adverbials=[a for a in adverbials(tree, up) if not set(a) <= set(what)], negation=bool(tree.kids(up, "neg"))))
        elif kind == "SVOO":
            out += [Fact(kind, s, verb, tree.phrase(d), tree.phrase(i), adverbials=advs, negation=negated) for s in subjects for d in tree.objects(v) for i in tree.objects(v, "iobj")]
        elif kind == "SVO" or kind in ("SVX", "SVOC") and last != v:
            found = tree.objects(last) or ([] if last == v else tree.objects(v))
            kind = "SVO" if found else "SVX"
            out += [Fact(kind, s, verb, tree.phrase(o) if o else [], adverbials=advs, negation=negated) for s in subjects for o in found or [0]]
        elif kind == "SVX":
            nouns = [x for k in tree.kids(v, "xcomp") if tree.pos[k].startswith("NN") for x in (k, *tree.kids(k, "conj"))]
            out += [Fact(kind, s, verb, tree.phrase(o), adverbials=advs, negation=negated) for s in subjects for o in nouns]
        elif kind in ("SVC", "SVcC"):
            comp = [x for k in tree.kids(v, "ccomp") for x in tree.below(k)]
            linked = tree.complements.get(tree.origin[v])
            out += [Fact(kind, s, verb, complement=comp, adverbials=advs, negation=negated, linked=linked) for s in subjects]
        elif kind == "SV":
            out += [Fact(kind, s, verb, adverbials=advs, negation=negated) for s in subjects]
    return out


@dataclass
class Aside:
    """What simplification takes out of a sentence, by the place of the word it belongs to, as lists of places."""

    nouns: dict[int, list[list[int]]] = field(default_factory=dict)
    verbs: dict[int, list[list[int]]] = field(default_factory=dict)


def _gerund_case(tree: Tree, n: int) -> bool:
    return any(tree.pos[c] == "VBG" for c in tree.kids(n, "case"))


def _trimmed(tree: Tree, nodes: list[int]) -> list[int]:
    """``nodes`` without relative, participial and adverbial clauses, and without complements of prepositions in -ing."""
    gone = {x for k in nodes if tree.rel[k] in CLAUSAL or tree.rel[k] == "nmod" and _gerund_case(tree, k) for x in tree.below(k)}
    return [k for k in nodes if k not in gone]


def simplified(tree: Tree) -> tuple[Tree, Aside]:
    """A sentence without modifiers: first 'nmod' of nouns and second and later 'nmod' of verbs are set aside, then
    adjectives, numbers and compounds are dropped, which the phrases of the whole tree still have."""
    aside = Aside()
    places = lambda nodes: [tree.origin[k] for k in nodes]
    taken: list[list[int]] = []
    for i in tree.nodes():
        if tree.pos[i].startswith("NN"):
            for k in tree.kids(i, "nmod"):
                if not _gerund_case(tree, k):
                    sub = tree.below(k)
                    aside.nouns.setdefault(tree.origin[i], []).append(places(_trimmed(tree, sub)))
                    taken.append(sub)
        elif tree.pos[i].startswith("VB"):
            for k in tree.kids(i, "nmod")[1:]:
                for a in adverbial(tree, k):
                    if trimmed := _trimmed(tree, a):
                        aside.verbs.setdefault(tree.origin[i], []).append(places(trimmed))
                taken.append(tree.below(k))
    gone = {x for sub in taken for x in sub}
    for i in tree.nodes():
        if tree.pos[i].startswith("NN") and i not in gone:
            for k in tree.kids(i, "amod", "nummod", "quantmod", "nn", "compound"):
                gone.update(tree.below(k))
    for k in sorted(gone):
        for part in (tree.word, tree.pos, tree.head, tree.rel, tree.origin):
            part.pop(k, None)
    return tree, aside


def from_spacy(tokens: list[dict]) -> list[dict]:
    """Trees in the other dialect, in which prepositions and copulas are heads, turned into this one: an attribute or
    adjectival complement becomes the head and its verb the copula, what a preposition governs becomes an 'nmod' with the
    preposition as its case, and a predicative noun ('oprd') an 'xcomp'."""
    out = [dict(t) for t in tokens]
    by = {t["i"]: t for t in out}
    for t in out:
        rel = t["rel"] or ""
        t["rel"] = {"dative": "iobj", "prt": "compound:prt", "poss": "nmod:poss", "relcl": "acl:relcl", "oprd": "xcomp"}.get(rel, rel)
    for t in list(out):
        if t["rel"] == "pobj" and t["head"] in by and by[t["head"]]["rel"] in ("prep", "agent"):
            prep = by[t["head"]]
            t["head"], t["rel"] = prep["head"], "nmod"
            prep["head"], prep["rel"] = t["i"], "case"
    for t in list(out):
        verb = by.get(t["head"])
        if t["rel"] in ("attr", "acomp") and verb is not None and (verb["word"] or "").lower() in COPULAS:
            t["head"], t["rel"] = verb["head"], verb["rel"]
            verb["head"], verb["rel"] = t["i"], "cop"
            for k in out:
                if k["head"] == verb["i"] and k is not t:
                    k["head"] = t["i"]
    return out


ORDERS = ("appositives", "compounds", "once", "multiple")


def decompose(tokens: list[dict], simplify: bool = False, order: str = "appositives", shared_objects: bool = False) -> list[Tree]:
    """A sentence as simple clauses. ``order``: a strategy of ``restructure``, after which coordinated verbs are split; or
    'compounds', in which they are split first, and each clause by strategy 'appositives' after."""
    return _decomposed(tokens, simplify, order, shared_objects)[0]


def _decomposed(tokens: list[dict], simplify: bool, order: str, shared_objects: bool) -> tuple[list[Tree], Aside | None]:
    tree, aside = Tree.of(tokens, shared_objects), None
    if simplify:
        tree, aside = simplified(tree)
    if order == "compounds":
        out = [c for part in decompose_compound(tree, shared_objects) if part.word for c in restructure(part, "appositives")]
    else:
        out = [c for t in restructure(tree, order) if t.word for c in decompose_compound(t, shared_objects)]
    return [c for c in out if c.word], aside


def parent_numbers(trees: list[Tree]) -> list[int | None]:
    """For each clause the number of the clause it was split off: the one that now has the word it hung on."""
    own = {id(t): n for n, t in enumerate(trees)}
    parts: dict[int, list[int]] = {}
    for n, t in enumerate(trees):
        if t.kind == "CONJ" and t.parent is not None:
            parts.setdefault(id(t.parent), []).append(n)
    out: list[int | None] = []
    for t in trees:
        if t.parent is None:
            out.append(None)
            continue
        among = ([own[id(t.parent)]] if id(t.parent) in own else []) + [n for n in parts.get(id(t.parent), []) if trees[n] is not t]
        holds = [n for n in among if t.link in trees[n].origin.values()]
        out.append((holds or among or [None])[0])
    return out


def rebuilt(full: Tree, places: list[int], aside: Aside) -> list[int]:
    """Original nodes of an element with what simplification took: the complements set aside from its nouns, and the
    phrases of all its nouns."""
    nodes = {p + 1 for p in places if p >= 0}
    todo = sorted(nodes)
    while todo:
        for part in aside.nouns.get(todo.pop() - 1, []):
            new = {p + 1 for p in part if p >= 0} - nodes
            nodes |= new
            todo += new
    out = set(nodes)
    for k in nodes:
        if full.pos.get(k, "").startswith("NN"):
            out.update(x for x in full.phrase(k) if x in full.word)
    return sorted(out)


ELEMENT = pa.struct([("word", pa.string()), ("word_index", pa.list_(pa.int32())), ("prep", pa.string())])
SPARK_ELEMENT = "struct<word:string,word_index:array<int>,prep:string>"


def _element(tree: Tree, parts: list[int], full: Tree | None, aside: Aside | None) -> dict | None:
    if not parts:
        return None
    index = [tree.origin[k] for k in parts]
    if full is not None:
        nodes = rebuilt(full, index, aside)
        if len(nodes) > len([x for x in index if x >= 0]):
            return {"word": full.text(nodes), "word_index": [k - 1 for k in nodes], "prep": None}
    return {"word": tree.text(parts), "word_index": index, "prep": None}


def _adverbial(tree: Tree, parts: list[int], full: Tree | None, aside: Aside | None) -> dict:
    index = [tree.origin[k] for k in parts]
    return _placed(full, index, aside) if full is not None and min(index) >= 0 else {"word": tree.text(parts[1:]), "word_index": index, "prep": tree.word[parts[0]]}


def _placed(full: Tree, places: list[int], aside: Aside) -> dict:
    """An adverbial from the places of its words, its preposition first, with what simplification took."""
    rest = [k for k in rebuilt(full, places[1:], aside) if k != places[0] + 1]
    return {"word": full.text(rest), "word_index": [places[0], *(k - 1 for k in rest)], "prep": full.word[places[0] + 1]}


def sentence_facts(tokens: list[dict], how: str = "raw", dialect: str = "corenlp", order: str = "appositives") -> list[dict]:
    """All tuples of a sentence, see ``extract``."""
    spacy = dialect == "spacy"
    if spacy:
        tokens = from_spacy(tokens)
    full = Tree.of(tokens) if how == "simplified" else None
    trees, aside = ([Tree.of(tokens, spacy)], None) if how == "raw" else _decomposed(tokens, how == "simplified", order, spacy)
    parents = parent_numbers(trees)
    rows: list[dict] = []
    said: list[tuple[dict, Fact, int]] = []
    for c, t in enumerate(trees):
        for f in facts(t):
            advs = [_adverbial(t, a, full, aside) for a in f.adverbials]
            if aside is not None:
                verb = next((t.origin[k] for k in f.predicate if t.origin[k] in aside.verbs), None)
                advs += [_placed(full, a, aside) for a in aside.verbs.get(verb, [])]
            row = {
                "tuple_no": len(rows), "clause_type": f.kind, "negation": f.negation, "subject": _element(t, f.subject, full, aside), "predicate": _element(t, f.predicate, None, None),
                "direct_object": _element(t, f.object, full, aside), "indirect_object": _element(t, f.indirect, full, aside), "adverbial": advs, "complement": t.text(f.complement) if f.complement else None,
                "complement_tuples": [], "clause": t.text(), "clause_no": c, "parent_clause": parents[c],
            }
            rows.append(row)
            said.append((row, f, c))
    for row, f, c in said:
        if f.linked is not None:
            inside = [n for n, t in enumerate(trees) if t is f.linked or t.kind == "CONJ" and t.parent is f.linked]
            row["complement"] = " ".join(trees[n].text() for n in sorted(inside, key=lambda n: max(trees[n].origin.values()))) or row["complement"]
            row["complement_tuples"] = [r["tuple_no"] for r, _, n in said if n in inside]
        elif f.complement:
            row["complement_tuples"] = [r["tuple_no"] for r, g, n in said if n == c and set(g.predicate) <= set(f.complement)]
    return rows


FIELDS = [("tuple_no", pa.int32(), "int"), ("clause_type", pa.string(), "string"), ("negation", pa.bool_(), "boolean"), *((r, ELEMENT, SPARK_ELEMENT) for r in ("subject", "predicate", "direct_object", "indirect_object")), ("adverbial", pa.list_(ELEMENT), f"array<{SPARK_ELEMENT}>"), ("complement", pa.string(), "string"), ("complement_tuples", pa.list_(pa.int32()), "array<int>"), ("clause", pa.string(), "string"), ("clause_no", pa.int32(), "int"), ("parent_clause", pa.int32(), "int")]
CLAUSE_FIELDS = [("clause_no", pa.int32(), "int"), ("parent_clause", pa.int32(), "int"), *((n, pa.string(), "string") for n in ("kind", "side", "mark", "linking_word", "text"))]


def _by_sentence(sents: DataFrame, made: Callable[[list[dict]], list[dict]], fields: list[tuple]) -> DataFrame:
    """The rows that ``made`` gives for the tokens of each sentence, with the sentence's ids."""
    keys = [c for c in sents.columns if c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[dict] = []
            for n, tokens in enumerate(batch.column(len(keys)).to_pylist()):
                found = made(tokens) if tokens else []
                at += [n] * len(found)
                rows += found
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(where) for n in range(len(keys))), *(pa.array([r[f] for r in rows], kind) for f, kind, _ in fields)], [*keys, *(f for f, _, _ in fields)])

    out = ", ".join([f"`{k}` {sents.schema[k].dataType.simpleString()}" for k in keys] + [f"{f} {kind}" for f, _, kind in fields])
    return sents.select(*keys, "tokens").mapInArrow(run, out)


def extract(sents: DataFrame, how: str = "raw", dialect: str = "corenlp", order: str = "appositives") -> DataFrame:
    """Tuples of sentences: ``how`` is 'raw', 'clauses' (the sentence decomposed first, in the ``order`` of ``decompose``)
    or 'simplified' (modifiers taken out before, and put back by their places after). With ``dialect`` 'spacy', trees are
    turned into the own dialect first, and coordinated verbs share what follows them.

    A tuple with a clause as complement has its text in ``complement`` and the numbers of its tuples in
    ``complement_tuples``; ``clause_no`` and ``parent_clause`` link clauses as in ``clauses``."""
    return _by_sentence(sents, lambda tokens: sentence_facts(tokens, how, dialect, order), FIELDS)


def clauses(sents: DataFrame, simplify: bool = False, order: str = "appositives", dialect: str = "corenlp") -> DataFrame:
    """The simple clauses of each sentence: ``clause_no``, ``parent_clause`` (the one it was split off), ``kind``, ``side``,
    ``mark``, ``linking_word`` (the word it hung on), ``text``."""
    spacy = dialect == "spacy"

    def made(tokens: list[dict]) -> list[dict]:
        trees = decompose(from_spacy(tokens) if spacy else tokens, simplify, order, spacy)
        return [{"clause_no": n, "parent_clause": up, "kind": t.kind, "side": t.side, "mark": t.mark, "linking_word": t.linking_word, "text": t.text()} for n, (t, up) in enumerate(zip(trees, parent_numbers(trees)))]

    return _by_sentence(sents, made, CLAUSE_FIELDS)


def noun_phrases(sents: DataFrame) -> DataFrame:
    """For each noun, ``i``, the words of its phrase."""

    def made(tokens: list[dict]) -> list[dict]:
        tree = Tree.of(tokens)
        return [{"i": i, "phrase": tree.text(tree.phrase(i))} for i in tree.nodes() if tree.pos[i].startswith("NN")]

    return _by_sentence(sents, made, [("i", pa.int32(), "int"), ("phrase", pa.string(), "string")])
