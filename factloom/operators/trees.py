"""Tree primitives, clause detection, clause types and head-word tuples over sentences of tokens.

Most works inside the row of a sentence with higher-order functions, or on its exploded tokens, without a shuffle.
Subtrees, chains of conjuncts and trimming double pointers over exploded tokens (``hierarchy``), which places them by
sentence once. Defined results: null rel or head means no link; a head that is no token has no word; of several subjects the
first counts, with its conjuncts; empty sentences give no rows; ``keys`` are the sentence's ids and may be any columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import COPULAS
from factloom.operators import hierarchy

NODE = "struct<i:int,word:string,pos:string,rel:string>"
# Relation labels.
SUBJECTS = ["nsubj", "nsubjpass"]
POINTS = ["advcl", "acl", "acl:relcl", "relcl", "appos", "ccomp", "csubj", "xcomp", "nmod"]
POINTS_SPACY = ["advcl", "acl", "acl:relcl", "relcl", "appos", "ccomp", "csubj"]
CUTS = ["acl", "advcl", "acl:relcl", "relcl"]


def keys_of(sents: DataFrame) -> list[str]:
    return [c for c in sents.columns if c != "tokens"]


def _node(t: Column) -> Column:
    return F.struct(t["i"].alias("i"), t["word"].alias("word"), t["pos"].alias("pos"), t["rel"].alias("rel"))


def enriched(sents: DataFrame) -> DataFrame:
    """One row per token with its ``parent`` (node, null at the top), ``kids`` (nodes in order), ``prev`` (word before),
    ``parent_kids``."""
    keys = keys_of(sents)
    t = sents.select(*keys, "tokens", F.explode("tokens").alias("t"))
    kids = lambda i: F.transform(F.filter("tokens", lambda c: c["head"] == i), _node)
    one = lambda i: F.get(F.transform(F.filter("tokens", lambda c: c["i"] == i), _node), F.lit(0))
    return t.select(*keys, "tokens", F.col("t.i").alias("i"), F.col("t.word").alias("word"), F.col("t.pos").alias("pos"), F.col("t.head").alias("head"), F.col("t.rel").alias("rel"), one(F.col("t.head")).alias("parent"), kids(F.col("t.i")).alias("kids"), one(F.col("t.i") - 1)["word"].alias("prev"), kids(F.col("t.head")).alias("parent_kids"))


def rels(kids: str = "kids") -> Column:
    return F.coalesce(F.transform(kids, lambda k: F.coalesce(k["rel"], F.lit(""))), F.array().cast("array<string>"))


def children(sents: DataFrame) -> DataFrame:
    """``i`` and each of its dependents with the label."""
    e = enriched(sents)
    return e.select(*keys_of(sents), "i", F.explode("kids").alias("k")).select(*keys_of(sents), "i", F.col("k.i").alias("child"), F.col("k.word").alias("word"), F.col("k.rel").alias("rel"))


def relations(sents: DataFrame) -> DataFrame:
    """``incoming`` label ('root' at a top, null for a token without any link) and the sorted ``outgoing`` ones."""
    e = enriched(sents)
    incoming = F.when(F.col("head") == 0, "root").otherwise(F.col("rel"))
    return e.select(*keys_of(sents), "i", incoming.alias("incoming"), F.array_join(F.array_sort(rels()), ",").alias("outgoing"))


def _of(kids: Column, labels: list[str]) -> Column:
    return F.filter(kids, lambda k: k["rel"].isin(labels))


def conjuncts(tokens: Column, i: Column) -> Column:
    """Direct ``conj`` dependents, as nodes."""
    return F.transform(F.filter(tokens, lambda c: (c["head"] == i) & (c["rel"] == "conj")), _node)


def _with_conjuncts(first: Column) -> Column:
    """A node (or null) followed by its conjuncts; empty for null."""
    return F.when(first.isNotNull(), F.concat(F.array(first), conjuncts(F.col("tokens"), first["i"]))).otherwise(F.array().cast(f"array<{NODE}>"))


def subjects() -> Column:
    """First subject and its conjuncts; for a conjunct without subject, those of its head."""
    own = F.get(_of(F.col("kids"), SUBJECTS), F.lit(0))
    up = F.get(_of(F.coalesce(F.col("parent_kids"), F.array().cast(f"array<{NODE}>")), SUBJECTS), F.lit(0))
    return _with_conjuncts(F.coalesce(own, F.when(F.col("rel") == "conj", up)))


def objects(label: str = "dobj") -> Column:
    """All objects with their conjuncts."""
    return F.flatten(F.transform(_of(F.col("kids"), [label]), _with_conjuncts))


def conjunction_chains(sents: DataFrame) -> DataFrame:
    """Chains that follow ``conj`` from a first conjunct on: ``i``, ``member``, ``step``."""
    keys = keys_of(sents)
    t = sents.select(*keys, F.explode("tokens").alias("t")).select(*keys, "t.i", "t.head", "t.rel")
    chain = t.select(*keys, "i", F.when(F.col("rel") == "conj", F.col("head")).alias("up"))
    down = hierarchy.descendants(hierarchy.resolve(chain, keys, "i", "up"), keys, "i")
    return down.select(*keys, F.col("ancestor").alias("i"), F.col("descendant").alias("member"), F.col("distance").alias("step"))


def conjunction_span(sents: DataFrame) -> DataFrame:
    """Coordinated subjects written out: every word from the first to the last of them."""
    keys = keys_of(sents)
    s = enriched(sents).filter("pos LIKE 'VB%'").withColumn("s", subjects()).filter("size(s) > 1")
    lo, hi = F.array_min(F.transform("s", lambda x: x["i"])), F.array_max(F.transform("s", lambda x: x["i"]))
    words = F.transform(F.filter("tokens", lambda t: t["i"].between(lo, hi)), lambda t: F.coalesce(t["word"], F.lit("")))
    return s.select(*keys, "i", F.array_join(words, " ").alias("subject"))


def subtrees(sents: DataFrame, exclusion: list[str] | None = None) -> DataFrame:
    """``i`` and each node of its subtree, itself included, by pointer doubling. With ``exclusion``, nodes are pruned at
    any such label on the way, the start node's own one included. Nodes on or below a round have no subtree."""
    keys = keys_of(sents)
    t = sents.select(*keys, F.explode("tokens").alias("t")).select(*keys, "t.i", "t.head", "t.rel")
    r = hierarchy.resolve(t.filter("head IS NOT NULL"), keys, "i", "head", "rel", 0).filter("NOT cyclic AND NOT leads_to_cycle")
    lag = F.size("path") - F.size("labels")
    flat = r.select(*keys, F.col("i").alias("node"), "path", "labels", lag.alias("lag"), F.posexplode("path").alias("at", "i"))
    if exclusion:
        way = F.slice("labels", F.greatest(F.col("at") - F.col("lag") + 1, F.lit(1)), F.size("labels"))
        flat = flat.filter(~F.arrays_overlap(way, F.array(*map(F.lit, exclusion))))
    return flat.select(*keys, "i", "node")


def phrase_heads(spans: DataFrame, sents: DataFrame) -> DataFrame:
    """The one node of each span (``span_id``, ``lo``, ``hi``) whose head is outside it; null if none or several."""
    keys = keys_of(sents)
    both = spans.join(sents, keys)
    out = F.filter("tokens", lambda t: t["i"].between(F.col("lo"), F.col("hi")) & ~F.coalesce(t["head"].between(F.col("lo"), F.col("hi")), F.lit(False)))
    return both.select(*keys, "span_id", F.when(F.size(out) == 1, F.get(F.transform(out, lambda t: t["i"]), F.lit(0))).alias("head_i"))


def noun_chunks(sents: DataFrame) -> DataFrame:
    """Runs of determiners, adjectives, numbers and nouns that end in a noun: ``lo``, ``hi``, ``words``."""
    keys = keys_of(sents)
    code = lambda t: F.when(t["pos"].rlike("^(NN|PRP$)"), "N").when(t["pos"].rlike(r"^(DT|JJ|CD|PRP\$|POS)"), "M").otherwise("x")
    coded = sents.select(*keys, "tokens", F.array_join(F.transform("tokens", code), "").alias("code"))
    starts = F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.substr("code", i, F.lit(1)).isin("N", "M") & ((i == 1) | (F.substr("code", i - 1, F.lit(1)) == "x")))
    runs = coded.select(*keys, "tokens", "code", F.explode(starts).alias("lo"))
    run = F.regexp_extract(F.substr("code", F.col("lo")), "^([MN]*N)", 1)
    found = runs.withColumn("n", F.length(run)).filter("n > 0")
    words = F.transform(F.slice("tokens", F.col("lo"), F.col("n")), lambda t: F.coalesce(t["word"], F.lit("")))
    return found.select(*keys, "lo", (F.col("lo") + F.col("n") - 1).alias("hi"), F.array_join(words, " ").alias("words"))


def kept_tokens(sents: DataFrame) -> DataFrame:
    """The tokens left when noun chunks of several words are cut down to their head (the first word whose head is outside)
    and their determiners and possessives: ``i`` (the place in the sentence) and ``word``."""
    keys = keys_of(sents)
    spans = noun_chunks(sents).filter("hi > lo").groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # of one sentence
    both = sents.join(spans, keys, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")))
    heads = F.transform("spans", lambda s: F.array_min(F.transform(F.filter("tokens", lambda t: t["i"].between(s["lo"], s["hi"]) & ~F.coalesce(t["head"].between(s["lo"], s["hi"]), F.lit(False))), lambda t: t["i"])))
    kept = F.filter("tokens", lambda t: ~F.exists("spans", lambda s: t["i"].between(s["lo"], s["hi"])) | F.coalesce(F.array_contains("heads", t["i"]), F.lit(False)) | F.coalesce(t["rel"].isin("det", "nmod:poss"), F.lit(False)))
    return both.withColumn("heads", heads).select(*keys, F.explode(kept).alias("t")).select(*keys, "t.i", "t.word")


def clause_points(sents: DataFrame, dialect: str = "corenlp") -> DataFrame:
    """Where sentences may be decomposed, and the kind of clause there (CORE is not split)."""
    keys = keys_of(sents)
    spacy = dialect == "spacy"
    e = enriched(sents).filter(F.col("rel").isin(POINTS_SPACY if spacy else POINTS))
    subj = F.arrays_overlap(rels(), F.array(*map(F.lit, SUBJECTS)))
    participle = F.col("pos").isin("VBG", "VBN")
    after_to = F.col("prev") == "to"
    noun, ppos = F.col("pos").startswith("NN"), F.col("parent.pos")
    comma = F.exists("tokens", lambda t: (t["i"] > F.col("head")) & (t["i"] < F.col("i")) & (t["word"] == ","))
    gerund_case = F.exists("kids", lambda k: (k["rel"] == "case") & (k["pos"] == "VBG"))
    acl = F.col("rel").isin("acl", "acl:relcl", "relcl")
    none = F.lit(None).cast("string")
    advcl = F.when(participle & ~subj, "PARADVCL").when(after_to, "INFINITE").when(subj, "ADVCL")
    advcl = advcl.when(noun, "NN").when(F.col("pos") == "JJ", "JJ") if spacy else advcl
    ccomp = F.when(subj, F.when(~F.array_contains(rels("parent_kids"), "dobj"), F.when(ppos.startswith("NN"), "APPOSCL").otherwise("OBJCL")))
    ccomp = ccomp if spacy else ccomp.when(noun, "NN").when(F.col("pos") == "JJ", "JJ")
    kind = (
        F.when(F.col("rel") == "appos", F.when(ppos.startswith("NN"), "APPOS"))
        .when(F.col("rel") == "advcl", advcl)
        .when(acl, F.when(participle & ~subj, "PARACL").when(after_to, "INFINITE").when(F.col("head") < F.col("i"), "ACL"))
        .when(F.col("rel") == "ccomp", ccomp)
        .when(F.col("rel") == "xcomp", F.when(participle & (F.col("i") > F.col("head")) & comma, "PARADVCL"))
        .when(F.col("rel") == "csubj", "SUBJCL")
        .when(F.col("rel") == "nmod", F.when(gerund_case & ppos.startswith("NN"), "PARACL").when(gerund_case & ppos.startswith("VB"), "PARADVCL"))
        .otherwise(none)
    )
    return e.select(*keys, "i", "rel", F.coalesce(kind, F.lit("CORE")).alias("kind"))


def clause_type(dialect: str = "corenlp") -> Column:
    """The clause type of a verb's row of ``enriched``."""
    out = rels()
    has = lambda *r: F.arrays_overlap(out, F.array(*map(F.lit, r)))
    subj = F.size(subjects()) > 0
    up = rels("parent_kids")
    up_has = lambda r: F.array_contains(up, r)
    if dialect == "spacy":
        copula = F.col("word").isin(COPULAS)
        above = F.transform(_of(F.coalesce(F.col("parent_kids"), F.array().cast(f"array<{NODE}>")), ["dobj"]), lambda k: k["i"])
        shared = F.coalesce((F.col("rel") == "conj") & (F.array_min(above) > F.col("i")), F.lit(False))  # the object of the verb it is coordinated with
        kind = F.when(copula & F.col("rel").isin("aux", "auxpass"), None).when(copula & subj & has("ccomp"), "SVcC").when(copula & subj & has("xcomp"), "SVcX").when(copula & has("attr") & has("expl"), "SVb").when(subj & has("attr", "acomp"), "SVc")
        kind = kind.when(subj & has("dobj") & has("iobj"), "SVOO").when(subj & has("dobj") & has("oprd"), "SVOC").when(subj & has("dobj") | shared, "SVO")
        return kind.when(~subj, None).when(has("xcomp"), "SVX").when(has("ccomp"), "SVC").when(has("oprd"), "SVX").otherwise("SV")
    up_subj = F.arrays_overlap(up, F.array(*map(F.lit, SUBJECTS)))
    any_subj = subj | up_subj
    copula = F.when(F.col("rel") == "cop", "SVc").when(F.col("rel").isin("aux", "auxpass"), None).when(any_subj & has("ccomp"), "SVcC").when(any_subj & has("xcomp"), "SVcX").when(any_subj & has("expl"), "SVb")
    plain = F.when(~subj, None).when(has("dobj") & has("iobj"), "SVOO").when(has("dobj") & has("xcomp"), "SVOC").when(has("dobj"), "SVO").when(has("xcomp"), "SVX").when(has("ccomp"), "SVC").otherwise("SV")
    settled = F.col("rel").isin("cop", "aux", "auxpass")
    return F.when(F.col("word").isin(COPULAS), F.when(settled, copula).otherwise(F.coalesce(copula, plain))).otherwise(plain)


def typed_verbs(sents: DataFrame, dialect: str = "corenlp") -> DataFrame:
    """Verbs with their clause type (null: none) and ``negation``; that of a copula hangs on its complement."""
    e = enriched(sents).filter("pos LIKE 'VB%'")
    where = F.when(F.col("rel") == "cop", rels("parent_kids")).otherwise(rels())
    return e.withColumn("clause_type", clause_type(dialect)).withColumn("negation", F.array_contains(where, "neg"))


def head_tuples(sents: DataFrame, kind: str) -> DataFrame:
    """Head words of subject, verb and objects for one clause type: SV, SVO, SVOO or SVc (subject, copula, complement).
    Subjects x objects of one verb; complements are the copula's head and its conjuncts without a copula of their own."""
    keys = keys_of(sents)
    v = typed_verbs(sents).filter(F.col("clause_type") == kind)
    if kind == "SVc":
        parent = F.col("parent")
        first = F.get(_of(F.col("parent_kids"), SUBJECTS), F.lit(0))
        grand = F.get(F.filter("tokens", lambda t: t["i"] == parent["i"]), F.lit(0))
        above = F.get(F.transform(F.filter("tokens", lambda c: (c["head"] == grand["head"]) & c["rel"].isin(SUBJECTS)), _node), F.lit(0))
        subj = _with_conjuncts(F.coalesce(first, F.when(parent["rel"] == "conj", above)))
        others = F.filter(conjuncts(F.col("tokens"), parent["i"]), lambda c: ~F.coalesce(c["pos"].startswith("VB"), F.lit(False)) & ~F.exists("tokens", lambda t: (t["head"] == c["i"]) & (t["rel"] == "cop")))
        self_ok = F.filter(F.array(parent), lambda p: ~F.coalesce(p["pos"].startswith("VB"), F.lit(False)))
        rows = v.select(*keys, "i", "word", "negation", F.explode(subj).alias("s"), F.concat(self_ok, others).alias("os"))
        return rows.select(*keys, "i", F.col("s.word").alias("subject"), F.col("word").alias("predicate"), F.explode("os").alias("o"), "negation").select(*keys, "i", "subject", "predicate", F.col("o.word").alias("object"), "negation")
    rows = v.select(*keys, "i", F.col("word").alias("predicate"), "negation", F.explode(subjects()).alias("s"), objects().alias("ds"), objects("iobj").alias("is"))
    out = rows.select(*keys, "i", F.col("s.word").alias("subject"), "predicate", "negation", "ds", "is")
    if kind == "SV":
        return out.drop("ds", "is")
    out = out.select(*keys, "i", "subject", "predicate", "negation", F.explode("ds").alias("d"), "is").withColumn("object", F.col("d.word"))
    if kind == "SVO":
        return out.drop("d", "is")
    return out.select(*keys, "i", "subject", "predicate", "negation", "object", F.explode("is").alias("x")).select(*keys, "i", "subject", "predicate", "negation", "object", F.col("x.word").alias("indirect_object"))


def extra_adverbials(sents: DataFrame) -> DataFrame:
    """Second and later ``nmod`` dependents of verbs, with their preposition if any."""
    keys = keys_of(sents)
    e = enriched(sents).filter("pos LIKE 'VB%'")
    n = e.select(*keys, "tokens", F.col("i").alias("verb"), F.posexplode(_of(F.col("kids"), ["nmod"])).alias("nth", "n"))
    prep = F.get(F.transform(F.filter("tokens", lambda t: (t["head"] == F.col("n.i")) & (t["rel"] == "case")), lambda t: t["word"]), F.lit(0))
    return n.select(*keys, "verb", (F.col("nth") + 1).alias("nth"), F.col("n.i").alias("i"), prep.alias("prep"), F.col("n.word").alias("word"))


def trimmed(sents: DataFrame, exclusion: list[str] | None = None) -> DataFrame:
    """``text`` of each sentence without the subtrees of relative, participial and adverbial clauses, and of complements
    of prepositions in -ing."""
    keys = keys_of(sents)
    gerund = F.exists("tokens", lambda c: (c["head"] == F.col("t.i")) & (c["rel"] == "case") & (c["pos"] == "VBG"))
    cut_at = sents.select(*keys, "tokens", F.explode("tokens").alias("t")).filter(F.col("t.rel").isin(exclusion or CUTS) | ((F.col("t.rel") == "nmod") & gerund)).select(*keys, F.col("t.i").alias("i"))
    gone = subtrees(sents).join(cut_at, [*keys, "i"], "left_semi").groupBy(*keys).agg(F.collect_set("node").alias("gone"))
    both = sents.join(gone, keys, "left")
    held = F.filter("tokens", lambda t: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), t["i"]))
    return both.select(*keys, F.array_join(F.transform(held, lambda t: F.coalesce(t["word"], F.lit(""))), " ").alias("text"))


def verb_chunks(sents: DataFrame) -> DataFrame:
    """Verbs with the prepositions, and the words between, that follow them, by a pattern over the tags: a verb and two
    prepositions; a verb, words and (left out) the preposition after them; or a verb and one preposition."""
    keys = keys_of(sents)
    word = lambda t: t["pos"].rlike(r"^(NN|JJ|RB.*|PRP.*|DT)$")
    code = lambda t: F.when(t["pos"].rlike("^VB"), "V").when(t["pos"].isin("IN", "TO", "PR"), "p").when(word(t), "w").otherwise("x")
    coded = sents.select(*keys, "tokens", F.array_join(F.transform("tokens", code), "").alias("code"))
    verbs = coded.select(*keys, "tokens", "code", F.explode(F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.substr("code", i, F.lit(1)) == "V")).alias("lo"))
    n = F.length(F.regexp_extract(F.substr("code", F.col("lo")), "^(V(?:pp|p?w+(?=p)|p))", 1))
    found = verbs.withColumn("n", n).filter("n > 1")
    return found.select(*keys, "lo", (F.col("lo") + F.col("n") - 1).alias("hi"), F.array_join(F.transform(F.slice("tokens", F.col("lo"), F.col("n")), lambda t: F.coalesce(t["word"], F.lit(""))), " ").alias("words"))
