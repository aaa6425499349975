"""Tuple algebra: elements, triples, equality, merging of extraction runs, overlap.

A tuples table has ``doc_id``, ``sent_id``, ``tuple_id``, ``run``, the roles ``subject``, ``predicate``,
``direct_object``, ``indirect_object`` (Element structs) and ``adverbial`` (array of Elements). Null elements are
absent roles; an element with null word is absent too. Null adverbial arrays are empty ones. Rows are compared within
one sentence only, so every join has (doc_id, sent_id) and a word among its equality keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.runtime import cut, small

ROLES = ("subject", "predicate", "direct_object", "indirect_object")
SENTENCE = ["doc_id", "sent_id"]


def refine_word(word: Column) -> Column:
    """Undo the tokenizer's spaces around possessive s, hyphens and commas."""
    for a, b in ((" 's", "'s"), (" - ", "-"), (" , ", ", ")):
        word = F.replace(word, F.lit(a), F.lit(b))
    return word


def adverbials(t: str = "adverbial") -> Column:
    empty = F.filter(F.coalesce(F.col(t), F.array()), lambda e: e["word"].isNotNull())
    return empty


def once(df: DataFrame) -> DataFrame:
    """Rows sent again count once: one row for each tuple_id."""
    return df.dropDuplicates(["tuple_id"])


def elements(t: DataFrame) -> DataFrame:
    """One row for each element of each tuple, with its ``role`` and its place ``ord`` among adverbials."""
    single = [F.struct(F.lit(r).alias("role"), F.lit(0).alias("ord"), F.col(r).alias("e")) for r in ROLES]
    many = F.transform(F.col("adverbial"), lambda e, i: F.struct(F.lit("adverbial").alias("role"), i.alias("ord"), e.alias("e")))
    every = F.concat(F.array(*single), F.coalesce(many, F.array().cast(f"array<struct<role:string,ord:int,e:{t.schema['subject'].dataType.simpleString()}>>")))
    rows = t.select("doc_id", "sent_id", "tuple_id", "run", F.explode(F.filter(every, lambda x: x["e"]["word"].isNotNull())).alias("x"))
    return rows.select("doc_id", "sent_id", "tuple_id", "run", "x.role", "x.ord", "x.e.*")


def triples(t: DataFrame) -> DataFrame:
    """One row for each triple (subject, predicate, object, label) of each tuple, numbered by ``ord``. A tuple with
    neither direct object nor adverbial gives a triple without object, also beside an indirect object."""
    kind = "struct<o:string,label:string>"
    part = lambda role, label: F.when(F.col(f"{role}.word").isNotNull(), F.array(F.struct(F.col(f"{role}.word").alias("o"), F.lit(label).alias("label")))).otherwise(F.array().cast(f"array<{kind}>"))
    adv = F.transform(adverbials(), lambda e: F.struct(e["word"].alias("o"), e["prep"].alias("label")))
    bare = F.when(F.col("direct_object.word").isNull() & (F.size(adverbials()) == 0), F.array(F.struct(F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("label")))).otherwise(F.array().cast(f"array<{kind}>"))
    rows = t.select(*SENTENCE, "tuple_id", "run", F.col("subject.word").alias("s"), F.col("predicate.word").alias("p"), F.posexplode(F.concat(part("direct_object", "dobj"), part("indirect_object", "iobj"), adv, bare)).alias("ord", "x"))
    return rows.select(*SENTENCE, "tuple_id", "run", "ord", "s", "p", "x.o", "x.label")


def triple_key(tr: DataFrame) -> DataFrame:
    """Triples with their comparison key: subject and object refined and without case, predicate as written."""
    return tr.withColumn("ks", F.lower(refine_word(F.col("s")))).withColumn("ko", F.lower(refine_word(F.col("o"))))


def element_key(role: str) -> Column:
    """Equality of elements as a string: word without case, and preposition without case or its absence."""
    e = F.col(role)
    return F.when(e["word"].isNotNull(), F.concat(F.lower(e["word"]), F.lit("\u0001"), F.coalesce(F.lower(e["prep"]), F.lit("\u0002"))))


def role_key(roles: tuple[str, ...] = ROLES) -> Column:
    return F.concat_ws("\u0003", *[F.coalesce(element_key(r), F.lit("\u0004")) for r in roles])


def adverbial_keys() -> Column:
    return F.transform(adverbials(), lambda e: F.concat(F.lower(e["word"]), F.lit("\u0001"), F.coalesce(F.lower(e["prep"]), F.lit("\u0002"))))


def hash_key() -> Column:
    """Case-sensitive words of all roles, prepositions ignored."""
    words = [F.coalesce(F.col(f"{r}.word"), F.lit("")) for r in ROLES]
    return F.concat_ws(";", *words, F.transform(adverbials(), lambda e: e["word"]))


def equal_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of equal tuples of two runs: roles equal, and as many adverbials, each of the first found in the second.
    Repeated tuples are paired by class: the smallest id of each class stands for it, with its number of rows."""
    keyed = lambda t, p: t.filter("subject.word IS NOT NULL AND predicate.word IS NOT NULL").select(*SENTENCE, "tuple_id", role_key().alias("k"), F.array_sort(adverbial_keys()).alias(p)).groupBy(*SENTENCE, "k", p).agg(F.min("tuple_id").alias(f"{p}_id"), F.count("*").alias(f"{p}_rows"))
    both = keyed(a, "left").join(keyed(b, "right"), [*SENTENCE, "k"])
    return both.filter((F.size("left") == F.size("right")) & F.forall("left", lambda x: F.array_contains("right", x))).select(*SENTENCE, "left_id", "right_id", "left_rows", "right_rows")


def similar(x: Column, y: Column) -> Column:
    """Refined words equal without case, or the reference of the first (else of the second) names the other."""
    wx, wy = refine_word(F.lower(x["word"])), refine_word(F.lower(y["word"]))
    named = F.when(x["reference"].isNotNull() & (x["reference"] != ""), F.lower(x["reference"]) == wy).otherwise(F.coalesce(F.lower(y["reference"]) == wx, F.lit(False)))
    return (wx == wy) | named


def compared(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """Pairs of tuples of one sentence that agree role by role, references resolved; with ``strict``, adverbials too.

    Candidates are joined on the subject: both its word and its reference are keys, so no pair of a sentence is tried
    that shares neither.
    """
    names = lambda e: F.array_distinct(F.filter(F.array(refine_word(F.lower(e["word"])), F.lower(e["reference"])), lambda w: w.isNotNull() & (w != "")))
    side = lambda t, p: t.filter("subject.word IS NOT NULL AND predicate.word IS NOT NULL").withColumn("adverbial", adverbials()).select(*SENTENCE, F.col("tuple_id").alias(f"{p}_id"), F.struct(*ROLES, "adverbial").alias(p), F.explode(names(F.col("subject"))).alias("_n"))
    pairs = side(a, "left").join(side(b, "right"), [*SENTENCE, "_n"])
    ok = similar(F.col("left.subject"), F.col("right.subject")) & similar(F.col("left.predicate"), F.col("right.predicate"))
    for r in ROLES[2:]:
        lw, rw = F.col(f"left.{r}.word"), F.col(f"right.{r}.word")
        ok = ok & ((lw.isNull() & rw.isNull()) | (lw.isNotNull() & rw.isNotNull() & similar(F.col(f"left.{r}"), F.col(f"right.{r}"))))
    if strict:
        ok = ok & (F.size("left.adverbial") == F.size("right.adverbial")) & F.forall("left.adverbial", lambda x: F.exists("right.adverbial", lambda y: similar(x, y)))
    return pairs.filter(ok).select(*SENTENCE, "left_id", "right_id").distinct()


def merge_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge run ``b`` into run ``a``: the j-th tuple of ``b`` with some roles goes into copy ((j - 1) mod n) of the n
    tuples of ``a`` with the same roles, or into the first of its own kind where ``a`` has none. Equal copies inside
    ``a`` stay apart, those inside ``b`` collapse. One row per merged tuple: ``first_id``, ``n_merged`` and the sorted
    distinct adverbials as ``adv``."""
    within = Window.partitionBy(*SENTENCE, "k")
    keyed = lambda t: t.filter("subject.word IS NOT NULL AND predicate.word IS NOT NULL").select(*SENTENCE, "tuple_id", role_key().alias("k"), adverbial_keys().alias("adv"))
    both = keyed(a).withColumn("side", F.lit(0)).unionByName(keyed(b).withColumn("side", F.lit(1)))
    placed = both.withColumn("n", F.sum(1 - F.col("side")).over(within)).withColumn("j", F.row_number().over(Window.partitionBy(*SENTENCE, "k", "side").orderBy("tuple_id")) - 1)
    slot = F.when(F.col("side") == 0, F.col("j")).otherwise(F.col("j") % F.greatest(F.col("n"), F.lit(1)))
    return placed.groupBy(*SENTENCE, "k", slot.cast("int").alias("copy")).agg(F.min(F.struct("side", "tuple_id"))["tuple_id"].alias("first_id"), F.count("*").alias("n_merged"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("adv")))).alias("adv")).drop("k")


def lexically_valid(t: DataFrame, texts: DataFrame) -> DataFrame:
    """Tuples whose subject and objects stand in their text, as it is or with its tokens joined by spaces."""
    spaced = F.array_join(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)), " ")
    both = t.join(texts.select("doc_id", "text", spaced.alias("_tokens")), "doc_id")
    here = lambda r: F.col("text").contains(F.col(f"{r}.word")) | F.col("_tokens").contains(F.col(f"{r}.word"))
    ok = F.coalesce(here("subject"), F.lit(False))
    for r in ROLES[2:]:
        ok = ok & (F.col(f"{r}.word").isNull() | here(r))
    return both.filter(ok).drop("text", "_tokens")


def overlapping(e: DataFrame, keep: list[str], skip_inserted: bool = True) -> DataFrame:
    """Pairs ``a``, ``b`` (structs of ``tuple_id`` and ``keep``) of ``elements`` of different tuples of a sentence that share
    a word index but are not equal. Elements are exploded to their indices and joined on (doc_id, sent_id, index)."""
    e = e.select(*SENTENCE, F.struct("tuple_id", *keep, F.lower("word").alias("_w"), F.lower("prep").alias("_p")).alias("x"), F.explode(F.array_distinct("word_index")).alias("ix"))
    if skip_inserted:
        e = e.filter("ix >= 0")
    pairs = e.withColumnRenamed("x", "a").join(e.withColumnRenamed("x", "b"), [*SENTENCE, "ix"]).filter("a.tuple_id < b.tuple_id")
    same = F.col("a._w") == F.col("b._w")
    equal = same & F.col("a._p").eqNullSafe(F.col("b._p"))
    one_prep = (F.col("a._p").isNull() != F.col("b._p").isNull()) & same
    return pairs.filter(~equal & ~one_prep).select(*SENTENCE, "a", "b")


def overlaps(t: DataFrame, skip_inserted: bool = True, block: int = 200) -> DataFrame:
    """Pairs of elements of different tuples of a sentence that share a word index but are not equal.

    Equal words with just one preposition don't count. Index -1 marks an inserted word and is left out unless
    ``skip_inserted`` is off.

    Pairs grow with the square of a sentence's tuples, so they are made where they are given and never shuffled. A sentence
    with more than ``block`` tuples is dealt into blocks of about that many, and each two of them are paired on their own:
    what is shuffled is far less than the pairs, and no task gets all pairs of a sentence.
    """
    places = lambda e: F.filter(F.array_distinct(e["word_index"]), (lambda i: i >= 0) if skip_inserted else (lambda i: i.isNotNull()))
    part = lambda k, ord, e: F.struct(F.lit(k).cast("tinyint").alias("role"), ord.alias("ord"), F.lower(e["word"]).alias("w"), F.lower(e["prep"]).alias("p"), places(e).alias("ix"))
    many = F.transform("adverbial", lambda e, i: part(len(ROLES), i, e))
    every = F.concat(F.array(*[part(k, F.lit(0), F.col(r)) for k, r in enumerate(ROLES)]), F.coalesce(many, F.array().cast("array<struct<role:tinyint,ord:int,w:string,p:string,ix:array<int>>>")))
    t = t.filter("doc_id IS NOT NULL AND sent_id IS NOT NULL AND tuple_id IS NOT NULL")
    hot = small(cut(t.groupBy(*SENTENCE).agg(F.ceil(F.count("*") / block).cast("int").alias("_n")).filter("_n > 1")))
    rows = t.select(*SENTENCE, "tuple_id", F.filter(every, lambda x: x["w"].isNotNull() & (F.size(x["ix"]) > 0)).alias("es")).filter(F.size("es") > 0)
    dealt = rows.join(hot, SENTENCE, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("tuple_id"), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select(*SENTENCE, F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") > F.col("_other")).cast("tinyint").alias("side"), "tuple_id", "es")
    kind = {f.name: f.dataType.simpleString() for f in t.schema}
    schema = f"doc_id {kind['doc_id']}, sent_id {kind['sent_id']}, " + ", ".join(f"{q}_id {kind['tuple_id']}, {q}_role tinyint, {q}_ord int" for q in ("left", "right"))
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt.repartition(parts, *UNIT).sortWithinPartitions(*UNIT).mapInArrow(_overlap_chunks, schema)
    role = lambda q: F.array(*map(F.lit, (*ROLES, "adverbial")))[F.col(f"{q}_role")].alias(f"{q}_role")
    return pairs.select(*SENTENCE, *[c for q in ("left", "right") for c in (f"{q}_id", role(q), f"{q}_ord")])


UNIT = [*SENTENCE, "lo", "hi"]


def _overlap_chunks(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Whole units (two blocks of a sentence, or one with itself), about ``rows`` tuples at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= rows:
            t = pa.concat_tables(held)
            whole = int(np.searchsorted(units := _units(t), units[-1]))
            if whole:
                yield from _overlapping_pairs(t.slice(0, whole))
            held = [t.slice(whole)]
    if held and sum(t.num_rows for t in held):
        yield from _overlapping_pairs(pa.concat_tables(held))


def _units(t: pa.Table) -> np.ndarray:
    """A rising number for the unit of each row."""
    new = np.zeros(t.num_rows, np.int64)
    for c in UNIT:
        x = t[c].combine_chunks()
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _overlapping_pairs(t: pa.Table, most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """The pairs of whole units, about ``most`` candidates at a time. Elements are sorted by place, side and tuple, so those
    that an element is to be paired with at a place are a run; what shares several places is met at each, and counts once."""
    number = lambda c: np.asarray(c).astype(np.int64)
    code = lambda c: number(pc.fill_null(c.dictionary_encode().indices, -1))
    doc, sent, ids, lists = (t[c].combine_chunks() for c in (*SENTENCE, "tuple_id", "es"))
    unit, side, cross = _units(t), number(t["side"]), number(t["lo"]) != number(t["hi"])
    rank = number(pc.rank(ids, tiebreaker="dense")) - 1
    of, n = number(pc.list_parent_indices(lists)), int(rank.max()) + 1
    role, ord, w, p, ix = pc.list_flatten(lists).flatten()
    role, ord, w, p = np.asarray(role), np.asarray(ord), code(w), code(p)
    own = ((unit * n + rank)[of] * (len(ROLES) + 1) + role) * (int(ord.max()) + 1) + ord
    first, own = np.unique(own, return_index=True, return_inverse=True)[1:]  # rows of one tuple_id give an element once
    by, x = number(pc.list_parent_indices(ix)), number(pc.list_flatten(ix))
    place = np.unique(unit[of][by] * (int(x.max() - x.min()) + 1) + x - x.min(), return_inverse=True)[1]
    r, s = rank[of][by], side[of][by]
    run = (place * 2 + s) * n
    order = np.argsort(run + r)
    there, runs = by[order], (run + r)[order]
    other = (place * 2 + np.where(cross[of][by], 1 - s, s)) * n
    left = np.argsort(own[by], kind="stable")
    begin = np.searchsorted(runs, other + r, "right")[left]
    count = np.searchsorted(runs, other + n, "left")[left] - begin
    left = by[left]
    last = np.flatnonzero(np.diff(own[left], append=-1))  # a chunk holds all places of its left elements
    ends = last[np.flatnonzero(np.diff(np.cumsum(count)[last] // most, append=-1))] + 1
    lo, lw, lp = own[left], w[left], p[left]
    ro, rw, rp = own[there], w[there], p[there]
    row, role, ord = of[first], role[first], ord[first]
    at = 0
    for end in ends.tolist():
        c = count[at:end]
        total = int(c.sum())
        if total:
            b = np.arange(total) + np.repeat(begin[at:end] - (np.cumsum(c) - c), c)
            differ = np.repeat(lw[at:end], c) != rw[b]
            same = np.flatnonzero(~differ)
            x, y = np.repeat(lp[at:end], c)[same], rp[b[same]]
            differ[same] = (x >= 0) & (y >= 0) & (x != y)
            pair = np.sort(((np.repeat(lo[at:end], c) << 32) | ro[b])[differ])
            pair = pair[np.diff(pair, prepend=-1) != 0]  # np.unique hashes, which takes ten times as long
            a, b = pair >> 32, pair & 0xFFFFFFFF
            x, y = pa.array(row[a]), pa.array(row[b])
            yield pa.RecordBatch.from_arrays([doc.take(x), sent.take(x), ids.take(x), pa.array(role[a]), pa.array(ord[a]), ids.take(y), pa.array(role[b]), pa.array(ord[b])], [*SENTENCE, "left_id", "left_role", "left_ord", "right_id", "right_role", "right_ord"])
        at = end


def evaluate(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of triples: a found triple is correct if its sentence has an equal gold one, and many may
    share it. Null where nothing can be divided."""
    key = [*SENTENCE, "ks", "p", "ko", "label"]
    g, f = triple_key(triples(gold)), triple_key(triples(found))
    same = None
    gk = g.select(*key).distinct().alias("g")
    fx = f.alias("f")
    for c in key:
        part = F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}"))
        same = part if same is None else same & part
    correct = fx.join(gk, same, "left_semi").agg(F.count("*").alias("n")).select(F.lit("correct").alias("m"), "n")
    sums = correct.unionByName(g.agg(F.count("*").alias("n")).select(F.lit("gold").alias("m"), "n")).unionByName(f.agg(F.count("*").alias("n")).select(F.lit("extracted").alias("m"), "n"))
    total = lambda m: F.sum(F.when(F.col("m") == m, F.col("n")))
    out = sums.agg(total("correct").alias("correct"), total("gold").alias("gold"), total("extracted").alias("extracted"))
    rated = out.withColumn("recall", F.try_divide("correct", "gold")).withColumn("precision", F.try_divide("correct", "extracted"))
    f1 = F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision"))
    return rated.withColumn("f1", F.round(f1, 6)).withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))
