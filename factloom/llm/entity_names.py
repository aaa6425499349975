"""Mapping free-entered values to a reference list.

1. Distinct values are normalized: one visible form, no markup, possessives, titles, case or accents; common short forms
   spelled out.
2. Every entry of the list has the forms in which it may be named: its label, with and without article, with the first or
   last word as an initial and, for a person, the last name alone. Character 2- and 3-grams of the words of all forms make an inverted
   index with idf weights; the order of words doesn't count.
3. For each value the cosine with every form that shares a gram is summed over the postings touched. Accepted are the
   entries with a form whose cosine is at least ``threshold`` and that no other form beats by ``margin``.
4. An exact check follows: of the accepted entries, those count from one of whose forms at most ``max_edits`` slips
   (insertion, deletion, change, swap of neighbours) lead to the value, spaces ignored, words rotated if need be. The one
   with the fewest slips is named; if two have as few, or none passes, the value is reported as naming no entry.

The index is broadcast only if the list has at most ``index_rows`` entries with at most 16 MB of labels; above that,
values and forms are joined by the grams of the values' prefixes (what is left out can't reach the threshold), with the
same scores and the same choice. No candidate is dropped by number.

Defined results: null and empty values, and values without letters, name no entry; entries with null uri or label are
left out; of entries with equal labels none is named; equal values get equal results.
"""

from __future__ import annotations

import math
import re
import unicodedata
import urllib.parse
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.lookalike import visible
from factloom.runtime import cut, join_groups, small, spread

NIL = "_NIL_"
# Common English short forms, titles, and words that name nothing.
SPELLED = {"univ": "university", "uni": "university", "inst": "institute", "soc": "society", "mus": "museum", "st": "saint", "obs": "observatory", "co": "company", "bros": "brothers", "philh": "philharmonic", "phil": "philharmonic", "ss": "steamship", "riv": "river"}
TITLES = frozenset("prof dr mr mrs ms rev gen capt sir lady".split())
NOTHING = frozenset("he him his she her hers it its they them their theirs who which that this these those i me my we us our you your none null nil unknown na nan nobody someone something anyone illegible".split())

POSSESSIVE = re.compile(r"\s*['’`´]\s*s(?=\W|$)", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
ARTICLE = re.compile(r"^(?:the )+")


def normal(value: str | None) -> str:
    """The normalized value; empty if it names nothing by itself."""
    if not value:
        return ""
    text = visible(value)
    if "%" in text:
        text = urllib.parse.unquote(text)
    text = CAMEL.sub(" ", POSSESSIVE.sub(" ", text.replace("_", " ")))
    text = unicodedata.normalize("NFD", text.lower())
    text = "".join(c if c.isalnum() else " " for c in text if not unicodedata.combining(c))
    words = [SPELLED.get(w, w) for w in text.split() if w not in TITLES]
    out = ARTICLE.sub("", " ".join(words))
    if out.endswith(" the"):
        out = out[:-4]
    return "" if out in NOTHING or not any(c.isalpha() for c in out) else out


def forms(label: str, kind: str | None) -> list[tuple[str, int]]:
    """The ways in which an entry may be named, normalized, each with the slips that its shortness counts as."""
    base = normal(label)
    if not base:
        return []
    words = base.split()
    out = {base: 0}
    if visible(label).lower().startswith("the "):
        out["the " + base] = 0
    if len(words) > 1:
        out.setdefault(" ".join([words[0][0], *words[1:]]), 1)
        out.setdefault(" ".join([*words[:-1], words[-1][0]]), 1)
        if kind == "PERSON":
            out.setdefault(words[-1], 1)
    return list(out.items())


def grams(form: str) -> Counter:
    """Bigrams and trigrams of each word with its ends marked."""
    out: Counter = Counter()
    for w in form.split():
        w = f"^{w}$"
        for k in (2, 3):
            for i in range(len(w) - k + 1):
                out[w[i : i + k]] += 1
    return out


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours (also of ones with slips between) from ``a`` to ``b``, or
    ``most`` + 1 if there are more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    same, least = 0, min(la, lb)
    while same < least and a[same] == b[same]:  # what both begin and end with costs nothing
        same += 1
    tail = 0
    while tail < least - same and a[la - 1 - tail] == b[lb - 1 - tail]:
        tail += 1
    a, b = a[same : la - tail], b[same : lb - tail]
    la, lb = len(a), len(b)
    if not la or not lb:
        return la or lb
    if len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    top = la + lb
    where: dict[str, int] = {}
    d = [[top] * (lb + 2) for _ in range(la + 2)]
    for j in range(lb + 1):
        d[1][j + 1] = j
    for i in range(1, la + 1):
        d[i + 1][1] = i
        last = 0
        lo, hi = max(1, i - most), min(lb, i + most)
        row, up, ca = d[i + 1], d[i], a[i - 1]
        for j in range(1, lo):
            if b[j - 1] == ca:
                last = j
        for j in range(lo, hi + 1):
            k = where.get(b[j - 1], 0)
            same = b[j - 1] == ca
            row[j + 1] = min(up[j] + (not same), row[j] + 1, up[j + 1] + 1, d[k][last] + (i - k - 1) + 1 + (j - last - 1))
            if same:
                last = j
        where[ca] = i
        if min(row[lo + 1 : hi + 2]) > most and i > most:
            if min(up[max(1, lo - 1) : hi + 2]) > most:
                return most + 1
    return min(d[la + 1][lb + 1], most + 1)


def allowed(form: str, max_edits: int) -> int:
    """Short forms may differ less."""
    return max_edits if len(form) >= 8 else min(1, max_edits) if len(form) >= 6 else 0


def letters(flat: str) -> int:
    """Which letters a text has, as bits: one slip changes two of them at most."""
    out = 0
    for c in flat:
        out |= 1 << (ord(c) & 63)
    return out


class Form:
    """What the exact check needs of a form."""

    __slots__ = ("turned", "bits", "most")

    def __init__(self, form: str, short: int, max_edits: int) -> None:
        words = form.split()
        self.turned = list(dict.fromkeys("".join(words[k:] + words[:k]) for k in range(len(words))))
        self.bits = letters(self.turned[0])
        self.most = allowed(self.turned[0], max_edits) - short


def checked(flat: str, bits: int, form: Form, most: int) -> int:
    """The exact check: the slips from the value (its spaces left out; ``bits``: its letters) to the form, with its words
    in the order given or rotated; ``most`` + 1 if there are more than ``most``, or than the form allows."""
    limit = min(most, form.most)
    if limit < 0 or abs(len(flat) - len(form.turned[0])) > limit or (bits ^ form.bits).bit_count() > 2 * limit:
        return most + 1
    if flat in form.turned:
        return 0
    best = limit + 1
    for turned in form.turned:
        if best > 1:
            best = min(best, slips(flat, turned, best - 1))
    return best if best <= limit else most + 1


def fewest(name: str, forms: list[tuple[Form, int]], max_edits: int) -> int | None:
    """The fewest slips, shortness included, to one of an entry's forms; None if none passes."""
    flat = name.replace(" ", "")
    bits, best = letters(flat), max_edits + 1
    for form, short in forms:
        best = min(best, checked(flat, bits, form, best - 1 - short) + short) if best > short else best
    return best if best <= max_edits else None


class Index:
    """Inverted index of the entries' forms."""

    def __init__(self, entries: list[tuple[str, str, str | None]]) -> None:
        found: dict[tuple[str, str], int] = {}
        for uri, label, kind in entries:
            for f, short in forms(label, kind):
                found[uri, f] = min(short, found.get((uri, f), short))
        self.entry = [uri for uri, _ in found]
        self.form = [f for _, f in found]
        self.short = list(found.values())
        self.forms: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for (uri, f), short in found.items():
            self.forms[uri].append((f, short))
        self.ready: dict[str, list[tuple[Form, int]]] = {}
        held = [grams(f) for f in self.form]
        df = Counter(g for h in held for g in h)
        self.idf = {g: math.log(1 + len(held) / n) for g, n in df.items()}
        self.unseen = math.log(1 + len(held))
        lists: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for i, h in enumerate(held):
            norm = math.sqrt(sum((n * self.idf[g]) ** 2 for g, n in h.items())) or 1.0
            for g, n in h.items():
                lists[g][0].append(i)
                lists[g][1].append(n * self.idf[g] / norm)
        self.postings = {g: (np.array(i, np.int32), np.array(w)) for g, (i, w) in lists.items()}

    def accepted(self, value: str, threshold: float, margin: float) -> list[tuple[int, float]]:
        """Forms above the threshold that none beats by the margin."""
        weights = {g: n * self.idf.get(g, self.unseen) for g, n in grams(value).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        touched = [(*p, w / norm) for g, w in weights.items() if (p := self.postings.get(g)) is not None]
        if not touched:
            return []
        lists, shares, own = zip(*touched)
        ids, scores = np.concatenate(lists), np.concatenate(shares)
        scores *= np.repeat(own, [len(x) for x in lists])
        if 4 * len(ids) < len(self.form):  # few postings of a long list
            where, back = np.unique(ids, return_inverse=True)
            total = np.bincount(back, scores)
        else:
            where, total = None, np.bincount(ids, scores, len(self.form))
        near = np.flatnonzero(total >= max(threshold, total.max() - margin))
        return [(int(i if where is None else where[i]), float(total[i])) for i in near]

    def choose(self, value: str, threshold: float, margin: float, max_edits: int) -> tuple[str, int, float]:
        """The entry named by a normalized value, the slips and the cosine; NIL if there is none, or no single one."""
        cosines: dict[str, float] = {}
        for i, c in self.accepted(value, threshold, margin):
            cosines[self.entry[i]] = max(c, cosines.get(self.entry[i], 0.0))
        best = {}
        for e in cosines:
            if (ready := self.ready.get(e)) is None:
                ready = self.ready[e] = [(Form(f, short, max_edits), short) for f, short in sorted(self.forms[e], key=lambda x: x[1])]
            d = fewest(value, ready, max_edits)
            if d is not None:
                best[e] = d
        if not best:
            return NIL, -1, 0.0
        least = min(best.values())
        names = [e for e, d in best.items() if d == least]
        return (names[0] if len(names) == 1 else NIL), least, max(cosines[e] for e in names)


def distinct_values(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.alias("value")).filter("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("n_rows"))


def map_values(values: DataFrame, entries: DataFrame, threshold: float = 0.25, margin: float = 0.05, max_edits: int = 2, index_rows: int = 50_000) -> DataFrame:
    """``value``, ``uri`` (or NIL), ``edits``, ``score`` for every distinct value of ``values``; ``entries`` has ``uri``,
    ``label`` and ``ne_type``. Values with the same normalized name are mapped once."""
    listed = entries.select("uri", "label", "ne_type").dropna(subset=["uri", "label"]).distinct()

    def normalized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([normal(v) for v in batch.column(0).to_pylist()], pa.string())], names=["value", "name"])

    named = cut(values.select("value").mapInArrow(normalized, "value string, name string"))
    names = cut(named.filter("name <> ''").groupBy("name").agg(F.count("*").alias("n_values")))
    rows, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("label") + F.octet_length("uri")), F.lit(0))).first()
    if rows > index_rows or size > 1 << 24:
        mapped = names.join(_map_joined(names.select("name"), listed, threshold, margin, max_edits), "name")
    else:
        mapped = _map_indexed(names, listed, threshold, margin, max_edits)
    there = join_groups(named.filter("name <> ''"), cut(mapped), ["name"], "n_values").select("value", "uri", "edits", "score")
    nothing = named.filter("name = ''").select("value", F.lit(NIL).alias("uri"), F.lit(-1).alias("edits"), F.lit(0.0).alias("score"))
    return there.unionByName(nothing)


def _map_indexed(names: DataFrame, listed: DataFrame, threshold: float, margin: float, max_edits: int) -> DataFrame:
    """``names`` with ``uri``, ``edits`` and ``score``, by the broadcast index."""
    index = names.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in listed.orderBy("uri", "label", "ne_type").collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            found = [ix.choose(name, threshold, margin, max_edits) for name in batch.column(0).to_pylist()]
            uri, edits, score = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(uri, pa.string()), pa.array(edits, pa.int32()), pa.array(score, pa.float64())], [*batch.schema.names, "uri", "edits", "score"])

    return spread(names, names.count()).mapInArrow(run, "name string, n_values bigint, uri string, edits int, score double")


def _gram_maps(texts: list[str]) -> pa.Array:
    return pa.array([list(grams(t).items()) for t in texts], pa.map_(pa.string(), pa.int32()))


def _map_joined(names: DataFrame, listed: DataFrame, threshold: float, margin: float, max_edits: int) -> DataFrame:
    """``name``, ``uri``, ``edits`` and ``score`` by joins, for lists too long to broadcast."""

    def entry_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(uri, f, short) for uri, label, kind in zip(*(c.to_pylist() for c in batch.columns)) for f, short in forms(label, kind)]
            uris, texts, shorts = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(uris, pa.string()), pa.array(texts, pa.string()), pa.array(shorts, pa.int32())], names=["uri", "form", "short"])

    def with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _gram_maps(batch.column(0).to_pylist())], [*batch.schema.names, "grams"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [fewest(n, [(Form(f, s, max_edits), s)], max_edits) for n, f, s in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32())], [*batch.schema.names, "edits"])

    form = cut(listed.mapInArrow(entry_forms, "uri string, form string, short int").groupBy("uri", "form").agg(F.min("short").alias("short")))
    total = form.count()
    text = form.groupBy("form").agg(F.count("*").alias("n_entries")).mapInArrow(with_grams, "form string, n_entries bigint, grams map<string,int>")
    text = cut(text)
    idf = cut(text.select(F.explode("grams").alias("g", "n"), "n_entries").groupBy("g").agg(F.log(1 + F.lit(float(total)) / F.sum("n_entries")).alias("idf")))
    norm = lambda w: F.sqrt(F.sum(F.col(w) * F.col(w)))

    def weighed(df: DataFrame, key: str, unseen: float | None) -> DataFrame:
        """``key``, ``g`` and its share ``w`` in the unit vector of ``key``."""
        rows = df.select(key, F.explode("grams").alias("g", "n"))
        rows = rows.join(small(idf), "g", "left" if unseen else "inner").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unseen)))
        return rows.join(rows.groupBy(key).agg(norm("w").alias("_norm")), key).select(key, "g", (F.col("w") / F.col("_norm")).alias("w"))

    distinct = names.mapInArrow(with_grams, "name string, grams map<string,int>")
    vectors = cut(weighed(distinct, "name", math.log(1 + total)))
    # A form that shares only the last of a value's grams, in order of weight, has a cosine of at most their norm.
    rest = Window.partitionBy("name").orderBy(F.col("w"), "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = cut(vectors.withColumn("_rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).filter(F.col("_rest") >= threshold * (1 - 1e-9)).select("name", "g"))
    posting = cut(weighed(text, "form", None))
    sizes = prefix.groupBy("g").agg(F.count("*").alias("_n"))
    pairs = join_groups(prefix, cut(posting.select("form", "g").join(sizes, "g")), ["g"], "_n").select("name", "form").distinct()
    unit = lambda df, key, out: df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias(out))  # noqa: E731  # of one short text
    both = pairs.join(unit(vectors, "name", "_v"), "name").join(unit(posting, "form", "_f"), "form")
    dot = F.aggregate(F.map_entries("_v"), F.lit(0.0), lambda at, x: at + x["value"] * F.coalesce(F.try_element_at("_f", x["key"]), F.lit(0.0)))
    scored = cut(both.select("name", "form", dot.alias("score")).filter(F.col("score") >= threshold))
    top = scored.groupBy("name").agg(F.max("score").alias("_top"))
    near = scored.join(top, "name").filter(F.col("score") >= F.col("_top") - margin)
    accepted = near.join(form.select("form", "uri"), "form").groupBy("name", "uri").agg(F.max("score").alias("score"))
    entry = accepted.join(form, "uri").select("name", "form", "short", "uri", "score")
    passed = entry.mapInArrow(check, "name string, form string, short int, uri string, score double, edits int").filter("edits IS NOT NULL")
    per = cut(passed.groupBy("name", "uri").agg(F.min("edits").alias("edits"), F.max("score").alias("score")))
    least = per.groupBy("name").agg(F.min("edits").alias("edits"))
    chosen = per.join(least, ["name", "edits"]).groupBy("name", "edits").agg(F.count("*").alias("_n"), F.min("uri").alias("uri"), F.max("score").alias("score"))
    done = names.join(chosen, "name", "left")
    return done.select("name", F.when(F.col("_n") == 1, F.col("uri")).otherwise(NIL).alias("uri"), F.coalesce("edits", F.lit(-1)).alias("edits"), F.coalesce("score", F.lit(0.0)).alias("score"))


def link(df: DataFrame, id_col: str, value: Column, entries: DataFrame, **options: float) -> DataFrame:
    """``id_col``, ``uri`` for every id of ``df``. Values are mapped once each; a value that very many rows share is
    joined without gathering its rows."""
    rows = df.select(id_col, value.alias("value")).filter(F.col(id_col).isNotNull()).distinct()
    counted = cut(distinct_values(df, value))
    mapped = cut(map_values(counted, entries, **options).join(counted, "value"))
    there = join_groups(rows, mapped.select("value", "uri", "n_rows"), ["value"], "n_rows").select(id_col, "uri")
    return there.unionByName(rows.filter("value IS NULL OR value = ''").select(id_col, F.lit(NIL).alias("uri"))).distinct()
