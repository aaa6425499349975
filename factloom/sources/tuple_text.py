"""The tuple text format: a sentence line, lines 'S; V; dO; iO; adv||adv', a blank line; '======' between documents.

Words may carry '|index', nouns '(reference)'; '?' marks uncertain, '##' implicit and '!' negated tuples; an adverbial's
first word is its preposition. Defined results: empty fields are null; the last document counts without a closing line;
a sentence without tuples is kept; a word without index gives no index; an adverbial of one word has no preposition.

Characters of the format's own within words are written as a backslash and a letter (``ESCAPES``) and read back; so are
spaces at the ends of words or beside others. The format has no place for references of predicates and adverbials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "struct<word:string,word_index:array<int>,prep:string,reference:string>"
ESCAPES = {";": "s", "|": "p", "(": "l", ")": "r", "?": "q", "#": "h", "!": "x", "=": "e", "\n": "n", "\r": "c", "\t": "t", "\f": "f", "\x0b": "v"}
SPACE, NOTHING, NO_PREP = "\\_", "\\0", "\\-"


def escaped(text: Column, whole: bool = False) -> Column:
    """Text without characters of the format's own; ``whole``: as one word."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for char, letter in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    text = F.regexp_replace(text, " " if whole else "^ | $|(?<= ) ", r"\\_")
    return F.when(text == "", NOTHING).otherwise(text)


def unescaped(text: Column) -> Column:
    for code, char in {SPACE: " ", NOTHING: ""}.items():
        text = F.replace(text, F.lit(code), F.lit(char))
    for char, letter in ESCAPES.items():
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _words(text: Column) -> tuple[Column, Column]:
    """Words without their indices, and the indices."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    word = F.array_join(F.transform(parts, lambda w: F.regexp_replace(w, r"\|-?\d+$", "")), " ")
    index = F.transform(F.filter(parts, lambda w: w.rlike(r"\|-?\d+$")), lambda w: F.regexp_extract(w, r"\|(-?\d+)$", 1).cast("int"))
    return word, index


def element(text: Column, noun: bool = True) -> Column:
    """A field as Element; null if empty."""
    trimmed = F.trim(text)
    reference = F.when(trimmed.rlike(r"\([^()]*\)\s*$"), F.regexp_extract(trimmed, r"\(([^()]*)\)\s*$", 1)) if noun else F.lit(None)
    body = F.regexp_replace(trimmed, r"\s*\([^()]*\)\s*$", "") if noun else trimmed
    word, index = _words(body)
    return F.when(trimmed != "", F.struct(unescaped(word).alias("word"), index.alias("word_index"), F.lit(None).cast("string").alias("prep"), unescaped(reference.cast("string")).alias("reference")))


def adverbial(text: Column) -> Column:
    word, index = _words(text)
    parts = F.split(word, " ")
    many = F.size(parts) > 1
    rest = F.when(many, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ")).otherwise(word)
    prep = F.when(many & (parts[0] != NO_PREP), parts[0])
    return F.struct(unescaped(rest).alias("word"), index.alias("word_index"), unescaped(prep).alias("prep"), F.lit(None).cast("string").alias("reference"))


def build_tuple(line: Column) -> dict[str, Column]:
    """The columns of a tuple line."""
    marks = F.regexp_extract(line, r"^\s*([?#!]*)", 1)
    fields = F.split(F.regexp_replace(line, r"^\s*[?#!]*\s*", ""), r"\s*;\s*")
    field = lambda k: F.coalesce(F.get(fields, F.lit(k)), F.lit(""))
    advs = F.filter(F.split(field(4), r"\|\|"), lambda a: F.trim(a) != "")
    return {
        "uncertain": marks.contains("?"), "implicit": marks.contains("##"), "negation": marks.contains("!"),
        "subject": element(field(0)), "predicate": element(field(1), False), "direct_object": element(field(2)), "indirect_object": element(field(3)),
        "adverbial": F.transform(advs, adverbial),
    }


def parse(texts: DataFrame, value: str = "value") -> DataFrame:
    """Tuples of texts: the other columns, ``doc``, ``sent``, ``sentence``, ``ord`` and the tuple's columns (null for a
    sentence without tuples)."""
    keys = [c for c in texts.columns if c != value]
    docs = texts.select(*keys, F.posexplode(F.split(value, r"(?m)^======.*$")).alias("doc", "_body"))
    docs = docs.filter(F.trim(F.regexp_replace("_body", r"\s", "")) != "")
    sents = docs.select(*keys, "doc", F.posexplode(F.filter(F.split(F.regexp_replace("_body", r"\r", ""), r"\n[ \t]*\n+"), lambda b: ~b.rlike(r"^\s*$"))).alias("sent", "_block"))
    lines = F.filter(F.split("_block", "\n"), lambda x: ~x.rlike(r"^\s*$"))
    rows = sents.withColumn("_lines", lines).select(*keys, "doc", "sent", F.regexp_replace(F.col("_lines")[0], r"^\?\s*", "").alias("sentence"), F.posexplode_outer(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("ord", "_line"))
    return rows.select(*keys, "doc", "sent", "sentence", "ord", *[c.alias(n) for n, c in build_tuple(F.col("_line")).items()])


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def to_word(e: Column, with_index: bool, kind: str = "noun") -> Column:
    """An element as text, its preposition first, each word with its index if there is one for every word, with or
    without the preposition; a noun's reference last. An adverbial of several words without preposition is marked so."""
    word, prep = escaped(e["word"]), escaped(e["prep"], True)
    parts = F.split(word, " ")
    if kind == "adverbial":
        prep = F.coalesce(prep, F.when(F.size(parts) > 1, NO_PREP))
    indexed = lambda ws, at: F.array_join(F.zip_with(ws, at, lambda w, i: F.concat(w, F.lit("|"), i)), " ")
    n, every, at = F.size(parts), F.concat(F.array(prep), parts), e["word_index"]
    text = F.concat_ws(" ", prep, word)
    if with_index:
        text = F.when(n == F.size(at), F.concat_ws(" ", prep, indexed(parts, at))).when(prep.isNotNull() & (n + 1 == F.size(at)), indexed(every, at)).otherwise(text)
    if kind == "noun":
        text = F.concat(text, F.coalesce(F.concat(F.lit(" ("), escaped(e["reference"]), F.lit(")")), F.lit("")))
    return F.coalesce(F.when(e["word"].isNotNull(), text), F.lit(""))


def to_line(with_index: bool = True) -> Column:
    """A tuple row as a line."""
    advs = F.array_join(F.transform(F.filter(F.coalesce(F.col("adverbial"), F.array()), lambda a: a["word"].isNotNull()), lambda a: to_word(a, with_index, "adverbial")), "||")
    return F.concat_ws("; ", *[to_word(F.col(r), with_index, "predicate" if r == "predicate" else "noun") for r in ("subject", "predicate", "direct_object", "indirect_object")], advs)


def to_text(tuples: DataFrame, doc: str, sent: str, sentence: Column, order: str) -> DataFrame:
    """``doc``, ``value``: each document in the text format. Documents are built from sentences by two aggregations, so
    a task holds one document at most, as its text is one value."""
    mark = F.when(F.col("negation"), "!").otherwise("") if "negation" in tuples.columns else F.lit("")
    lines = tuples.groupBy(doc, sent).agg(F.first(sentence).alias("_s"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(mark, to_line()).alias("l")))).alias("_l"))
    block = lines.select(doc, sent, F.concat_ws("\n", "_s", F.transform("_l", lambda x: x["l"])).alias("_b"))
    docs = block.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(sent, "_b"))).alias("_d"))
    return docs.select(doc, F.concat(F.array_join(F.transform("_d", lambda x: x["_b"]), "\n\n"), F.lit("\n\n" + "=" * 22 + "\n")).alias("value"))


def to_json(tuples: DataFrame) -> DataFrame:
    """Tuples as JSON objects: every role as its whole element, null where absent, the adverbials, and what else the table
    has of clause type, negation, clause, sentence."""
    rest = [c for c in ("clause_type", "negation", "clause", "sentence", "sent_id") if c in tuples.columns]
    return tuples.select("tuple_id", F.to_json(F.struct("subject", "predicate", "direct_object", "indirect_object", "adverbial", *rest), {"ignoreNullFields": "false"}).alias("json"))
