"""The pN_ queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import entity_names, formatting_duplicates, leakage, lookalike, mixing, sentences, term_frequency
from factloom.runtime import squeeze, table

TUPLE_FIELDS = ["subject", "predicate", "direct_object"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates.copies(table(spark, sf_dir, "tuple_dumps"), "rec_id", "record", TUPLE_FIELDS)


def p1_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates.collapse(table(spark, sf_dir, "tuple_dumps"), "rec_id", "record", TUPLE_FIELDS)


def _named() -> Column:
    return F.when(F.col("surface_form") != "", F.col("surface_form")).otherwise(F.col("word"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_names.link(table(spark, sf_dir, "mentions"), "mention_id", _named(), table(spark, sf_dir, "kb_things"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = entity_names.distinct_values(table(spark, sf_dir, "mentions"), _named())
    mapped = entity_names.map_values(values, table(spark, sf_dir, "kb_things"))
    return values.join(mapped.filter(F.col("uri") == entity_names.NIL).select("value"), "value").select("value", "n_rows")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text")[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*mixing.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tuples").select("tuple_id", "doc_id", F.lower(squeeze(F.col("predicate.word"))).alias("predicate"), F.trim("clause_type").alias("clause_type"))
    return t.dropDuplicates()


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _values(spark, sf_dir)
    total = t.agg(F.count_distinct("doc_id")).first()[0]
    return term_frequency.marked(term_frequency.value_frequencies(t, "doc_id", {"predicate": "predicate", "clause_type": "clause_type"}), max(total, 1))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_values(spark, sf_dir).filter("mark <> 'useful'").select("field", "val")


def p5_predicate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _values(spark, sf_dir)
    total = t.agg(F.count_distinct("doc_id")).first()[0]
    words = t.filter("predicate <> ''").select("doc_id", F.split("predicate", " ").alias("words"))
    return term_frequency.marked(term_frequency.frequencies(words, "doc_id", "words").filter("gram IS NOT NULL"), max(total, 1))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lookalike.canonicalise(docs, "doc_id", "text", lookalike.train(docs, "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_CANON = "lower(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
_FIELD = "CASE WHEN starts_with(trim(record), '{{') THEN json_extract_string(record, '$.{0}') ELSE regexp_extract(record, '(?:^|\\|)\\s*{0}\\s*[=:]([^|]*)', 1) END"
_KEYED = "WITH k AS (SELECT rec_id, " + ", ".join(f"{_CANON.format(_FIELD.format(f))} AS {f}" for f in TUPLE_FIELDS) + " FROM tuple_dumps WHERE record IS NOT NULL)"
_VALS = """WITH v AS (SELECT DISTINCT tuple_id, doc_id, lower(trim(regexp_replace(predicate.word, '\\s+', ' ', 'g'))) AS predicate, trim(clause_type) AS clause_type FROM tuples),
n AS (SELECT field, val, count(*) AS n, count(DISTINCT doc_id) AS n_records FROM (SELECT doc_id, 'predicate' AS field, predicate AS val FROM v UNION ALL SELECT doc_id, 'clause_type', clause_type FROM v) WHERE val IS NOT NULL GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records / (SELECT count(DISTINCT doc_id) FROM tuples) > 0.1 THEN 'common' ELSE 'useful' END AS mark FROM n)"""

ORACLE = {
    "p1_found": _KEYED + ", w AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY subject, predicate, direct_object) AS kept_id FROM k) SELECT DISTINCT kept_id, rec_id AS copy_id FROM w WHERE rec_id > kept_id",
    "p1_collapse": _KEYED + " SELECT min(rec_id) AS kept_id, count(*) AS n_copies, subject, predicate, direct_object FROM k GROUP BY ALL",
    "p5_values": _VALS + " SELECT field, val, n, n_records, mark FROM m",
    "p5_predicate_terms": """WITH v AS (SELECT DISTINCT tuple_id, doc_id, lower(trim(regexp_replace(predicate.word, '\\s+', ' ', 'g'))) AS predicate, trim(clause_type) AS clause_type FROM tuples),
w AS (SELECT doc_id, string_split(predicate, ' ') AS w FROM v WHERE predicate <> ''), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), j AS (SELECT doc_id, w, i, unnest(range(i, len(w) + 1)) AS j FROM i),
n AS (SELECT array_to_string(w[i:j], ' ') AS gram, count(*) AS n, count(DISTINCT doc_id) AS n_records FROM j GROUP BY ALL)
SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records / (SELECT count(DISTINCT doc_id) FROM tuples) > 0.1 THEN 'common' ELSE 'useful' END AS mark FROM n""",
    "p5_found": _VALS + " SELECT field, val FROM m WHERE mark <> 'useful'",
}
