"""Frequency of every value or term sequence by suffix sorting.

Every sequence of terms is cut into its suffixes, truncated to ``longest`` terms. Suffixes are routed by their first
term, sorted in reverse lexicographic order, and one pass with a stack counts all prefixes (so all n-grams) and the
records they occur in: an n-gram comes after all its extensions, so its counts are complete when it is popped.

Records are counted without holding sets of them for each n-gram: an n-gram's number of records is its number of suffixes
less those whose record already stood in it. For each record only the place of its last suffix is held; the longest
common prefix of that suffix and the present one is the innermost n-gram on the stack that began at or before that place,
and there, so in all prefixes of it, one is taken off.

A first term may be that of a third of all suffixes: routing therefore also uses a bucket of the record's id, of which
there are enough that a task holds the places of a bounded number of records. Records of different buckets differ, so
counts and numbers of records of the buckets add up to exact totals.

Defined results: null sequences are left out, empty ones too; a null record id counts as occurrence, not as record;
repeated rows count as often as they stand there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SHUT = "\u0002", "\u0003"


def _count(batches: Iterator[pa.RecordBatch], begin: str | None, end: str | None) -> Iterator[pa.RecordBatch]:
    """Counts of all n-grams of sorted suffixes; with ``begin`` and ``end``, only those that begin and end so are given."""
    terms: list[str] = []
    since: list[int] = []  # the first suffix that has the n-gram of this depth
    counts: list[int] = []
    records: list[int] = []
    last: dict[object, int] = {}
    grams: list[str] = []
    occurrences: list[int] = []
    spread: list[int] = []
    at = 0

    def pop(depth: int) -> None:
        while len(terms) > depth:
            n, held = counts.pop(), records.pop()
            if begin is None or (begin in terms[0] and terms[-1].endswith(end)):
                grams.append(" ".join(terms))
                occurrences.append(n)
                spread.append(held)
            terms.pop()
            since.pop()
            if terms:
                counts[-1] += n
                records[-1] += held

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(grams, pa.string()), pa.array(occurrences, pa.int64()), pa.array(spread, pa.int64())], names=["gram", "n", "n_records"])
        grams.clear(), occurrences.clear(), spread.clear()
        return out

    for batch in batches:
        for suffix, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if suffix != terms:
                same = 0
                for a, b in zip(terms, suffix):
                    if a != b:
                        break
                    same += 1
                if same < len(terms):
                    if not same:
                        last.clear()  # no earlier suffix shares anything with this one
                    pop(same)
                for term in suffix[same:]:
                    terms.append(term)
                    since.append(at)
                    counts.append(0)
                    records.append(0)
            counts[-1] += 1
            if record is not None:
                records[-1] += 1
                before = last.get(record)
                if before is not None:
                    shared = bisect.bisect_right(since, before) - 1
                    if shared >= 0:
                        records[shared] -= 1
                last[record] = at
            at += 1
        if len(grams) > 20_000:
            yield flush()
    pop(0)
    yield flush()


def frequencies(df: DataFrame, record: str, sequence: str, longest: int | None = None, begin: str | None = None, end: str | None = None, bucket_rows: int = 1_000_000) -> DataFrame:
    """``gram``, ``n`` (occurrences), ``n_records`` (distinct values of ``record``) of all n-grams of the array column
    ``sequence`` up to ``longest`` terms (none: of any length). With ``begin`` and ``end``, n-grams whose first term
    contains the one and whose last term ends with the other."""
    rows = df.select(F.col(record).alias("_record"), F.col(sequence).alias("_terms")).filter("size(_terms) > 0")
    limit = F.lit(longest) if longest else F.size("_terms")
    starts = F.sequence(F.lit(1), F.size("_terms"))
    suffixes = rows.select("_record", F.explode(F.transform(starts, lambda i: F.slice("_terms", i, limit))).alias("_suffix"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(32, parts, rows.count() // bucket_rows)
    routed = suffixes.select("_suffix", "_record").repartition(F.element_at("_suffix", 1), F.pmod(F.xxhash64("_record"), F.lit(buckets))).sortWithinPartitions(F.desc("_suffix"))
    part = routed.mapInArrow(lambda batches: _count(batches, begin, end), "gram string, n bigint, n_records bigint")
    return part.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))


def value_frequencies(df: DataFrame, record: str, values: dict[str, str]) -> DataFrame:
    """``field``, ``val``, ``n``, ``n_records`` of every distinct value of the string columns named by ``values``
    (field: column). A value is the sequence of its words, marked where it begins and ends: it is the n-gram from the one
    mark to the other, and counted as such."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).alias("v")) for f, c in values.items()])).alias("_p")
    words = F.split(F.concat(F.col("_p.f"), F.lit(OPEN), F.col("_p.v"), F.lit(SHUT)), " ")
    flat = df.select(F.col(record).alias("_r"), pairs).filter("_p.v IS NOT NULL").select("_r", words.alias("_w"))
    counted = frequencies(flat, "_r", "_w", begin=OPEN, end=SHUT)
    cut = F.split("gram", OPEN)
    return counted.select(cut[0].alias("field"), F.regexp_replace(cut[1], SHUT + "$", "").alias("val"), "n", "n_records")


def marked(counted: DataFrame, total: int, rare: int = 3, common: float = 0.1) -> DataFrame:
    """``counted`` with ``mark``: 'rare' in fewer than ``rare`` records, 'common' in more than the share ``common`` of
    ``total``, else 'useful'."""
    return counted.withColumn("mark", F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") / F.lit(total) > F.lit(common), "common").otherwise("useful"))
