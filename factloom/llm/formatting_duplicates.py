"""Duplicates hidden by formatting differences: Bloom filters first, exact grouping of possible repeats after.

1. Every record gets a canonical key (letters and digits of the compared fields, lower case) and its 64-bit hash.
2. Each partition builds two Bloom filters: bits seen once, and bits seen again. Two partitions' filters merge by
   ``again = again1 | again2 | (once1 & once2)`` and ``once = once1 | once2``, which loses no repeat.
3. The merged ``again`` filter is probed where the records are read. A record none of whose copies can exist is emitted
   as a singleton at once; only possible repeats are shuffled, by their whole key, and counted exactly.

A filter has 16 bits for each record and at most ``max_bits``; it is the only thing that is broadcast. More records than
one filter is made for are cut into slices by their hashes, as many as it takes: their keys are written by slice, without
a shuffle, to the shared folder, and every slice is filtered by itself. So the share of single records that a filter lets
through (about 0.1 %) is the same at any number of records.

Defined results: a null record, and one in which no field can be read, is no tuple and has no row; a field that is
missing, null, or has neither letters nor digits is empty; ties are broken by the smallest id; rows that repeat an id
count once as copies of each other (``copy_id`` > ``kept_id``); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import cut, drop_scratch, join_groups, scratch

HASHES = 8
CHUNK_BITS = 1 << 15  # 4 KB: what one merging group holds of each partition's filter


def fields_of(df: DataFrame, record_col: str, fields: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the fields of each record, written as JSON object or as ``name=value`` or ``name: value`` parts
    between bars. A record is parsed once for all its fields."""
    text = F.trim(F.col(record_col))
    schema = ", ".join(f"`{f}` string" for f in fields)
    parsed = df.select(*keep, F.col(record_col).alias("_record"), F.when(text.startswith("{"), F.from_json(text, schema, {"allowUnquotedControlChars": "true"})).alias("_json"))
    part = lambda f: F.regexp_extract("_record", rf"(?is)(?:^|\|)\s*{f}\s*[=:]((?:[^|]|\|(?!\s*\w+\s*[=:]))*)", 1)
    return parsed.select(*keep, *[F.when(F.col("_json").isNotNull(), F.col("_json")[f]).otherwise(part(f)).alias(f) for f in fields])


def canonical(value: Column) -> Column:
    """The letters and digits of ``value``, in lower case; empty for null."""
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{Nd}]+", ""))


def keyed(df: DataFrame, id_col: str, record_col: str, fields: list[str]) -> DataFrame:
    """``id_col``, ``_key`` and its hash ``_h`` for every record in which some field can be read."""
    read = fields_of(df.filter(F.col(record_col).isNotNull()), record_col, fields, [id_col])
    key = F.concat_ws("\u0001", *[canonical(F.col(f)) for f in fields])
    return read.select(id_col, key.alias("_key")).filter(F.length("_key") >= len(fields)).withColumn("_h", F.xxhash64("_key"))


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each hash, one row for each of HASHES, by double hashing."""
    h = hashes.view(np.uint64)
    step = ((h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (((h + np.arange(HASHES, dtype=np.uint64)[:, None] * step) >> np.uint64(5)) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(records: int, max_bits: int) -> int:
    """About 16 bits a record, as a power of two, within the bound."""
    return min(max_bits, 1 << max(15, (16 * max(1, records) - 1).bit_length()))


def repeat_filter(hashes: DataFrame, bits: int, tasks: int) -> DataFrame:
    """The merged filter of hashes that may have been seen again: ``chunk``, ``again`` (4 KB each; empty ones absent)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        seen: list[np.ndarray] = []
        for batch in batches:
            seen.append(_bits(np.asarray(batch.column(0)), bits).ravel())
            if sum(map(len, seen)) > 2_000_000:
                _add(first, second, seen)
        _add(first, second, seen)
        size = CHUNK_BITS // 8
        used = [c for c in range(bits // CHUNK_BITS) if first[c * size : (c + 1) * size].any()]
        for at in range(0, len(used), 256):
            part = used[at : at + 256]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array([first[c * size : (c + 1) * size].tobytes() for c in part], pa.binary()), pa.array([second[c * size : (c + 1) * size].tobytes() for c in part], pa.binary())], names=["chunk", "once", "again"])

    def merge(group: pa.Table) -> pa.Table:
        once, again = np.zeros(CHUNK_BITS // 8, np.uint8), np.zeros(CHUNK_BITS // 8, np.uint8)
        for o, a in zip(group.column("once").to_pylist(), group.column("again").to_pylist()):
            o, a = np.frombuffer(o, np.uint8), np.frombuffer(a, np.uint8)
            again |= a | (once & o)
            once |= o
        keep = bool(again.any())
        return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()] * keep, pa.int32()), "again": pa.array([again.tobytes()] * keep, pa.binary())})

    parts = hashes.select("_h").coalesce(tasks).mapInArrow(build, "chunk int, once binary, again binary")
    return parts.groupBy("chunk").applyInArrow(merge, "chunk int, again binary")


BIT = (0x80 >> np.arange(8)).astype(np.uint8)


def _add(once: np.ndarray, again: np.ndarray, seen: list[np.ndarray]) -> None:
    """Record-wise exactness isn't needed: a bit hit twice, by whatever records, may mean a repeat."""
    if not seen:
        return
    where, times = np.unique(np.concatenate(seen), return_counts=True)
    hot = where[(times > 1) | (once[where >> 3] & BIT[where & 7] != 0)]
    np.bitwise_or.at(again, hot >> 3, BIT[hot & 7])
    np.bitwise_or.at(once, where >> 3, BIT[where & 7])
    seen.clear()


MAX_BITS = 1 << 29


def possible_repeats(keys: DataFrame, records: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``keys`` (of about so many ``records``, one filter's worth) with ``_maybe``: whether another record may have the same
    hash. False only where none has."""
    spark = keys.sparkSession
    bits = filter_bits(records, max_bits)
    chunks = repeat_filter(keys, bits, spark.sparkContext.defaultParallelism).collect()  # at most bits / 8 bytes
    again = np.zeros(bits // 8, np.uint8)
    for row in chunks:
        again[row.chunk * CHUNK_BITS // 8 : (row.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(row.again, np.uint8)
    shared = spark.sparkContext.broadcast(again.tobytes())

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        held = np.frombuffer(shared.value, np.uint8)
        at = _bits(h.to_numpy(np.int64), bits)
        return pd.Series(((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return keys.withColumn("_maybe", maybe("_h"))


def by_slice(df: DataFrame, id_col: str, record_col: str, fields: list[str], max_bits: int, take: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``take`` of the keys with ``_maybe``, slice by slice, each made before the next one's filter; no more than one filter
    is held at a time."""
    records = df.count()
    keys = keyed(df, id_col, record_col, fields)
    slices = -(-16 * records // max_bits)
    if slices <= 1:
        return take(possible_repeats(keys, records, max_bits))
    spark = df.sparkSession
    folder = scratch(spark)
    keys.withColumn("_slice", F.pmod(F.xxhash64("_h"), F.lit(slices)).cast("int")).write.partitionBy("_slice").parquet(folder)
    held = spark.read.parquet(folder)
    out = None
    for k in range(slices):
        part = cut(take(possible_repeats(held.filter(F.col("_slice") == k).drop("_slice"), records // slices + 1, max_bits)))
        out = part if out is None else out.unionByName(part)
    drop_scratch(spark, folder)
    return out


def collapse(df: DataFrame, id_col: str, record_col: str, fields: list[str], max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each distinct tuple: ``kept_id`` (its smallest id), ``n_copies`` and the canonical fields."""

    def take(probed: DataFrame) -> DataFrame:
        single = probed.filter("NOT _maybe").select("_key", F.col(id_col).alias("kept_id"), F.lit(1).cast("bigint").alias("n_copies"))
        grouped = probed.filter("_maybe").groupBy("_key").agg(F.min(id_col).alias("kept_id"), F.count("*").alias("n_copies"))
        return grouped.unionByName(single)

    parts = F.split("_key", "\u0001")
    return by_slice(df, id_col, record_col, fields, max_bits, take).select("kept_id", "n_copies", *[parts[i].alias(f) for i, f in enumerate(fields)])


def copies(df: DataFrame, id_col: str, record_col: str, fields: list[str], max_bits: int = MAX_BITS) -> DataFrame:
    """``kept_id``, ``copy_id``: each record that is not the one with the smallest id of its tuple."""
    rows = cut(by_slice(df, id_col, record_col, fields, max_bits, lambda probed: probed.filter("_maybe").select(id_col, "_key")))
    groups = cut(rows.groupBy("_key").agg(F.min(id_col).alias("kept_id"), F.count("*").alias("n_copies")).filter("n_copies > 1"))
    joined = join_groups(rows, groups, ["_key"], "n_copies")
    return joined.filter(F.col(id_col) > F.col("kept_id")).select("kept_id", F.col(id_col).alias("copy_id")).distinct()
