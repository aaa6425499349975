"""Mixing sources to target weights by weighted fair queueing.

Documents of each source are put in a random order (by a hash of id, pass and seed). A document's virtual finish time is
the number of its source's tokens up to and with it, divided by the source's weight. Merging all sources by that time
and stopping at the budget gives every source its share, to within one document. A source may be passed through
``max_repeats`` times, in a new order each time.

Running sums are built in two levels: sums of small buckets of the order, a running sum over the buckets (one row for
each ``bucket_rows`` documents), and one inside each bucket. So no source, however large, is in one task, and no order
needs a single sorted partition. In the merged order, buckets that begin beyond the budget are dropped before their rows
are sorted; buckets get wider with the logarithm of time beyond the budget, so a source far larger than its share fills
many of them.

Defined results: documents with null text have 0 tokens; null sources and sources without target are left out of the
mix and reported with share 0; targets without documents are reported and their weight is spread over the others, as
shares of those that have tokens; a null ``max_repeats`` or one below 1 counts as 1; repeated ids count as different
documents; targets named twice count by their first row in order of share. With no budget given, the largest one is
taken for which no source runs out. An empty table gives an empty sample.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.runtime import cut, small

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = 1 << 40


def token_counts(df: DataFrame, id_col: str, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col``, ``keep`` and ``n_tokens``; a vocabulary file in tiktoken's, tokenizers' or sentencepiece's format. The
    driver's file is shipped to the executors, which need no copy of their own."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    columns = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def counter():
        tokenizer = SparkFiles.get(name)
        if tokenizer.endswith(".tiktoken"):
            import tiktoken

            with open(tokenizer, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            enc = tiktoken.Encoding(os.path.basename(tokenizer), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter()
            texts = [t or "" for t in batch.column(len(columns)).to_pylist()]
            yield pa.record_batch([*(batch.column(i) for i in range(len(columns))), pa.array(count(texts), pa.int64())], names=[*columns, "n_tokens"])

    return df.select(*columns, F.col(text)).mapInArrow(run, f"{kinds}, n_tokens bigint")


def running_sum(df: DataFrame, groups: list[str], bucket: Column, order: list[str], value: str, name: str, limit: int | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` within ``groups``, in order of ``bucket`` and then ``order``. With a
    ``limit``, rows of buckets before which it is passed are left out."""
    b = df.withColumn("_b", bucket)
    over = Window.partitionBy(*groups).orderBy("_b") if groups else Window.orderBy("_b")
    sums = b.groupBy(*groups, "_b").agg(F.sum(value).alias("_s")).withColumn("_before", F.sum("_s").over(over) - F.col("_s")).drop("_s")
    if limit is not None:
        sums = sums.filter(F.col("_before") <= limit)
    inner = Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.join(sums, [*groups, "_b"]).withColumn(name, F.col("_before") + F.sum(value).over(inner)).drop("_b", "_before")


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source or target: ``source``, ``target_share``, ``max_repeats``, ``n_docs``, ``tokens``, ``weight``."""
    first = Window.partitionBy("source").orderBy("target_share", "max_repeats")
    wanted = targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    totals = counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    both = totals.join(wanted, totals.source.eqNullSafe(wanted.source), "full").select(F.coalesce(totals.source, wanted.source).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    live = F.when((F.col("target_share") > 0) & (F.col("tokens") > 0), F.col("target_share"))
    both = cut(both)
    whole = both.agg(F.sum(live)).first()[0] or 1.0
    return both.withColumn("weight", live / F.lit(whole))


def mix(counts: DataFrame, targets: DataFrame, id_col: str, budget: int | None = None, seed: int = 7, bucket_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """From ``counts`` (``id_col``, ``source``, ``n_tokens``): the sample (``id_col``, ``source``, ``copy``, ``n_tokens``,
    ``finish``) and the plan with the ``budget``. The plan has one row for each source and is small."""
    counts = cut(counts.select(id_col, "source", "n_tokens"))
    p = cut(plan(counts, targets))
    facts = p.filter("weight > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("weight")), F.sum(F.col("n_docs"))).first()
    limit = int(facts[0] or 0) if budget is None else budget
    buckets = max(16, (facts[1] or 0) // bucket_rows)
    passes = F.least(F.col("max_repeats"), F.ceil(F.lit(float(limit)) * F.col("weight") / F.col("tokens")).cast("int"))
    used = counts.join(small(p.filter("weight > 0").select("source", "weight", "tokens", passes.alias("_passes"))), "source").filter("_passes > 0")
    copies = used.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1))).withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), "copy", id_col), F.lit(UNIT)))
    own = running_sum(copies, ["source", "copy"], (F.col("_u") * F.lit(buckets) / F.lit(UNIT)).cast("bigint"), ["_u", id_col], "n_tokens", "_cum")
    timed = own.withColumn("finish", (F.col("copy") * F.col("tokens") + F.col("_cum")) / F.col("weight")).select(id_col, "source", "copy", "n_tokens", "finish")
    late = F.col("finish") / F.lit(max(1.0, float(limit)))
    slot = F.when(late <= 1, late).otherwise(1 + F.log2(late)) * F.lit(float(buckets))
    merged = running_sum(cut(timed), [], slot.cast("bigint"), ["finish", "source", id_col, "copy"], "n_tokens", "_at", limit)
    sample = merged.filter(F.col("_at") <= limit).drop("_at")
    return sample, p.withColumn("budget", F.lit(limit).cast("bigint"))


def shares(sample: DataFrame, the_plan: DataFrame) -> DataFrame:
    """What was reached: one row for each source or target."""
    got = sample.groupBy("source").agg(F.sum("n_tokens").alias("sample_tokens"), F.count("*").alias("sample_docs"), F.max("copy").alias("_c"))
    got = cut(got)
    whole = got.agg(F.sum("sample_tokens")).first()[0] or 1
    out = the_plan.alias("p").join(got.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")), "left")
    return out.select("p.source", "target_share", "weight", "max_repeats", "n_docs", "tokens", "budget", F.coalesce("sample_docs", F.lit(0)).alias("sample_docs"), F.coalesce("sample_tokens", F.lit(0)).alias("sample_tokens"), F.coalesce(F.col("_c") + 1, F.lit(0)).alias("times_used"), F.coalesce(F.col("sample_tokens") / F.lit(whole), F.lit(0.0)).alias("share"))


def sample(df: DataFrame, targets: DataFrame, id_col: str, text: str, budget: int | None = None, tokenizer: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The sample and the plan for documents with columns ``id_col``, ``text`` and ``source``."""
    return mix(token_counts(df, id_col, text, ["source"], tokenizer), targets, id_col, budget, seed)
