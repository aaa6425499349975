"""Knowledge-base queries over triples ``kb(head, rel, tail)`` and things ``kb_things(uri)``.

Repeated triples count once; triples with a null are left out. Every query is set-oriented: it takes a table of uris or
pairs instead of being asked one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triples(kb: DataFrame) -> DataFrame:
    return kb.select("head", "rel", "tail").dropna().distinct()


def neighbours(kb: DataFrame, things: DataFrame) -> DataFrame:
    """``uri``, ``neighbour``: out and in neighbours that are known things, as a bag."""
    k = triples(kb)
    both = k.select(F.col("head").alias("uri"), F.col("tail").alias("neighbour")).unionByName(k.select(F.col("tail").alias("uri"), F.col("head").alias("neighbour")))
    return both.join(things.select(F.col("uri").alias("neighbour")).dropna().distinct(), "neighbour", "left_semi").select("uri", "neighbour")


def relations(kb: DataFrame) -> DataFrame:
    """``head``, ``tail``, ``rels``: all relations from one uri to another, sorted."""
    return triples(kb).groupBy("head", "tail").agg(F.array_sort(F.collect_set("rel")).alias("rels"))


def head_counts(kb: DataFrame) -> DataFrame:
    """``rel``, ``tail``, ``n_heads``."""
    return triples(kb).groupBy("rel", "tail").agg(F.count("*").alias("n_heads"))


def tail_counts(kb: DataFrame) -> DataFrame:
    """``head``, ``rel``, ``n_tails``."""
    return triples(kb).groupBy("head", "rel").agg(F.count("*").alias("n_tails"))


def path_counts(kb: DataFrame) -> DataFrame:
    """``u1`` < ``u2``, ``n_paths``: paths of two steps from one to the other, in both directions.

    Steps are counted by (from, middle) first and only then joined, so repeated relations don't multiply. A middle with
    many ways in and many out still has as many pairs as their product: these are the result, and a join on a hot middle
    is split where adaptive execution sees it.
    """
    k = triples(kb)
    first = k.groupBy(F.col("head").alias("a"), F.col("tail").alias("m")).agg(F.count("*").alias("n"))
    second = k.groupBy(F.col("head").alias("m"), F.col("tail").alias("b")).agg(F.count("*").alias("n2"))
    paths = first.join(second, "m").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("n2")).alias("n"))
    return paths.groupBy(F.least("a", "b").alias("u1"), F.greatest("a", "b").alias("u2")).agg(F.sum("n").alias("n_paths"))


def relatedness(kb: DataFrame) -> DataFrame:
    """``u1`` < ``u2``, ``score``: for each direction the sum over relations of 2 / (heads of (rel, to) + tails of
    (from, rel)); the greater direction counts. Pairs without a triple have score 0 and are left out, which keeps the
    number of rows within that of the triples."""
    k = triples(kb)
    one = k.join(head_counts(kb), ["rel", "tail"]).join(tail_counts(kb), ["head", "rel"])
    way = one.groupBy("head", "tail").agg(F.sum(2.0 / (F.col("n_heads") + F.col("n_tails"))).alias("w")).filter("head <> tail")
    return way.groupBy(F.least("head", "tail").alias("u1"), F.greatest("head", "tail").alias("u2")).agg(F.round(F.max("w"), 6).alias("score"))


def page_urls(things: DataFrame, prefix: str = "page:") -> DataFrame:
    """``uri``, ``url``: uri to page address by lookup."""
    return things.select("uri", F.concat(F.lit(prefix), "uri").alias("url")).dropna().distinct()


def remember(memo: DataFrame, kb: DataFrame, things: DataFrame, asked: DataFrame) -> DataFrame:
    """``memo`` (``uri``, ``neighbour``) with the neighbours of all ``asked`` uris that it doesn't have yet. A uri without
    neighbours has one row with null, so it isn't looked up again."""
    missing = asked.select("uri").dropna().distinct().join(memo.select("uri").distinct(), "uri", "left_anti")
    found = neighbours(kb, things).join(missing, "uri", "left_semi").distinct()
    return memo.select("uri", "neighbour").unionByName(missing.join(found, "uri", "left").select("uri", "neighbour"))


def recall(memo: DataFrame, asked: DataFrame) -> DataFrame:
    """The remembered neighbours of the ``asked`` uris."""
    return memo.join(asked.select("uri").distinct(), "uri", "left_semi").filter("neighbour IS NOT NULL")
