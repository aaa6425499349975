"""Where results go: Parquet for tables and graphs, text for tuples."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Each node and each edge once, as Parquet."""
    nodes.dropDuplicates(["doc_id", "node_id"]).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    edges.dropDuplicates(["doc_id", "src", "dst", "relation"]).write.mode("overwrite").parquet(os.path.join(path, "edges"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges written by ``write_graph``."""
    return spark.read.parquet(os.path.join(path, "nodes")), spark.read.parquet(os.path.join(path, "edges"))


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """A stage's result as Parquet, read back: later stages don't repeat it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_tuple_text(texts: DataFrame, path: str) -> None:
    texts.select("value").write.mode("overwrite").text(path)
