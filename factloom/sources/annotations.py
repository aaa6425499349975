"""Annotated text to sentences of tokens: from annotator JSON, from CoNLL-U, or from a pluggable annotator.

A sentences table has one row per sentence: ids and ``tokens``, an array of structs (i from 1, word, pos, head with 0 for
the top, rel, ner). The whole tree is in the row, so operators on it need no shuffle. Labels are normalized to one
dialect. Defined results: sentences without tokens have no row; a token without link has a null head and rel; of several
links of a token the first counts; a second sentence with the same position is kept apart by its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.nested import Invalid, Nested, Shredder

TOKEN = "struct<i:int,word:string,pos:string,head:int,rel:string,ner:string>"
# Labels of other dialects and what they are here.
DIALECT = {"obj": "dobj", "obl": "nmod", "nsubj:pass": "nsubjpass", "aux:pass": "auxpass", "csubj:pass": "csubjpass", "dative": "iobj", "nmod:of": "nmod", "prt": "compound:prt"}
KINDS = [
    Nested("token", "sentences/tokens", ("word", "originalText", "pos", "ner")),
    Nested("dependency", "sentences/basicDependencies", ("dep", "governor", "dependent")),
]
ARROW_TOKEN = pa.struct([("i", pa.int32()), ("word", pa.string()), ("pos", pa.string()), ("head", pa.int32()), ("rel", pa.string()), ("ner", pa.string())])


def label(rel: object) -> str | None:
    if not isinstance(rel, str) or not rel.strip():
        return None
    low = rel.strip().lower()
    return DIALECT.get(low, low)


def _whole(x: str | None) -> int | None:
    return int(x) if x and len(x) < 10 and x.isascii() and x.lstrip("-").isdigit() else None


def _string(x: object) -> str | None:
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else None


def sentences(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id_col``, ``sent_id``, ``tokens`` from annotator JSON, in one pass over the records."""
    names = [id_col, "sent_id", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = Shredder(KINDS, ("result",))
        for batch in batches:
            ids, sents, tokens = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words: dict[tuple, list] = {}
                links: dict[tuple, dict] = {}
                try:
                    found = shredder.rows(text)
                except Invalid:
                    continue
                for kind, at, leaves in found:
                    if kind == "token":
                        words.setdefault(at[:-1], []).append((at[-1] + 1, leaves))
                    elif (d := _whole(leaves.get("dependent"))) is not None:
                        links.setdefault(at[:-1], {}).setdefault(d, (_whole(leaves.get("governor")), label(leaves.get("dep"))))
                for s, found in words.items():
                    link = links.get(s, {})
                    ids.append(key)
                    sents.append(s[-1])
                    tokens.append([{"i": i, "word": _string(t.get("word", t.get("originalText"))), "pos": _string(t.get("pos")), "head": link.get(i, (None, None))[0], "rel": link.get(i, (None, None))[1], "ner": _string(t.get("ner"))} for i, t in found])
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(sents, pa.int32()), pa.array(tokens, pa.list_(ARROW_TOKEN))], names=names)

    return df.select(id_col, json_col).filter(F.col(json_col).isNotNull()).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, sent_id int, tokens array<{TOKEN}>")


def tokens(sents: DataFrame) -> DataFrame:
    """One row per token."""
    keys = [c for c in sents.columns if c != "tokens"]
    return sents.select(*keys, F.explode("tokens").alias("t")).select(*keys, "t.*")


def annotate(df: DataFrame, id_col: str, text: str, annotator: Callable[[str], list[list[dict]]]) -> DataFrame:
    """Sentences from an own annotator, which gives for a text its sentences as lists of token dicts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, s, tok) for k, t in zip(f[id_col], f[text]) if t for s, tok in enumerate(annotator(t)) if tok]
            yield pd.DataFrame(rows, columns=[id_col, "sent_id", "tokens"])

    return df.select(id_col, text).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, sent_id int, tokens array<{TOKEN}>")


def to_conllu(sents: DataFrame) -> DataFrame:
    """Sentences as CoNLL-U blocks in ``value``."""
    dash = lambda c: F.coalesce(c, F.lit("_"))
    line = lambda t: F.concat_ws("\t", t["i"], dash(t["word"]), F.lit("_"), F.lit("_"), dash(t["pos"]), F.lit("_"), dash(t["head"].cast("string")), dash(t["rel"]), F.lit("_"), F.lit("_"))
    keys = [c for c in sents.columns if c != "tokens"]
    return sents.select(*keys, F.array_join(F.transform("tokens", line), "\n").alias("value"))


def from_conllu(blocks: DataFrame, value: str = "value") -> DataFrame:
    """``tokens`` of CoNLL-U blocks; lines that don't begin with a plain number are left out."""
    lines = F.filter(F.split(value, "\r?\n"), lambda x: x.rlike(r"^\d+\t"))
    blank = lambda c: F.when(c != "_", c)
    mapping = F.create_map(*[F.lit(x) for kv in DIALECT.items() for x in kv])

    def token(x: Column) -> Column:
        c = F.split(x, "\t")
        rel = F.lower(blank(c[7]))
        return F.struct(c[0].cast("int").alias("i"), blank(c[1]).alias("word"), blank(c[4]).alias("pos"), blank(c[6]).cast("int").alias("head"), F.coalesce(mapping[rel], rel).alias("rel"), F.lit(None).cast("string").alias("ner"))

    keys = [c for c in blocks.columns if c != value]
    return blocks.select(*keys, F.transform(lines, token).alias("tokens")).filter("size(tokens) > 0")


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """CoNLL-U files: ``path``, ``sent_id``, ``tokens``. Blocks are separated by blank lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n[ \t]*\r?\n+")).alias("sent_id", "value"))
    return from_conllu(whole)
