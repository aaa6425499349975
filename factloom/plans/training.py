"""Queries of the general operators for training data: hierarchies and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import hierarchy, nested
from factloom.runtime import table

SENTENCE = ["doc_id", "sent_id"]
KINDS = {"sentences/tokens": "token", "sentences/basicdependencies": "dependency", "sentences/entitymentions": "entitymention", "corefs/*": "coref"}
PLACES = [nested.Nested("token", "sentences/tokens"), nested.Nested("dependency", "sentences/basicDependencies"), nested.Nested("entitymention", "sentences/entitymentions"), nested.Nested("coref", "corefs/*")]
TOKEN = nested.Nested("token", "sentences/tokens", ("index", "word", "originalText", "characterOffsetBegin", "characterOffsetEnd", "pos", "ner", "lemma"))
DEPENDENCY = nested.Nested("dependency", "sentences/basicDependencies", ("dep", "governor", "governorGloss", "dependent", "dependentGloss"))
ENTITY = nested.Nested("entitymention", "sentences/entitymentions", ("text", "ner", "tokenBegin", "tokenEnd"))
COREF = nested.Nested("coref", "corefs/*", ("id", "text", "type", "startIndex", "endIndex", "sentNum", "isRepresentativeMention"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cycles(table(spark, sf_dir, "dependencies"), SENTENCE, "dependent", "governor", 0).withColumnRenamed("dependent", "node")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.resolve(table(spark, sf_dir, "dependencies"), SENTENCE, "dependent", "governor", "dep", 0)


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = lambda c: F.array_join(c, hierarchy.UP).alias(c)
    return _resolved(spark, sf_dir).select(*SENTENCE, "dependent", written("path"), written("labels"), "depth", "top", "cyclic", "leads_to_cycle")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_resolved(spark, sf_dir), SENTENCE, "dependent")


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.once(table(spark, sf_dir, "annotations").select("ann_id", "payload", "loaded_at"), "ann_id", "loaded_at")


def _every_table(spark: SparkSession, sf_dir: str, leaves: bool = True) -> DataFrame:
    return nested.shred(_annotations(spark, sf_dir), "ann_id", "payload", free=("corefs",), leaves=leaves)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds among all tables that the payloads turn out to hold."""
    kind = F.create_map(*[F.lit(x) for path, k in KINDS.items() for x in (path, k)])[F.col("kind")]
    return _every_table(spark, sf_dir, leaves=False).select("ann_id", kind.alias("kind"), "parent", "child").filter("kind IS NOT NULL")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table found, with its number of rows and its columns."""
    return nested.tables_of(_every_table(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


def _flat(kind: nested.Nested) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.table_of(nested.shred(_annotations(spark, sf_dir), "ann_id", "payload", [kind]), "ann_id", kind)

    return query


def p3_unparsable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.unparsable(_annotations(spark, sf_dir), "ann_id", "payload")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants,
        "p3_found": p3_found, "p3_tables": p3_tables, "p3_tokens": _flat(TOKEN), "p3_dependencies": _flat(DEPENDENCY), "p3_entitymentions": _flat(ENTITY), "p3_corefs": _flat(COREF), "p3_unparsable": p3_unparsable,
    }


_UP = """WITH RECURSIVE l AS (SELECT doc_id, sent_id, dependent AS node, min(nullif(governor, 0)) AS up FROM dependencies
  WHERE doc_id IS NOT NULL AND sent_id IS NOT NULL AND dependent IS NOT NULL GROUP BY ALL),
"""

_OBJECTS = """WITH a AS (SELECT ann_id, arg_min(payload, loaded_at) AS p FROM annotations GROUP BY ann_id),
rec AS (SELECT ann_id, coalesce(json_extract(d, '$.result'), d) AS d FROM (SELECT ann_id, TRY_CAST(p AS JSON) AS d FROM a) WHERE d IS NOT NULL),
sl AS (SELECT ann_id, json_extract(d, '$.sentences[*]') AS l FROM rec), st AS (SELECT ann_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS s FROM sl),
ck AS (SELECT ann_id, d, unnest(json_keys(d, '$.corefs')) AS k FROM rec),
v AS (SELECT ann_id, 'token' AS kind, CAST(k AS VARCHAR) AS parent, json_extract(s, '$.tokens') AS v FROM st UNION ALL SELECT ann_id, 'dependency', CAST(k AS VARCHAR), coalesce(json_extract(s, '$.basicDependencies'), json_extract(s, '$."basic-dependencies"')) FROM st
  UNION ALL SELECT ann_id, 'entitymention', CAST(k AS VARCHAR), json_extract(s, '$.entitymentions') FROM st UNION ALL SELECT ann_id, 'coref', k, json_extract(d, '$.corefs."' || k || '"') FROM ck),
i AS (SELECT ann_id, kind, parent, unnest(CAST(v AS JSON[])) AS x, generate_subscripts(CAST(v AS JSON[]), 1) - 1 AS child FROM v WHERE json_type(v) = 'ARRAY'),
o AS (SELECT ann_id, kind, parent, CAST(child AS INT) AS child, x FROM i WHERE json_type(x) = 'OBJECT' UNION ALL SELECT ann_id, kind, parent, 0, v FROM v WHERE json_type(v) = 'OBJECT')"""


def _leaves(n: nested.Nested) -> str:
    return _OBJECTS + " SELECT ann_id, parent, child, " + ", ".join(f"x->>'{c}' AS \"{c}\"" for c in n.columns) + f" FROM o WHERE kind = '{n.kind}'"


ORACLE = {
    "p2_found": _UP + """w AS (SELECT doc_id, sent_id, node, up AS cur FROM l WHERE up IS NOT NULL
  UNION SELECT w.doc_id, w.sent_id, w.node, l.up FROM w JOIN l ON l.doc_id = w.doc_id AND l.sent_id = w.sent_id AND l.node = w.cur WHERE l.up IS NOT NULL)
SELECT doc_id, sent_id, node FROM w WHERE node = cur""",
    "p2_descendants": _UP + """w AS (SELECT doc_id, sent_id, node, up AS cur, 1 AS distance FROM l WHERE up IS NOT NULL
  UNION ALL SELECT w.doc_id, w.sent_id, w.node, l.up, distance + 1 FROM w JOIN l ON l.doc_id = w.doc_id AND l.sent_id = w.sent_id AND l.node = w.cur WHERE l.up IS NOT NULL AND distance < 250),
stuck AS (SELECT DISTINCT doc_id, sent_id, node FROM w WHERE distance = 250)
SELECT doc_id, sent_id, cur AS ancestor, node AS descendant, CAST(distance AS INT) AS distance FROM w ANTI JOIN stuck USING (doc_id, sent_id, node)""",
    "p2_paths": """WITH RECURSIVE l AS (SELECT DISTINCT ON (doc_id, sent_id, dependent) doc_id, sent_id, dependent AS node, nullif(governor, 0) AS up, coalesce(lower(trim(dep)), '') AS label FROM dependencies
  WHERE doc_id IS NOT NULL AND sent_id IS NOT NULL AND dependent IS NOT NULL ORDER BY doc_id, sent_id, dependent, nullif(governor, 0) NULLS LAST, lower(trim(dep)) NULLS LAST),
w AS (SELECT doc_id, sent_id, node, node AS cur, up, CAST(node AS VARCHAR) AS path, label AS labels, 0 AS depth FROM l
  UNION ALL SELECT w.doc_id, w.sent_id, w.node, w.up, l.up, w.up || ' > ' || path, CASE WHEN l.node IS NULL THEN labels ELSE l.label || ' > ' || labels END, depth + 1
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id AND l.sent_id = w.sent_id AND l.node = w.up WHERE w.up IS NOT NULL AND depth < 250),
done AS (SELECT * FROM w WHERE up IS NULL), """ + _UP.replace("WITH RECURSIVE l AS", "m AS") + """r AS (SELECT doc_id, sent_id, node, up AS cur FROM m WHERE up IS NOT NULL
  UNION SELECT r.doc_id, r.sent_id, r.node, m.up FROM r JOIN m ON m.doc_id = r.doc_id AND m.sent_id = r.sent_id AND m.node = r.cur WHERE m.up IS NOT NULL),
cy AS (SELECT doc_id, sent_id, node FROM r WHERE node = cur)
SELECT l.doc_id, l.sent_id, l.node AS dependent, path, labels, CAST(depth AS INT) AS depth, cur AS top, cy.node IS NOT NULL AS cyclic, done.node IS NULL AND cy.node IS NULL AS leads_to_cycle
FROM l LEFT JOIN done USING (doc_id, sent_id, node) LEFT JOIN cy USING (doc_id, sent_id, node)""",
    "p3_found": _OBJECTS + " SELECT ann_id, kind, parent, child FROM o",
    "p3_tokens": _leaves(TOKEN), "p3_dependencies": _leaves(DEPENDENCY), "p3_entitymentions": _leaves(ENTITY), "p3_corefs": _leaves(COREF),
    "p3_unparsable": "SELECT ann_id FROM annotations GROUP BY ann_id HAVING NOT coalesce(json_valid(min_by(payload, loaded_at)), false)",
}
