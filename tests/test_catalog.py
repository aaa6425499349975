import __spark_entry__ as entry
from factloom.plans import catalog

from .conftest import DATA


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "sent_id", "node"]


def test_some_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("tuples", "annotations", "dependencies", "kb", "kb_things"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("p2_found", "to_triples", "overlap_collisions", "svo_tuples", "kb_relatedness", "noun_chunks"):
        df = catalog.queries()[name](spark, DATA)
        rel = con.execute(catalog.oracle_sql()[name])
        cols = [d[0] for d in rel.description]
        expected = sorted(repr(tuple(r[cols.index(c)] for c in sorted(cols))) for r in rel.fetchall())
        assert sorted(repr(tuple(r[c] for c in sorted(cols))) for r in df.collect()) == expected, name
