import random
from collections import Counter, defaultdict

from factloom.llm import queries as llm
from factloom.llm import term_frequency as tf

E = "struct<word:string,word_index:array<int>,prep:string,reference:string,ne_type:string,entity:array<struct<uri:string,final_score:double>>>"


def test_ngrams_against_counting(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(12)]), [rng.choice("abc") for _ in range(rng.randint(0, 6))], "clash") for _ in range(300)] + [(1, None, "x"), (2, [], "x")] + [(d, ["a"], "y") for d in range(200)]
    n, docs = Counter(), defaultdict(set)
    for d, terms, _ in rows:
        for i in range(len(terms or [])):
            for k in range(1, 4):
                if i + k <= len(terms):
                    g = " ".join(terms[i : i + k])
                    n[g] += 1
                    docs[g] |= {d} - {None}
    df = spark.createDataFrame(rows, "doc bigint, terms array<string>, gram string")
    for rows_each in (2, 10**6):
        got = {r.gram: (r.n, r.n_records) for r in tf.frequencies(df, "doc", "terms", longest=3, bucket_rows=rows_each).collect()}
        assert got == {g: (n[g], len(docs[g])) for g in n}


def test_values_and_marks(spark):
    rows = [(1, "was", "SVO"), (2, "was", None), (3, "was", "SVO"), (4, "was sold", "SVO"), (4, "was sold", "SVO"), (5, None, "svo"), (6, "", None)]
    df = spark.createDataFrame(rows, "doc bigint, p string, c string")
    got = {(r.field, r.val): (r.n, r.n_records, r.mark) for r in tf.marked(tf.value_frequencies(df, "doc", {"predicate": "p", "clause": "c"}), 20).collect()}
    assert got == {("predicate", "was"): (3, 3, "common"), ("predicate", "was sold"): (2, 1, "rare"), ("predicate", ""): (1, 1, "rare"), ("clause", "SVO"): (4, 3, "common"), ("clause", "svo"): (1, 1, "rare")}
    assert tf.value_frequencies(df.limit(0), "doc", {"predicate": "p"}).count() == 0


def test_predicate_terms_are_counted_up_to_the_longest_and_marked(spark, tmp_path):
    said = [(1, 1, "would have been sold"), (2, 2, "would  have been sold"), (3, 3, "Would have been"), (4, 3, "was"), (5, 4, "")]
    rows = [(i, d, (w, None, None, None, None, None), "SVO") for i, d, w in said]
    spark.createDataFrame(rows, f"tuple_id bigint, doc_id bigint, predicate {E}, clause_type string").write.parquet(str(tmp_path / "tuples.parquet"))
    docs, n = defaultdict(set), defaultdict(int)
    for _, d, text in said:
        ws = text.lower().split()
        for g in (" ".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)):
            docs[g].add(d)
            n[g] += 1
    want = {g: (n[g], len(docs[g]), "rare" if len(docs[g]) < 3 else "common") for g in n}
    got = {r.gram: (r.n, r.n_records, r.mark) for r in llm.queries()["p5_predicate_terms"](spark, str(tmp_path)).collect()}
    assert got == want and got["would have been sold"] == (2, 2, "rare")
