import json
import random

from factloom.operators import nested
from factloom.plans.training import COREF, PLACES, TOKEN


def shredded(spark, payloads, tables=PLACES):
    df = spark.createDataFrame(list(enumerate(payloads)), "ann_id bigint, payload string").selectExpr("*", "'x' AS kind", "1 AS parent")
    return nested.shred(df, "ann_id", "payload", tables)


def places(df):
    return sorted(tuple(r) for r in df.select("ann_id", "kind", "parent", "child").collect())


def test_shapes(spark):
    payloads = [
        json.dumps({"sentences": [{"tokens": [{"word": "a"}, None, 3, {"word": "b"}], "basic-dependencies": {"dep": "x"}}, {"tokens": []}, {"entity_mentions": [{"text": "q"}]}]}),
        json.dumps({"status": "ok", "result": {"Sentences": {"tokens": {"word": "a"}}, "corefs": {"7": [{"id": 1}, {"id": 2}], "9": {"id": 3}, "11": None}}}),
        '{"sentences": [', None, "[]", "3", "null", "", '{"sentences": null, "corefs": null}', '{"sentences": [{"tokens": [{"x": NaN}]}]}', "[" * 100_000,
    ]
    assert places(shredded(spark, payloads)) == [
        (0, "dependency", "0", 0), (0, "entitymention", "2", 0), (0, "token", "0", 0), (0, "token", "0", 3),
        (1, "coref", "7", 0), (1, "coref", "7", 1), (1, "coref", "9", 0), (1, "token", "0", 0),
    ]


def test_pivoted_columns(spark):
    df = shredded(spark, [json.dumps({"sentences": [{"tokens": [{"index": 1, "Word": "aé", "pos": None, "lemma": {"x": [1]}}]}]})], [TOKEN])
    row = nested.table_of(df, "ann_id", TOKEN).first()
    assert (row["index"], row["word"], row["pos"], row["lemma"], row["ner"]) == ("1", "aé", None, '{"x": [1]}', None)
    assert nested.table_of(shredded(spark, [], [COREF]), "ann_id", COREF).count() == 0


def test_once_and_unparsable(spark):
    df = spark.createDataFrame([(1, "{}", 2), (1, "{} ", 1), (2, "{", 5), (3, None, 1), (None, "{}", 1)], "ann_id bigint, payload string, at int")
    assert sorted((r.ann_id, r.at) for r in nested.once(df, "ann_id", "at").collect()) == [(1, 1), (2, 5), (3, 1)]
    assert sorted(r.ann_id for r in nested.unparsable(nested.once(df, "ann_id", "at"), "ann_id", "payload").collect()) == [2, 3]


def test_three_levels_and_arrays_in_arrays(spark):
    payload = json.dumps({"sentences": [{"tokens": [{"features": [{"f": 1}, {"f": 2}]}]}, {"tokens": [{"w": "x"}, {"features": [{"f": 3}], "tags": ["a", None]}]}], "grid": [[{"c": 1}], [{"c": 2}, {"c": 3}]]})
    found = shredded(spark, [payload, "[" + payload + "]"], None)
    rows = {(r.ann_id, r.kind, tuple(r.ordinals)): r.leaves for r in found.collect()}
    features = {k[2]: v["f"] for k, v in rows.items() if k[:2] == (0, "sentences/tokens/features")}
    assert features == {("0", "0", "0"): "1", ("0", "0", "1"): "2", ("1", "1", "0"): "3"}
    assert {k[2]: v["c"] for k, v in rows.items() if k[:2] == (0, "grid/#")} == {("0", "0"): "1", ("1", "0"): "2", ("1", "1"): "3"}
    assert {k[2]: v["="] for k, v in rows.items() if k[:2] == (0, "sentences/tokens/tags/=")} == {("1", "1", "0"): "a", ("1", "1", "1"): None}
    assert ("0", "1", "1", "0") in {k[2] for k in rows if k[:2] == (1, "sentences/tokens/features")}
    tables = {r.kind: (r.n_rows, r.columns) for r in nested.tables_of(found.filter("ann_id = 0")).collect()}
    assert tables["sentences/tokens"] == (3, ["features", "tags", "w"]) and tables["grid/#"] == (3, ["c"])


def test_depth_has_no_limit(spark):
    n = 30_000
    deep = '{"a": ' * n + '{"tokens": 1}' + "}" * n
    df = shredded(spark, ['{"x": ' + deep + ', "sentences": [{"tokens": [{"word": "w"}]}]}', "[" * n + "]" * n, "[" * n + "]" * (n - 1)])
    assert places(df) == [(0, "token", "0", 0)]
    text = spark.createDataFrame([(1, "[" * n + "]" * n), (2, "[" * n)], "ann_id bigint, payload string")
    assert [r.ann_id for r in nested.unparsable(text, "ann_id", "payload").collect()] == [2]


def test_same_as_the_standard_parser():
    rng = random.Random(3)
    shredder = nested.Shredder(None, ())
    parts = ['{"a":', "[", "]", "}", ",", ":", '"b"', "1", "-0.5e+3", "01", "true", "null", "nul", '"\\u00e9\\n"', '"\\x"', '"\t"', " ", "{}", "[]", '"c": 2', "NaN", '"', ".5", "\u00a0"]
    pieces = [json.dumps({"k": [rng.choice([1, "x", None, {"y": [True]}, [[]], {}]) for _ in range(3)], "q": {"1": [{"z": 1}], "2": {"z": 2}}}) for _ in range(50)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    for p in pieces:
        texts += [p, p[: rng.randrange(len(p))], p.replace(rng.choice(p), rng.choice(p), 1)]
    for t in texts:
        try:
            json.loads(t, parse_constant=lambda x: 1 / 0)
            valid = True
        except (ValueError, ZeroDivisionError):
            valid = False
        try:
            shredder.rows(t)
            assert valid, t
        except nested.Invalid:
            assert not valid, t
