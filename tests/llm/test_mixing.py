from factloom.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.25, 3), ("none", 0.15, 2), ("c", 0.1, None)]


def counts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_shares_repeats_and_budget(spark):
    rows = [(i, "a", 10) for i in range(2000)] + [(5000 + i, "b", 7) for i in range(300)] + [(7000 + i, "c", 11) for i in range(400)] + [(9000, None, 5), (9001, "other", 5), (9002, "c", 0)]
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    sample, plan = mixing.mix(counts(spark, rows), targets, "doc_id", bucket_rows=50)
    got = {r.source: r for r in mixing.shares(sample, plan).collect()}
    budget = plan.first()["budget"]
    assert budget == int(300 * 7 * 3 / (0.25 / 0.85))
    assert abs(got["a"].share - 0.5 / 0.85) < 0.002 and abs(got["b"].share - 0.25 / 0.85) < 0.002 and abs(got["c"].share - 0.1 / 0.85) < 0.002
    assert got["b"].times_used == 3 and got["a"].times_used == 1 and got["none"].share == got["other"].share == got[None].share == 0.0
    total = sum(r.sample_tokens for r in got.values())
    assert budget - 11 < total <= budget
    assert sample.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
    small, _ = mixing.mix(counts(spark, rows), targets, "doc_id", budget=1000, bucket_rows=50)
    assert small.join(sample, ["doc_id", "copy"], "left_anti").count() == 0 and 950 < small.agg({"n_tokens": "sum"}).first()[0] <= 1000


def test_order_is_by_finish_time(spark):
    rows = [(i, "a", 1 + i % 5) for i in range(500)] + [(1000 + i, "b", 3) for i in range(400)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    sample = mixing.mix(counts(spark, rows), targets, "doc_id", bucket_rows=20)[0].collect()
    for s in "ab":
        own = sorted((r for r in sample if r.source == s), key=lambda r: r.finish)
        run = 0
        for r in own:
            run += r.n_tokens
            assert abs(r.finish - run / 0.5) < 1e-6


def test_empty_and_texts(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([(1, "one two three", "a", 9), (2, None, "a", 9), (3, "", "b", 9), (4, "x " * 20_000, "c", 9)], "doc_id bigint, text string, source string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(docs, "doc_id", "text", ["source"]).collect()}
    assert got[1] == 3 and got[2] == 0 and got[3] == 0 and got[4] >= 20_000
    sample, plan = mixing.sample(docs.limit(0), targets, "doc_id", "text")
    assert sample.count() == 0 and mixing.shares(sample, plan).count() == 4
