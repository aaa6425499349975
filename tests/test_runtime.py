import pytest

from factloom import runtime


def test_hot_keys_are_split_to_the_same_result(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", None if i % 5 else "x") for i in range(600)] + [(1, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, key string, other string")
    groups = df.filter("key IS NOT NULL").groupBy("key").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        plain = sorted(map(repr, df.join(groups, "key", how).select("id", "key", "other", "n").collect()))
        split = runtime.join_groups(df, groups, ["key"], "n", how, hot_rows=20)
        assert sorted(map(repr, split.select("id", "key", "other", "n").collect())) == plain
    parts = runtime.join_groups(df, groups, ["key"], "n", hot_rows=20, most_hot=1).count()
    assert parts == df.join(groups, "key").count()
    assert runtime.join_groups(df.limit(0), groups.limit(0), ["key"], "n").count() == 0


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "id bigint, t string")
    assert runtime.small(df, 50) is not df and runtime.small(df, 49) is df
    assert runtime.small(df, 50, "t", 5_000) is not df and runtime.small(df, 50, "t", 4_999) is df


def test_scratch_is_shared_and_deleted(spark):
    folder = runtime.scratch(spark)
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3 and "checkpoints" in folder
    runtime.drop_scratch(spark, folder)
    with pytest.raises(Exception):
        spark.read.parquet(folder).count()


def test_workers_have_the_package(spark):
    """A task imports the package from what was shipped, whatever the workers' paths are."""
    runtime.ship(spark.sparkContext)

    def where(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            yield pa.record_batch([pa.array([any(p.endswith("factloom.zip") for p in sys.path)])], names=["there"])

    assert all(r.there for r in spark.range(4).mapInArrow(where, "there boolean").collect())
