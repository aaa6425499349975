from factloom.streaming import ingest

DATA = "/root/testdata/sf0.001"


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams_match_batch(spark, tmp_path):
    ann = spark.read.parquet(f"{DATA}/annotations.parquet")
    ann.write.parquet(str(tmp_path / "a"))
    live = ingest.read(spark, str(tmp_path / "a"), ann.schema)
    got = drain(ingest.extracted(live, "ann_id", "payload"), "facts", "append")
    assert got.count() == ingest.extracted(ann, "ann_id", "payload").count() > 0
    t = spark.read.parquet(f"{DATA}/tuples.parquet")
    t.write.parquet(str(tmp_path / "t"))
    live = ingest.read(spark, str(tmp_path / "t"), t.schema)
    counts = drain(ingest.predicate_counts(live, "extracted_at"), "counts", "complete")
    assert counts.agg({"n": "sum"}).first()[0] == t.count()
    once = drain(ingest.deduplicated(live, "tuple_id", "extracted_at"), "once", "append")
    assert once.count() == t.select("tuple_id").distinct().count()
