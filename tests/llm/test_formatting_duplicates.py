import json
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import formatting_duplicates as fd

FIELDS = ["subject", "predicate", "direct_object"]


def make(spark, records):
    return spark.createDataFrame([(i, r, "clash", 1) for i, r in records], "rec_id bigint, record string, _key string, n_copies int")


def pairs(df):
    return sorted((r.kept_id, r.copy_id) for r in df.collect())


def test_forms_of_one_tuple(spark):
    records = [
        (5, json.dumps({"subject": "The Mill!", "predicate": "was  sold", "direct_object": "to Ann"})), (2, "predicate: WAS SOLD | subject: the_mill | direct_object: (to ann)"),
        (9, "direct_object=to Ann|subject=the mill|predicate=was sold|negation=false"), (1, '{"subject": "the mill", "predicate": "was sold"}'), (3, "subject=the mill|predicate=was sold|direct_object="),
        (4, '{"subject": "the mill", "predicate": "was sold", "direct_object": null}'), (6, '{"subject": "thé mill", "predicate": "was sold"}'), (7, None), (8, ""), (10, "{broken"),
    ]
    assert pairs(fd.copies(make(spark, records), "rec_id", "record", FIELDS)) == [(1, 3), (1, 4), (2, 5), (2, 9)]
    rows = {r.kept_id: r.n_copies for r in fd.collapse(make(spark, records), "rec_id", "record", FIELDS).collect()}
    assert rows == {1: 3, 2: 3, 6: 1}


def test_empty(spark):
    assert pairs(fd.copies(make(spark, []), "rec_id", "record", FIELDS)) == []
    assert fd.collapse(make(spark, []), "rec_id", "record", FIELDS).count() == 0


def test_brute_force_with_a_saturated_filter(spark):
    rng = random.Random(3)
    records = [(i, f"subject=s{rng.randint(0, 300)}|predicate=p|direct_object=") for i in range(600)] + [(1000 + i, "subject=hot|predicate=p") for i in range(400)]
    first: dict = {}
    for i, r in records:
        first.setdefault(r.replace("|direct_object=", ""), []).append(i)
    expected = sorted((min(v), x) for v in first.values() for x in v if x != min(v))
    for bits in (1 << 15, 1 << 28):
        assert pairs(fd.copies(make(spark, records).repartition(7), "rec_id", "record", FIELDS, max_bits=bits)) == expected


def test_no_repeat_is_missed():
    h = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    once, again = np.zeros(1 << 14, np.uint8), np.zeros(1 << 14, np.uint8)
    fd._add(once, again, [fd._bits(np.concatenate([h, h[:30]]), 1 << 17).ravel()])
    fd._add(once, again, [fd._bits(h[30:50], 1 << 17).ravel()])
    held = np.unpackbits(again).astype(bool)[fd._bits(h, 1 << 17)].all(axis=0)
    assert held[:50].all() and held[50:].mean() < 0.05


def test_slices_give_the_same(spark):
    rows = [(i, f"subject=s{i % 700}|predicate=P {i % 3}|direct_object={'x' if i % 2 else 'X.'}") for i in range(9_000)]
    df = spark.createDataFrame(rows, "rec_id bigint, record string")
    fields = ["subject", "predicate", "direct_object"]
    for work in (fd.copies, fd.collapse):
        one = sorted(tuple(r) for r in work(df, "rec_id", "record", fields).collect())
        assert one == sorted(tuple(r) for r in work(df, "rec_id", "record", fields, max_bits=1 << 15).collect())


def test_few_single_records_pass(spark):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("_h"))
    assert fd.possible_repeats(keys, 300_000).filter("_maybe").count() < 1_500
