import random

import numpy as np

from factloom.llm import leakage


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            v = (x or "").lower().split()
            if any(w[a : a + n] == v[b : b + n] for a in range(len(w) - n + 1) for b in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        src = rng.choice(items[:12])[1].split()
        k = rng.randint(0, len(src))
        at = rng.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + src[k : k + rng.randint(10, 16)] + w[at:])))
    docs += [(100, items[0][1]), (100, items[0][1]), (101, None), (102, "")]
    dd = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, _hits string")
    ii = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, fp int")
    for rows in (0, 10**6):
        got = leakage.leaks(dd, ii, "doc_id", "item_id", broadcast_rows=rows)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(brute(docs, items, 13))


def test_disguises(spark):
    item = "In 1936 the physician Kamdit and the composer Rodfogref described a wooden map collection near Pegsel"
    docs = [(1, "Intro. " + item.upper().replace(" ", " ") + "!"), (2, item.replace("o", "о").replace(" the", " [the]")), (3, " ".join(item.split()[:12]) + " x"), (4, item.replace("wooden", "stone"))]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = leakage.leaks(dd, spark.createDataFrame([(7, item)], "item_id bigint, text string"), "doc_id", "item_id").collect()
    assert sorted((r.doc_id, r.n_words, r.doc_word) for r in got) == [(1, 16, 1), (2, 16, 0)]
    assert leakage.leaks(dd.limit(0), dd.selectExpr("doc_id AS item_id", "text"), "doc_id", "item_id").count() == 0


def test_window_guarantee():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**62, 300).astype(np.uint64)
    _, at = leakage.fingerprints(h, 8, 6)
    assert np.diff(at).max() <= 6 and at[0] <= 5
    assert len(leakage.fingerprints(h[:12], 8, 6)[0]) == 0


def test_longest_run_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        n, x, y = leakage.Runs(b).longest(a)
        most = max((k for k in range(31) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)
        assert n == most and a[x : x + n] == b[y : y + n]


def test_repetitive_texts_are_linear():
    words = ["na", "na", "hey"] * 40_000
    assert leakage.Runs(words[:60_000]).longest(words)[0] == 60_000


def test_surroundings_do_not_matter(spark):
    passage = "ΤΟ ΜΕΓΑΛΟ ΣΠΙΤΙ ΤΗΣ ΠΟΛΗΣ ΕΙΝΑΙ ΚΟΝΤΑ ΣΤΗΝ ΠΑΛΙΑ ΑΓΟΡΑ ΚΑΙ ΤΟ ΛΙΜΑΝΙ"
    docs = [(1, "the old map and more English words here " + passage), (2, "это русский текст рядом " + passage.lower()), (3, passage)]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, passage)], "item_id bigint, text string"), "doc_id", "item_id")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3]
