import random

from pyspark.sql import functions as F

from factloom.llm import entity_names as en

THINGS = [
    ("Ilse_Sokketmak", "Ilse Sokketmak", "PERSON"), ("Suppindob", "Suppindob", "LOCATION"), ("Suppindob_(river)", "Suppindob (river)", "LOCATION"), ("University_of_Kolnilmif", "University of Kolnilmif", "ORGANIZATION"),
    ("The_Silent_Quarry", "The Silent Quarry", "MISC"), ("Saint_Vovkam_Abbey", "Saint Vovkam Abbey", "ORGANIZATION"), ("Royal_Tubbal_Observatory", "Royal Tübbal Observatory", "ORGANIZATION"), (None, "No Uri", None), ("X1", "Same Label", None), ("X2", "Same Label", None),
]
CASES = {
    "Suppindob": "Suppindob", "the  SUPPINDOB 's": "Suppindob", "Ssuppindob": "Suppindob", "Supinddob": "Suppindob", "Suppindob (rivre)": "Suppindob_(river)", "River Suppindob": "Suppindob_(river)", "Suppindob River": "Suppindob_(river)",
    "Sokketmak, Ilse": "Ilse_Sokketmak", "I. Sokketmak": "Ilse_Sokketmak", "Prof. Ilse Soketmak": "Ilse_Sokketmak", "sokketmak": "Ilse_Sokketmak", "IlseSokketmak": "Ilse_Sokketmak", "Ilse_Sоkketmаk": "Ilse_Sokketmak",
    "Univ. of Kolnilmif": "University_of_Kolnilmif", "Silent Quarry, The": "The_Silent_Quarry", "TheSilentQuarry": "The_Silent_Quarry", "Th Silent Qaurry": "The_Silent_Quarry", "St. Vovkam Abbey": "Saint_Vovkam_Abbey", "R. T%C3%BCbbal Obs.": "Royal_Tubbal_Observatory",
    "he": en.NIL, "?": en.NIL, "1874": en.NIL, "_NIL_": en.NIL, "the narrow ferry line": en.NIL, "Ilse Kolnilmif": en.NIL, "University of Sokpindit": en.NIL, "Same Label": en.NIL, "x" * 5000: en.NIL,
}


def test_values(spark):
    things = spark.createDataFrame(THINGS, "uri string, label string, ne_type string")
    values = spark.createDataFrame([(v,) for v in CASES], "value string")
    for rows in (10**6, 0):
        got = {r.value: r.uri for r in en.map_values(values, things, index_rows=rows).collect()}
        assert {v: u for v, u in got.items() if CASES[v] != u} == {}
        assert len(got) == len(CASES)


def test_link(spark):
    things = spark.createDataFrame(THINGS, "uri string, label string, ne_type string")
    rows = [(1, "Suppindob", "x", 1), (1, "Suppindob", "x", 1), (2, "", "ilse sokketmak", 1), (3, None, None, 1), (4, None, "", 1), (None, "Suppindob", None, 1)]
    df = spark.createDataFrame(rows, "mention_id bigint, surface_form string, word string, uri int")
    value = F.when(F.col("surface_form") != "", F.col("surface_form")).otherwise(F.col("word"))
    assert sorted(tuple(r) for r in en.link(df, "mention_id", value, things).collect()) == [(1, "Suppindob"), (2, "Ilse_Sokketmak"), (3, en.NIL), (4, en.NIL)]
    assert en.link(df.limit(0), "mention_id", value, things).count() == 0
    assert {r.uri for r in en.link(df.filter("mention_id > 0"), "mention_id", value, things.limit(0)).collect()} == {en.NIL}


def test_slips_against_search():
    rng = random.Random(1)

    def near(word, n):
        out = {word}
        for _ in range(n):
            out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))} | {w[:i] + c + w[i:] for w in out for i in range(len(w) + 1) for c in "ab"} | {w[:i] + c + w[i + 1 :] for w in out for i in range(len(w)) for c in "ab"} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in out for i in range(len(w) - 1)}
        return out

    for _ in range(25):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        exact = 0 if a == b else next((n for n in (1, 2) if b in near(a, n)), 3)
        assert min(en.slips(a, b, 2), 3) == exact


def test_both_arms_choose_alike(spark):
    rng = random.Random(8)
    syllables = "mor lon kus vel pom rit sab nuk dul gek fir tan".split()
    labels = [" ".join("".join(rng.choice(syllables) for _ in range(3)).title() for _ in range(rng.randint(1, 3))) for _ in range(80)]
    rows = [(f"u{i}", x, rng.choice(["PERSON", None])) for i, x in enumerate(labels)] + [("u1", labels[0] + " " + labels[1], "PERSON"), ("u2", labels[2], None)]
    things = spark.createDataFrame(rows, "uri string, label string, ne_type string")

    def typed(x):
        k = rng.randrange(len(x))
        return rng.choice([x, x.upper(), x[:k] + x[k + 1 :], x[:k] + "x" + x[k:], " ".join(reversed(x.split())), x[0] + ". " + x.split()[-1], x[: k + 3]])

    values = spark.createDataFrame([(v,) for v in sorted({typed(rng.choice(labels)) for _ in range(300)})], "value string")
    arms = [sorted((r.value, r.uri, r.edits, round(r.score, 9)) for r in en.map_values(values, things, index_rows=n).collect()) for n in (10**6, 0)]
    assert arms[0] == arms[1] and sum(r[1] != en.NIL for r in arms[0]) > 150
