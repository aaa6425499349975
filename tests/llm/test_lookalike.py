import unicodedata

import pytest

from factloom.llm import lookalike as la

WORDS = "the council sold maps history printing house reopening Дом река школа известна мельница ελληνικα γραμματα".split()


@pytest.fixture(scope="module")
def model(spark):
    return la.train(spark.createDataFrame([(" ".join(WORDS * 5),), (None,), ("",)], "text string"), "text")


@pytest.mark.parametrize(
    ("a", "b"),
    [("the house", "thе hоuѕе"), ("co­un​cil", "council"), ("the  house", "the  house"), ("ｔｈｅ", "the"), ("ﬁve", "five"), ("café", "café"), ("café", "cаfе́"), ("well‐known", "well-known"), ("река", "pека"), ("ﾃﾙ", "テル"), ("한", "한"), ("น้ำ", "น้ํา"), ("قرية", "قریة"), ("a\r\nb", "a\nb"), ("x \n", "x"), ("well\ufe63known", "well-known"), ("Ⅳ", "IV"), ("ⅷ", "viii"), ("𝙼𝖺𝗉 𝟶", "Map 0"), ("maɡic", "magic"), ("ꓮꓳꓓ", "AOD"), ("Ꭺ Ꮇ", "A M"), ("hօt", "hot"), ("ӏ", "ӏ")],
)
def test_same_look(model, a, b):
    assert la.canonical(a, model) == la.canonical(b, model)


@pytest.mark.parametrize(("a", "b"), [("house", "House"), ("cafe", "café"), ("“a”", '"a"'), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("①", "1"), ("l", "I"), ("a–b", "a-b"), ("في", "فی"), ("क्‌ष", "क्ष"), ("a\n\nb", "a\nb"), ("𝐛", "b"), ("ı", "i"), ("α", "a")])
def test_different_look(model, a, b):
    assert la.canonical(a, model) != la.canonical(b, model)


def test_script_is_found(model):
    assert la.canonical("thе hоuѕе", model) == "the house"
    assert la.canonical("Дoм, pека и шкoла", model) == "Дом, река и школа"
    assert la.canonical(None, model) is None and la.canonical("", model) == ""
    assert la.canonical("l" * 100_000, model) == "l" * 100_000


def test_form_depends_on_looks_only(model):
    for word in ("сара", "оса", "кот", "СОРТ", "хор"):
        mixed = "".join(la.TO_CLASS.get(c, c) if i % 2 else c for i, c in enumerate(word))
        assert len({la.canonical(f"the {w} house", model) for w in (word, mixed, la.visible(word))}) == 1


def test_pairs_and_classes(spark):
    rows = [(1, "the house", "x"), (2, "thе house", "x"), (3, "the house", "x"), (4, "The house", "x"), (5, None, "x"), (6, "", "x"), (7, "​", "x"), (2, "thе house", "x"), (None, "the house", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, form string")
    assert sorted(tuple(r) for r in la.same_look_pairs(df, "id", "text").collect()) == [(1, 2), (2, 3), (6, 7)]
    got = {r.id: (r.class_id, r.n_stored) for r in la.same_look_classes(df, "id", "text").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 1), 6: (6, 2), 7: (6, 2)}
    assert la.same_look_pairs(df.limit(0), "id", "text").count() == 0
    assert {r.id: r.canonical for r in la.canonicalise(df.filter("id < 3"), "id", "text", la.train(df, "text")).collect()} == {1: "the house", 2: "the house"}


def test_nfc_stays(model):
    assert unicodedata.is_normalized("NFC", la.canonical("café прий", model))


def test_words_are_compared_by_their_own_characters():
    assert not any(c < 128 for c in la._CASE_CLASSES if chr(c).islower())
    assert la.compared("ΗΛΙΟΣ") == la.compared("ηλιοσ") and la.compared("НОС hat") == la.compared("нос HAT") and la.compared("Ilk") != la.compared("llk")


def test_other_scripts_keep_their_letters(spark):
    words = "հատու տունը որպես ուսում օդը".split()
    model = la.train(spark.createDataFrame([(" ".join(words * 5),)], "text string"), "text")
    for w in words:
        assert la.canonical(w, model) == w
