import random

import pytest

from factloom.llm.sentences import UNBALANCED, best_cuts, candidates, length_score, segment, split


def cut(text):
    return [text[a:b] for a, b in segment(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["S. B. Ward sold the line with Dr. Putrir, approx. 79 years before it closed.", "It was sold for 82.30 million crowns, i.e. twice the price."],
        ["The choir belongs to the K.L.K.", "Version 45.1 of the plan, e.g. the draft, names Ann."], ["Trains leave at 2 a.m. and at 3 p.m.", "He left."], ["Two rooms measure 45.5 m by 2.32 m.", "Ann came."],
        ["She lives there with three cats etc.", "Version two."], ["Ann sold maps, chairs etc. to the weaver."], ["Who came?!", "Historians disagree."], ["The council waited... and left."], ["(The mill closed in 1879.)", "Rev. Ann spoke."],
        ['"The roof leaks. Nothing was paid," said Runa.', "What a day!"], ["“Winter came early?” asked the man.", "He left."], ['Runa wrote: "It leaks. It stays."', "He left."], ['"We will return!" Ann Lee told the weaver.', "He left."],
        ["The man answered, ‘Nobody works there. He’s gone.’", "Ilse left."], ["Ann kept the mill;", "Tom left;", "nobody thanked them."], ["The tower (cf. K. Gur, 1890, p. 88) was sold."], ["The firm traded as Sab Corp. until 1753."],
        ["Ann wurde am 25. Januar 1831 geboren.", "Das Haus Nr. 73 steht im 3. Jahrhundert.", "Er arbeitete z. B. als Lehrer.", "Tilda kaufte Karten usw.", "Die Mühle liegt ca. 87,1 km südlich."], ["„Niemand hört zu. Der Turm fällt,“ sagte Ulf.", "Er schrieb: „Der Turm fällt!“", "Gut."],
        ["M. Gof a vendu la scierie.", "Qui a bâti la scierie ?", "« Personne n’a répondu. Nous étions là », dit Runa.", "La forêt (cf. t. 7, p. 31) fut détruite."], ["El Sr. Vaf vendió mapas, etc. al Dr. Pin.", "¿Quién vino?", "La pág. 24 menciona la casa."],
        ["В 1869 г. школа сгорела.", "А. Б. Фар описал её.", "Он купил хлеб, соль и т. д.", "Дом стоит на ул. Речной, д. 94.", "«Никто не пришёл. Дом пустой», — сказал Рап."], ["Он родился в 1853 г. в деревне."],
        ["塔高72.8米。", "“水很冷。春天来了。”莫德哈说。", "旧磨坊在大火中烧毁……后来重建。", "多么美丽的剧院！"], ["「水が冷たい。春が来た。」とリンは言った。", "なんと美しい橋だろう！"], ['"아무도 없다. 물이 차갑다." 나신이 말했다.', "탑의 높이는 79.5미터이다."],
        ["डॉ. सागे ने पुल देखा।", "“पानी ठंडा है। चलो लौटें।” नमोर ने कहा।", "यह किसने बनाया?"], ["قال سور: «لنرجع الآن. جاء الربيع.»", "وصف د. بانيب تلك الطاحونة.", "من بنى هذه؟"], ["ผู้คนมาบ่อย ๆ ในฤดูหนาว", "กอลอเกิดในปี 1944 ที่หมู่บ้าน", "ใครสร้างห้องสมุดนี้"],
    ],
)
def test_languages(parts):
    glue = "" if parts[0][0] in "塔「" else " "
    assert cut(glue.join(parts)) == parts


def test_layout():
    assert cut("History\n\nIt was\nold. It fell.\n \n\nLater years\n\nEnd") == ["History", "It was\nold.", "It fell.", "Later years", "End"]
    assert cut("It was old.Ann left. Goflon.Prof. A. Dem came.") == ["It was old.", "Ann left.", "Goflon.", "Prof. A. Dem came."]
    text = "  Th​e e﻿nd. ​ Dr­. Ánn came. Ok?"
    assert cut(text) == ["Th​e e﻿nd.", "​ Dr­. Ánn came.", "Ok?"]


def test_blocks_in_which_nothing_is_seen():
    assert cut("\u200b") == [] and cut("One.\n\n\u200b\n\nTwo.") == ["One.", "Two."]


def test_all_text_is_held():
    for text in ("a.b.c", "...", "?!", "x" * 50_000 + ". Y", "“open. quote", 'one " two. Three', "a\n\n\nb"):
        spans = segment(text)
        assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
        assert all(text[a:b].strip() == text[a:b] and a < b for a, b in spans)


def full_search(block):
    found = [*candidates(block), (len(block), 0.0, False)]
    at = [0, *(p for p, _, _ in found)]
    within = [0.0, *(UNBALANCED * x for _, _, x in found)]
    best = [(0.0, [])]
    for j in range(1, len(at)):
        span = lambda i: length_score(at[j] - at[i]) + within[i] + within[j]
        v, cuts = max(((best[i][0] + span(i), i, best[i][1]) for i in range(j)), key=lambda x: x[0])[::2]
        best.append((v + found[j - 1][1], [*cuts, at[j]]))
    return best[-1]


def value(block, cuts):
    found = {p: (s, UNBALANCED * x) for p, s, x in [*candidates(block), (len(block), 0.0, False), (0, 0.0, False)]}
    return sum(length_score(b - a) + found[a][1] + found[b][1] + found[b][0] for a, b in zip([0, *cuts], cuts))


def test_linear_search_is_the_full_one():
    rng = random.Random(4)
    parts = ["One. ", "He left; ", "A. ", "B.", "why? ", "No... ", "Dr. Who. ", '"It is. Yes." ', "said Ann. ", "x" * 300 + ". ", "x" * 700 + "... ", "(Oh. No.) ", "e.g. so. ", "Is it? ", "3.5. "]
    for _ in range(300):
        block = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))).strip()
        cuts = best_cuts(block)
        assert cuts[-1] == len(block) and abs(value(block, cuts) - full_search(block)[0]) < 1e-9


def test_long_blocks_are_linear():
    for piece in ("The house was old. He went home. ", "A. B. C. ", "a.b.c.", "“Hm.” x ", '(:( " '):
        assert segment(piece * (300_000 // len(piece)))
    assert len(segment('"' + "He went home. " * 20_000 + '" he said. Then he left.')) == 2
    assert len(segment("“你好。”" + "他" * 500 + "说。再见。")) == 2


def test_operator(spark):
    df = spark.createDataFrame([(1, "One. Two.", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (1, "One. Two.", 0)], "id bigint, text string, start_char int")
    assert sorted(tuple(r) for r in split(df, "id", "text").distinct().collect()) == [(1, 0, 4), (1, 5, 9)]
