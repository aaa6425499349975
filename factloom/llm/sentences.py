"""Sentence boundaries across languages and scripts by semi-Markov dynamic programming.

A text is cut at blank lines. In each block, the places after closing marks (and, between Thai letters, spaces) are
candidates. The best sequence of whole spans between candidates is searched; a span's score is the sum of

* how its last words and marks close a sentence (abbreviations, initials, ordinals, ellipses, decimals are weighed)
  before the words that open the next one (case, script, marks of opening),
* its length,
* whether quotations and parentheses are balanced in it: each end that lies inside one costs ``UNBALANCED``, and
* whether quoted speech keeps its reporting clause, however long that is.

The search is exact and linear in the number of candidates: length counts in four bands, so the best span before a place
is the best of the few nearest ones, of a moving window, and of all earlier ones. Nothing else looks further than the
next or last mark of its kind, whose places are found once.

Offsets are code points of the text as stored. White space never belongs to a sentence's ends; all other characters
belong to exactly one sentence. Defined results: null, empty and blank texts, and blocks in which nothing can be seen, have no sentences; text
without any closing mark is one sentence per block; characters that can't be seen stay with the sentence before them.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.lookalike import TO_CLASS, UNSEEN

NEVER, BLOCK = -6.0, -9.0
UNBALANCED = -6.5
TOKEN = 64  # characters at the end of a token: longer than any that is listed

# Abbreviations, in lower case without the last period.
TITLES = "dr dra drs prof mr mrs ms mme mmes mlle m mm st ste rev gen capt col lt sgt maj cmdr adm hon gov sen rep pres fr sr sra srta d da ud uds hr fr. dipl ing"
INNER = "e.g i.e cf vs viz approx al ca bzw z.b d.h u.a p.ex env aprox pág págs pag núm num art fig figs cap vol vols bd nr no nos pp p t s sec ch ed eds trad geb gest est zzt vgl sog ggf inkl exkl bspw ул пл пр пер им см ср напр проф акад тов гл рис табл стр руб тыс млн млрд др т.е т.к т.н डॉ श्री प्रो कु د أ म पं"
ENDING = "etc usw a.m p.m am pm corp ltd inc co bros jr jh u.s.w и.т.д т.д т.п г гг в вв н.э a.c d.c d.c ee.uu uu"
WITH_NUMBER = "no nos pp p vol vols est fig nr ch sec art t s d núm num pág págs bd cap с д гл т ст"
GERMAN_ORDINALS = "januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jahrtausend jahrestag mal klasse auflage etage stock bezirk januars"
REPORTING = "said told remarked explained insisted cried exclaimed observed noted murmured admitted said asked answered replied wrote whispered shouted added sagte fragte antwortete schrieb rief dit demanda répondit écrivit dijo preguntó contestó respondió escribió сказал сказала спросил спросила ответил ответила написал написала"
REPORTS_BEFORE = {  # marks that may end a reporting clause, marks that begin a quotation, and what stands before the end
    "cjk": ("。！？", "“「", re.compile(r"(?:说|道|问|答|喊|写)道?$")),
    "korean": (".!?", '"“', re.compile(r"(?:말했다|물었다|대답했다|외쳤다|썼다|덧붙였다)$")),
    "hindi": ("।!?", '"“', re.compile(r"(?:कहा|पूछा|बोला|बोली|लिखा|दिया)\s?$")),
}
REPORTS_AT_ONCE = re.compile(r"と|って|라고|이라고|하고|고 ")
REPORTS_ARABIC = re.compile(r"(?:قال|قالت|سأل|سألت|أجاب|أجابت|كتب|كتبت)\s")
REPORTS_THAI = re.compile(r"[^\s“\"]*(?:\s[^\s“\"]+){0,3}?(?<=กล่าว|..พูด|..ถาม|..ตอบ)(?:\s|$)")

_FLAT = str.maketrans(TO_CLASS)


def _words(listed: str) -> frozenset[str]:
    """The words, and the same without accents: combining ones are not seen in a shadow."""
    flat = [w.translate(_FLAT) for w in listed.split()]
    bare = ["".join(c for c in unicodedata.normalize("NFD", w) if not 0x300 <= ord(c) <= 0x36F) for w in flat]
    return frozenset(flat + bare)


TITLES, INNER, ENDING, WITH_NUMBER, GERMAN_ORDINALS, REPORTING = map(_words, (TITLES, INNER, ENDING, WITH_NUMBER, GERMAN_ORDINALS, REPORTING))

END = ".!?;。！？；।॥؟…｡"
STRONG = frozenset("!?。！？।॥؟｡‼⁇⁈⁉")
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“”", "(": ")", "（": "）", "[": "]", "‘": "’", "‹": "›"}
OPENERS: dict[str, str] = {}
for _o, _closing in PAIRS.items():
    for _c in _closing:
        OPENERS[_c] = OPENERS.get(_c, "") + _o
CLOSERS = frozenset("”»」』)）]’\"'›“")
OPENING = "“«「『„(（[‘\"'¿¡‹—–-•*"
CLUSTER = re.compile(rf"[{re.escape(END)}]+")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
LAST_TOKEN = re.compile(r"[\w.'’ऀ-ॿ]+\Z")
NEXT_WORD = re.compile(r"[\w'’]+")
ACRONYM = re.compile(r"^[^\W\d_](?:\.[^\W\d_])+$")
THAI = re.compile(r"[ก-๛]")
THAI_SPACE = re.compile(r"(?<=[^\s])\s+(?=[^\s])")
REPORT_BY_NAME = re.compile(r"(?:[A-ZÀ-Þ][\w'’.-]*\s+){1,4}(" + "|".join(sorted(w for w in REPORTING if w.isascii())) + r")\b")
_SPACES = re.compile(r"\s*")


class _Shadow(dict):
    """What a character counts as: none for what can't be seen, one plain character for wide, odd or look-alike ones."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        out: str | None = ch
        if any(a <= code <= b for a, b in UNSEEN) or 0x300 <= code <= 0x36F:
            out = None
        elif ch in "  \x85":
            out = "\n"
        elif ch == "　" or ch == "\t" or ch == "\r" or unicodedata.category(ch) == "Zs":
            out = " "
        elif ch in TO_CLASS:
            out = TO_CLASS[ch]
        else:
            mapping = unicodedata.decomposition(ch)
            if mapping.startswith(("<wide>", "<narrow>")) and not 0xFFA0 <= code <= 0xFFDC and ch not in "！？；（）":
                plain = unicodedata.normalize("NFKC", ch)
                out = plain if len(plain) == 1 else ch
        self[code] = out
        return out


SHADOW = _Shadow()


def shadow_of(text: str) -> tuple[str, list[int] | None]:
    """The plain text and, if places differ, the place of each of its characters in the stored text."""
    flat = text.translate(SHADOW)
    if len(flat) == len(text):
        return flat, None
    keep = [i for i, ch in enumerate(text) if SHADOW[ord(ch)] is not None]
    return flat, keep


def quotes(block: str) -> list[tuple[int, int, str]]:
    """Outermost pairs of quotation marks or parentheses: places of the opening and the closing one, and the opener."""
    found: list[tuple[int, int, str]] = []
    stack: list[tuple[int, str]] = []
    open_marks: Counter = Counter()
    n = len(block)

    def cut(k: int) -> None:
        for _, o in stack[k:]:
            open_marks[o] -= 1
        del stack[k:]

    for m in re.finditer(r"[“”«»「」『』„()（）\[\]‘’\"'‹›]", block):
        i, ch = m.start(), m.group()
        before = block[i - 1] if i else " "
        after = block[i + 1] if i + 1 < n else " "
        if ch in "\"'":
            if ch == "'" and before.isalnum() and (after.isalnum() or not open_marks["'"]):
                continue
            held = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == ch) if open_marks[ch] else None
            if held is not None and not (before.isspace() and not after.isspace()):
                if ch == "'" and before.isalnum():
                    continue
                found.append((stack[held][0], i, ch))
                cut(held)
            elif ch == '"' or (after.isalnum() and not before.isalnum()):
                if held is not None:
                    stack = [x for x in stack if x[1] != ch]
                stack.append((i, ch))
                open_marks[ch] = 1
            continue
        if ch == "’" and (after.isalpha() or not open_marks["‘"]):
            continue
        held = None
        if any(open_marks[o] for o in OPENERS.get(ch, ())):
            held = next(k for k in range(len(stack) - 1, -1, -1) if ch in PAIRS.get(stack[k][1], ""))
        if held is not None:
            found.append((stack[held][0], i, stack[held][1]))
            cut(held)
        elif ch in PAIRS:
            stack.append((i, ch))
            open_marks[ch] += 1
    found.sort()
    outer: list[tuple[int, int, str]] = []
    for q in found:
        if not outer or q[0] > outer[-1][1]:
            outer.append(q)
    return outer


class Marks:
    """The places of some characters (or matches) of a block, found once."""

    def __init__(self, block: str) -> None:
        self.block = block
        self.places: dict[str, list[int]] = {}

    def next(self, pattern: str, at: int) -> int:
        """The first place of ``pattern`` from ``at`` on; the block's length if there is none."""
        if (places := self.places.get(pattern)) is None:
            places = self.places[pattern] = [m.start() for m in re.finditer(pattern, self.block)]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else len(self.block)


_OPENING = re.compile(rf"[{re.escape(OPENING)}]*\s*")


def _opens(block: str, at: int) -> tuple[str, str]:
    """Kind of the first letter or digit from ``at`` on ('upper', 'lower', 'digit', 'caseless', ''), and the word."""
    at = _SPACES.match(block, at).end()
    if block[at : at + 1] == "[":
        return "mark", "["  # an editor's remark stands apart
    at = _OPENING.match(block, at).end()
    if at >= len(block):
        return "", ""
    ch = block[at]
    m = NEXT_WORD.match(block, at)
    word = m.group() if m else ch
    if ch.isdigit():
        return "digit", word
    if ch.isupper():
        return "upper", word
    if ch.islower():
        return "lower", word
    return ("caseless" if ch.isalpha() else "mark"), word


def closing(block: str, start: int, stop: int, marks: str) -> float:
    """How well what stands before ``start``, and ``marks`` there, close a sentence that what stands from ``stop`` on
    follows. A run of parts of one or two letters of over 64 characters counts by its last 64."""
    kind, word = _opens(block, stop)
    spaced = block[stop].isspace()
    if any(ch in STRONG for ch in marks):
        return -2.0 if kind == "lower" else 4.0
    if ";" in marks or "；" in marks:
        return 4.0
    if "…" in marks or ".." in marks:
        if kind in ("lower", "caseless", "mark"):
            return NEVER
        return 1.5 if spaced else -1.0
    m = LAST_TOKEN.search(block, max(0, start - TOKEN), start)
    token = m.group().strip(".'’") if m else ""
    if "." in token and any(len(part) > 2 for part in token.split(".")[:-1]):
        token = token.rsplit(".", 1)[1]  # white space is missing before it
    low = token.lower()
    if kind == "lower":
        return NEVER
    if not token:
        return 1.0
    last = low.rsplit(".", 1)[-1]
    if not spaced and kind != "caseless" and (kind == "digit" or len(last) == 1 or token[-1].isdigit()):
        return NEVER
    end = m.start() if m else 0
    while end and block[end - 1].isspace():
        end -= 1
    earlier = LAST_TOKEN.search(block, max(0, end - TOKEN), end)
    earlier_low = earlier.group().lower().strip("'’") if earlier else ""
    whole = (earlier_low.rstrip(".") + "." + low) if earlier_low.endswith(".") and len(low) <= 2 else low
    if whole in INNER:
        return NEVER
    if low in ENDING or whole in ENDING:
        if kind == "digit" and low in WITH_NUMBER:
            return NEVER
        return 1.5
    if low in WITH_NUMBER:
        if kind == "digit" or len(low) == 1:
            return NEVER
        return 1.5 if low == "no" and kind in ("upper", "mark") else NEVER
    if low in INNER or (low in TITLES and (token[0].isupper() or len(token) > 1)):
        return NEVER
    if ACRONYM.match(token):
        return 1.5 if kind != "caseless" or spaced else NEVER
    if len(token) == 1 and token.isalpha() and not _no_space_script(token):
        unit = token.islower() and earlier_low[-1:].isdigit()
        return 4.0 if unit and spaced and kind in ("upper", "digit", "caseless", "mark") else NEVER
    if token.isdigit() and len(token) <= 2 and word.lower() in GERMAN_ORDINALS:
        return NEVER
    if THAI.match(token[-1]):
        return NEVER
    if not spaced:
        return 2.0 if kind in ("upper", "caseless", "mark") and len(last) > 1 else NEVER
    return 4.0 if kind in ("upper", "digit", "caseless", "mark") else 2.0


def _no_space_script(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "가" <= ch <= "힣"


USUAL = (10, 600)


def length_score(n: int) -> float:
    """Sentences of one or two characters, and very long ones, are less likely; always between -1.5 and 0."""
    return -1.5 if n < 4 else -0.5 if n < USUAL[0] or n > USUAL[1] else 0.0


def candidates(block: str) -> list[tuple[int, float, bool]]:
    """Places where a sentence may end, with the score of a cut there, and whether the place is inside a quotation."""
    pairs = quotes(block)
    closes = {q[1]: q for q in pairs}
    thai = THAI.search(block) is not None
    marked = Marks(block)
    places: dict[int, tuple[float, bool]] = {}
    k = 0
    n = len(block)
    seen = len(block.rstrip())
    for m in CLUSTER.finditer(block):
        start, end = m.span()
        if end in places:
            continue
        while k < len(pairs) and pairs[k][1] < start:
            k += 1
        inside = pairs[k] if k < len(pairs) and pairs[k][0] < start < pairs[k][1] else None
        stop, closed = end, None
        while stop < n:
            gap = stop + (block[stop] in " \n" and stop + 1 < n and block[stop + 1] in "»›")
            if gap in closes:
                closed, stop = closes[gap], gap + 1
                inside = None if inside and inside[1] < stop else inside
            elif closed and block[stop] in END:
                stop += 1
            else:
                break
        if stop >= seen:
            continue
        marks = m.group()
        if marks == "." and start and block[start - 1].isdigit() and block[stop].isdigit():
            continue
        score = closing(block, start, stop, marks)
        if inside is None and closed is not None:
            score = _after_quote(block, closed, score, stop, marked)
        before = places.get(stop)
        if before is None or (inside is None, score) > (not before[1], before[0]):
            places[stop] = (score, inside is not None)
    if thai:
        at = 0
        for m in THAI_SPACE.finditer(block):
            a, b = block[m.start() - 1], block[m.end()]
            while at < len(pairs) and pairs[at][1] < m.start():
                at += 1
            if at < len(pairs) and pairs[at][0] < m.start() < pairs[at][1]:
                continue
            if not (THAI.match(a) or THAI.match(b)) or a.isdigit() or b.isdigit() or "ๆ" in (a, b):
                continue
            if a in "“«„(" or b in "”»),.;:!?“«\"" or a in ":,":
                continue
            if m.start() not in places:
                places[m.start()] = (4.0, False)
    return sorted((p, score, within) for p, (score, within) in places.items())


def _after_quote(block: str, pair: tuple[int, int, str], score: float, stop: int, marked: Marks) -> float:
    """The score of a cut right after a quotation or parenthesis that closes with an end mark inside it."""
    at = _SPACES.match(block, stop).end()
    first = unicodedata.normalize("NFC", block[at : at + 1])
    end = pair[0]
    while end and block[end - 1].isspace():
        end -= 1
    last = block[end - 1 : end]
    kind, word = _opens(block, stop)
    if pair[2] in "(（[":
        own = not last or last in END or last in CLOSERS
        return 4.0 if own and kind != "lower" else BLOCK
    if first in ",，、—–:;" or kind == "lower" or word.lower() in REPORTING:
        return BLOCK
    introduced = bool(last) and last in ":,：，、"
    if not introduced and _reports(block, at, marked):
        end = marked.next("[.!?。！？।؟]", at)
        if marked.next("[:：]\\s*[“\"«「]", at) >= end:  # else what follows reports the next quotation
            return BLOCK
    return 4.0 if score > NEVER else max(score, 1.5)


def _reports(block: str, at: int, marked: Marks) -> bool:
    """Whether the clause from ``at`` on reports the quotation before it."""
    joined = lambda a, b: unicodedata.normalize("NFC", block[a:b])  # noqa: E731  # letters may be stored decomposed
    begins_with = joined(at, at + 24)
    if REPORTS_AT_ONCE.match(begins_with) or REPORTS_THAI.match(block, at):
        return True
    for ends, begins, verb in REPORTS_BEFORE.values():
        stop = marked.next(f"[{ends}{begins}]", at)
        if stop < len(block) and block[stop] in ends and verb.search(joined(max(at, stop - 24), stop)):
            return True
    if REPORTS_ARABIC.match(begins_with):
        stop = marked.next("[:.!؟]", marked.next("\\s", at))
        if stop < len(block) and block[stop] != ":":
            return True
    m = REPORT_BY_NAME.match(block, at)
    return m is not None and marked.next(":\\s*[“\"'‘«]", m.end()) >= marked.next("[.!?]", m.end())


def best_cuts(block: str) -> list[int]:
    """The places of the best sequence of spans, the block's end included."""
    found = candidates(block)
    at = [0, *(p for p, _, _ in found), len(block)]
    cut = [0.0, *(s for _, s, _ in found), 0.0]
    within = [0.0, *(UNBALANCED if x else 0.0 for _, _, x in found), 0.0]
    total, back = [0.0], [0]
    window: deque[int] = deque()  # starts of spans of usual length, best first
    entered = far = 0  # how many starts have come into the window; the best start of very long spans, after them
    best_far = -1
    for j in range(1, len(at)):
        best, frm = -math.inf, 0
        i = j - 1
        while i >= 0 and at[j] - at[i] < USUAL[0]:
            value = total[i] + within[i] + length_score(at[j] - at[i])
            if value > best:
                best, frm = value, i
            i -= 1
        while entered <= i:
            while window and total[window[-1]] + within[window[-1]] <= total[entered] + within[entered]:
                window.pop()
            window.append(entered)
            entered += 1
        while window and at[j] - at[window[0]] > USUAL[1]:
            window.popleft()
        while far <= i and at[j] - at[far] > USUAL[1]:
            if best_far < 0 or total[far] + within[far] >= total[best_far] + within[best_far]:
                best_far = far
            far += 1
        for k in (window[0] if window else -1, best_far):
            if k >= 0:
                value = total[k] + within[k] + length_score(at[j] - at[k])
                if value > best:
                    best, frm = value, k
        total.append(best + cut[j] + within[j])
        back.append(frm)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def segment(text: str | None) -> list[tuple[int, int]]:
    """The sentences of a text: places of the first character and after the last one."""
    if not text or text.isspace():
        return []
    flat, keep = shadow_of(text)
    place = (lambda k: k) if keep is None else (lambda k: keep[k] if k < len(keep) else len(text))
    out: list[tuple[int, int]] = []
    at, begin = 0, 0
    for m in [*BLANK.finditer(flat), None]:
        block = flat[at : m.start()] if m else flat[at:]
        if block.strip():
            cuts = best_cuts(block)
            for k, c in enumerate(cuts):
                stop = place(at + c) if k + 1 < len(cuts) or m else len(text)
                a, b = begin, stop
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((a, b))
                begin = stop
        if m:
            at = m.end()
            begin = place(at - 1) + 1
    return out


def split(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col``, ``start_char``, ``end_char``: one row for each sentence of each text. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in segment(t):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "start_char", "end_char"])

    return df.select(id_col, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, start_char int, end_char int")
