"""Visually identical text with different characters, brought to one form.

1. Compatibility normalization, limited to what a reader can't see (width, ligatures, kinds of space and hyphen,
   composed and decomposed letters), and deletion of ignorable characters.
2. Every letter with look-alikes in other scripts is replaced by one representative of its class. What shows the same
   text is the same string from here on, whatever letters it was stored with.
3. Each word is a lattice of the letters that look like its representatives. Viterbi picks the best path: a word by
   letter bigrams of each script, learned from all words of the corpus that only one script can write, with a price for
   changing the script inside a word; and over the words of a text, with a smaller price for changing it between words.

Step 3 only depends on the outcome of step 2, so texts that look the same get the same form, and texts that differ to a
reader keep different forms.

Defined results: null text gives null; empty text stays empty; ends of lines are written "\\n"; spaces before an end of
line and around the text can't be seen and are deleted; case, accents, quotation marks and line breaks are kept.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.runtime import cut, join_groups

# Letters that look like Latin ones, by script. Letters that differ visibly in text fonts (as Greek small
# alpha, rho, nu or upsilon, or a dotless i) are left out: a difference that can be seen makes two texts different.
LATIN = {"ɡ": "g"}
CYRILLIC = {"а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ә": "ə", "ӕ": "æ", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ӏ": "I", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V", "Ә": "Ə", "Ӕ": "Æ"}
GREEK = {"ο": "o", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J"}
ARMENIAN = {"օ": "o", "հ": "h", "ո": "n", "ս": "u", "Օ": "O", "Տ": "S", "Ս": "U"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B"}
LISU = {"ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U"}
HYPHENS = "\u2010\u2011"
UNSEEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE01EF)]
LINE_ENDS = "\u2028\u2029\x85\x0b\x0c"
SAME_LOOK = ("<wide>", "<narrow>", "<small>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

SCRIPTS = ("latin", "cyrillic", "greek", "armenian", "cherokee", "lisu")
ALIKE = (LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU)
COUNT = len(SCRIPTS)
TO_CLASS = {letter: plain for script in ALIKE for letter, plain in script.items()}
# how a class is written in each script; of several letters of one class the first listed one
BACK = ({}, *({plain: letter for letter, plain in reversed(script.items())} for script in ALIKE[1:]))
WORD = re.compile(r"[^\W\d_]+")
INSIDE, BETWEEN = 9.0, 4.0  # prices of changing the script, in nats


class _Fold(dict):
    """Step 1 for one character, made when first seen."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if any(a <= code <= b for a, b in UNSEEN):
            out = ""
        elif ch in HYPHENS:
            out = "-"
        elif ch in LINE_ENDS:
            out = "\n"
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            out = " "
        else:
            mapping = unicodedata.decomposition(ch)
            kind = mapping.split(" ", 1)[0] if mapping.startswith("<") else ""
            joined = kind == "<compat>" and unicodedata.category(ch) in ("Ll", "Lu", "Lt", "Lo", "Lm", "Nl")  # ligatures, Roman numerals
            upright = kind == "<font>" and re.fullmatch(r"MATHEMATICAL (?:SANS-SERIF|MONOSPACE) (?:CAPITAL|SMALL|DIGIT) \w+", unicodedata.name(ch, ""))
            out = unicodedata.normalize("NFKC", ch) if kind in SAME_LOOK or joined or upright else ch
        self[code] = out
        return out


FOLD = _Fold()


@functools.cache
def folded() -> re.Pattern:
    """All characters that step 1 changes, found by trying them, as one class."""
    places = [c for c in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)) if FOLD[c] != chr(c)]
    runs: list[list[int]] = []
    for c in [9, *places]:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs) + "]")


OTHER_SCRIPTS = re.compile("[\u0261\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\ua4d0-\ua4ff]")  # where letters of TO_CLASS stand
_JOINERS = re.compile("(?:(?<=[\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d])|(?<=[\u0620-\u06ff]))[\u200c\u200d]")
_FARSI = re.compile("[یک]")
_EDGES = re.compile(r"[ ]+(?=\n)|[ ]+\Z|\A\s+|\s+\Z")
_CLASSES = str.maketrans(TO_CLASS)


def _farsi(text: str) -> str:
    """Farsi yeh and keheh look like the Arabic letters where they join the next letter; a final yeh has no dots."""

    def letter(m: re.Match) -> str:
        after = text[m.end() : m.end() + 1]
        joins = "ؠ" <= after <= "ي" or "ٱ" <= after <= "ۓ"
        if m.group() == "ی":
            return "ي" if joins else "ى"
        return "ك" if joins else m.group()

    return _FARSI.sub(letter, text)


def visible(text: str) -> str:
    """Steps 1 and 2: one string for all texts that look the same."""
    if not text.isascii():
        if "\u200c" in text or "\u200d" in text:  # a joiner after a virama or an Arabic letter changes what is seen
            text = _JOINERS.sub(lambda m: "\ue000" if m.group() == "\u200c" else "\ue001", text)
        if folded().search(text):
            text = text.translate(FOLD).replace("\ue000", "\u200c").replace("\ue001", "\u200d")
        if _FARSI.search(text):
            text = _farsi(text)
        if OTHER_SCRIPTS.search(text):
            text = unicodedata.normalize("NFD", text).translate(_CLASSES)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    else:
        text = text.translate({9: " "}) if "\t" in text else text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _EDGES.sub("", text)


def _case_classes() -> dict[int, str]:
    """One small letter for all letters that look alike in either case: H, Greek Eta and Cyrillic En look alike, so h, eta
    and en count as the same where case and look don't count. Made from TO_CLASS by joining what it and case link."""
    parent: dict[str, str] = {}

    def top(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for letter, plain in TO_CLASS.items():
        for a, b in ((letter, letter.lower()), (letter, plain), (plain, plain.lower())):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    parent[top("ς")] = top("σ")
    lowest: dict[str, str] = {}
    for c in sorted(parent):
        if c == c.lower():
            lowest.setdefault(top(c), c)
    return {ord(c): lowest[top(c)] for c in parent if lowest[top(c)] != c}


_CASE_CLASSES = _case_classes()


def compared(text: str) -> str:
    """The form in which words are compared regardless of case and of what only looks alike; it depends on nothing but
    the characters themselves, so equal passages are equal whatever stands around them."""
    low = visible(text).lower()
    return low if low.isascii() else low.translate(_CASE_CLASSES)


def _base(ch: str) -> str:
    """The class of a letter, without its accents."""
    return ch if ch.isascii() else unicodedata.normalize("NFD", ch)[0]


_script_cache: dict[str, int] = {}


def scripts_of(ch: str) -> int:
    """The scripts, as bits, that can write this class; 0 for letters of other scripts."""
    if (known := _script_cache.get(ch)) is None:
        base = _base(ch)
        own = unicodedata.name(base, "").split(" ")[0].lower()
        known = 1 << SCRIPTS.index(own) if own in SCRIPTS else 0
        if known == 1:
            known += sum(1 << s for s in range(1, COUNT) if base in BACK[s])
        _script_cache[ch] = known
    return known


class Model:
    """Letter bigrams of each script, by class; the number of bigrams is bounded by the letters of the scripts."""

    def __init__(self, counts: dict[tuple[int, str], int]) -> None:
        self.logp: list[dict[str, float]] = [{} for _ in SCRIPTS]
        most = 0
        for s in range(COUNT):
            own = {pair: n for (script, pair), n in counts.items() if script == s}
            first = Counter()
            for pair, n in own.items():
                first[pair[0]] += n
            for pair, n in own.items():
                self.logp[s][pair] = math.log(n / (first[pair[0]] + 100.0))
            most = max(most, max(first.values(), default=0))
        self.floor = math.log(0.5 / (100.0 + most))  # the same for all scripts: one that is rarely seen is no likelier
        self.words: dict[str, tuple | str] = {}
        self.changed: set[str] = set()
        self.gains = [_Gains(self, s) for s in range(COUNT)]
        self.written = [_Written(self, s) for s in range(COUNT)]

    def one_script(self, words: list[str]) -> int | None:
        """The script in which the best path writes all words, where that is seen without a search: a stretch of words in
        other scripts costs BETWEEN at least, so none is on the best path if no stretch gains as much by its words."""
        for s, gains in enumerate(self.gains):
            if len(gains) > 500_000:
                gains.clear()
            gain = np.fromiter(map(gains.__getitem__, words), float, len(words))
            if gain.max(initial=0.0) >= BETWEEN:
                continue
            sums = np.cumsum(gain)
            if (sums - np.minimum.accumulate(np.minimum(sums - gain, 0.0))).max(initial=0.0) < BETWEEN:
                return s
        return None

    def step(self, script: int, before: str, now: str) -> float:
        return self.logp[script].get(before + now, self.floor)

    def word(self, word: str) -> tuple | str:
        """The scripts that can write the word, each with its score, or, as a string, the form of a word that no single script
        can write."""
        if (known := self.words.get(word)) is None:
            bits = possible(word)
            if not bits:  # a word with letters of other scripts stays as it is
                known = self.mixed(word) if all(map(scripts_of, word)) else word
            else:
                known = tuple((s, sum((self.step(s, a, b) for a, b in zip("^" + word, word + "$")), 0.0)) for s in range(COUNT) if bits >> s & 1)
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[word] = known
        return known

    def mixed(self, word: str) -> str:
        """Viterbi over the letters of a word that no single script can write."""
        best = {s: (0.0, "") for s in range(COUNT)}
        before = "^"
        for ch in word:
            now = {}
            for s in range(COUNT):
                if scripts_of(ch) >> s & 1:
                    score, path = max((v - (INSIDE if t != s and path else 0.0), path) for t, (v, path) in best.items())
                    now[s] = (score + self.step(s, before, ch), path + write(ch, s))
            best, before = now, ch
        return max(best.values())[1]


class _Gains(dict):
    """For a word, what the best other script scores above this one: very much where this one can't write it, very little
    where no other can, 0 for a word that is the same in all paths."""

    def __init__(self, model: Model, script: int) -> None:
        self.model, self.script = model, script

    def __missing__(self, word: str) -> float:
        score = self.model.word(word)
        if isinstance(score, str):
            out = 0.0
            if score != word:
                self.model.changed.add(word)
        else:
            own = dict(score).get(self.script)
            out = 1e6 if own is None else max((x for s, x in score if s != self.script), default=own - 1e4) - own
        self[word] = out
        return out


class _Written(dict):
    """A word as written in this script."""

    def __init__(self, model: Model, script: int) -> None:
        self.model, self.script = model, script

    def __missing__(self, word: str) -> str:
        score = self.model.word(word)
        self[word] = out = score if isinstance(score, str) else write(word, self.script)
        return out


def write(text: str, script: int) -> str:
    """Classes written in a script."""
    if script == 0:
        return text
    table = BACK[script]
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", text)))


def canonical(text: str | None, model: Model) -> str | None:
    """The one form of all texts that look like this one."""
    if text is None:
        return None
    text = visible(text)
    found = WORD.findall(text)
    s = model.one_script(found)
    if s == 0 and model.changed.isdisjoint(found):
        return text
    if s is not None:
        written = model.written[s]
        if len(written) > 500_000:
            written.clear()
        return WORD.sub(lambda m: written[m.group()], text)
    words = [(m.start(), m.end(), model.word(m.group())) for m in WORD.finditer(text)]
    lattice = [w[2] for w in words if not isinstance(w[2], str)]
    live = sorted({s for score in lattice for s, _ in score})  # no path leads through a script that can write no word
    place = {s: k for k, s in enumerate(live)}
    back: list[list[int]] = []
    scores = [0.0] * len(live)
    every = range(len(live))
    for score in lattice:
        best = max(scores)
        top, move = scores.index(best), best - BETWEEN
        now, frm = [-math.inf] * len(live), [k if scores[k] >= move else top for k in every]
        for s, x in score:
            k = place[s]
            now[k] = max(scores[k], move) + x
        scores = now
        back.append(frm)
    chosen: list[int] = []
    if lattice:
        k = scores.index(max(scores))
        for frm in reversed(back):
            chosen.append(live[k])
            k = frm[k]
        chosen.reverse()
    out, at, picks = [], 0, iter(chosen)
    for start, end, score in words:
        if not isinstance(score, str):
            s = next(picks)
            if s:
                out += [text[at:start], write(text[start:end], s)]
                at = end
        elif score != text[start:end]:
            out += [text[at:start], score]
            at = end
    return "".join([*out, text[at:]]) if out else text


def possible(word: str) -> int:
    """The scripts, as bits, that can write the whole word."""
    out = (1 << COUNT) - 1
    for ch in word:
        out &= scripts_of(ch)
    return out


class _Possible(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = possible(word)
        return out


def script_counts(texts: Iterator[str]) -> Counter:
    """Letter pairs by script. Words that one script alone can write count for it; in a text in which only one script has
    such words, all words that it can write."""
    known = _Possible()
    words: list[Counter] = [Counter() for _ in range(COUNT + 1)]
    pairs: Counter = Counter()

    def spend() -> None:
        for script, held in enumerate(words):
            for word, n in held.items():
                p = known[word]
                s = script if script < COUNT and p >> script & 1 else p.bit_length() - 1 if p and not p & (p - 1) else None
                if s is not None:
                    for a, b in zip("^" + word, word + "$"):
                        pairs[s, a + b] += n
            held.clear()
        known.clear()

    for text in texts:
        found = WORD.findall(visible(text))
        only = {p for p in set(map(known.__getitem__, found)) if p and not p & (p - 1)}
        words[only.pop().bit_length() - 1 if len(only) == 1 else COUNT].update(found)
        if len(known) > 200_000:
            spend()
    spend()
    return pairs


def train(df: DataFrame, text: str) -> Model:
    """Letter bigrams of each script from the whole corpus. Tasks count, the driver gets only the sums: at most one for each
    pair of letters of a script."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = script_counts(t for batch in batches for t in batch.column(0).to_pylist() if t)
        yield pa.record_batch([pa.array([k[0] for k in pairs], pa.int32()), pa.array([k[1] for k in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["script", "pair", "n"])

    summed = df.select(text).mapInArrow(count, "script int, pair string, n bigint").groupBy("script", "pair").agg(F.sum("n").alias("n"))
    return Model({(r.script, r.pair): r.n for r in summed.collect()})


def canonicalise(df: DataFrame, id_col: str, text: str, model: Model) -> DataFrame:
    """``id_col``, ``canonical`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([canonical(t, model) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "canonical"])

    return df.select(id_col, text).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, canonical string")


def digests(df: DataFrame, id_col: str, text: str, model: Model) -> DataFrame:
    """``id_col``, ``form`` and ``stored``: 128-bit digests of the one form and of the stored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            form = [None if t is None else xxhash.xxh3_128_digest(canonical(t, model).encode("utf-8", "surrogatepass")) for t in texts]
            stored = [None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(form, pa.binary()), pa.array(stored, pa.binary())], names=[id_col, "form", "stored"])

    return df.select(id_col, text).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, form binary, stored binary")


def same_look_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``<id_col>_a`` < ``<id_col>_b``: rows whose stored texts differ but have the same form. Forms with only one
    stored text are left out before the join, which pairs rows of different stored texts of one form. A form with many
    rows is split: each of its parts is paired with all of them in a task of its own. It still has one row for each pair,
    as asked for; ``same_look_classes`` has one row for each text instead."""
    d = digests(df.filter(F.col(text).isNotNull() & F.col(id_col).isNotNull()), id_col, text, train(df, text))
    d = cut(d)
    forms = cut(d.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"), F.count("*").alias("_n")).filter("lo <> hi").select("form", "_n"))
    open_rows = cut(join_groups(d, forms, ["form"], "_n"))
    a = open_rows.select("form", F.col(id_col).alias(f"{id_col}_a"), F.col("stored").alias("_sa"))
    b = open_rows.select("form", F.col(id_col).alias(f"{id_col}_b"), F.col("stored").alias("_sb"), "_n")
    return join_groups(a, b, ["form"], "_n", hot_rows=10_000).filter((F.col(f"{id_col}_a") < F.col(f"{id_col}_b")) & (F.col("_sa") != F.col("_sb"))).select(f"{id_col}_a", f"{id_col}_b").distinct()


def same_look_classes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each text: ``id_col``, ``class_id`` (smallest id with the same form), ``n_stored`` (distinct stored
    texts of the class), ``n_rows``."""
    d = cut(digests(df.filter(F.col(text).isNotNull() & F.col(id_col).isNotNull()), id_col, text, train(df, text)))
    per = d.groupBy("form", "stored").agg(F.min(id_col).alias("_lo"), F.count("*").alias("_n"))
    groups = cut(per.groupBy("form").agg(F.min("_lo").alias("class_id"), F.count("*").alias("n_stored"), F.sum("_n").alias("n_rows")))
    return join_groups(d.select(id_col, "form"), groups, ["form"], "n_rows").select(id_col, "class_id", "n_stored", "n_rows")
