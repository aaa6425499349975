"""Evaluation texts leaking into training text, found by winnowing.

Words are runs of letters and digits of the text's visible form (see ``lookalike.compared``), regardless of case. Hashes
of ``gram`` consecutive words are taken, and in each window of ``window`` hashes the smallest one (the rightmost of
equals) is kept. Any shared run of ``gram + window - 1`` words is guaranteed to share a kept hash, so joining the
fingerprints of both sides misses no run of that length. All hits of a text and an item are then extended at once, in one
pass over the text's words through an automaton of the item's word runs: linear in both, however repetitive they are. The
longest shared run counts if it has at least ``gram + window - 1`` words.

Defined results: null and empty texts, and texts with fewer words, have no fingerprints and no rows; a text and an item
give one row with the longest run, the first of equals in the text; repeated input rows give no repeated result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import lookalike
from factloom.runtime import cut, join_groups, small

WORDS = re.compile(r"[^\W_]+")
GRAM, WINDOW = 8, 6
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return [] if not text else WORDS.findall(lookalike.compared(text))


def fingerprints(hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and the places of their first words."""
    n = len(hashes) - gram + 1
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    for j in range(gram):
        rolled = rolled * BASE + hashes[j : j + n]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    view = np.lib.stride_tricks.sliding_window_view(rolled, window)
    at = np.unique(np.arange(len(view)) + (window - 1 - view[:, ::-1].argmin(axis=1)))
    return rolled[at], at


def winnow(df: DataFrame, id_col: str, text: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``id_col``, ``fp`` for every kept hash of every text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, fps = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                if len(words) < gram + window - 1:
                    continue
                hashed = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
                fp = np.unique(fingerprints(hashed, gram, window)[0])
                ids += [key] * len(fp)
                fps.append(fp)
                if len(known) > 500_000:
                    known.clear()
            if ids:
                yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(np.concatenate(fps).view(np.int64))], names=[id_col, "fp"])

    return df.select(id_col, text).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, fp bigint")


class Runs:
    """All runs of consecutive words of an item, as the states of an automaton: two for each word at most."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for at, w in enumerate(words, 1):
            now = self._state({}, self.length[last] + 1, at)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[now] = q
                else:
                    half = self._state(dict(self.next[q]), self.length[p] + 1, self.end[q])
                    self.link[half] = self.link[q]
                    self.link[q] = self.link[now] = half
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = half
                        p = self.link[p]
            last = now

    def _state(self, after: dict[str, int], length: int, end: int) -> int:
        self.next.append(after)
        self.link.append(-1)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, words: list[str]) -> tuple[int, int, int]:
        """The longest run of ``words`` that is one of the item's: its length, and where it begins in both (in the item,
        where the run first stands)."""
        best = (0, 0, 0)
        state = n = 0
        for at, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
                if n > best[0]:
                    best = (n, at - n, self.end[state] - n)
        return best


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", gram: int = GRAM, window: int = WINDOW, broadcast_rows: int = 2_000_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words`` (of the longest shared run), ``doc_word`` and ``item_word`` (where it begins).

    The items' fingerprints, of fixed size each, are broadcast up to ``broadcast_rows`` (32 MB); more of them are joined by
    shuffle, those that very many texts hold split. The result is the same."""
    docs = docs.select(doc_id, F.col(text).alias("_text")).filter(F.col(doc_id).isNotNull() & F.col("_text").isNotNull())
    items = items.select(item_id, F.col(text).alias("_item")).filter(F.col(item_id).isNotNull() & F.col("_item").isNotNull())
    item_prints = cut(winnow(items, item_id, "_item", gram, window).distinct())
    prints = winnow(docs, doc_id, "_text", gram, window)
    if item_prints.count() <= broadcast_rows:
        hits = prints.join(F.broadcast(item_prints), "fp")
    else:
        shared = cut(prints.join(item_prints.select("fp").distinct(), "fp", "left_semi"))
        sizes = shared.groupBy("fp").agg(F.count("*").alias("_n"))
        hits = join_groups(shared, cut(item_prints.join(sizes, "fp")), ["fp"], "_n")
    pairs = cut(hits.select(doc_id, item_id).distinct())
    both = docs.join(small(pairs), doc_id).join(small(items, text="_item"), item_id).select(doc_id, item_id, "_text", "_item")
    least = gram + window - 1

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Runs] = {}
        for batch in batches:
            out: list[tuple] = []
            last: tuple = (None, None)
            for d, i, t, item in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last[0] != t:
                    last = (t, words_of(t))
                if item not in known:
                    if len(known) >= 1_000:
                        known.clear()
                    known[item] = Runs(words_of(item))
                n, at, frm = known[item].longest(last[1])
                if n >= least:
                    out.append((d, i, n, at, frm))
            cols = [*zip(*out)] or [()] * 5
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, types)], names=[doc_id, item_id, "n_words", "doc_word", "item_word"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    found = both.mapInArrow(extend, f"{doc_id} {kinds[doc_id]}, {item_id} {kinds[item_id]}, n_words int, doc_word int, item_word int")
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_word", "item_word")).alias("_b")  # of repeated ids
    return found.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, (-F.col("_b.n")).cast("int").alias("n_words"), "_b.doc_word", "_b.item_word")
