"""Problem 7: held-out evaluation passages inside training documents.

Method: suffix arrays of the training text. Every task turns its documents, shard by shard, into arrays of word numbers and
sorts all their suffixes (prefix doubling, to the length of the longest test item). Every test suffix is binary-searched in
each shard's array: its neighbours there give the longest verbatim match, and running minima of the common prefix lengths
give all other places that share its first words, in time linear in their number. Runs of one document and item are chained
into stretches across a few changed words, and a document holds an item if one or two stretches in order cover enough of it.

A shard's array is built once, searched for the whole test set and dropped: kept for a corpus, it would take several times
the corpus on disk. The test set is a stated query set: it goes to the tasks in broadcast blocks of bounded size, one in
memory at a time. Documents are never split or shuffled; only (document, item) pairs are.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.functions.visual import consistent

RUN = 4  # words of the shortest verbatim match; of shorter items, the whole item
GAP = 6  # words that may differ between two runs of a stretch
LEAST_SHARE = 1 / 3
SHARD_WORDS = 250_000  # a task's memory: some 150 bytes a word
BLOCK_WORDS = 500_000  # words of the test set that are in a task's memory at a time


class _Fold(dict):
    """Per character, its letters without case and accents, or a blank."""

    def __missing__(self, code: int) -> str:
        letters = unicodedata.normalize("NFKD", consistent(chr(code), fold_case=True) or " " * chr(code).isspace())
        out = "".join(x if x.isalnum() else "" if unicodedata.category(x) in ("Mn", "Cf") else " " for x in letters).replace("đ", "d")
        self[code] = out
        return out


_FOLD = _Fold()


def words(text: str) -> list[str]:
    """Words as they are compared: letter case, accents, punctuation and layout don't count."""
    return text.translate(_FOLD).split()


class Shard:
    """Documents as word numbers (0 between them) with their suffixes sorted to at least `depth` words."""

    def __init__(self, texts: list[list[str]], depth: int):
        self.number: dict[str, int] = {}
        number = self.number
        flat: list[int] = []
        self.ends = np.zeros(len(texts), dtype=np.int64)
        for d, t in enumerate(texts):
            flat += [number.setdefault(w, len(number) + 1) for w in t]
            flat.append(0)
            self.ends[d] = len(flat)
        self.words = np.array(flat, dtype=np.int64)
        self.bits = (len(number) + 1).bit_length()
        self.packed = max(2, min(4, 62 // self.bits))  # words of the first sort
        self.depths, self.names, self.keys = [1], [self.words], []  # names[j]: equal where so many words are equal, and in their order
        order, sorted_ = None, False
        while True:
            name, k = self.names[-1], self.depths[-1]
            key = self._packed(name) if k == 1 else name * (int(name.max(initial=0)) + 2) + self._ahead(name, k)
            order = order if sorted_ else np.argsort(key)
            in_order = key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = in_order[1:] != in_order[:-1]
            name = np.empty_like(key)
            name[order] = np.cumsum(new)
            self.keys.append((int(self.names[-1].max(initial=0)) + 2, in_order[new]))
            self.names.append(name)
            self.depths.append(2 * k if k > 1 else self.packed)
            sorted_ = bool(new.all())  # then longer prefixes change nothing but are still looked up
            if self.depths[-1] > depth:
                break
        self.array = order
        self.common = np.zeros(len(order), dtype=np.int64)  # words a suffix shares with the one before it in the array
        if len(order) > 1:
            self.common[1:] = self.shared(self.names, order[:-1], order[1:])

    @staticmethod
    def _ahead(name: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(name)
        out[: max(0, len(name) - k)] = name[k:]
        return out

    def _packed(self, words: np.ndarray) -> np.ndarray:
        out = words
        for j in range(1, self.packed):
            out = (out << self.bits) | self._ahead(words, j)
        return out

    def shared(self, other: list[np.ndarray], at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many words the suffixes of `other` (names by depth) at `at` share with those of the shard at `places`."""
        n = np.zeros(len(at), dtype=np.int64)
        levels = [*range(len(self.names) - 1, 0, -1), *[0] * (self.packed - 1)]
        for names, own, k in ((other[x], self.names[x], self.depths[x]) for x in levels):
            i, p = np.minimum(at + n, len(names) - 1), np.minimum(places + n, len(own) - 1)
            same = (names[i] == own[p]) & (at + n < len(names)) & (places + n < len(own))
            n += np.where(same, k, 0)
        return n

    def named(self, words: np.ndarray) -> list[np.ndarray]:
        """The names of test suffixes by depth; -1 where the shard has no such words."""
        out = [words]
        for (base, keys), k in zip(self.keys, self.depths):
            if k == 1:
                unknown = np.any([self._ahead(words, j) < 0 for j in range(self.packed)], axis=0)
                key = np.where(unknown, -1, self._packed(words))
            else:
                name, ahead = out[-1], self._ahead(out[-1], k)
                key = np.where((name < 0) | (ahead < 0), -1, name * base + ahead)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out.append(np.where(keys[at] == key, at + 1, -1))
        return out


class TestSet:
    """A block of test items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.lengths = np.array([len(ws) for _, ws in items], dtype=np.int64)
        self.words = [w for _, ws in items for w in (*ws, "")]  # an empty word, which no document has, after each
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.item = np.repeat(np.arange(len(items)), self.lengths + 1)


def _matches(tests: TestSet, shard: Shard, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item, place in the item, places in the shard, lengths) of all matches that can't be extended to the left."""
    if not len(shard.words) or not tests.words:
        return
    words = np.array([shard.number.get(w, -1) for w in tests.words], dtype=np.int64)
    names = shard.named(words)
    array, common, n = shard.array, shard.common, len(shard.array)
    at = np.flatnonzero(words >= 0)
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), n, dtype=np.int64)
    while (open_ := low < high).any():  # the place of every test suffix in the sorted order, all of them together
        mid = np.minimum((low + high) // 2, n - 1)
        k = shard.shared(names, at, array[mid])
        mine, its = words[np.minimum(at + k, len(words) - 1)], shard.words[np.minimum(array[mid] + k, n - 1)]
        right = open_ & (its < mine)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    before, after = np.maximum(low - 1, 0), np.minimum(low, n - 1)
    k_before = np.where(low > 0, shard.shared(names, at, array[before]), 0)
    k_after = np.where(low < n, shard.shared(names, at, array[after]), 0)
    best, longest = np.where(k_after >= k_before, after, before), np.maximum(k_before, k_after)
    item = tests.item[at]
    place = at - tests.starts[item]
    least = np.minimum(run, tests.lengths[item])
    breaks: dict[int, np.ndarray] = {}
    for x in np.flatnonzero(longest >= least).tolist():
        m = int(least[x])
        if m not in breaks:
            breaks[m] = np.flatnonzero(common < m)  # where suffixes with other first m words begin
        j = int(best[x])
        g = int(np.searchsorted(breaks[m], j, side="right"))
        first, last = int(breaks[m][g - 1]), int(breaks[m][g]) if g < len(breaks[m]) else n
        lengths = np.empty(last - first, dtype=np.int64)
        lengths[j - first :] = np.minimum.accumulate(np.concatenate([[longest[x]], common[j + 1 : last]]))
        lengths[: j - first + 1] = np.minimum.accumulate(np.concatenate([[longest[x]], common[first + 1 : j + 1][::-1]]))[::-1]
        places, a = array[first:last], int(at[x])
        if place[x]:  # a match that can be extended to the left is part of another
            kept = (places == 0) | (shard.words[places - 1] != words[a - 1])
            places, lengths = places[kept], lengths[kept]
        if len(places):
            yield int(item[x]), int(place[x]), places, lengths


def held(runs: list[tuple[int, int, int]], gap: int = GAP) -> int:
    """Most words of an item that one or two stretches hold; runs: (place in the document, place in the item, length)."""
    best: list[tuple[int, int, int, int, int]] = []  # words, start and end in the document, start and end in the item
    near: list[tuple[int, int, int, int, int]] = []  # those that a later run can still continue
    for p, i, n in sorted(runs):
        own = (n, p, p + n, i, i + n)
        near = [x for x in near if p - x[2] <= gap]
        for words_, p0, p1, i0, i1 in near:
            if p0 < p and i0 < i and p + n > p1 and i + n > i1 and -n < p - p1 and -n < i - i1 <= gap:
                more = words_ + n - max(0, p1 - p, i1 - i)
                if more > own[0]:
                    own = (more, p0, p + n, i0, i + n)
        best.append(own)
        near.append(own)
    # two stretches in order: by their start in the document, the best one that has ended before, by its end in the item
    most = max(x[0] for x in best)
    ended = sorted(best, key=lambda x: x[2])
    ends_, tops, e = [], [], 0  # ends in the item, rising, with rising words
    for x in sorted(best, key=lambda x: x[1]):
        while e < len(ended) and ended[e][2] <= x[1]:
            words_, end = ended[e][0], ended[e][4]
            at = bisect_right(ends_, end)
            if not at or tops[at - 1] < words_:
                upto = at
                while upto < len(tops) and tops[upto] <= words_:
                    upto += 1
                at = bisect_left(ends_, end)
                ends_[at:upto], tops[at:upto] = [end], [words_]
            e += 1
        if (at := bisect_right(ends_, x[3])) and x[0] + tops[at - 1] > most:
            most = x[0] + tops[at - 1]
    return most


def _search(tests: TestSet, docs: list, shard: Shard, least_share: float, run: int) -> Iterator[tuple]:
    """(document, item, words held, words of the item) for one shard and block."""
    parts = [(np.searchsorted(shard.ends, places, side="right"), np.full(len(places), item), places, np.full(len(places), i), lengths) for item, i, places, lengths in _matches(tests, shard, run)]
    if not parts:
        return
    d, item, p, i, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((p, item, d))
    d, item, p, i, n = d[order], item[order], p[order], i[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])]))
    last = np.append(first[1:], len(d))
    for a, b in zip(first[np.add.reduceat(n, first) >= least_share * tests.lengths[item[first]]].tolist(), last[np.add.reduceat(n, first) >= least_share * tests.lengths[item[first]]].tolist()):
        of = int(tests.lengths[item[a]])
        if (most := held(list(zip(p[a:b].tolist(), i[a:b].tolist(), n[a:b].tolist())))) >= least_share * of:
            yield docs[d[a]], tests.ids[item[a]], most, of


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least_share: float = LEAST_SHARE, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, words_held, item_words) of every document that holds an item; each pair once.

    Null texts and ids and items without words hold nothing. Of an item with fewer than `run` words the whole item is a run.
    Copies of a document are found each. Extra columns are ignored; empty tables give no rows.
    """
    schema = "doc_id long, item_id long, words_held int, item_words int"
    columns = [x.split()[0] for x in schema.split(", ")]
    sc = documents.sparkSession.sparkContext
    blocks, block, size, depth = [], [], 0, 1
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    for i, t in wanted.toLocalIterator():
        if ws := words(t):
            if size + len(ws) > BLOCK_WORDS and block:
                blocks.append(sc.broadcast(TestSet(block)))
                block, size = [], 0
            block.append((i, ws))
            size, depth = size + len(ws), max(depth, len(ws))
    if block:
        blocks.append(sc.broadcast(TestSet(block)))
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)
    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def searched(docs: list, texts: list[list[str]]) -> pd.DataFrame:
        shard = Shard(texts, depth)
        return pd.DataFrame([x for b in blocks for x in _search(b.value, docs, shard, least_share, run)], columns=columns)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, texts, n = [], [], 0
        for batch in batches:
            for d, t in zip(batch.doc_id, batch.text):
                docs.append(d)
                texts.append(words(t))
                n += len(texts[-1]) + 1
                if n >= SHARD_WORDS:
                    yield searched(docs, texts)
                    docs, texts, n = [], [], 0
        if docs:
            yield searched(docs, texts)

    found = rows.mapInPandas(search, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("words_held").alias("words_held"), F.max("item_words").alias("item_words"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{sf}/eval_items.parquet"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """The test items that leaked, with the number of documents that hold them."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("words_held").alias("most_words_held"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that hold no test item."""
    return spark.read.parquet(f"{sf}/documents.parquet").join(_leaks(spark, sf).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "source", "lang")
