"""Evaluation passages in training texts, by an FM-index over each shard of the corpus.

A shard is a run of documents of bounded length in words. Its words are numbered, its suffixes sorted by doubling, and its
Burrows-Wheeler transform kept in a wavelet matrix, whose levels answer ranks by one look-up. All phrases of the test items are
searched backwards at once; every occurrence is located by walking to the next sampled suffix position. Occurrences of one
item in one document that keep the item's order are merged to a span.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_DROP = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])


def words(text: str | None) -> list[str]:
    """The words of a text: compatibility forms and case folded, zero-width characters and soft hyphens dropped."""
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(_DROP)).casefold()) if text else []


class FMIndex:
    """Index of a sequence of word numbers >= 1; backward search and location are vectorised over patterns."""

    def __init__(self, seq: np.ndarray, sample: int = 8) -> None:
        text = np.concatenate([seq.astype(np.int64), [0]])
        n = len(text)
        sa = self._suffixes(text)
        bwt = text[sa - 1]  # the suffix at 0 is preceded by the end mark
        self.n, self.sigma = n, int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.bits = max(1, (self.sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        x = bwt
        for level in range(self.bits - 1, -1, -1):
            one = (x >> level) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(one.sum()))
            x = np.concatenate([x[one == 0], x[one == 1]])
        self.marked = sa % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = sa[self.marked]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        n, step = len(text), 1
        _, rank = np.unique(text, return_inverse=True)
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank.astype(np.int64) * (n + 1) + nxt
            sa = np.argsort(key, kind="stable")
            k = key[sa]
            r = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            rank = np.empty(n, np.int64)
            rank[sa] = r
            if r[-1] == n - 1:
                return sa
            step *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the transform before row ``at``."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, ones in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo

    def symbol(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transform's symbol at each row, and its rank there."""
        at, lo, value = row.astype(np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for k, ones in enumerate(self.levels):
            bit = ones[at + 1] - ones[at]
            a, b = ones[lo], ones[at]
            lo, at = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, at - b)
            value = value * 2 + bit
        return value, at - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern (rows of equal length; -1 never matches)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for c in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, c]
            known = (s > 0) & (s < self.sigma)
            hi[live[~known]] = lo[live[~known]]
            live, s = live[known], s[known]
            lo[live], hi[live] = self.first[s] + self.rank(s, lo[live]), self.first[s] + self.rank(s, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out, steps, live, at = np.zeros(len(row), np.int64), 0, np.arange(len(row)), row.astype(np.int64)
        while len(live):
            hit = self.marked[at]
            out[live[hit]] = self.samples[self.mark_rank[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            s, r = self.symbol(at)
            at = self.first[s] + r
            steps += 1
        return out


def _phrases(items: pd.DataFrame, length: int, common: float):
    """Vocabulary, phrases by length with their uses (phrase, item, position), of each item the mask of words that count, and its phrases' length.

    Items of fewer words than ``length`` are one phrase each. Words in phrases of more than the share ``common`` of the different items, but at least three, don't count: instructions and stock phrases. An
    item that is made of such only counts whole.
    """
    vocabulary: dict[str, int] = {}
    coded = [[vocabulary.setdefault(x, len(vocabulary)) for x in words(t)] for t in items.text]
    kinds = {tuple(w): k for k, w in enumerate(coded)}
    sizes = np.array([min(length, len(w)) for w in coded], np.int64)
    counts = [np.ones(len(w), bool) for w in coded]
    groups = []
    for size in sorted({*sizes.tolist()} - {0}):
        mine = [k for k in range(len(coded)) if sizes[k] == size]
        codes = np.array([coded[k][j : j + size] for k in mine for j in range(len(coded[k]) - size + 1)], np.int64).reshape(-1, size)
        item = np.array([k for k in mine for _ in range(len(coded[k]) - size + 1)], np.int64)
        at = np.array([j for k in mine for j in range(len(coded[k]) - size + 1)], np.int64)
        phrases, use = np.unique(codes, axis=0, return_inverse=True)
        use = use.ravel()
        spread = pd.DataFrame({"p": use, "i": [kinds[tuple(coded[k])] for k in item]}).drop_duplicates().groupby("p").size().reindex(range(len(phrases)), fill_value=0).to_numpy()
        stock = spread >= max(3, common * len(kinds))
        for p, i, a in zip(use, item, at, strict=True):
            if stock[p]:
                counts[i][a : a + size] = False
        whole = np.array([not counts[i].any() for i in range(len(coded))])
        for i in mine:
            if whole[i]:
                counts[i][:] = True
        keep = ~stock[use] | whole[item]
        groups.append((phrases, use[keep], item[keep], at[keep]))
    return list(vocabulary), groups, counts, sizes


def _shard_hits(docs: list, texts: list[list[str]], starts: list[int], plan, least: float) -> pd.DataFrame:
    vocabulary, groups, counts, lengths = plan
    sizes = np.array([c.sum() for c in counts])
    code, names = pd.factorize(np.array([w for t in texts for w in (*t, "")], dtype=object))
    number = {w: k + 1 for k, w in enumerate(names)}
    index, known = FMIndex(code + 1), np.array([number.get(w, -1) for w in vocabulary], np.int64)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out = []
    for phrases, use, item, at in groups:
        lo, hi = index.search(known[phrases])
        found = hi - lo
        uses = np.flatnonzero(found[use] > 0)
        if not len(uses):
            continue
        live = np.unique(use[uses])
        first = np.zeros(len(found), np.int64)
        first[live] = np.cumsum(found[live]) - found[live]
        where = index.locate(np.repeat(lo[live] - first[live], found[live]) + np.arange(found[live].sum()))
        # each use of a phrase in an item, at each place in the shard
        n = found[use[uses]]
        u = np.repeat(uses, n)
        place = where[np.repeat(first[use[uses]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        d = np.searchsorted(begin, place, "right") - 1
        group = d * len(counts) + item[u]
        order = np.argsort(group, kind="stable")
        group, at_, pos = group[order], at[u][order], (place - begin[d])[order]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k, i = divmod(int(group[a]), len(counts))
            # too few phrases to reach the least share, even if none overlap
            if (b - a) * lengths[i] >= least * sizes[i]:
                out += ((docs[k], i, n_, sizes[i], starts[k] + x, starts[k] + y) for n_, x, y in _covers(at_[a:b], pos[a:b], int(lengths[i]), counts[i], least * sizes[i]))
    return pd.DataFrame(out, columns=["doc_id", "item", "covered", "item_words", "start_word", "end_word"])


def _covers(at: np.ndarray, pos: np.ndarray, length: int, counts: np.ndarray, need: float) -> list[tuple[int, int, int]]:
    """Copies of the item: ``(counting words covered, start, end)`` of each set of phrases near one line that covers ``need`` words or more.

    Phrases count together if their offsets (place minus position in the item) differ by at most a quarter of the item's length. Of sets that share phrases the fullest is
    taken first, the earliest of equals; what is left of the others counts again by itself.
    """
    order = np.argsort(pos - at, kind="stable")
    at, pos = at[order], pos[order]
    out, todo = [], [(0, len(at))]
    while todo:
        lo, hi = todo.pop()
        n, a, b = _fullest(at[lo:hi], pos[lo:hi], length, counts)
        if n and n >= need:
            a, b = lo + a, lo + b
            out.append((n, int(pos[a:b].min()), int(pos[a:b].max()) + length))
            todo += [(lo, a), (b, hi)]
    return sorted(out, key=lambda x: x[1:])


def _fullest(at: np.ndarray, pos: np.ndarray, length: int, counts: np.ndarray) -> tuple[int, int, int]:
    """Most counting words of the item that phrases in one window of offsets cover, and the window [a, b) of the phrases, which are sorted by offset."""
    shift = pos - at
    ends = np.searchsorted(shift, shift + max(8, len(counts) // 4), "right")
    best, last = (0, 0, 0), -1
    for a in range(len(shift)):
        if ends[a] == last or (ends[a] - a) * length <= best[0]:
            continue
        last = ends[a]
        mask = np.zeros(len(counts), bool)
        for j in range(length):
            mask[at[a : ends[a]] + j] = True
        if (n := int((mask & counts).sum())) > best[0]:
            best = (n, a, int(ends[a]))
    return best


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", phrase: int = 4, least: float = 0.47, common: float = 0.02, shard_words: int = 400_000, max_items: int = 100_000) -> DataFrame:
    """``(doc_id, item_id, covered, item_words, start_word, end_word)``: spans of documents that hold at least ``least`` of an item's words, one row for each copy.

    Words are taken over if they lie in a phrase of ``phrase`` words that is unchanged, near the other phrases of the item and in
    its order. Words in phrases that many items share (``common``) count neither for the item's size nor as taken over.
    Items are the query side: they are read by the driver and must be at most ``max_items``, else ``ValueError``. Documents
    are read whole; one longer than a shard is cut into parts that overlap by more than two items. Null and empty texts
    match nothing; items of fewer words than a phrase are found where they stand as a whole. ``start_word`` and ``end_word`` bound the words to remove; spans of one document and item don't overlap.
    """
    few = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).limit(max_items + 1).toPandas().sort_values("item_id", ignore_index=True)
    if len(few) > max_items:
        raise ValueError(f"more than {max_items} items; search them in blocks")
    plan = _phrases(few, phrase, common)
    ids = few.item_id.to_numpy()
    overlap = 3 * max([1, *map(len, plan[2])])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, texts, starts, held = [], [], [], 0

        def flush():
            h = _shard_hits(docs_, texts, starts, plan, least)
            if len(h):
                i = h.item.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h.doc_id, ids[i], h.covered, h.item_words, h.start_word, h.end_word)], ["doc_id", "item_id", "covered", "item_words", "start_word", "end_word"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                for a in range(0, max(1, len(w) - overlap), shard_words):
                    part = w[a : a + shard_words + overlap]
                    if not part or not plan[1]:
                        continue
                    docs_.append(d)
                    texts.append(part)
                    starts.append(a)
                    held += len(part)
                    if held >= shard_words:
                        yield from flush()
                        docs_, texts, starts, held = [], [], [], 0
        if docs_:
            yield from flush()

    hits = docs.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(search, "doc_id long, item_id long, covered long, item_words long, start_word long, end_word long")
    # copies that overlap, of one part or of two, are one span
    by = Window.partitionBy("doc_id", "item_id").orderBy("start_word", "end_word")
    so_far = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    span = hits.withColumn("new", F.when(F.col("start_word") < so_far, 0).otherwise(1)).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return span.groupBy("doc_id", "item_id", "span").agg(F.max("covered").alias("covered"), F.max("item_words").alias("item_words"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("span")
