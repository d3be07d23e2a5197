"""Benchmark decontamination: counted word pairs and local alignment.

1. A text and an item are aligned by Smith-Waterman over their words (match 2,
   other -1, gap -1).  The score is the best local alignment over that of the
   whole item: 1 for an exact copy; edits, insertions and cut ends lower it
   step by step.
2. Which texts to align is decided without loss.  m matched words with x
   errors score 2m - x, so at a score of S or more at least S/2 - 1 of the
   m - 1 neighbouring matches have one error or none between them: two words
   that stand one or two places apart both in the item and in the text.  Only
   where a stretch of the text holds that many such pairs of an item can the
   alignment reach S.  Pairs that many items share may be left out, each for
   one pair less that is asked for.

Test items are worked through in blocks of `block_bytes` of text, each a
broadcast of that size at most; every block meets every text whole.

Rows: a NULL or empty text matches nothing; NULL and empty items and those of
fewer than `min_words` words are never matched; equal items match each for
itself; repeated documents are reported each; an empty table on either side
gives no matches.  Several copies of an item in one text give one row, the
best; of equal scores always the same one.  Texts of any length are searched
whole, `CHUNK_WORDS` words or one text at a time.  Ids are read as numbers; one
that is none is NULL.  Other input columns are ignored (`drop_contaminated`
keeps them).
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, internal, lower_words

MATCH, OTHER, GAP = 2, -1, -1
#: Unrelated texts reach 0.2 by chance; half an item reaches 0.5.
MIN_SCORE = 0.35
MIN_WORDS = 5
#: Fewer matched words than these in a row never count, however short the item.
LEAST_RUN = 3
#: Words that are searched together, and the items from which a pair is common.
CHUNK_WORDS = 100_000
COMMON = 32


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best Smith-Waterman score of two id sequences and where it ends:
    (score, item end, text end), a row of the matrix at a time.  A gap along
    the text is a running maximum, so each row is a few vector operations."""
    m = len(text)
    slope = np.arange(m + 1, dtype=np.int64) * -GAP
    prev = np.zeros(m + 1, np.int64)
    best, at_i, at_j = 0, 0, 0
    for i, w in enumerate(item):
        row = np.zeros(m + 1, np.int64)
        np.maximum(prev[:-1] + np.where(text == w, MATCH, OTHER), prev[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope
        j = int(row.argmax())
        if row[j] > best:
            best, at_i, at_j = int(row[j]), i + 1, j
        prev = row
    return best, at_i, at_j, m


class Matcher:
    """Word pairs and alignment of one block of test items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], min_score: float):
        self.items = items
        self.word_id: dict[bytes, int] = {}
        self.coded = [np.array([self.word_id.setdefault(w, len(self.word_id)) for w in ws],
                               np.int64) for _, ws in items]
        sizes = np.array([len(x) for x in self.coded])
        self.least = np.maximum(2 * min_score * sizes, MATCH * LEAST_RUN)  # the raw score S
        self.need = np.ceil(self.least / 2 - 1 - 1e-9).astype(np.int64)
        # m words and the errors that S leaves them: at most 3m - S words of text
        self.span = np.ceil(3 * sizes - self.least).astype(np.int64) + 1
        item, left, code = [], [], []
        for k, x in enumerate(self.coded):
            for d in (1, 2):
                item.append(np.full(len(x) - d, k))
                left.append(np.arange(len(x) - d))
                code.append(x[:-d] * len(self.word_id) + x[d:])
        item, left, code = map(np.concatenate, (item, left, code))
        kept = self._without_common(item, left, code)
        pairs = np.unique(np.stack([code[kept], item[kept]]), axis=1)
        self.codes, self.first, self.many = np.unique(pairs[0], return_index=True,
                                                      return_counts=True)
        self.item_of = pairs[1]

    def _without_common(self, item: np.ndarray, left: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Which pairs to look for: an item's places whose pairs are common
        are left out, half of the needed ones at most, and `need` falls by as
        many."""
        _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
        shared = counts[at]
        kept = np.ones(len(code), bool)
        for row in np.flatnonzero(np.bincount(item, shared > COMMON, len(self.items))):
            own = np.flatnonzero(item == row)
            most = np.zeros(len(self.coded[row]), np.int64)
            np.maximum.at(most, left[own], shared[own])
            out = np.argsort(-most, kind="stable")[:self.need[row] // 2]
            out = out[most[out] > COMMON]
            kept[own[np.isin(left[own], out)]] = False
            self.need[row] -= len(out)
        return kept

    def find(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """For each text (item index, score, first word, word after the last)
        of each item found in it."""
        out: list[list[tuple[int, float, int, int]]] = []
        held, words = [], 0
        for t in texts:
            held.append(lower_words(t))
            words += len(held[-1])
            if words >= CHUNK_WORDS:
                out += self._find(held)
                held, words = [], 0
        return out + self._find(held)

    def _find(self, texts: list[list[bytes]]) -> list[list[tuple[int, float, int, int]]]:
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        get, sizes = self.word_id.get, np.array([len(ws) for ws in texts], np.int64)
        n = int(sizes.sum())
        ids = np.fromiter((get(w, -1) for ws in texts for w in ws), np.int64, n)
        owner, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        places = defaultdict(list)
        for k, at, last in zip(*(x.tolist() for x in self._stretches(ids, owner))):
            places[k, int(owner[at])].append((max(0, last + 1 - int(self.span[k])),
                                              at + int(self.span[k])))
        for (k, t), ranges in places.items():
            item, lo_t, best = self.coded[k], int(begin[t]), (0, 0, 0)
            for lo, hi in _merged(ranges):
                lo, hi = max(lo, lo_t), min(hi, lo_t + int(sizes[t]))
                part = ids[lo:hi]
                score, ie, je, _ = align(item, part)
                if score > best[0]:
                    back = align(item[:ie][::-1], part[:je][::-1])
                    best = (score, lo - lo_t + je - back[2], lo - lo_t + je)
            if best[0] >= self.least[k] - 1e-9:
                out[t].append((k, best[0] / (MATCH * len(item)), best[1], best[2]))
        return out

    def _stretches(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, first and last place) of all stretches of text that hold as
        many pairs of an item as it needs."""
        found = []
        for d in (1, 2):
            a, b = ids[:-d], ids[d:]
            at = np.flatnonzero((a >= 0) & (b >= 0) & (owner[:-d] == owner[d:]))
            code = a[at] * len(self.word_id) + b[at]
            row = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[row] == code
            at, row = at[hit], row[hit]
            many = self.many[row]
            flat = np.repeat(self.first[row] - (np.cumsum(many) - many), many)
            flat += np.arange(len(flat))
            found.append(self.item_of[flat] * len(ids) + np.repeat(at, many))
        # one place counts once for an item, whichever its pair
        item, at = np.divmod(np.unique(np.concatenate(found)), max(1, len(ids)))
        last = np.arange(len(at)) + self.need[item] - 1
        fits = last < len(at)
        item_, at_, last = item[fits], at[fits], last[fits]
        fits = (item[last] == item_) & (at[last] - at_ < self.span[item_])
        fits[fits] = owner[at[last[fits]]] == owner[at_[fits]]
        return item_[fits], at_[fits], at[last[fits]]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, overlapping ones as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def matchers(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id",
             item_text: str = "text", min_score: float = MIN_SCORE, min_words: int = MIN_WORDS,
             block_bytes: int = 8_000_000) -> list[Broadcast]:
    """One broadcast matcher for each block of test items."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(benchmark[item_id].alias("item_id"),
                             benchmark[item_text].alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        coded = [(r["item_id"], lower_words(r["text"])) for r in block]
        coded = [(i, ws) for i, ws in coded if len(ws) >= max(min_words, LEAST_RUN)]
        if coded:
            out.append(sc.broadcast(Matcher(coded, min_score)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
               **options) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: one row for each document
    and test item whose alignment reaches `min_score`."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for model in matchers(docs, benchmark, **options):
        def match(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            m = model.value
            for pdf in batches:
                hits = [(d, m.items[k][0], s, a, b) for d, found in zip(
                    pdf["doc_id"], m.find(pdf["text"])) for k, s, a, b in found]
                out = pd.DataFrame(hits, columns=["doc_id", "item_id", "score", "first_word",
                                                  "end_word"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})
        found = found.unionByName(rows.mapInPandas(match, schema))
    return found


def leaks_column(text: Column, model: Broadcast) -> Column:
    """True where the text holds an item of the block."""
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([bool(x) for x in model.value.find(s)], dtype=bool)
        give_back()
    return leaks(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      **options) -> DataFrame:
    """The rows of `docs`, all columns, that hold no test item."""
    kept = docs
    for model in matchers(docs, benchmark, **options):
        mark = internal("leak")
        kept = kept.withColumn(mark, leaks_column(kept[text], model)).where(~F.col(mark)).drop(mark)
    return kept
