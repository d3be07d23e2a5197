"""Importance resampling of documents towards a target corpus.

A document's features are its words and its pairs of neighbouring words, each
in the bucket that its crc32 names.  `bucket_counts` counts the buckets of a
corpus, `gains` compares two corpora, `weigh` gives each document the mean
gain of its features, and `draw` takes the highest scores: a weight plus Gumbel
noise that hangs on the document's id alone (sampling without replacement).

Features are interned batch by batch in an open-addressed NumPy table
(`Interned`): places are found by the XXH64 of a feature's bytes and linear
probing, bytes are compared before two features share a slot, and a slot keeps
the feature's bucket and count.  Every occurrence has a slot id; counting adds
the slots' counts into buckets, weighing gathers gains by slot id.

Counts of tasks (at most one row a bucket and task) are added by Spark; the
driver holds one number a bucket.  Ranks come from running totals on two levels
over an order without ties.

Rows: a NULL or empty text has no features, weight 0 and is never drawn; a
NULL doc_id counts as an empty id and stands last among ties; repeated rows
are documents of their own (each is counted, and each has a rank); very long
texts are read piece by piece, so a batch holds a bounded number of features;
an empty table gives no rows, an empty target leaves all t at 0; other input
columns are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back
from quarry.operators.prefix import running_totals
from quarry.session import stage

BUCKETS = 10_000
#: Words whose features are interned together.
BATCH_WORDS = 1 << 17
#: Bytes of words after lower-casing A-Z (every byte of a
#: character beyond ASCII, digits and a-z).
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = _IS_WORD[48:58] = _IS_WORD[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161,
    9650029242287828579, 2870177450012600261))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


# --- hashes of many equally long strings --------------------------------------

def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64_rows(rows: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of a matrix of bytes."""
    n, size = rows.shape
    at = 0

    def lanes(width, kind):
        return np.ascontiguousarray(rows[:, at:at + width]).view(kind).astype(np.uint64)

    with np.errstate(over="ignore"):
        if size >= 32:
            acc = [np.full(n, v, np.uint64) for v in
                   (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            while at + 32 <= size:
                block = lanes(32, "<u8")
                acc = [_round(a, block[:, i]) for i, a in enumerate(acc)]
                at += 32
            h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros(n, np.uint64), a)) * _P1 + _P4
        else:
            h = np.full(n, _P5, np.uint64)
        h += np.uint64(size)
        while at + 8 <= size:
            h = _rot(h ^ _round(np.zeros(n, np.uint64), lanes(8, "<u8")[:, 0]), 27) * _P1 + _P4
            at += 8
        if at + 4 <= size:
            h = _rot(h ^ lanes(4, "<u4")[:, 0] * _P1, 23) * _P2 + _P3
            at += 4
        while at < size:
            h = _rot(h ^ rows[:, at].astype(np.uint64) * _P5, 11) * _P1
            at += 1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


def crc32_rows(rows: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each row of a matrix of bytes."""
    c = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for i in range(rows.shape[1]):
        c = _CRC[(c ^ rows[:, i]) & np.uint32(255)] ^ c >> np.uint32(8)
    return ~c


# --- interning ------------------------------------------------------------------

class Interned:
    """The distinct features of one batch.

    `slot` holds each occurrence's place in an open-addressed table of twice
    as many places or more; `bucket` and `count` are the table's columns.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int):
        bits = max(4, int(2 * len(start)).bit_length())
        self.key = np.zeros(1 << bits, np.uint64)
        self.size = np.zeros(1 << bits, np.int32)  # 0: an open place
        self.first = np.zeros(1 << bits, np.int64)  # where a slot's bytes stand
        self.bucket = np.zeros(1 << bits, np.int64)
        self.slot = np.zeros(len(start), np.int64)
        order = np.argsort(np.minimum(size, 65535).astype(np.uint16), kind="stable")
        if len(size) and size.max() > 65535:
            order = np.argsort(size, kind="stable")
        sizes, at = np.unique(size[order], return_index=True)
        for n, a, b in zip(sizes.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
            step = max(1, (1 << 24) // n)  # long features: a few at a time
            for c in range(a, b, step):
                self._add(data, start, order[c:min(b, c + step)], n, buckets)
        self.count = np.bincount(self.slot, minlength=1 << bits)

    def _add(self, data: np.ndarray, start: np.ndarray, which: np.ndarray, n: int,
             buckets: int) -> None:
        """Intern the occurrences `which`, all of n bytes."""
        view = np.lib.stride_tricks.sliding_window_view(data, n)
        rows = view[start[which]]
        key = xxh64_rows(rows)
        mask = np.uint64(len(self.key) - 1)
        place = (key & mask).astype(np.int64)
        left = np.arange(len(which))
        while len(left):
            p = place[left]
            open_ = self.size[p] == 0
            if open_.any():  # of several that ask for a place the last one gets it
                new, q = left[open_], p[open_]
                self.first[q] = start[which[new]]
                new = new[self.first[q] == start[which[new]]]
                q = place[new]
                self.key[q], self.size[q] = key[new], n
                self.bucket[q] = crc32_rows(rows[new]) % np.uint32(buckets)
            same = (self.key[p] == key[left]) & (self.size[p] == n)
            near = np.flatnonzero(same)
            differ = (view[self.first[p[near]]] != rows[left[near]]).any(axis=1)
            same[near[differ]] = False  # one hash, other bytes
            self.slot[which[left[same]]] = p[same]
            left = left[~same]
            place[left] = place[left] + 1 & int(mask)


class Words:
    """The words of some texts: `data` has each word and one blank after it,
    word i lies at start[i]..end[i] and stands in text doc[i]."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, places, data = texts.buffers()
        place = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[place[0]:place[-1]]
        raw = _LOWER[raw]
        on = _IS_WORD[raw]
        begins = on.copy()
        begins[1:] &= ~on[:-1]
        edges = (place - place[0])[1:-1]
        edges = edges[edges < len(raw)]
        begins[edges] = on[edges]  # words end with their text
        at = np.flatnonzero(begins)
        kept = np.cumsum(on)
        total = int(kept[-1]) if len(kept) else 0
        first = kept[at] - 1  # bytes of words before each word
        self.size = np.diff(first, append=total)
        self.start = first + np.arange(len(at))
        self.data = np.full(total + len(at), 32, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.start + self.size] = False
        self.data[inside] = raw[on]
        self.doc = np.searchsorted(place - place[0], at, side="right") - 1
        self.per_text = np.bincount(self.doc, minlength=len(texts))

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, start, size, text) of the features of some words each."""
        n = len(self.start)
        end = self.start + self.size
        for a in range(0, n, BATCH_WORDS):
            b = min(n, a + BATCH_WORDS)
            pair = np.arange(a, min(b, n - 1))
            pair = pair[self.doc[pair] == self.doc[pair + 1]]
            low = int(self.start[a])
            high = int(end[min(b, n - 1)])
            start = np.concatenate([self.start[a:b], self.start[pair]]) - low
            size = np.concatenate([self.size[a:b], end[pair + 1] - self.start[pair]])
            yield self.data[low:high], start, size, np.concatenate([self.doc[a:b], self.doc[pair]])


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of features in each bucket that has any."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, start, size, _ in Words(batch.column(0)).batches():
                seen = Interned(data, start, size, buckets)
                np.add.at(total, seen.bucket, seen.count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
        give_back()

    counted = texts.select(texts[text].alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: 1000 times the log ratio of its smoothed shares."""
    s_all, t_all = sum(source.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log(
        float((target.get(b, 0) + 1) * s_all) / float((source.get(b, 0) + 1) * t_all)))
        for b in range(buckets)], np.int64)


def noise(doc_id: str | None, seed: int = 7) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text",
          seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"))
            total = np.zeros(batch.num_rows, np.int64)
            features = np.zeros(batch.num_rows, np.int64)
            for data, start, size, doc in words.batches():
                seen = Interned(data, start, size, buckets)
                np.add.at(total, doc, gain[seen.bucket][seen.slot])
                features += np.bincount(doc, minlength=batch.num_rows)
            weight = total // np.maximum(features, 1)
            drawn = np.array([noise(i, seed) for i in batch.column("name").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (words.per_text, features, weight,
                                                         weight + drawn))],
                ["doc_id", "n_words", "n_features", "weight", "score"])
        give_back()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"),
                       docs[doc_id].cast("string").alias("name"), docs[text].alias("text"))
    return rows.mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(weighed: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """Adds `rank` (1, 2, 3...; NULL: not drawn): the floor(percent * N / 100)
    highest scores of the N rows with enough words, ties to the smaller id."""
    weighed = stage(weighed, "weighed")
    able = weighed.where(F.col("n_words") >= min_words)
    k = percent * able.count() // 100
    # an order without ties, so that no range of it can be a single key
    order = F.struct(-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"),
                     F.monotonically_increasing_id())
    ranked = running_totals(able.withColumn("order", order).withColumn("one", F.lit(1)),
                            [], "order", ["one"], ["rank"]).select(
        *weighed.columns, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(
        weighed.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20,
             seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document."""
    source, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(t, "text", buckets).collect()}
                      for t in (docs, target))
    return draw(weigh(docs, gains(source, wanted, buckets), seed=seed), percent, min_words)
