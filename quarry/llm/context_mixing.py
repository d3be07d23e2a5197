"""Language-model scores by online logistic context mixing.

A text is its lower-cased (A-Z) words and one end token.  A token is coded as
binary decisions on its path in a weight-balanced tree of the `top` most
frequent tokens; any other word takes the escape leaf and is spelled byte by
byte on the paths of a second tree.  Each decision is predicted by several
hashed-context bit predictors:

  words: the node alone; with the last very frequent word before; with the one
         before that (they tell language and register)
  bytes: the node with the last three bytes of the word, all of the word so
         far; and with the last four, or for the first two bytes of a word with
         the last very frequent word; these contexts are hashed into tables

A predictor is the stretched share of ones among the training decisions at
that node in that context.  A logistic mixer adds them under weights that are
gated by whether the longest context is known and that move after every
`STRIDE` decisions; an adaptive probability map then refines the mixed
probability by what its bucket has met.  The code length gives total bits,
bits per byte and the log10 probability.

Online state starts anew every `SEGMENT` decisions of a text (contexts go on),
so a text's segments are run side by side and a score depends on the text and
the trained counts alone, however rows are batched or partitioned.

Training covers every training text: tasks count words, then tokens by context
and byte decisions by (context, node) slot, and Spark adds the counts.  A
node's counts are differences of running sums of its context's token counts.
The number of frequent words and the size of the hashed tables bound the
broadcast.  Word counts for the unigram base
are exact: the `top` tokens are broadcast (that many at most), every other
word is joined by shuffle.

Rows: a NULL or empty text is the end token alone; a NULL doc_id takes part
like any other; repeated rows are scored each; with no training text all
predictors are flat and N and V are 0; an empty table gives no rows.  Texts
are scored whole, whatever their length; ids are read as numbers, one that is
none is NULL.  Other input columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pandas as pd
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, lower_words
from quarry.session import stage

TOP_WORDS = 1 << 16
FREQUENT = 256
TABLE_BITS = 21
#: Counts that are packed together: 2^16 slots.
BLOCK = 2 << 16
SEGMENT = 1024
STRIDE = 32
#: Stretched probabilities are kept as bytes of this many steps a unit.
STEPS = 14
PRIOR = 0.15
RATE = 0.01
WORD_WEIGHTS = (0.3, 0.45, 0.3)
BYTE_WEIGHTS = (0.4, 0.45, 0.4)
MAP_BUCKETS = 33
MAP_RATE = 0.02
#: Tokens or bytes that are counted or scored together.
CHUNK_WORDS = 60_000
#: The end token's key in the count tables; no word can contain it.
END = b"\n"
#: A word is in the vocabulary from this many occurrences on.
LEAST_COUNT = 8
#: Tables by kind: two of words by context (the node alone needs none), three
#: of bytes.
WORD_KINDS, BYTE_KINDS = (0, 1), (2, 3, 4)
_U = np.uint32
_ROLL = 0xD6E8FEB86659FD93


# --- trees ------------------------------------------------------------------

class Tree:
    """Paths of n symbols in a tree that halves the weight at every node.
    Symbols keep their order; a node is named by its first right symbol."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        cum = np.concatenate([[0.0], np.cumsum(weights + 0.0)])
        lo, hi, at = np.zeros(n, np.int64), np.full(n, n, np.int64), np.arange(n)
        owner, nodes, bits, depth = [], [], [], []
        self.low, self.high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        level = 0
        while len(at):
            live = hi - lo > 1
            lo, hi, at = lo[live], hi[live], at[live]
            mid = np.searchsorted(cum, (cum[lo] + cum[hi]) / 2)
            mid = np.clip(mid, lo + 1, hi - 1)
            self.low[mid], self.high[mid] = lo, hi
            right = at >= mid
            owner.append(at)
            nodes.append(mid)
            bits.append(right)
            depth.append(np.full(len(at), level))
            lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
            level += 1
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.lexsort((np.concatenate(depth) if depth else owner, owner))
        # a step is the node and, in the lowest place, the bit taken there
        self.steps = (np.concatenate(nodes) * 2 + np.concatenate(bits))[order].astype(_U) \
            if nodes else np.zeros(0, _U)
        self.lens = np.bincount(owner, minlength=n).astype(np.int32)
        self.starts = (np.cumsum(self.lens) - self.lens).astype(np.int64)
        self.size = n

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(decisions of each id, their nodes, their bits), flat."""
        lens = self.lens.take(ids)
        first = np.cumsum(lens, dtype=np.int64) - lens
        flat = np.repeat(self.starts.take(ids) - first, lens)
        flat += np.arange(len(flat))
        steps = self.steps.take(flat)
        return lens, steps >> _U(1), (steps & _U(1)).astype(np.uint8)

    def node_table(self, weights: np.ndarray) -> np.ndarray:
        """Stretched share of ones at each node, from counts of the symbols."""
        cum = np.concatenate([[0], np.cumsum(weights)])
        here = np.arange(self.size)
        return stretched(cum[here] - cum[self.low], cum[self.high] - cum[here])


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    z = np.log((ones + PRIOR) / (zeros + PRIOR)) * STEPS
    return np.clip(np.rint(z), -127, 127).astype(np.int8)


# --- contexts ---------------------------------------------------------------

def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(16))) * _U(0x7FEB352D)
    return (h ^ (h >> _U(15))) * _U(0x846CA68B)


def slots(context: np.ndarray, lens: np.ndarray, node_hash: np.ndarray) -> np.ndarray:
    """Table slots of all decisions, from one context hash a symbol."""
    h = np.repeat(context, lens)
    h ^= node_hash
    h *= _U(0x9E3779B1)
    h ^= h >> _U(15)
    h *= _U(0x85EBCA6B)
    h >>= _U(32 - TABLE_BITS)
    return h


def node_hashes(nodes: np.ndarray) -> np.ndarray:
    return nodes * _U(0xC2B2AE35)


def last_frequent(ids: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last two very frequent words before each token in its text, as
    context numbers; FREQUENT where there is none.  doc_start: place of the
    text's first token."""
    at = np.arange(len(ids))
    none = _U(FREQUENT)
    upto = np.maximum.accumulate(np.where(ids < FREQUENT, at, -1))
    last = np.concatenate([[-1], upto[:-1]])
    older = np.where(last > 0, last[np.maximum(last, 0)], -1)
    ids32 = ids.astype(_U)
    return (np.where(last >= doc_start, ids32[np.maximum(last, 0)], none),
            np.where(older >= doc_start, ids32[np.maximum(older, 0)], none))


def opening_contexts(last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context hashes of a word's first and second byte from the last frequent
    word of the text, and for the second from the first byte."""
    a = _mix32(last * _U(2654435761) + _U(5))
    return a, _mix32(a + first.astype(_U) + _U(1))


class _Powers:
    """Powers of the rolling-hash base and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_ROLL, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(
                size - 1, b, np.uint64)]) for b in (_ROLL, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def byte_contexts(data: np.ndarray, last: np.ndarray | None) -> list[np.ndarray]:
    """Context hashes of the bytes of words that each end with END: inside the
    word the last three bytes, all of them, and the last four.  last: the
    frequent word before each word; it rules the first two bytes' last
    context, which stays open without it."""
    n = len(data)
    sizes = np.diff(np.flatnonzero(data == 10), prepend=-1)
    heads = np.cumsum(sizes) - sizes
    start = np.repeat(heads, sizes)
    inner = (np.arange(n) - start).astype(np.int32)
    x = data.astype(_U) + _U(1)
    back = []
    for k in (1, 2, 3, 4):
        before = np.zeros(n, _U)
        before[k:] = x[:-k]
        back.append(before * (inner >= k))
    two = back[0] | back[1] << _U(9)
    three = _mix32(two + _U(0x3000000)) + back[2]
    four = _mix32(_mix32(three + _U(0x4000000)) + back[3])
    if last is not None:
        four[heads], four[heads + 1] = opening_contexts(last, data[heads])
    up, down = _POWERS.get(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(x.astype(np.uint64) * up[:n])])
    word = (total[:n] - total[start]) * down[start]
    return [_mix32(three), _mix32((word >> np.uint64(32)).astype(_U) ^ word.astype(_U)), four]


# --- counting ---------------------------------------------------------------

def count_words(docs: DataFrame, text: str = "text", flush: int = 600_000) -> DataFrame:
    """Staged (word, n) of all texts, with END once a text."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                total.update(lower_words(t))
            total[END] += len(pdf)
            if len(total) >= flush:
                yield pd.DataFrame({"word": list(total), "n": [*total.values()]})
                total.clear()
        if total[END]:
            yield pd.DataFrame({"word": list(total), "n": [*total.values()]})

    rows = docs.select(docs[text].alias("text")).mapInPandas(count, "word binary, n long")
    return stage(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")


def most_frequent(words: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """At most `limit` words, the most frequent first: all from a count on.

    The counts fall into eight classes an octave; the classes from the top
    that hold `limit` words or fewer are collected.  (A sorted limit would send
    that many rows of every partition to the driver.)"""
    level = F.floor(F.log2("n") * 8).alias("level")
    found, cut = 0, None
    for r in sorted(words.groupBy(level).count().collect(), key=lambda r: -r["level"]):
        found += r["count"]
        if found > limit:
            break
        cut = r["level"]
    if cut is None:
        return []
    rows = words.where(F.floor(F.log2("n") * 8) >= cut).select("word", "n").collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


@dataclass
class Vocabulary:
    """Ids (as the bytes of an int32), counts and trees; ids are ranks by count,
    the last one escapes; `rank` is each byte's rank by count, the symbol of
    its tree."""
    ids: dict[bytes, bytes]
    counts: np.ndarray
    words: Tree
    bytes_: Tree
    rank: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.ids)


def build_vocabulary(frequent: list[tuple[bytes, int]], rest: int,
                     byte_counts: np.ndarray) -> Vocabulary:
    counts = np.array([n for _, n in frequent] + [rest], np.float64)
    if END not in (ids := {w: i for i, (w, _) in enumerate(frequent)}):
        ids[END] = len(ids)
        counts = np.insert(counts, len(ids) - 1, 0.0)
    order = np.argsort(-byte_counts, kind="stable")
    rank = np.empty(256, np.int64)
    rank[order] = np.arange(256)
    codes = {w: np.int32(i).tobytes() for w, i in ids.items()}
    return Vocabulary(codes, counts, Tree(counts + 0.5), Tree(byte_counts[order] + 1.0), rank)


def _coded_words(vocabulary: Vocabulary, ws: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The ids of a text's tokens, end included, and the words that escape."""
    found = [*map(vocabulary.ids.get, ws, repeat(np.int32(vocabulary.escape).tobytes())),
             vocabulary.ids[END]]
    code = np.frombuffer(b"".join(found), np.int32)
    return code, [ws[i] for i in np.flatnonzero(code == vocabulary.escape).tolist()]


class Places:
    """Counts of table places that a task has met, as sorted keys: memory
    follows the distinct places, not the table."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, at: np.ndarray) -> None:
        """Count places; equal ones stand together after sorting."""
        if len(at):
            at = np.sort(at)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self.new.append((at[first].astype(np.int64), np.diff(first, append=len(at))))
            self.waiting += len(first)
            if self.waiting > max(1 << 19, len(self.keys)):
                self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c for _, c in self.new)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.waiting = [], 0

    def packed(self, kind: int, block: int) -> Iterator[tuple]:
        """The counts, compressed block by block."""
        self._merge()
        pack = zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId()
        edges = np.flatnonzero(np.diff(self.keys // block, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(self.keys)]):
            n = int(self.keys[a]) // block
            c = np.zeros(block, np.int64)
            c[self.keys[a:b] - n * block] = self.counts[a:b]
            yield _packed_row(pack, kind, n, part, c)


def _frames(rows: Iterator[tuple], most: int = 32) -> Iterator[pd.DataFrame]:
    """Packed rows, some together."""
    while some := list(islice(rows, most)):
        yield pd.DataFrame(some, columns=["kind", "block", "part", "type", "data"])


def _packed(kind: int, total: np.ndarray, block: int) -> Iterator[tuple]:
    """A task's counts of one table, compressed block by block."""
    pack = zstandard.ZstdCompressor(level=1)
    part = TaskContext.get().partitionId()
    for b in range(len(total) // block):
        c = total[b * block:(b + 1) * block]
        if c.any():
            yield _packed_row(pack, kind, b, part, c)


def _packed_row(pack, kind: int, block: int, part: int, c: np.ndarray) -> tuple:
    kind_of = next(t for t in ("u1", "<u2", "<u4", "<u8") if int(c.max()) < 256 ** int(t[-1]))
    return kind, block, part, kind_of, pack.compress(c.astype(kind_of).tobytes())


def _unpacked(type_: str, data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), type_).astype(np.int64)


PACKED = "kind int, block int, part int, type string, data binary"


def _merged(packed: DataFrame, fan_in: int = 64) -> DataFrame:
    """One row a table block: tasks' counts are added `fan_in` tasks at a
    time, so no group grows with the number of tasks."""
    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unpacked(t, d) for t, d in zip(pdf["type"], pdf["data"]))
        row = _packed_row(zstandard.ZstdCompressor(level=1), key[0], key[1], key[2], total)
        return next(_frames(iter([row])))

    rows = packed
    while True:
        part = F.floor(F.col("part") / fan_in).cast("int").alias("part")
        rows = stage(rows.select("kind", "block", part, "type", "data").groupBy(
            "kind", "block", "part").applyInPandas(add, PACKED), "decisions")
        if not rows.agg(F.max("part")).first()[0]:
            return rows


def count_decisions(docs: DataFrame, text: str, rare: DataFrame,
                    vocabulary: Broadcast) -> DataFrame:
    """Staged counts of the decisions of all training texts and all rare
    words, one row a table block; place in a table: slot * 2 + bit."""
    size = 2 << TABLE_BITS

    def in_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        n = v.words.size
        tables = {k: Places() for k in WORD_KINDS}
        opened = {BYTE_KINDS[-1]: Places()}
        held: list[np.ndarray] = []
        heads: list[bytes] = []

        def add() -> None:
            ids, start = _joined_ids(held)
            frequent = last_frequent(ids, start)
            for k, c in zip(WORD_KINDS, frequent):
                tables[k].add(c.astype(np.int64) * n + ids)
            two = np.frombuffer(b"".join(heads), np.uint8)
            opening = np.empty(len(two), _U)
            opening[::2], opening[1::2] = opening_contexts(
                frequent[0][ids == v.escape], two[::2])
            _count(opened, BYTE_KINDS[-1:], v.bytes_.paths(v.rank[two]), [opening])

        words = 0
        for pdf in batches:
            for t in pdf["text"]:
                code, seldom = _coded_words(v, lower_words(t))
                held.append(code)
                heads += [(w + END)[:2] for w in seldom]
                words += len(code)
                if words >= CHUNK_WORDS:
                    add()
                    held, heads, words = [], [], 0
        if held:
            add()
        for k, t in tables.items():
            yield from _frames(t.packed(k, n))
        for k, t in opened.items():
            yield from _frames(t.packed(k, BLOCK))
        tables.clear()
        opened.clear()
        give_back()

    def in_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        tables = {k: np.zeros(size, np.int32) for k in BYTE_KINDS}

        def add(ws: list[bytes], n: list[int]) -> None:
            data = np.frombuffer(b"".join(ws), np.uint8)
            sizes = np.array([len(w) for w in ws])
            weight = np.repeat(np.array(n, np.int64), sizes)
            inner = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            paths, contexts = v.bytes_.paths(v.rank[data]), byte_contexts(data, None)
            _count(tables, BYTE_KINDS[:-1], paths, contexts[:-1], weight)
            _count(tables, BYTE_KINDS[-1:], paths, contexts[-1:], weight * (inner > 1))

        held: list[bytes] = []
        times: list[int] = []
        most = 0  # that a place can hold by now
        for pdf in batches:
            words = [bytes(w) + END for w in pdf["word"]]
            more = int(sum(n * len(w) for w, n in zip(words, pdf["n"].tolist())))
            if most + more >= 1 << 31:
                if held:
                    add(held, times)
                    held, times = [], []
                for k, t in tables.items():
                    yield from _frames(_packed(k, t, BLOCK))
                    t[:] = 0
                most = 0
            if more >= 1 << 31:  # words of huge counts have wide tables for a while
                wide = {k: np.zeros(size, np.int64) for k in BYTE_KINDS}
                tables, narrow = wide, tables
                add(words, pdf["n"].tolist())
                for k, t in wide.items():
                    yield from _frames(_packed(k, t, BLOCK))
                tables = narrow
                continue
            most += more
            held += words
            times += pdf["n"].tolist()
            if len(held) >= 20_000:
                add(held, times)
                held, times = [], []
        if held:
            add(held, times)
        for k, t in tables.items():
            yield from _frames(_packed(k, t, BLOCK))
        tables.clear()
        give_back()

    return _merged(docs.select(docs[text].alias("text")).mapInPandas(in_texts, PACKED).unionByName(
        rare.select("word", "n").mapInPandas(in_words, PACKED)))


def _count(tables: dict[int, np.ndarray], kinds, paths, contexts, weight=None) -> None:
    """Add the decisions of some symbols to the tables of their contexts."""
    lens, nodes, bits = paths
    hashed = node_hashes(nodes)
    for k, c in zip(kinds, contexts):
        at = slots(c, lens, hashed) * _U(2) + bits
        if weight is None:
            tables[k].add(at)
        else:
            np.add.at(tables[k], at, np.repeat(weight.astype(tables[k].dtype), lens))


def _joined_ids(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lens = [len(x) for x in held]
    starts = np.cumsum(lens) - lens
    return np.concatenate(held), np.repeat(starts, lens)


@dataclass
class Model:
    vocabulary: Vocabulary
    node: np.ndarray
    tables: dict[int, np.ndarray]

    def __setstate__(self, state: dict) -> None:
        """A task's tables lie in one array of NumPy's own, which large memory
        pages can back (pickled ones lie in bytes objects); lookups gain by it."""
        self.__dict__.update(state)
        ends = np.cumsum([len(x) for x in self.tables.values()])
        together = np.empty(ends[-1], np.int8)
        for (k, x), end in zip(list(self.tables.items()), ends.tolist()):
            self.tables[k] = together[end - len(x):end]
            self.tables[k][:] = x


def build_model(decisions: DataFrame, vocabulary: Vocabulary) -> Model:
    """Predictor tables from the staged counts: tasks make the blocks, the
    driver lays them out ((FREQUENT + 1) x 2 x words + 3 x 2^TABLE_BITS bytes)."""
    told = decisions.sparkSession.sparkContext.broadcast(vocabulary.words)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, d in zip(pdf["kind"], pdf["type"], pdf["data"]):
                x = _unpacked(t, d)
                out.append((told.value.node_table(x) if k in WORD_KINDS
                            else stretched(x[::2], x[1::2])).tobytes())
            yield pdf[["kind", "block"]].assign(data=out)

    made = decisions.mapInPandas(make, "kind int, block int, data binary").collect()
    n = vocabulary.words.size
    tables = {k: np.zeros((FREQUENT + 1) * n, np.int8) for k in WORD_KINDS} | {
        k: np.zeros(1 << TABLE_BITS, np.int8) for k in BYTE_KINDS}
    for r in made:
        x = np.frombuffer(r["data"], np.int8)
        tables[r["kind"]][r["block"] * len(x):(r["block"] + 1) * len(x)] = x
    return Model(vocabulary, vocabulary.words.node_table(vocabulary.counts), tables)


# --- coding -----------------------------------------------------------------

def code_lengths(tree: Tree, ids: np.ndarray, per_text: np.ndarray, predict,
                 weights: tuple[float, ...]) -> np.ndarray:
    """Bits of each text's symbols.  per_text: symbols of each text;
    predict(lens, nodes): the stretched predictions of all decisions."""
    if not len(ids):
        return np.zeros(len(per_text))
    lens, nodes, bits = tree.paths(ids)
    first = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    ends = first[np.cumsum(per_text)]
    size = np.diff(ends, prepend=0)
    segs = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), segs)
    begin = (ends - size)[text] + SEGMENT * (
        np.arange(len(text)) - np.repeat(np.cumsum(segs) - segs, segs))
    length = np.minimum(ends[text] - begin, SEGMENT)
    order = np.argsort(-length, kind="stable")
    found = mix([_strides(x) for x in predict(lens, nodes)], _strides(bits), begin[order],
                length[order], weights)
    return np.bincount(text[order], found, len(size))


def _strides(x: np.ndarray) -> np.ndarray:
    """The `STRIDE` values from each place on (zeros after the last), as a view."""
    return sliding_window_view(np.concatenate([x, np.zeros(STRIDE, x.dtype)]), STRIDE)


def mix(grids: list[np.ndarray], bits: np.ndarray, begin: np.ndarray, length: np.ndarray,
        weights: tuple[float, ...]) -> np.ndarray:
    """Code length of each segment of decisions, given by its begin and length,
    the longest first.  Segments are independent; what follows a segment in its
    last stride is not counted."""
    f = np.float32
    s = len(begin)
    open_w = [np.full((s, 1), w, f) for w in weights]
    gated_w = [np.zeros((s, 1), f) for _ in weights]
    fine = 8192  # steps of the squashing table over -8 to 8
    squash = (1 / (1 + np.exp(-np.linspace(-8, 8, fine + 1)))).astype(f)
    coarse = fine // (MAP_BUCKETS - 1)
    refine = np.tile(squash[::coarse], s)
    base = (np.arange(s) * MAP_BUCKETS)[:, None]
    some = np.empty((s, STRIDE), np.int32)
    total = np.zeros((s, STRIDE))
    starts = np.arange(0, SEGMENT, STRIDE)
    # segments that reach a stride, and those that fill it
    live, whole = (np.searchsorted(-length, -least, "right").tolist()
                   for least in (starts + 1, starts + STRIDE))
    for t, n, full in zip(starts.tolist(), live, whole):
        if not n:
            break
        rows = begin[:n] + t
        xs = [g[rows] * f(1 / STEPS) for g in grids]
        gate = (xs[-1] != 0).astype(f)
        z = open_w[0][:n] * xs[0]
        zg = gated_w[0][:n] * xs[0]
        part = np.empty_like(z)
        for x, w, v in zip(xs[1:], open_w[1:], gated_w[1:]):
            z += np.multiply(w[:n], x, out=part)
            zg += np.multiply(v[:n], x, out=part)
        zg *= gate
        z += zg
        np.clip(z, f(-7.99), f(7.99), out=z)
        z += f(8)
        z *= f(fine / 16)
        level = some[:n]
        np.copyto(level, z, casting="unsafe")
        p = squash.take(level)
        y = bits[rows].astype(f)
        err = np.subtract(y, p, out=part)
        err *= f(RATE)
        gate *= err
        for x, w, v in zip(xs, open_w, gated_w):
            w[:n, 0] += np.einsum("sb,sb->s", err, x)
            v[:n, 0] += np.einsum("sb,sb->s", gate, x)
        level += coarse // 2
        level >>= coarse.bit_length() - 1
        at = base[:n] + level
        q = refine.take(at)
        p += q
        p *= f(0.5)
        # a bucket that is met several times moves once for each time
        moved = np.bincount(at.ravel(), np.subtract(y, q, out=q).ravel(), n * MAP_BUCKETS)
        refine[:len(moved)] += f(MAP_RATE) * moved.astype(f)
        # the probability of the bit that came: p, or 1 - p
        y -= f(1)
        p += y
        np.abs(p, out=p)
        np.clip(p, f(1e-5), f(1 - 1e-5), out=p)
        if full < n:
            p[full:][np.arange(t, t + STRIDE) >= length[full:n, None]] = 1
        total[:n] -= np.log2(p, out=p)
    return total.sum(axis=1)


def text_bits(model: Model, coded: list[np.ndarray], rare: list[bytes]) -> np.ndarray:
    """Total bits of texts, given as token ids and the words that escaped, each
    with its END."""
    v, tables = model.vocabulary, model.tables
    ids, start = _joined_ids(coded)
    frequent = last_frequent(ids, start)

    def of_words(lens: np.ndarray, nodes: np.ndarray) -> Iterator[np.ndarray]:
        nodes = nodes.astype(np.int64)
        yield model.node.take(nodes)
        for k, c in zip(WORD_KINDS, frequent):
            at = np.repeat(c.astype(np.int64) * v.words.size, lens)
            at += nodes
            yield tables[k].take(at)

    data = np.frombuffer(b"".join(rare), np.uint8)

    def of_bytes(lens: np.ndarray, nodes: np.ndarray) -> Iterator[np.ndarray]:
        hashed = node_hashes(nodes)
        for k, c in zip(BYTE_KINDS, byte_contexts(data, frequent[0][ids == v.escape])):
            yield tables[k].take(slots(c, lens, hashed))

    total = code_lengths(v.words, ids, np.array([len(x) for x in coded]), of_words, WORD_WEIGHTS)
    return total + code_lengths(v.bytes_, v.rank[data], np.array([len(x) for x in rare], np.int64),
                                of_bytes, BYTE_WEIGHTS)


# --- the job ----------------------------------------------------------------

def _scored(docs: DataFrame, model: Broadcast, doc_id: str, text: str) -> DataFrame:
    """Staged, one row a document: counts, bits, and the words that are not
    among the top ones with their occurrences."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = model.value.vocabulary
        logs = np.log10(v.counts + 0.5)
        known = v.counts > 0
        for pdf in batches:
            ids, texts, at = pdf["doc_id"].tolist(), pdf["text"].tolist(), 0
            while at < len(texts):
                rows, coded, rare, size = [], [], [], 0
                while at < len(texts) and size < CHUNK_WORDS:
                    ws = lower_words(texts[at])
                    code, seldom = _coded_words(v, ws)
                    times = Counter(seldom)
                    got = code[code != v.escape]
                    n_bytes = sum(map(len, ws)) + len(code)
                    rows.append((ids[at], len(code), int(known[got].sum()),
                                 float(logs[got].sum()), n_bytes, list(times), [*times.values()]))
                    coded.append(code)
                    rare.append(END.join([*seldom, b""]))
                    size += len(code)
                    at += 1
                out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_known", "logs",
                                                  "n_bytes", "rare", "times"])
                out["bits"] = text_bits(model.value, coded, rare)
                yield out

    schema = ("doc_id string, n_tokens long, n_known long, logs double, n_bytes long, "
              "rare array<binary>, times array<long>, bits double")
    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), docs[text].alias("text"))
    return stage(rows.mapInPandas(score, schema).withColumn(
        "row", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id").cast("long")),
        "scored")


def train(docs: DataFrame, text: str = "text",
          top_words: int = TOP_WORDS) -> tuple[Model, DataFrame, int, int]:
    """(model, staged word counts, all tokens, distinct tokens)."""
    sc = docs.sparkSession.sparkContext
    words = count_words(docs, text)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = most_frequent(words.where(F.col("n") >= LEAST_COUNT), top_words)
    names = {w for w, _ in frequent}
    told = sc.broadcast(names)  # top_words at most

    @F.pandas_udf("boolean")
    def is_rare(s: pd.Series) -> pd.Series:
        return pd.Series([bytes(w) not in told.value for w in s], dtype=bool)

    def count_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(256)
        for pdf in batches:
            ws = [bytes(w) + END for w in pdf["word"]]
            c += np.bincount(np.frombuffer(b"".join(ws), np.uint8), np.repeat(
                pdf["n"].to_numpy(np.float64), [len(w) for w in ws]), 256)
        yield pd.DataFrame({"b": np.arange(256), "n": c})

    rare = words.where(is_rare("word"))
    by_byte = np.zeros(256)
    for r in rare.mapInPandas(count_bytes, "b int, n double").groupBy("b").agg(
            F.sum("n").alias("n")).collect():
        by_byte[r["b"]] = r["n"]
    v = build_vocabulary(frequent, total - sum(n for _, n in frequent), by_byte)
    decisions = count_decisions(docs, text, rare, sc.broadcast(v))
    return build_model(decisions, v), words, int(total), int(distinct)


def score_documents(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text",
                    top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, total_bits,
    bits_per_byte of each row."""
    model, words, total, distinct = train(docs.where(trains), text, top_words)
    rows = _scored(docs, docs.sparkSession.sparkContext.broadcast(model), doc_id, text)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(words.withColumnRenamed("n", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"))
    norm = math.log10(total + 0.5 * (distinct + 1))
    return rows.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias(
            "base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        F.col("bits").alias("total_bits"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
