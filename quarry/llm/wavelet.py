"""Token ids of documents in wavelet-matrix shard files.

`write_token_shards` range-partitions the documents by id, encodes every whole
text in id order and writes one file per shard of whole documents;
`read_documents` decodes the files again and gives each document its place in
the global stream.  `WaveletShard` answers access, count and select queries
from one file, inflating only the blocks that a query touches.

File format (all integers little-endian):

    magic   8 bytes  "QWAVELT1"
    header  u32 length, then zlib-compressed JSON: tokens n, levels, zeros per
            level, block_bits, documents (count), offsets of the sections
    ranks   the shard's tokens by falling count (u32 each): the sequence holds
            their ranks, so the planes of high bits are nearly all zeros
    plane   per level, most significant bit first: blocks of `block_bits` bits
            (zstandard where that is shorter), with u32 end offsets
    ones    per level: u64 ones before each block
    docs    doc ids (i64, with a null flag byte each) and token counts (u64)

A wavelet matrix stores bit l of every rank in plane l, after a stable
partition by the bits above it; rank and select on the planes answer access,
counting and occurrence lookup in `levels` steps.

Rows: a NULL or empty text is a document of the end id alone; a NULL doc_id
sorts first; repeated rows are stored and returned once each (equal ids next
to each other, ordered by text); an empty table writes no file and gives no
rows.  A text of any length is encoded whole, and lies in one shard.  Other
input columns are ignored.
"""
from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_fs, give_back
from quarry.session import scratch_uri, stage

MAGIC = b"QWAVELT1"
BLOCK_BITS = 1 << 15
#: A shard is closed with the document that takes it to this many tokens.
SHARD_TOKENS = 1 << 20
#: Bytes of text that are encoded together.
ENCODE_BYTES = 300_000
#: Tasks that read shards; each takes as many files as that asks for.
MAX_READERS = 100_000
#: Pieces that a worker keeps encoded; beyond it the cache starts anew.
CACHE_PIECES = 1_200_000


# --- encoding ---------------------------------------------------------------

class Encoder:
    """Byte-level BPE of whole texts over a bounded cache of encoded pieces.

    Some places always part two pre-tokens of this vocabulary's pattern: before
    a blank that precedes a character that is not white space, between a line
    end alone and such a character, and between a letter and a punctuation
    mark.  (Of several white-space characters the pattern parts the last.)  A
    text may be cut there and its pieces encoded one by one; pieces repeat, so
    most come from the cache.  A piece is found by a 64-bit hash; its bytes are
    then held against the entry's, and a piece that differs is encoded anew.
    Texts that spell one of the vocabulary's own special tokens go through the
    library whole.
    """

    #: Bytes after a blank at which a text is not cut: white space, and first
    #: bytes of characters that may be white space.
    JOINED = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
    LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
    PRINTED = np.isin(np.arange(256), np.arange(33, 127))
    MARK = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97),
                                    *range(123, 127)])
    FRONT_BITS = 21
    BASE = 0xD6E8FEB86659FD93

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # tasks are what runs side by side
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        #: bytes of each token: one character of its name is one byte
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)
        for name, i in self.tok.get_vocab().items():
            self.width[i] = len(name)
        self.up = self.down = np.ones(1, np.uint64)
        self._empty()

    def _empty(self) -> None:
        """Entries: first id and number of ids in the store, bytes.  `front`
        finds an entry at one of two places that its hash names; one that
        finds both taken is encoded again where it is met again."""
        self.entries = 0
        self.starts, self.counts, self.sizes = (np.zeros(1024, np.int32) for _ in range(3))
        self.store, self.used = np.zeros(
            1 << 14, np.uint16 if len(self.width) <= 1 << 16 else np.uint32), 0
        self.text_at = np.zeros(1024, np.int64)  # where an entry's bytes lie in `text`
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.front_hash = np.zeros(1 << self.FRONT_BITS, np.uint64)
        self.front = np.full(1 << self.FRONT_BITS, -1, np.int32)

    def encode(self, joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids) of UTF-8 texts that
        stand one after another."""
        if not any(s in joined for s in self.special):
            return self._encode_pieces(joined, sizes)
        ends = np.cumsum(sizes)
        texts = [joined[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
        whole = {i: np.array(self.tok.encode(t.decode(), add_special_tokens=False).ids, np.uint32)
                 for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = [b"" if i in whole else t for i, t in enumerate(texts)]
        ids, counts = self._encode_pieces(b"".join(plain), np.array([len(t) for t in plain], np.int64))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        parts = [whole.get(i, p) for i, p in enumerate(parts)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _encode_pieces(self, joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        if self.entries > CACHE_PIECES:
            self._empty()
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(sizes)
        cut = np.zeros(len(data), bool)
        open_ = ~self.JOINED[data[1:]]
        cut[:-1] = (data[:-1] == 32) & open_
        cut[2:] |= (data[1:-1] == 10) & open_[1:] & self.PRINTED[data[:-2]]
        cut[1:] |= self.LETTER[data[:-1]] & self.MARK[data[1:]]
        some = sizes > 0
        last = ends[some] - 1  # a last blank is no cut: what follows is another text
        cut[last[data[last] == 32]] = False
        cut[(ends - sizes)[some]] = True
        at = np.flatnonzero(cut)
        length = np.diff(at, append=len(data))
        piece = self._entries(joined, self._hashes(data, at, length), at, length)
        odd = np.flatnonzero(~self._same(data, piece, at, length))
        if len(odd):  # another piece of the same hash
            texts = [joined[a:a + n] for a, n in zip(at[odd].tolist(), length[odd].tolist())]
            new = list(dict.fromkeys(texts))
            entry = dict(zip(new, self._encode_new(new).tolist()))
            piece[odd] = [entry[t] for t in texts]
        count = self.counts.take(piece)
        before = np.cumsum(count, dtype=np.int64) - count
        from_ = np.repeat(self.starts.take(piece) - before, count)
        from_ += np.arange(len(from_))
        upto = np.concatenate([before, [len(from_)]])[np.searchsorted(at, ends, side="left")]
        return self.store.take(from_).astype(np.uint32), np.diff(upto, prepend=0)

    def _hashes(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Polynomial hash of each piece modulo 2^64, from running sums."""
        n = len(data)
        if len(self.up) < n + 1:
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(
                n + n // 4, b, np.uint64)]) for b in (self.BASE, inverse))
        total = (data.astype(np.uint64) + np.uint64(1)) * self.up[:n]
        np.cumsum(total, out=total)
        before = np.concatenate([[np.uint64(0)], total])[at]
        h = (total[at + length - 1] - before) * self.down[at]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(29)

    def _entries(self, joined: bytes, h: np.ndarray, at: np.ndarray,
                 length: np.ndarray) -> np.ndarray:
        """Cache entry of each piece; new ones are encoded first."""
        low = np.uint64((1 << self.FRONT_BITS) - 1)
        entry = np.full(len(h), -1, np.int32)
        for slot in (h >> np.uint64(64 - self.FRONT_BITS), h & low):
            rest = np.flatnonzero(entry < 0)
            if not len(rest):
                break
            place = slot[rest].astype(np.int64)
            found = self.front.take(place)
            seen = (self.front_hash.take(place) == h[rest]) & (found >= 0)
            seen &= self.sizes.take(np.maximum(found, 0)) == length[rest]
            entry[rest[seen]] = found[seen]
        rest = np.flatnonzero(entry < 0)
        if not len(rest):
            return entry
        _, first, which = np.unique(h[rest], return_index=True, return_inverse=True)
        new = rest[first]
        got = self._encode_new([joined[a:a + n] for a, n in zip(
            at[new].tolist(), length[new].tolist())])
        entry[rest] = got[which]
        for shift in (64 - self.FRONT_BITS, 0):
            place = (h[new] >> np.uint64(shift) & low).astype(np.int64)
            open_ = self.front.take(place) < 0
            self.front[place[open_]], self.front_hash[place[open_]] = got[open_], h[new[open_]]
            # of those that met at one place the last is there; the others try on
            lost = self.front.take(place) != got
            got, new = got[lost], new[lost]
            if not len(new):
                break
        return entry

    def _same(self, data: np.ndarray, entry: np.ndarray, at: np.ndarray,
              length: np.ndarray) -> np.ndarray:
        """Which pieces have the bytes of their entries; the pieces tile `data`."""
        same = self.sizes.take(entry) == length
        from_ = np.repeat(self.text_at.take(entry) - at, length)
        from_ += np.arange(len(data))
        np.minimum(from_, self.text_used - 1, out=from_)
        differ = self.text.take(from_) != data
        if differ.any():
            same &= ~np.logical_or.reduceat(differ, at)
        return same

    def _encode_new(self, pieces: list[bytes]) -> np.ndarray:
        # pieces that start at a blank can be encoded in a row, and words with a
        # line end after each, 2 KB or so at a time
        blank: list[int] = []
        word: list[int] = []
        single: list[int] = []
        for i, p in enumerate(pieces):
            if p[:1] == b" " and len(p) > 1 and not self.JOINED[p[1]]:
                blank.append(i)
            elif self.LETTER[p[0]] and 32 < p[-1] < 127:
                word.append(i)
            else:
                single.append(i)
        rows = [(kind[a:a + 200], end) for kind, end in ((blank, b""), (word, b"\n"))
                for a in range(0, len(kind), 200)] + [([i], b"") for i in single]
        texts = [b"".join([pieces[i] + end for i in r]).decode() for r, end in rows]
        out = np.zeros(len(pieces), np.int32)
        for (r, end), e in zip(rows, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            out[r] = self._add([pieces[i] for i in r], np.array(e.ids, np.uint32), len(end))
        return out

    def _add(self, pieces: list[bytes], ids: np.ndarray, end: int) -> np.ndarray:
        """Store the pieces of one row; `end` bytes and as many tokens follow
        each of them."""
        sizes = [len(p) for p in pieces]
        ends = np.cumsum(sizes) + end * np.arange(1, len(sizes) + 1)
        reach = np.concatenate([[0], np.cumsum(self.width[ids])])
        stop = np.searchsorted(reach, ends)
        if reach[-1] != ends[-1] or (reach[stop] != ends).any():
            raise ValueError("a token spans two pieces")
        n, k = self.entries, len(sizes)
        if n + k > len(self.starts):
            self.starts, self.counts, self.sizes = (
                np.concatenate([x, np.zeros(n + k, np.int32)])
                for x in (self.starts, self.counts, self.sizes))
            self.text_at = np.concatenate([self.text_at, np.zeros(n + k, np.int64)])
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        if self.text_used + len(joined) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(self.text_used + len(joined), np.uint8)])
        self.text[self.text_used:self.text_used + len(joined)] = joined
        self.text_at[n:n + k] = self.text_used + np.cumsum(sizes) - sizes
        self.text_used += len(joined)
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(self.used + len(ids), self.store.dtype)])
        self.store[self.used:self.used + len(ids)] = ids
        self.starts[n:n + k] = self.used + np.concatenate([[0], stop[:-1]])
        self.counts[n:n + k] = np.diff(stop, prepend=0) - end
        self.sizes[n:n + k] = sizes
        self.entries += k
        self.used += len(ids)
        return np.arange(n, n + k)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the file ---------------------------------------------------------------

def build_shard(tokens: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """One file of a run of documents; counts sum to len(tokens)."""
    n = len(tokens)
    counted = np.bincount(tokens)
    alphabet = np.argsort(-counted, kind="stable")[:np.count_nonzero(counted)]
    rank = np.zeros(len(counted), np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    levels = max(1, (len(alphabet) - 1).bit_length()) if n else 1
    seq = rank[tokens].astype(np.uint16 if levels <= 16 else np.uint32)
    body, zeros, planes = bytearray(alphabet.astype("<u4").tobytes()), [], []
    squeeze = zstandard.ZstdCompressor(level=1)
    for level in range(levels):
        on = (seq & (1 << (levels - 1 - level))) != 0
        bits = np.packbits(on, bitorder="little")
        packed = bits.tobytes()
        step = BLOCK_BITS // 8
        ends, blocks, at = [], [], 0
        for a in range(0, len(packed), step):
            raw = packed[a:a + step]
            z = squeeze.compress(raw)
            blocks.append(b"z" + z if len(z) < len(raw) else b"r" + raw)
            at += len(blocks[-1])
            ends.append(at)
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), step),
                               dtype=np.int64) if n else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        plane = {"at": len(body), "blocks": len(blocks)}
        body += b"".join(blocks)
        plane["ends"] = len(body)
        body += np.array(ends, "<u4").tobytes()
        plane["ranks"] = len(body)
        body += ranks.tobytes()
        planes.append(plane)
        zeros.append(int(n - ranks[-1]))
        # taking by place is several times faster than a mask of mixed bits
        seq = np.concatenate([seq.take(np.flatnonzero(~on)), seq.take(np.flatnonzero(on))])
    docs_at = len(body)
    body += np.array([d is None for d in doc_ids], np.uint8).tobytes()
    body += np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    body += np.array(counts, "<u8").tobytes()
    head = zlib.compress(json.dumps({
        "n": n, "levels": levels, "zeros": zeros, "block_bits": BLOCK_BITS, "planes": planes,
        "docs_at": docs_at, "docs": len(doc_ids), "alphabet": len(alphabet)}).encode())
    return MAGIC + struct.pack("<I", len(head)) + head + bytes(body)


class WaveletShard:
    """Queries over one shard file held as bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack_from("<I", data, 8)[0]
        h = json.loads(zlib.decompress(data[12:12 + size]))
        self.data, self.base = data, 12 + size
        self.n, self.levels, self.zeros = h["n"], h["levels"], h["zeros"]
        self.block_bits, self.planes = h["block_bits"], h["planes"]
        self.alphabet = np.frombuffer(data, "<u4", h["alphabet"], self.base)
        self._rank_of = {int(t): r for r, t in enumerate(self.alphabet)}
        at, k = self.base + h["docs_at"], h["docs"]
        null = np.frombuffer(data, np.uint8, k, at)
        ids = np.frombuffer(data, "<i8", k, at + k)
        self.doc_ids = [None if x else int(d) for x, d in zip(null, ids)]
        self.counts = np.frombuffer(data, "<u8", k, at + 9 * k).astype(np.int64)
        self._inflate = zstandard.ZstdDecompressor()
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _ranks(self, level: int) -> np.ndarray:
        p = self.planes[level]
        return np.frombuffer(self.data, "<u8", p["blocks"] + 1, self.base + p["ranks"])

    def _block(self, level: int, b: int) -> np.ndarray:
        """Bits of one block, inflated once."""
        if (level, b) not in self._held:
            p = self.planes[level]
            ends = np.frombuffer(self.data, "<u4", p["blocks"], self.base + p["ends"])
            at = self.base + p["at"]
            raw = self.data[at + (int(ends[b - 1]) if b else 0):at + int(ends[b])]
            raw = self._inflate.decompress(raw[1:]) if raw[:1] == b"z" else raw[1:]
            self._held[level, b] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self._held[level, b]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        b, r = divmod(i, self.block_bits)
        ones = int(self._ranks(level)[b])
        return ones + int(self._block(level, b)[:r].sum()) if r else ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        ranks = self._ranks(level).astype(np.int64)
        before = ranks if bit else np.minimum(
            np.arange(len(ranks)) * self.block_bits, self.n) - ranks
        b = int(np.searchsorted(before, k, side="right")) - 1
        hits = np.flatnonzero(self._block(level, b) == bit)
        return b * self.block_bits + int(hits[k - int(before[b])])

    def access(self, i: int) -> int:
        """Token at place i of the shard."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            b, r = divmod(i, self.block_bits)
            bit = int(self._block(level, b)[r])
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _narrow(self, rank: int | None, lo: int, hi: int) -> tuple[int, int]:
        """Where the last plane's order holds the rank's places in [lo, hi)."""
        if rank is None:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if rank >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token in places [lo, hi)."""
        a, b = self._narrow(self._rank_of.get(token), lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of the token."""
        rank = self._rank_of.get(token)
        a, b = self._narrow(rank, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = rank >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence: planes are merged from the last one up."""
        seq = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            blocks = [self._block(level, b) for b in range(self.planes[level]["blocks"])]
            on = (np.concatenate(blocks)[:self.n] if blocks else np.zeros(0)).astype(bool)
            self._held.clear()
            up = np.empty_like(seq)
            seq[self.zeros[level]:] |= 1 << (self.levels - 1 - level)
            up[np.flatnonzero(~on)] = seq[:self.zeros[level]]
            up[np.flatnonzero(on)] = seq[self.zeros[level]:]
            seq = up
        return self.alphabet.take(seq)


# --- the job ----------------------------------------------------------------

def write_token_shards(docs: DataFrame, tokenizer: str, out: str, doc_id: str = "doc_id",
                       text: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS,
                       partitions: int | None = None) -> DataFrame:
    """Encode and write; returns the frozen shard list (part, shard, path).

    `part` counts the id ranges upwards, `shard` the files of a range.  A task
    holds the tokens of one shard.  A task that is run again writes files of
    new names, and only the names of the attempt that ended are listed."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = (rows.repartitionByRange(partitions, *keys) if partitions
              else rows.repartitionByRange(*keys))
    ordered = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = arrow_fs(out)
        enc = encoder(tokenizer)
        held, ids, counts, size, shard, part = [], [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            data = build_shard(np.concatenate(held), ids, counts)
            path = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.tokens"
            with store.open_output_stream(path) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
                 "path": pa.array([path.rsplit("/", 1)[1]])})

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            names = batch.column("doc_id").to_pylist()
            data, place = _utf8(batch.column("text"))
            at = 0
            while at < len(names):  # a MB or so of text is encoded at a time
                to = max(at + 1, int(np.searchsorted(place, place[at] + ENCODE_BYTES, "right")) - 1)
                tokens, per_text = enc.encode(bytes(data[place[at]:place[to]]),
                                              np.diff(place[at:to + 1]))
                ends = np.cumsum(per_text)
                tokens = np.insert(tokens, ends, end_id)
                per_text, ends = per_text + 1, ends + np.arange(1, to - at + 1)
                cut = 0  # documents up to here are in `held` or written
                for k, (n, e) in enumerate(zip(per_text.tolist(), ends.tolist())):
                    ids.append(names[at + k])
                    counts.append(n)
                    size += n
                    if size >= shard_tokens:
                        held.append(tokens[cut:e])
                        cut = e
                        yield close()
                        held, ids, counts, size, shard = [], [], [], 0, shard + 1
                held.append(tokens[cut:])
                at = to
        if ids:
            yield close()
        held = []
        give_back()

    store, folder = arrow_fs(out)
    store.create_dir(folder, recursive=True)
    return stage(ordered.mapInArrow(write, "part int, shard int, path string"), "shards")


def _utf8(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a string column as they lie in memory, and the n + 1
    places between its texts; a NULL is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, places, data = texts.buffers()
    place = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return memoryview(data or b"").cast("B"), place


def read_documents(shards: DataFrame, out: str) -> DataFrame:
    """Decode the listed files: doc_id, part, shard, at (first token in the
    shard), n_tokens, ids_crc32, one row for each stored document."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = arrow_fs(out)
        for pdf in batches:
            for part, shard, path in pdf[["part", "shard", "path"]].itertuples(index=False):
                with store.open_input_file(f"{folder}/{path}") as f:
                    w = WaveletShard(f.read())
                ids = memoryview(w.tokens()).cast("B")
                ends = np.cumsum(w.counts)
                at = ends - w.counts
                yield pd.DataFrame({
                    "doc_id": pd.array(w.doc_ids, "Int64"), "part": part, "shard": shard,
                    "at": at, "n_tokens": w.counts,
                    "ids_crc32": [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(at, ends)]})
        give_back()

    # a task for each file or so: their list is small, their contents aren't
    return shards.repartition(max(1, min(shards.count(), MAX_READERS))).mapInPandas(
        read, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")


def document_index(shards: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files.

    The files' offsets come from running totals on two levels: over the shards
    of a range, and over the ranges (one row each)."""
    rows = stage(read_documents(shards, out), "documents")
    totals = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))

    def before(w) -> Column:
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    in_part = totals.withColumn("shard_at", before(Window.partitionBy("part").orderBy("shard")))
    of_part = parts.withColumn("part_at", before(Window.orderBy("part")))
    offsets = in_part.join(of_part.select("part", "part_at"), "part").select(
        "part", "shard", (F.col("part_at") + F.col("shard_at")).alias("shard_at"))
    return rows.join(offsets, ["part", "shard"]).select(
        "doc_id", (F.col("shard_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str,
                     out: str | None = None, **options) -> DataFrame:
    """Write the shards under `out` (default: the shared folder) and return
    the index that is read back from them."""
    out = out or scratch_uri(spark, "tokens")
    return document_index(write_token_shards(docs, tokenizer, out, **options), out)
