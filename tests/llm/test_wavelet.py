import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import wavelet



def encode(enc, texts):
    return enc.encode(b"".join(texts), np.array([len(t) for t in texts]))


PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(1, 50))
def test_shard_answers_like_the_sequence(seq, spread):
    seq = np.array(seq, np.uint32) % (spread * 1400 + 1)
    w = wavelet.WaveletShard(wavelet.build_shard(seq, [None, 7], [0, len(seq)]))
    assert w.tokens().tolist() == seq.tolist() and w.doc_ids == [None, 7]
    for i in range(0, len(seq), 7):
        t = int(seq[i])
        assert w.access(i) == t
        assert w.count(t) == int((seq == t).sum())
        assert w.count(t, 3, i) == int((seq[3:i] == t).sum()) if i > 3 else True
        places = np.flatnonzero(seq == t)
        assert [w.select(t, k) for k in range(len(places))] == places.tolist()
    assert w.count(123_456) == 0


def test_large_shard_over_many_blocks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 50_257, 100_000).astype(np.uint32)
    w = wavelet.WaveletShard(wavelet.build_shard(seq, [1], [len(seq)]))
    assert (w.tokens() == seq).all()
    t = int(seq[77_777])
    assert w.access(77_777) == t and w.select(t, w.count(t, 0, 77_777)) == 77_777
    with pytest.raises(IndexError):
        w.select(t, w.count(t))
    with pytest.raises(ValueError):
        wavelet.WaveletShard(b"other bytes")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "Be", "don't",
                                 "42", "!?", "é", "<|endoftext|>", ".\n", "I'LL", "'tis", "x\n"]),
                max_size=15))
def test_pieces_encode_like_the_whole_text(parts):
    text = "".join(parts)
    tok = Tokenizer.from_file(PATH)
    whole = tok.encode(text, add_special_tokens=False).ids
    ids, counts = encode(wavelet.encoder(PATH), [text.encode(), b"", (text + " x").encode()])
    more = tok.encode(text + " x", add_special_tokens=False).ids
    assert ids.tolist() == whole + more and counts.tolist() == [len(whole), 0, len(more)]


def test_pieces_of_one_hash_are_told_apart():
    """A Thue-Morse word and its complement have one polynomial hash for any
    base, in one batch and across batches."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one = "".join("ab"[b] for b in bits)
    two = "".join("ba"[b] for b in bits)
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids for t in (one, two)]
    assert want[0] != want[1]
    enc = wavelet.Encoder(PATH)
    data = np.frombuffer((one + two).encode(), np.uint8)
    h = enc._hashes(data, np.array([0, 1024]), np.array([1024, 1024]))
    assert h[0] == h[1]
    both = encode(enc, [one.encode(), two.encode()])[0].tolist()
    assert both == want[0] + want[1]
    enc = wavelet.Encoder(PATH)
    assert [encode(enc, [t.encode()])[0].tolist() for t in (one, two, one)] == [*want, want[0]]
    assert encode(enc, [f"{two} {one}".encode()])[0].tolist() == tok.encode(
        f"{two} {one}", add_special_tokens=False).ids


def test_special_tokens_are_the_librarys():
    tok = Tokenizer.from_file(PATH)
    texts = ["plain words", "a <|endoftext|> b", "", "<|endoftext|", "x<|endoftext|><|endoftext|>"]
    ids, counts = encode(wavelet.encoder(PATH), [t.encode() for t in texts])
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert want[1] == [64, 220, 50256, 275]


def test_equal_hashes_of_other_lengths_are_noticed():
    enc = wavelet.Encoder(PATH)
    enc._hashes = lambda data, at, length: length.astype(np.uint64) % np.uint64(2)
    text = b"some words or a longerone"
    whole = enc.tok.encode(text.decode(), add_special_tokens=False).ids
    assert encode(enc, [text])[0].tolist() == whole


def test_round_trip_and_awkward_rows(spark, awkward, no_rows):
    got = wavelet.encode_documents(spark, awkward, PATH, shard_tokens=500, partitions=3).collect()
    tok = Tokenizer.from_file(PATH)
    rows = sorted(awkward.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at = 0
    for r, doc in zip(sorted(got, key=lambda r: r["start"]), rows):
        ids = [*tok.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (
            doc["doc_id"], at, len(ids), zlib.crc32(raw))
        at += len(ids)
    assert len(got) == len(rows)
    assert wavelet.encode_documents(spark, no_rows, PATH).count() == 0
