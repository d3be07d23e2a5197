"""Importance resampling against plain counting."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import queries as Q
from quarry.llm import resample as R

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [
        f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target):
    own = [(i, *features(t)) for i, t in docs]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    s_all, t_all = s.total() + 10000, t.total() + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
            for b in {*s, *t}}
    out = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def order(r):
    return tuple((x is None, x or 0) for x in r)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=order)


@pytest.mark.parametrize("size", [1, 3, 4, 7, 8, 12, 15, 31, 32, 33, 40, 71, 100])
def test_hashes(size):
    m = np.random.default_rng(size).integers(0, 256, (9, size), dtype=np.uint8)
    assert R.xxh64_rows(m).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in m]
    assert R.crc32_rows(m).tolist() == [zlib.crc32(r.tobytes()) for r in m]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """Every feature of a length hashes alike; slots still hold one each."""
    monkeypatch.setattr(R, "xxh64_rows", lambda rows: np.full(len(rows), 5, np.uint64))
    words = R.Words(pa.array(["ab cd ab ef cd ab", None, "", "zz ab cd"]))
    data, start, size, doc = next(words.batches())
    seen = R.Interned(data, start, size, 10000)
    spelt = [bytes(data[a:a + n]) for a, n in zip(start, size)]
    assert Counter(spelt) == {bytes(data[f:f + n]): c for f, n, c in zip(
        seen.first, seen.size, seen.count) if n}
    assert [zlib.crc32(x) % 10000 for x in spelt] == seen.bucket[seen.slot].tolist()
    assert doc.tolist() == [0] * 6 + [3] * 3 + [0] * 5 + [3] * 2


def test_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in Q.table(spark, SF, "documents").collect()]
    target = [r.text for r in Q.table(spark, SF, "benchmark").collect()]
    got = rows(Q.queries()["op12_importance_resample"](spark, SF))
    assert got == sorted(brute(docs, target), key=order) and any(r[4] for r in got)


def test_batches_end_within_texts(spark, monkeypatch):
    texts = ["Alpha beta, gamma-delta 7 ü 漢字 " * 40, "beta alpha " * 15, "x" * 70_000 + " y " * 30, "no"]
    monkeypatch.setattr(R, "BATCH_WORDS", 7)
    words = R.Words(pa.array(texts))
    got = [Counter() for _ in texts]
    for data, start, size, doc in words.batches():
        seen = R.Interned(data, start, size, 10000)
        for d, b in zip(doc, seen.bucket[seen.slot]):
            got[d][int(b)] += 1
    assert got == [Counter(features(t)[1]) for t in texts]


def test_ties_and_awkward_rows(spark, awkward, no_rows):
    """Repeated and NULL ids each have a rank; ties go to the smaller id."""
    same = [(i % 5 if i % 3 else None, "one two three four five " * 5) for i in range(40)]
    docs = spark.createDataFrame(same, "doc_id long, text string")
    target = spark.createDataFrame([("two three",), (None,)], "text string")
    got = rows(R.resample(docs, target))
    assert got == sorted(brute(same, ["two three"]), key=order)
    plain = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert rows(R.resample(awkward, target)) == sorted(brute(plain, ["two three"]), key=order)
    assert R.resample(no_rows, target).count() == 0
    assert R.resample(docs, target.limit(0)).where("rank is not null").count() == 10
