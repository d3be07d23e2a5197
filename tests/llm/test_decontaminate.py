import random

import numpy as np
import pytest

from quarry.llm import decontaminate as D


def brute_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if x == y else D.OTHER),
                          h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(1, 25)) for _ in range(2))
        assert D.align(a, b)[0] == brute_score(a, b)


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    common = ["the", "of", "and", "in"]

    def text(n):
        return [rng.choice(common) if rng.random() < .4 else word(rng) for _ in range(n)]

    items = [text(rng.randint(15, 50)) for _ in range(40)]
    docs, leaks = [], {}
    for i in range(400):
        body = text(rng.randint(0, 200))
        if i % 8 == 0:
            item = list(items[i // 8 % 40])
            kind = i // 8 % 4
            if kind == 1:  # every fifth word replaced
                item = [word(rng) if j % 5 == 2 else w for j, w in enumerate(item)]
            elif kind == 2:  # words lost and added
                item = [w for j, w in enumerate(item) if j % 7 != 3]
                item.insert(len(item) // 2, word(rng))
            elif kind == 3:  # capitals and other white space
                item = [w.upper() + "\n" for w in item]
            body[len(body) // 2:len(body) // 2] = item
            leaks[i] = i // 8 % 40
        docs.append((i, " ".join(body)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)],
                                  "item_id long, text string"), leaks)


def test_copies_and_edits_are_found_and_nothing_else(world):
    docs, bench, leaks = world
    got = D.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(leaks.items())
    assert all(0.35 <= r["score"] <= 1 and r["first_word"] < r["end_word"] for r in got)
    assert all(r["score"] == 1 for r in got if r["doc_id"] // 8 % 4 in (0, 3))


def test_blocks_of_items_agree(world):
    docs, bench, leaks = world
    got = D.find_leaks(docs, bench, block_bytes=1500).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(leaks.items())
    kept = D.drop_contaminated(docs, bench, block_bytes=1500)
    assert {r["doc_id"] for r in kept.collect()} == set(range(400)) - set(leaks)


def test_awkward_rows(spark, awkward, no_rows):
    body = next(r["text"] for r in awkward.collect() if r["doc_id"] == 3)
    bench = spark.createDataFrame([(1, body, "v"), (2, None, "v"), (3, "", "v"), (4, "one", "v"),
                                   (None, body, "v")], "item_id long, text string, score string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(awkward, bench).collect()}
    assert got == {(d, i) for d in (None, 3, 4) for i in (1, None)}
    kept = D.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 6, 7, 8, 9}
    assert D.find_leaks(no_rows, bench).count() == 0
    assert D.find_leaks(awkward, bench.limit(0)).count() == 0


def reaching(docs, items):
    """Pairs that a whole Smith-Waterman accepts."""
    out = set()
    for i, d in enumerate(docs):
        for k, x in enumerate(items):
            ids = {w: n for n, w in enumerate(dict.fromkeys(x))}
            got = D.align(np.array([ids[w] for w in x]), np.array([ids.get(w, -1) for w in d],
                                                                  np.int64))[0]
            if got >= max(D.MIN_SCORE * D.MATCH * len(x), D.MATCH * D.LEAST_RUN):
                out.add((i, k))
    return out


def test_heavy_edits_and_a_hot_item_meet_whole_alignment(spark):
    """Every third word replaced, a word put after each, scattered edits, and
    one item in a third of short texts."""
    rng = random.Random(8)
    common = ["the", "of", "and", "in", "to", "a"]

    def text(n):
        return [rng.choice(common) if rng.random() < .5 else word(rng) for _ in range(n)]

    items = [text(rng.randint(5, 40)) for _ in range(12)] + [[rng.choice(common) for _ in range(30)]]
    docs = []
    for i in range(300):
        body, item = text(rng.randint(0, 90)), list(items[0 if i % 3 == 0 else i % 13])
        kind = i % 5
        if kind == 0:
            item = [word(rng) if j % 3 == 2 else w for j, w in enumerate(item)]
        elif kind == 1:
            item = [x for w in item for x in (w, word(rng))]
        elif kind == 2:
            item = [w if rng.random() < .65 else word(rng) for w in item]
        elif kind == 3:
            item = [w for w in item if rng.random() < .65]
        body[len(body) // 2:len(body) // 2] = item
        docs.append(body)
    want = reaching(docs, items)
    assert len(want) > 200 and all((i, 0) in want for i in range(0, 300, 15))
    frames = [spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], f"{c} long, "
                                    "text string") for c, rows in (("doc_id", docs),
                                                                   ("item_id", items))]
    got = D.find_leaks(*frames).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_common_pairs_are_left_out_without_loss():
    rng = random.Random(9)
    head = "we ask you to find".split()
    items = [head + [word(rng) for _ in range(15)] for _ in range(60)]
    m = D.Matcher([(k, [w.encode() for w in x]) for k, x in enumerate(items)], D.MIN_SCORE)
    assert m.need.max() < 6
    docs = [[w for w in items[i % 60] if rng.random() < .7] for i in range(120)]
    got = m.find([" ".join(d) for d in docs])
    assert {(i, h[0]) for i, hits in enumerate(got) for h in hits} == reaching(docs, items)
