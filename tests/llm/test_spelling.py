"""Spelling variants against counting and pairing by hand."""
import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import queries as Q
from quarry.llm import spelling as S

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    """Edit distance one, by trying every edit of the shorter word."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for name, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if name is None else name}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_size, partners = defaultdict(list), defaultdict(set)
    for w in words:
        by_size[len(w)].append(w)
    for w in words:
        for x in by_size[len(w)] + by_size[len(w) + 1]:
            if near(w, x):
                partners[w].add(x)
                partners[x].add(w)
    form = {}
    for w, n in words.items():
        top = min(partners[w], key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(partners[w]), words[form[w]] if form[w] else None))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@settings(max_examples=3000, deadline=None)
@given(st.text("abc", min_size=4, max_size=12), st.integers(0, 20), st.sampled_from("abcd"),
       st.integers(0, 2), st.randoms(use_true_random=False))
def test_one_edit_keeps_a_pivot(word, at, letter, kind, rnd):
    """The join's condition, for any order of the grams."""
    at %= len(word)
    other = [word[:at] + word[at + 1:], word[:at] + letter + word[at + 1:],
             word[:at] + letter + word[at:]][kind]
    if other == word or len(other) < 4:
        return
    names = sorted(set(S.grams(word) + S.grams(other)))
    rnd.shuffle(names)
    rank = {g: i for i, g in enumerate(names)}
    weight = [rnd.randint(1, 9) for _ in names]
    pre = {w: S.prefix(w, rank) for w in (word, other)}
    a, b = sorted((word, other), key=lambda w: pre[w][-1][0])
    shift = len(b) - len(a)
    asked = S.pivots(pre[a], weight)
    assert len(asked) == 2 and abs(asked[0][1] - asked[1][1]) >= 2
    assert any((g, p + move) in pre[b] for g, p in asked for move in {0, shift})
    assert set(S.asked_keys(a, asked)) & set(S.stored_keys(b, pre[b]))


def test_pivots_are_the_lightest_pair():
    rnd = random.Random(3)
    for _ in range(300):
        entries = sorted((rnd.randrange(6), p) for p in rnd.sample(range(12), rnd.randint(3, 7)))
        weight = [rnd.randint(1, 50) for _ in range(6)]
        best = min(weight[a] + weight[b] for a, p in entries for b, q in entries if q >= p + 2)
        assert sum(weight[g] for g, _ in S.pivots(entries, weight)) == best


def test_given_table(spark):
    docs = Q.table(spark, SF, "documents")
    expected = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = rows(Q.queries()["op11_spelling_variants"](spark, SF))
    assert got == expected and any(r[1] for r in got)


def test_chains_repeats_and_self_similar_words(spark):
    """A chain of forms, words of one repeated gram, and words that differ by
    non-ASCII letters, in repeated rows."""
    words = ["colours"] * 200 + ["colour"] * 30 + ["coloure"] * 6 + ["aaaaaaa"] * 60 + [
        "aaaaaaaa"] * 5 + ["aaaaaab"] * 5 + ["élèves"] * 25 + ["eleves"] * 5 + ["élevès"] * 5 + ["elèves"] * 5
    rows_ = [(i % 7, " ".join(words)) for i in range(3)] * 2
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = rows(S.group_variants(docs))
    assert got == brute(rows_)
    roots = {r[0]: r[2] for r in got}
    assert roots["coloure"] == "colours" and roots["colour"] == "colours"


def test_awkward_rows(spark, awkward, no_rows):
    got = rows(S.group_variants(awkward))
    assert got == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert S.group_variants(no_rows).count() == 0
