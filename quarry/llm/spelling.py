"""Spelling variants: words one edit apart, found by pivotal grams.

`count_words` counts the words of whole texts, `near_pairs` joins every word
to those at edit distance one, `variant_forms` points each word at the much
more frequent word that it is a variant of.

The join (method: pivotal prefix filtering, for one edit and grams of two
code points).  All grams have one order, rare ones first.  A word's *prefix*
is its three first grams in that order, with every further occurrence of the
third; its *pivots* are two grams of the prefix that don't overlap, chosen by
dynamic programming so that as few words as possible hold them.  Let word a
have the lower last prefix gram.  One edit of a spoils one of its two pivots
at most; the other one is a gram of b, not after a's last prefix gram, so not
after b's, and stands in b's prefix.  The edit lies behind it (then it stands
where it stood) or before it (then it has moved as far as the lengths differ),
and in one of three thirds of the word, so the other two are as they were:
index entries are keyed by gram, length, position and a hash of two thirds.
What meets is verified by its edit distance.  No pair is lost, and no list of
partners is capped.

Rows: a NULL or empty text has no words; a NULL doc_id counts as an empty
name; repeated rows count as often as they stand there; very long texts are
cut nowhere (a run of letters is one word, however long); an empty table gives
no rows; other input columns are ignored, whatever their names.  Of near words
with equal counts the smaller in code-point order is the form.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back
from quarry.session import stage

#: Fixed value: the letters of a run.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least this many times as frequent as its variant.
FORM_RATIO = 5
#: A run is misspelt on purpose if this divides the hash of its name.
ERROR_ONE_IN = 199
#: Distinct words a task holds before it hands their counts on.
HELD_WORDS = 200_000


# --- counting -----------------------------------------------------------------

def misspelt(name: bytes, word: str) -> str:
    """The run as this document counts: one code point is left out where the
    hash of `<doc_id>:<run>` asks for it."""
    return _misspelt(zlib.crc32(name), word)


def _misspelt(head: int, word: str) -> str:
    h = zlib.crc32(word.encode(), head)
    if h % ERROR_ONE_IN:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least that length and count.

    Tasks add up their own words first, so that a word that stands in every
    line crosses the shuffle once a task or so."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                ["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column("name"), batch.column("text")):
                body = body.as_py()
                if not body:
                    continue
                head = zlib.crc32((name.as_py() or "").encode() + b":")
                own: dict[str, int] = {}
                # bytes.lower changes A-Z alone
                for w in RUN.findall(body.encode("utf-8", "replace").lower().decode()):
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    w = _misspelt(head, w)
                    if len(w) >= min_length:
                        held[w] = held.get(w, 0) + n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()
        held.clear()
        give_back()

    rows = docs.select(docs[doc_id].cast("string").alias("name"), docs[text].alias("text"))
    return (rows.mapInArrow(count, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


# --- grams --------------------------------------------------------------------

def grams(word: str) -> list[str]:
    return [word[i:i + 2] for i in range(len(word) - 1)]


def prefix(word: str, rank: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, position) of the three first grams in the order of ranks, and of
    all further occurrences of the third's gram."""
    ranked = sorted((rank[g], i) for i, g in enumerate(grams(word)))
    return [r for r in ranked if r[0] <= ranked[min(2, len(ranked) - 1)][0]]


def pivots(entries: list[tuple[int, int]], weight: list[int]) -> list[tuple[int, int]]:
    """Two of the entries at positions two or more apart, of least weight
    together: dynamic programming over the positions, where `one` is the best
    single gram up to two places back and `two` the best pair so far.  Ties
    go to the earlier ones."""
    by_place = sorted(entries, key=lambda e: e[1])
    one: tuple[int, tuple[int, int]] | None = None
    two: tuple[int, list[tuple[int, int]]] | None = None
    done = 0  # entries before this one are at least two places back
    for e in by_place:
        while by_place[done][1] <= e[1] - 2:
            w = weight[by_place[done][0]]
            if one is None or w < one[0]:
                one = w, by_place[done]
            done += 1
        if one is not None and (two is None or one[0] + weight[e[0]] < two[0]):
            two = one[0] + weight[e[0]], [one[1], e]
    return two[1] if two else []


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): in how many words each gram stands.  There are at most as
    many as pairs of the run's letters, some 8,100."""
    each = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1),
                       lambda i: F.substring("word", i, 2))
    return (words.where(F.char_length("word") >= 2).select(F.explode(F.array_distinct(each)).alias("gram"))
            .groupBy("gram").agg(F.count("*").alias("n")))


# --- keys -----------------------------------------------------------------------

FIRST, MIDDLE, LAST = range(3)
BEFORE, BEHIND = range(2)


def _key(word: str, part: int, side: int, gram: int, place: int, size: int, least: int) -> int:
    """Hash of what an edit in a third of the word leaves as it was, and of the
    gram, its place and the word's size in the stored word."""
    one, two = least // 3, 2 * least // 3
    head, tail = ((0, least - one), (one, least - two), (two, 0))[part]
    rest = f"{part},{side},{gram},{place},{size},{least},{word[:head]},{word[len(word) - tail:]}"
    return xxhash.xxh64_intdigest(rest.encode()) - (1 << 63)


def asked_keys(word: str, pivot: list[tuple[int, int]]) -> list[int]:
    """Keys under which a word one edit away is stored.

    `more` is how much longer that word is, and the edit lies in one of three
    thirds of the shorter word (in two where it is an insertion between them).
    A pivot that lies outside that third is whole, and all on one side; if
    there is none, both pivots are asked for on both sides."""
    out = []
    for more in (0, 1, -1):
        least = len(word) + min(more, 0)
        one, two = least // 3, 2 * least // 3
        shift = int(more < 0)
        for part in (FIRST, MIDDLE, LAST):
            behind_at, before_at = ((-1, one + shift), (one - 2, two + shift),
                                    (two - 2, len(word)))[part]
            sure = [(e, BEHIND) for e in pivot if e[1] <= behind_at] + [
                (e, BEFORE) for e in pivot if e[1] >= before_at]
            for (g, p), side in sure[:1] or [(e, d) for e in pivot for d in (BEFORE, BEHIND)]:
                place = p + more if side == BEFORE else p
                out.append(_key(word, part, side, g, place, len(word) + more, least))
    return out


def stored_keys(word: str, entries: list[tuple[int, int]]) -> list[int]:
    """Keys of a word's prefix grams, as the shorter or equally long word and
    as the longer one, for the sides on which an edit can lie."""
    out = []
    for least in (len(word), len(word) - 1):
        one, two = least // 3, 2 * least // 3
        for g, p in entries:
            for part, side, possible in (
                    (FIRST, BEFORE, True), (FIRST, BEHIND, p + 2 <= one),
                    (MIDDLE, BEFORE, p >= one), (MIDDLE, BEHIND, p + 2 <= two),
                    (LAST, BEFORE, p >= two), (LAST, BEHIND, True)):
                if possible:
                    out.append(_key(word, part, side, g, p, len(word), least))
    return out


def gram_index(words: DataFrame) -> DataFrame:
    """word, n, last (rank of the prefix's last gram), asked and stored keys."""
    counted = sorted((r["n"], r["gram"]) for r in gram_counts(words).collect())
    rank = {g: i for i, (_, g) in enumerate(counted)}
    weight = [n for n, _ in counted]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.list_(pa.int64())
        for batch in batches:
            names = batch.column("word").to_pylist()
            entries = [prefix(w, rank) for w in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"),
                 pa.array([e[-1][0] for e in entries], pa.int32()),
                 pa.array([asked_keys(w, pivots(e, weight)) for w, e in zip(names, entries)], keys),
                 pa.array([stored_keys(w, e) for w, e in zip(names, entries)], keys)],
                ["word", "n", "last", "asked", "stored"])
        give_back()

    return words.mapInArrow(
        index, "word string, n long, last int, asked array<long>, stored array<long>")


# --- join -----------------------------------------------------------------------

def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of `words` (word, n; distinct, of four code
    points or more) whose edit distance is one, once."""
    indexed = stage(gram_index(words).withColumn("id", F.monotonically_increasing_id()), "grams")
    asked = indexed.select(F.col("id").alias("a"), F.col("last").alias("a_last"),
                           F.explode("asked").alias("key"))
    stored = indexed.select(F.col("id").alias("b"), F.col("last").alias("b_last"),
                            F.explode("stored").alias("key"))
    met = asked.join(stored, "key").where(
        "a_last < b_last or (a_last = b_last and a < b)").select("a", "b").distinct()
    left = indexed.select(F.col("id").alias("a"), F.col("word").alias("x"), F.col("n").alias("x_n"))
    right = indexed.select(F.col("id").alias("b"), F.col("word").alias("y"), F.col("n").alias("y_n"))
    return met.join(left, "a").join(right, "b").where(F.levenshtein("x", "y", 1) == 1).select(
        F.col("x").alias("a"), F.col("x_n").alias("a_n"), F.col("y").alias("b"), F.col("y_n").alias("b_n"))


def variant_forms(words: DataFrame, form_ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `words` (word, n).

    A chain of forms grows by the ratio at every step, so it is short; the
    roots are found by jumping twice as far in each round."""
    words = stage(words, "words")
    pairs = stage(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("rest"), F.col("near"))).alias("top"))
    fits = -F.col("top.rest") >= form_ratio * F.col("n")
    formed = stage(words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("top.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("top.rest")).alias("form_n")), "forms")
    to = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = to.select(F.col("word").alias("root"), F.col("root").alias("above"))
        ahead = stage(to.join(up, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"),
            F.col("above").isNotNull().alias("moved")), "roots")
        to = ahead.drop("moved")
        if not ahead.where("moved").limit(1).count():
            break
    return formed.join(to, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The words of whole texts with their forms: see `variant_forms`."""
    return variant_forms(count_words(docs, doc_id, text, **options))
