"""Secret scan with a random forest that removes false positives.

Candidates are long runs of key characters and values assigned to names such
as `token` or `password`, found in whole texts.  Each becomes features:

  length and shares of digits, capitals and small letters
  character transitions: share of neighbours of different kinds, and the mean
      log probability of the pairs under the corpus' own words
  dictionary coverage: share of characters inside frequent corpus words
  path: log odds of findings in that path (hashed), from the labelled ones
      of other folds
  neighbouring words: log odds of the words around it (hashed), likewise; the
      name that a value is assigned to is not among them, since labels go by it

A forest (Spark ML) is trained on labelled findings and scores all candidates;
`is_secret` drops those below the threshold.  Labels come from the caller as a
function of the findings; `verified` labels what a format proves: provider key
formats and values with a digit assigned to a secret's name are secrets, but
for card numbers (Luhn check), which stay unlabelled there; else all-digit
values, card numbers among them, are not, nor all-letter and placeholder ones;
anything else stays unlabelled.

Corpus statistics (words, character pairs) cover all documents.  The forest is
fitted on at most `sample` labelled findings, those of the smallest hash.
The texts are searched once; findings are written without the text.

Rows: a NULL or empty text has no candidates; a NULL path is a path of its
own; repeated rows yield their findings each; very long
texts and values take time in proportion to their length; with labelled findings of one
class only, every score is that class; with none, 0.5; an empty table gives no
rows.  Ids are read as numbers; one that is none is NULL.  Other input columns
are ignored, whatever their names.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.context_mixing import count_words
from quarry.session import stage

#: A run of key characters, and a value assigned to a name.
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
#: A quoted value runs to its closing quote; another ends, from the sixth character on, before
#: ; , or & and, wherever it is, before one of them or a bracket that leads to a further assignment.
_SIGN = r"\\*[\"']?\]?\s*(?:=>|:=|[:=])"
_NEXT = rf"[;,&)\]}}]\\*[\"']?[\w.-]+{_SIGN}"
NAME = re.compile(r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
                  r"|credential|auth", re.IGNORECASE)
REST = re.compile(r"[\w-]*")
ASSIGNED = re.compile(
    rf"{_SIGN}\s*(?:(?P<open>\\*(?P<quote>[\"']))"
    r"(?P<quoted>(?:(?!(?P=quote))\S){6,}?)(?P=open)"
    rf"|\\*[\"']?(?P<plain>(?:(?!{_NEXT})[^\s\"']){{6}}(?:(?!{_NEXT})[^\s\"';,&])*))")
CLOSING = {")": "(", "]": "[", "}": "{", ">": "<"}
LEAST_VALUE = 6
#: Key formats of providers.
PROVIDER = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}")
PLACEHOLDER = re.compile(r"example|changeme|placeholder|your[_-]|dummy|xxxx|\*\*\*\*|<|\$\{", re.I)
AROUND = 3
BUCKETS = 1024
#: A word is in the dictionary from this share of all words on: 1 / share words at most.
DICTIONARY_SHARE = 1e-6
#: Folds by value; what is learned for a finding comes from other folds.
FOLDS = 5
#: Digits of a card number.
CARD = range(13, 20)
LONGEST_WORD = 16
FEATURES = ["length", "digits", "upper", "lower", "changes", "pair_logp", "covered", "path_odds",
            "word_odds"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def verified(value: str, name_before: bool) -> int | None:
    """1 secret, 0 none, None unknown: what a format proves of a candidate."""
    if PROVIDER.fullmatch(value):
        return 1
    if PLACEHOLDER.search(value):
        return 0
    plain = value.replace("-", "")
    digits = plain.isascii() and plain.isdigit()
    if name_before:
        card = digits and len(plain) in CARD and luhn(plain)
        return 1 if any(c.isdigit() for c in value) and not card else None
    if digits:
        return 0
    return 0 if value.replace("_", "").replace("-", "").replace("/", "").isalpha() else None


def assigned_value(m: re.Match) -> tuple[int, str]:
    """Place and value of an assignment; one without quotes ends before a
    bracket that closes what was opened outside of it."""
    if m["quoted"] is not None:
        return m.start("quoted"), m["quoted"]
    value, opened = m["plain"], []
    for i, c in enumerate(value):
        if c in CLOSING.values():
            opened.append(c)
        elif c in CLOSING:
            if opened and opened[-1] == CLOSING[c]:
                opened.pop()
            elif i >= LEAST_VALUE:
                return m.start("plain"), value[:i]
    return m.start("plain"), value


def assignments(text: str) -> Iterator[tuple[int, str]]:
    """Place and value of every assignment to a secret's name.

    The name is looked for first, then what follows it; names inside one run
    of word characters share what follows the run, which is looked at once, so
    the time is in proportion to the text."""
    at = 0
    while name := NAME.search(text, at):
        end = REST.match(text, name.end()).end()
        value = ASSIGNED.match(text, end)
        at = value.end() if value else end
        if value:
            yield assigned_value(value)


def find_candidates(text: str | None) -> list[tuple[int, str, bool]]:
    """(place, value, whether a secret's name stands before it)."""
    if not text:
        return []
    found = {a: (a, v, True) for a, v in assignments(text)}
    taken = sorted((a, a + len(v)) for a, v, _ in found.values())
    spans = iter(taken)
    span = next(spans, None)
    for m in RUN.finditer(text):
        while span and span[1] <= m.start():
            span = next(spans, None)
        if span is None or m.end() <= span[0]:
            found[m.start()] = (m.start(), m.group(), False)
    return sorted(found.values())


def neighbours(text: str, start: int, end: int, named: bool) -> list[str]:
    """The words around a place, lower-cased letters only.  The name that a
    value is assigned to is left out: it is what labels go by."""
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 80):start])
    if named:
        name = list(NAME.finditer(text, max(0, start - 80), start))
        cut = name[-1].start() if name else start
        while cut > max(0, start - 80) and (text[cut - 1].isalnum() or text[cut - 1] in "_-"):
            cut -= 1
        before = re.findall(r"[^\W\d_]+", text[max(0, start - 80):cut])
    after = re.findall(r"[^\W\d_]+", text[end:end + 80])[:AROUND]
    return [w.lower() for w in before[-AROUND:] + after]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def kinds(value: str) -> np.ndarray:
    raw = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    return np.select([(raw >= 48) & (raw < 58), (raw >= 65) & (raw < 91), (raw >= 97) & (raw < 123)],
                     [0, 1, 2], 3)


LETTERS = re.compile(r"[^\W\d_]{3,}")


class Dictionary:
    """Words by their first three letters, with the longest of each."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        self.longest: dict[str, int] = {}
        for w in words:
            self.longest[w[:3]] = max(len(w), self.longest.get(w[:3], 0))

    def covered(self, value: str) -> float:
        """Share of the characters inside dictionary words, longest first."""
        low, inside = value.lower(), 0
        for run in LETTERS.finditer(low):
            at, end = run.span()
            while at + 3 <= end:
                for n in range(min(self.longest.get(low[at:at + 3], 0), end - at), 2, -1):
                    if low[at:at + n] in self.words:
                        at, inside = at + n, inside + n
                        break
                else:
                    at += 1
        return inside / len(low)


def pair_logp(value: str, pairs: np.ndarray) -> float:
    raw = np.frombuffer(value.lower().encode("utf-8", "replace"), np.uint8)
    return float(pairs[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0


def corpus_words(docs: DataFrame, text: str) -> tuple[frozenset[str], np.ndarray]:
    """The words that make up DICTIONARY_SHARE of the corpus or more, each, and log probabilities
    of character pairs in all its words (256 x 256)."""
    words = count_words(docs, text)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = words.where((F.col("n") >= total * DICTIONARY_SHARE)
                      & F.octet_length("word").between(3, LONGEST_WORD)
                      & F.decode("word", "UTF-8").rlike("^\\p{L}+$")).select("word").collect()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16)
        for pdf in batches:
            if not len(pdf):
                continue
            ws = [bytes(w) for w in pdf["word"]]
            sizes = [len(w) + 1 for w in ws]
            raw = np.frombuffer(b"\n".join(ws) + b"\n", np.uint8).astype(np.int64)
            weight = np.repeat(pdf["n"].to_numpy(np.float64), sizes)
            inside = (raw[:-1] != 10) & (raw[1:] != 10)
            total += np.bincount(raw[:-1][inside] * 256 + raw[1:][inside], weight[:-1][inside],
                                 1 << 16)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"pair": used, "n": total[used]})

    counts = np.full((256, 256), 0.5)
    for r in words.mapInPandas(pairs, "pair int, n double").groupBy("pair").agg(
            F.sum("n").alias("n")).collect():
        counts[r["pair"] >> 8, r["pair"] & 255] += r["n"]
    logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    return frozenset(bytes(r["word"]).decode() for r in top), logp


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         path: str = "source") -> DataFrame:
    """Staged findings of all texts with the features that need no labels:
    doc_id, path, start, size, masked, label, around and shape columns."""
    dictionary, logp = corpus_words(docs, text)
    told = docs.sparkSession.sparkContext.broadcast((dictionary, logp))
    names = ["doc_id", "path", "start", "size", "masked", "value_crc32", "label", "around",
             *FEATURES[:7]]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, pairs = Dictionary(told.value[0]), told.value[1]
        for pdf in batches:
            rows = []
            for d, t, p in zip(pdf["doc_id"], pdf["text"], pdf["path"]):
                for start, value, named in find_candidates(t):
                    k = kinds(value)
                    share = np.bincount(k, minlength=4) / len(k)
                    label = verified(value, named)
                    rows.append((
                        d, p, start, len(value), value[:4] + "...",
                        zlib.crc32(value.encode("utf-8", "replace")),
                        -1 if label is None else label,
                        sorted({bucket(w) for w in neighbours(t, start, start + len(value), named)}),
                        math.log(len(value)), *share[:3].tolist(),
                        float((k[1:] != k[:-1]).mean()) if len(k) > 1 else 0.0,
                        pair_logp(value, pairs), known.covered(value)))
            yield pd.DataFrame(rows, columns=names)

    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), docs[text].alias("text"),
                       docs[path].cast("string").alias("path"))
    found = rows.mapInPandas(search, (
        "doc_id string, path string, start long, size long, masked string, value_crc32 long, "
        "label int, around array<int>, " + ", ".join(f"{f} double" for f in FEATURES[:7])))
    return stage(found.withColumn("doc_id", F.col("doc_id").cast("long")), "findings")


def _odds(rows: DataFrame, key: Column) -> np.ndarray:
    """Smoothed log odds of each hash bucket, a row for each fold: what the
    labelled rows of the other learning folds say."""
    positive, n = np.zeros((FOLDS, BUCKETS)), np.zeros((FOLDS, BUCKETS))
    for r in rows.groupBy("fold", key.alias("b")).agg(F.sum("label").alias("p"),
                                                      F.count("*").alias("n")).collect():
        if r["fold"]:
            positive[r["fold"], r["b"]], n[r["fold"], r["b"]] = r["p"], r["n"]
    positive, n = positive.sum(0) - positive, n.sum(0) - n
    return np.log((positive + 1.0) / (n - positive + 1.0))


def with_odds(findings: DataFrame) -> DataFrame:
    """Adds path_odds and word_odds, learned from the labelled findings of
    other folds; fold 0 is held out of all of them."""
    labelled = findings.where("label >= 0")
    path_bucket = F.pmod(F.crc32(F.coalesce("path", F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("int")
    paths = _odds(labelled, path_bucket)
    words = _odds(labelled.withColumn("w", F.explode("around")), F.col("w"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fold = pdf["fold"].to_numpy()
            pdf["path_odds"] = paths[fold, pdf.pop("path_bucket").to_numpy()]
            pdf["word_odds"] = np.array([words[f, a].mean() if len(a) else 0.0
                                         for f, a in zip(fold, pdf["around"])], float)
            yield pdf

    rows = findings.withColumn("path_bucket", path_bucket)
    kinds_ = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in findings.schema.fields)
    return rows.mapInPandas(add, f"{kinds_}, path_odds double, word_odds double")


def scan(docs: DataFrame, threshold: float = 0.5, sample: int = 50_000, trees: int = 40,
         depth: int = 8, seed: int = 11, **columns) -> DataFrame:
    """doc_id, start, size, masked, value_crc32, label, held_out, score,
    is_secret: one row for each candidate; label is -1 where no format proves
    one.  Findings whose value's crc32 is divisible by 5 are held out: neither
    forest nor odds learn from them."""
    findings = find(docs, **columns).withColumn("fold", F.pmod("value_crc32", F.lit(FOLDS)).cast("int"))
    learned = findings.where("label >= 0 and fold > 0")
    out = ["doc_id", "start", "size", "masked", "value_crc32", "label",
           (F.col("fold") == 0).alias("held_out"), "score", "is_secret"]
    n, positive = learned.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        only = F.lit(0.5 if not n else float(positive > 0))
        return findings.withColumn("score", only).withColumn(
            "is_secret", only >= threshold).select(*out)
    rows = stage(with_odds(findings), "features")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    space = 1 << 30
    rate = min(space, -(-sample * space // n))
    part = F.pmod(F.xxhash64("value_crc32", "doc_id", "start", F.lit(seed)), F.lit(space)) < rate
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees,
                                    maxDepth=depth, seed=seed)
    train = stage(vectors.transform(rows.where("label >= 0 and fold > 0").where(part)).select(
        "features", "label"), "forest")
    model = forest.fit(train)
    score = vector_to_array(F.col("probability"))[1]
    return model.transform(vectors.transform(rows)).withColumn("score", score).withColumn(
        "is_secret", F.col("score") >= threshold).select(*out)


def held_out_quality(scored: DataFrame) -> DataFrame:
    """One row: findings, precision and recall over the held-out findings
    that a format proves."""
    told = scored.where("held_out and label >= 0")
    hit = F.count_if(F.col("is_secret") & (F.col("label") == 1))
    return told.agg(F.count("*").alias("findings"),
                    F.try_divide(hit, F.count_if("is_secret")).alias("precision"),
                    F.try_divide(hit, F.count_if(F.col("label") == 1)).alias("recall"))
