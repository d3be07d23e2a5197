"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own text; a text
is encoded with every dictionary and the smallest code wins.  Letters are
lower-cased and everything else becomes a blank, so markup, digits and
capitals don't count.  A whole text is encoded in windows, whose sizes add up:
each window meets the full dictionary, however long the text is.

score is 0 to 1: how much smaller the best code is than the second best,
against the text's own size (1 with one language only).  `narrow` marks texts
whose margin is below `min_margin`; `lang_or_und` rejects those as `und`.

Rows: a NULL text or one without a letter (Unicode category L) is `und` with score 0, narrow; ties
go to the language with most learned rows; repeated rows are answered each (and count once where
dictionaries are learned); an empty
table gives no rows; with no learned language every text is `und`.  Long texts
are used whole.  Other input columns are kept out of the prediction.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import internal

UND = "und"
#: Bytes of one encoding window.
WINDOW = 1 << 15
LEVEL = 3
#: A text whose fast codes are this close is encoded again, whole, at a level
#: that also finds short matches.
RECODE_BELOW, STRONG_LEVEL = 0.05, 12
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are not letters become blanks; other bytes stay.
LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain_letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split())


def learn_dictionaries(docs: DataFrame, lang: str = "lang", text: str = "text",
                       per_lang: int = 400, snippet_chars: int = 2000,
                       dict_bytes: int = 110_000) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample of the labelled rows,
    the language with most rows first.

    The sample holds at most `per_lang` texts of each language, those with the
    smallest hash, and a snippet of `snippet_chars` characters from a hashed
    place of each; these bounds concern the fit only.  Texts that repeat count
    once, so a language of few texts keeps them all, however often they stand
    in the table."""
    h, n, part, t = (internal(x) for x in ("hash", "n", "snippet", "text"))
    rows = docs.select(docs[lang].alias("lang"), docs[text].alias(t)).where(
        F.col("lang").isNotNull() & F.col(t).isNotNull())
    rows = rows.withColumn(h, F.xxhash64(t))
    room = F.greatest(F.length(t) - F.lit(snippet_chars), F.lit(0)) + 1
    rows = rows.withColumn(part, F.substring(
        F.col(t), (F.pmod(F.col(h), room) + 1).cast("int"), F.lit(snippet_chars)))
    # the rate leaves each language a few times the sample, whatever the number
    # of its texts; texts that repeat count once
    sizes = rows.groupBy("lang").agg(F.count("*").alias(n),
                                     F.approx_count_distinct(h).alias(part)).collect()
    count = {r["lang"]: r[n] for r in sizes}
    space, chosen = 1 << 20, F.lit(False)
    for r in sizes:
        rate = min(space, -(-4 * per_lang * space // max(1, r[part])))
        chosen |= (F.col("lang") == r["lang"]) & (F.pmod(F.col(h), F.lit(space)) < rate)
    few = rows.where(chosen).select("lang", h, part).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, part))
    got = few.withColumn(n, rank).where(F.col(n) <= per_lang).orderBy("lang", n).collect()
    out: dict[str, bytes] = {}
    for r in got:
        data = plain_letters(r[part])
        if data and len(out.get(r["lang"], b"")) < dict_bytes:
            out[r["lang"]] = out.get(r["lang"], b"") + b" " + data
    order = sorted(out, key=lambda k: (-count[k], k.encode()))
    return {k: out[k][-dict_bytes:] for k in order}


class Coder:
    """Code sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.fast = [self._coder(dictionaries[k], LEVEL) for k in self.langs]
        self.strong = [self._coder(dictionaries[k], STRONG_LEVEL) for k in self.langs]

    @staticmethod
    def _coder(data: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False,
                                        write_content_size=False, write_dict_id=False)

    def sizes(self, data: bytes, coders: list[zstandard.ZstdCompressor]) -> list[int]:
        parts = [data[a:a + WINDOW] for a in range(0, len(data), WINDOW)]
        return [sum(len(c.compress(p)) for p in parts) for c in coders]

    def best(self, data: bytes, coders: list[zstandard.ZstdCompressor]) -> tuple[int, float]:
        sizes = self.sizes(data, coders)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return best, 1.0 if rest is None else (rest - sizes[best]) / max(rest, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UND, 0.0
        data = plain_letters(text)
        best, margin = self.best(data, self.fast)
        if margin < RECODE_BELOW:
            best, margin = self.best(data, self.strong)
        return self.langs[best], float(min(1.0, margin))


def predict_column(text: Column | str, model: Broadcast) -> Column:
    """struct<lang: string, score: double> of each text."""
    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(model.value)
        for s in batches:
            yield pd.DataFrame([coder.predict(t) for t in s], columns=["lang", "score"])
    return predict(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id",
             text: str = "text", min_margin: float = 0.02) -> DataFrame:
    """doc_id, lang_pred, score, narrow, lang_or_und for each row."""
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)  # langs x dict_bytes at most
    p = internal("p")
    narrow = F.col(p)["score"] < min_margin
    return docs.select(docs[doc_id].alias("doc_id"), predict_column(docs[text], model).alias(p)) \
        .select("doc_id", F.col(p)["lang"].alias("lang_pred"), F.col(p)["score"].alias("score"),
                narrow.alias("narrow"),
                F.when(narrow, UND).otherwise(F.col(p)["lang"]).alias("lang_or_und"))
