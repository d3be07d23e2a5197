"""Quality rules with thresholds learned per language and source.

Measures of a text are integers (shares in permille).  Each (language, source)
has a quantile sketch per measure: counts over log-linear buckets, exact below
`2^SUB_BITS` and within 1/2^SUB_BITS of the value above.  Sketches merge by
adding counts, so a language's sketch is the sum of its sources' and the whole
corpus' the sum of those; a group with fewer than `min_rows` base-passing rows
is judged by its language, and that by the corpus.  Merging adds integers:
neither the order of rows nor the partitioning changes a threshold.

Bounds come from the sketch alone.  Mean word length has Tukey fences, q1 - 3
(q3 - q1) and q3 + 3 (q3 - q1); a sketch without spread (a source of copies)
yields to its language's, and that to the corpus'.  Shares of symbols, of
duplicate lines and of repeated words are nearly all 0 in good text, so their
quartiles say nothing: each has a high percentile of the group as its bound
(`MEASURES`), one occurrence always being allowed (one symbol, one duplicate
line, one repeated window).  The fences join back to the measured rows, and a
row is kept if it passes the base rules and lies inside every fence.

All of it is DataFrame expressions.  The thin measured table (no text) is
written once; sketches are grouped with map-side sums, so a source that holds
a third of the rows sends one row per bucket and task.

Rows: a NULL or empty text has no words and fails the base rules; NULL
languages and sources are groups of their own; repeated rows come back once
each; with no base-passing row at all nothing is kept; an empty table gives
no rows.  Texts of any length are measured whole; a row's arrays hold its words.
Other input columns are ignored, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import GAP_CHARS, small_side_join, words
from quarry.session import stage

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A sketch bucket is at most 1/2^SUB_BITS of its value wide.
SUB_BITS = 5
#: measure -> its bound's percentile, the count behind it and the count that one
#: occurrence makes; without a percentile: Tukey fences on both sides.
MEASURES = {
    "symbols_pm": (95, "n_symbols", 1),
    "dup_lines_pm": (99, "n_dup_lines", 1),
    "repeats_pm": (99, "n_repeat_words", 6),
    "word_len_pc": (None, None, None),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    """The text without some characters (`translate` in one pass)."""
    return F.translate(text, chars, "")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are hashed and sorted with their places; equal neighbours give the
    places of repeated windows, and the union of [p, p + 2] over the sorted
    places is summed from the gaps between them."""
    def windows(h: Column) -> Column:
        n = F.size(h)
        two = F.zip_with(F.slice(h, 1, F.greatest(n - 2, F.lit(0))),
                         F.slice(h, 2, F.greatest(n - 2, F.lit(0))),
                         lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(h, 3, F.greatest(n - 2, F.lit(0))),
                          lambda a, b: F.xxhash64(a, b))

    def places(s: Column) -> Column:
        n = F.size(s)
        after = F.slice(s, 2, n)
        same = F.zip_with(s, after, lambda a, b: F.when(
            a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)),
                          lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    ranked = _let(hashed, lambda h: F.sort_array(F.transform(
        windows(h), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(
        _let(_let(ranked, places), covered)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, GAP_CHARS) != "")
    return _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
            source: str = "source") -> DataFrame:
    """The thin table: id, language, source, base counts and measures."""
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang"),
                       docs[source].alias("source"), t.alias("t")).withColumn(
        "ws", words(F.col("t")))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("ws").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), GAP_CHARS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("t")).alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
        F.size(F.split("t", "\n")).cast("long").alias("n_lines"))
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "lang", "source", *BASE, failed.alias("base_failed"),
        F.floor(1000 * F.col("n_symbols") / per_word).alias("symbols_pm"),
        F.floor(1000 * F.col("n_dup_lines") / F.col("n_lines")).alias("dup_lines_pm"),
        F.floor(1000 * F.col("n_repeat_words") / per_word).alias("repeats_pm"),
        F.floor(100 * F.col("word_chars") / per_word).alias("word_len_pc"))


def bucket_floor(v: Column) -> Column:
    """Smallest integer of the value's sketch bucket: all but the top
    SUB_BITS + 1 binary digits are cleared."""
    low = F.greatest(F.length(F.bin(v)) - (SUB_BITS + 1), F.lit(0))
    width = F.pow(F.lit(2.0), low)
    return (F.floor(v / width) * width).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over the rows that pass the base
    rules: the mergeable sketch of each group."""
    each = measured.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket_floor(F.col(m)).alias("bucket"))
        for m in MEASURES])).alias("x"))
    return each.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """rows, q1, q3 and the measure's own percentile q of each group of merged
    sketches; a window holds the buckets of one sketch, some hundreds at most."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(w))
    own = F.lit(None).cast("int")
    for m, (percent, _, _) in MEASURES.items():
        if percent:
            own = F.when(F.col("measure") == m, F.lit(percent)).otherwise(own)
    return ranked.groupBy(*keys, "measure").agg(
        F.max("all").alias("rows"),
        F.min(F.when(100 * F.col("upto") >= own * F.col("all"), F.col("bucket"))).alias("q"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"))


def thresholds(sketch: DataFrame, min_rows: int = 200) -> DataFrame:
    """One row for each (lang, source): lower and upper fence per measure,
    from its own sketch or, if that is thin, the language's or the corpus'."""
    names = ["measure", "rows", "q", "q1", "q3"]
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch, ["lang"]).select(
        F.col("lang").alias("l_lang"), *[F.col(n).alias(f"l_{n}") for n in names])
    every = _quantiles(sketch, []).select(*[F.col(n).alias(f"e_{n}") for n in names])
    j = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang"))
                 & (F.col("measure") == F.col("l_measure"))).join(
        F.broadcast(every), F.col("measure") == F.col("e_measure"))  # a row a measure

    def tells(of: str) -> Column:  # enough rows, and a spread where it is needed
        return (F.col(f"{of}rows") >= min_rows) & (
            F.col(f"{of}q").isNotNull() | (F.col(f"{of}q3") > F.col(f"{of}q1")))

    def pick(q: str) -> Column:
        return F.when(tells(""), F.col(q)).when(tells("l_"), F.col(f"l_{q}")).otherwise(
            F.col(f"e_{q}"))

    j = j.select("lang", "source", "measure", *[pick(q).alias(q) for q in ("q", "q1", "q3")])
    out = []
    for m, (percent, _, _) in MEASURES.items():
        own_row = F.col("measure") == m
        reach = 3 * (F.col("q3") - F.col("q1"))
        upper = F.col("q") if percent else F.col("q3") + reach
        out.append(F.max(F.when(own_row, upper)).alias(f"{m}_max"))
        if not percent:
            out.append(F.max(F.when(own_row, F.col("q1") - reach)).alias(f"{m}_min"))
    return j.groupBy("lang", "source").agg(*out)


def inside(measure: str) -> Column:
    """Whether a judged row lies inside a measure's fences."""
    percent, count, once = MEASURES[measure]
    bucket = bucket_floor(F.col(measure))  # stands for all values of the bucket
    if percent:
        return (bucket <= F.col(f"{measure}_max")) | (F.col(count) <= once)
    return bucket.between(F.col(f"{measure}_min"), F.col(f"{measure}_max"))


def judge(docs: DataFrame, min_rows: int = 200, **columns) -> DataFrame:
    """doc_id, base counts, base_failed, kept, the measures and their fences."""
    measured = stage(measure(docs, **columns), "measures")
    fences = stage(thresholds(sketches(measured), min_rows), "fences")
    judged = small_side_join(measured, fences, ["lang", "source"])
    passed = F.lit(True)
    for m in MEASURES:
        passed &= inside(m)
    kept = ~F.col("base_failed") & F.coalesce(passed, F.lit(False))
    return judged.select("doc_id", *BASE, "base_failed", kept.alias("kept"), *MEASURES,
                         *[c for c in fences.columns if c not in ("lang", "source")])
