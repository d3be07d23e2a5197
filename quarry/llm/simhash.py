"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks.

A fingerprint has bit b set if more than half of the document's shingle
hashes have it set.  Two fingerprints that differ in at most `max_bits` bits
agree in at least m - max_bits of m blocks, so joining on every choice of
m - max_bits blocks meets every close pair; the Hamming distance then decides.
m grows with the number of distinct fingerprints (only the plan depends on it,
never the links).  Equal fingerprints are one class from the start, so copies
are never paired; large buckets are cut into sub-blocks that meet two by two,
so no task holds more than two sub-blocks, and a large bucket returns a
spanning forest of its links instead of all its pairs.

Rows: a NULL or empty text has fingerprint zero and links like any other; a
NULL doc_id takes part but never names a component unless all ids in it are
NULL; repeated rows come back once each; an empty table gives no rows.  Texts of
any length are hashed whole, some 65,000 shingles at a time.  Other input
columns are ignored (`keep_one` keeps them, whatever their names).
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, internal, lower_words
from quarry.llm.components import connected_components
from quarry.session import stage

SEED = 42
BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the word shingles (A-Z lower-cased, repeats included); fewer
    words than a shingle: the whole sequence is one; no word: zero."""
    ws = lower_words(text)
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]).tolist()
    starts = [0, *ends[:-1]]
    h64 = xxhash.xxh64_intdigest
    k = min(shingle, len(ws))
    n = len(ws) - k + 1
    last = ends[k - 1:]
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, 65536):
        hs = np.array([h64(line[s:e - 1], SEED) for s, e in
                       zip(starts[a:min(n, a + 65536)], last[a:a + 65536])], "<u8")
        counts += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    on = counts * 2 > n
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column | str, shingle: int = 4) -> Column:
    """The fingerprint as a long with the same 64 bits."""
    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64)
                            .view(np.int64))
        give_back()
    return fp(F.col(text) if isinstance(text, str) else text)


def block_plan(n_distinct: int, max_bits: int) -> tuple[list[int], int]:
    """Block widths and how many blocks a key joins: the smallest number of
    blocks whose keys have log2(n) bits or more, so that chance meetings stay
    near one a row and table however large the input."""
    need = max(1, int(n_distinct)).bit_length()
    for m in range(max_bits + 1, max_bits + 6):
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        key_bits = sum(sorted(widths)[:m - max_bits])
        if key_bits >= need or m == max_bits + 5:
            return widths, m - max_bits
    raise AssertionError("unreachable")


def _masks(widths: list[int], take: int) -> list[int]:
    spans, at = [], 0
    for w in widths:
        spans.append(((1 << w) - 1) << at)
        at += w
    return [sum(c) for c in combinations(spans, take)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links inside `a`, or between `a` and
    `b`, compared a row of the matrix at a time."""
    every = a if b is None else np.concatenate([a, b])
    parent = list(range(len(every)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(a)):
        others, at = (a[i + 1:], i + 1) if b is None else (b, len(a))
        near = np.flatnonzero(np.bitwise_count(others ^ a[i]) <= max_bits)
        for j in near.tolist():
            ri, rj = root(i), root(at + j)
            if ri != rj:
                parent[rj] = ri
                edges.append((i, at + j))
    return [(int(every[i]), int(every[j])) for i, j in edges]


def _link_runs(masks: list[int], max_bits: int, small: int):
    """mapInPandas over rows sorted by (bucket, lo, hi): links inside each run.

    Runs of up to `small` rows are compared by shifting the whole batch
    against itself and give each link once, in the first table where the pair
    meets; longer runs give a spanning forest of their links."""
    mask_arr = np.array(masks, np.uint64)

    def small_runs(table, run, fp) -> list[np.ndarray]:
        out = []
        for d in range(1, small):
            same = np.flatnonzero(run[d:] == run[:-d])
            if not len(same):
                break
            x = fp[same] ^ fp[same + d]
            ok = np.bitwise_count(x) <= max_bits
            same, x = same[ok], x[ok]
            if len(same):
                meets = np.argmax((x[:, None] & mask_arr[None, :]) == 0, axis=1)
                own = same[meets == table[same]]
                if len(own):
                    out.append(np.stack([fp[own], fp[own + d]], axis=1))
        return out

    def link(batches):
        held: list[pd.DataFrame] = []

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf[["table", "bucket", "lo", "hi"]].to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
            run = np.cumsum(new) - 1
            size = np.bincount(run)
            fp = pdf["fp"].to_numpy().view(np.uint64)
            part, lo, hi = (pdf[c].to_numpy() for c in ("part", "lo", "hi"))
            plain = (size[run] <= small) & (lo == hi)
            pairs = small_runs(pdf["table"].to_numpy()[plain], run[plain], fp[plain])
            for r in np.unique(run[~plain]):
                at = slice(*np.searchsorted(run, [r, r + 1]))
                x, p = fp[at], part[at]
                if lo[at][0] == hi[at][0]:
                    found = _forest(x, None, max_bits)
                else:
                    found = _forest(x[p == lo[at][0]], x[p == hi[at][0]], max_bits)
                if found:
                    pairs.append(np.array(found, np.uint64))
            every = np.concatenate(pairs) if pairs else np.empty((0, 2), np.uint64)
            every = every.view(np.int64)
            return pd.DataFrame({"a": every.min(axis=1) if len(every) else every[:, 0],
                                 "b": every.max(axis=1) if len(every) else every[:, 1]})

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            first, last = held[0].iloc[0], pdf.iloc[-1]
            cols = ["table", "bucket", "lo", "hi"]
            if (first[cols] == last[cols]).all():
                continue  # one run so far
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
            key = whole[cols].to_numpy()
            tail = len(whole) - int(np.argmax((key[::-1] != key[-1]).any(axis=1)))
            yield work(whole.iloc[:tail])
            held = [whole.iloc[tail:]]
        if held:
            yield work(pd.concat(held, ignore_index=True))
        held.clear()
        give_back()

    return link


def links(fps: DataFrame, max_bits: int = 4, block_rows: int = 4096,
          small: int = 64) -> DataFrame:
    """(a, b) links between distinct fingerprints (column `fp`, long) at
    `max_bits` differing bits or fewer, enough of them that every close pair
    is connected."""
    n = fps.count()
    widths, take = block_plan(n, max_bits)
    masks = _masks(widths, take)
    keyed = fps.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("table", "bucket"))
    sizes = keyed.groupBy("table", "bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    met = keyed.join(sizes, ["table", "bucket"])
    parts = F.ceil(F.col("rows") / block_rows).cast("int")
    met = met.withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # sub-block p meets every sub-block q: once as (p, q), p <= q
    runs = met.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "table", "bucket", F.least("part", "q").alias("lo"), F.greatest("part", "q").alias("hi"),
        "part", "fp")
    keys = ["table", "bucket", "lo", "hi"]
    return runs.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(
        _link_runs(masks, max_bits, small), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable over links)
    and component (a fingerprint that names the component), one row for each
    row of `docs`."""
    rows = stage(docs.select(docs[doc_id].alias("doc_id"),
                             fingerprint_column(docs[text], shingle).alias("fp")), "simhash")
    return with_components(rows, max_bits).select("doc_id", "fp", "component_id", "component")


def with_components(rows: DataFrame, max_bits: int = 4) -> DataFrame:
    """Staged rows (doc_id, fp, ...) with component_id and component.

    Fingerprints that a thousandth of the rows or more share, which are at most
    a thousand, are looked up; the others are joined by shuffle, where no key
    has more rows than that."""
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"),
                                           F.count("*").alias("n")), "simhash-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = stage(components_of(classes, max_bits), "components")
    hot = found.join(F.broadcast(classes.where(F.col("n") * 1000 >= total).select("fp")), "fp", "left_semi")
    often = F.broadcast(hot)
    return rows.join(often, "fp").unionByName(
        rows.join(often, "fp", "left_anti").join(found, "fp"))


def components_of(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, component_id, component) of staged distinct fingerprints (fp,
    first_id)."""
    found = connected_components(links(classes.select("fp"), max_bits))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    roots = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(roots, "component").select("fp", "component_id", "component")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
             max_bits: int = 4) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each component:
    the one with the smallest id (NULL ids last; of several texts under that
    id the one with the smallest fingerprint, of repeated rows any one)."""
    fp, row = internal("fp"), internal("row")
    # written with fingerprint and row number, so that both are there once
    # and the choice among rows is made on thin columns; texts move once
    marked = stage(docs.withColumn(fp, fingerprint_column(docs[text], shingle)).withColumn(
        row, F.monotonically_increasing_id()), "marked")
    thin = marked.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    reps = with_components(thin, max_bits).groupBy(
        "component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row")).alias("r")) \
        .select(F.col("r.row").alias(row))
    return marked.join(reps, row, "left_semi").drop(fp, row)
