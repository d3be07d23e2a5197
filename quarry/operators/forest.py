"""Decision trees and forests of full depth (ML2, ML3, ML5).

Trees grow until their leaves are pure or can't be split, which Spark ML's
trees (30 levels, all open nodes in one broadcast) don't.  Growth has two
phases:

* **Large nodes, level by level.**  While a (tree, node) holds more than
  `task_rows` rows, quantiles of the node's own values give split candidates,
  one grouped aggregate counts the labels between them, and the best split of
  each node is taken by a window over those counts.  Rows then move to their
  child node.  Nothing but grouped sums is shuffled.
* **Small nodes, inside one task.**  Rows of one (tree, node) meet in a task,
  which grows the rest of the tree exactly (every midpoint between distinct
  values is tried), all open nodes of a level at once in NumPy.  `task_rows`
  is what fills `TASK_CELLS` numbers: the fewer features, the more rows.

A forest's trees see every row with a Poisson(1) weight drawn from a hash of
(seed, tree, row): bagging that needs no second pass.  Rows of one feature
vector are one row with their weights' sum in each tree, where that makes them
fewer: trees split between vectors, never inside one.  Those sums are taken in
the tasks that read the rows, before anything is multiplied by the trees.  Trees
are grown `trees_at_once` at a time, so only that multiple of the rows is on disk.

The model is two tables: the splits of large nodes, and one row for each
(tree, node) with its subtree as arrays.  It grows with the training rows, so
it is never broadcast as a whole: scoring sends each distinct feature vector
to the subtrees that it falls into (in chunks, so a popular one doesn't fill a
task) and averages what they say.  Splits of large nodes are broadcast, if
there are `MAX_BROADCAST` at most, else joined.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed)
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import freeze, stage

#: Split tables of more rows are joined by a shuffle.
MAX_BROADCAST = 20_000
#: Distinct labels of a classifier: each takes a column of the counts.
MAX_CLASSES = 1_000
#: Numbers (features, label sums) that a task holds of a node that it finishes,
#: and the rows that it takes at any width.
TASK_CELLS = 6_000_000
TASK_ROWS = 100_000
#: Numbers in a row that carries some vectors of a tree to the task that grows it.
BLOCK_CELLS = 200_000
#: Candidate splits of a feature in a large node.
CANDIDATES = 64
#: Cumulative probabilities of a Poisson(1) variable: a row's weight is the
#: number of these that its uniform draw reaches.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
           0.9963401531726563, 0.9994058151824183, 0.9999167588507120, 0.9999897508033253)

TREE_SCHEMA = ("tree int, node string, feature array<int>, threshold array<double>, "
               "left array<int>, right array<int>, value array<double>")
SPLIT_SCHEMA = "tree int, node string, feature int, threshold double"


# --- a whole tree in one task ---------------------------------------------------

def _ranked(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, each row's place among them)."""
    values, code = np.unique(column, return_inverse=True)
    return values, code.astype(np.int64)


def _node_sums(node: np.ndarray, n: int, stats: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(node, stats[:, k], n) for k in range(stats.shape[1])], 1)


def _value_sums(node: np.ndarray, n_nodes: int, code: np.ndarray, n_values: int,
                stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, value, sums) of each value that a node has, in order.  Few enough
    (node, value) pairs are counted in place, else the pairs are sorted."""
    key = node * n_values + code
    if n_nodes * n_values <= 4 * len(key):
        total = _node_sums(key, n_nodes * n_values, stats)
        key = np.flatnonzero(np.bincount(key, minlength=n_nodes * n_values))
        return key // n_values, key % n_values, total[key]
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key = key[start]
    return key // n_values, key % n_values, np.add.reduceat(stats[order], start, axis=0)


def _best_splits(ranked: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, stats: np.ndarray,
                 node: np.ndarray, n_nodes: int, regression: bool,
                 allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, threshold) of the best split of each node of `rows`; a feature
    of -1 where nothing splits it.

    `stats` has a row's weight for each class, or its weight and weighted
    label; a split is worth the sum of squared sums over weight on both sides.
    Of equal splits the first feature and the smallest threshold win."""
    best = np.full(n_nodes, -np.inf)
    feature = np.full(n_nodes, -1, np.int32)
    threshold = np.zeros(n_nodes)
    for f, (values, code) in enumerate(ranked):
        if allowed is None:
            at, v, run = _value_sums(node, n_nodes, code[rows], len(values), stats)
        else:
            here = np.flatnonzero(allowed[node, f])
            if len(here) < 2:
                continue
            at, v, run = _value_sums(node[here], n_nodes, code[rows[here]], len(values), stats[here])
        cut = np.flatnonzero((at[1:] == at[:-1]) & (values[v[1:]] > values[v[:-1]]))
        if not len(cut):
            continue
        run = np.cumsum(run, axis=0)
        ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True])
        total = np.diff(run[ends], axis=0, prepend=np.zeros((1, run.shape[1]), run.dtype))
        before = run[ends] - total
        place = np.searchsorted(ends, cut)  # which of the nodes that are here
        left = run[cut] - before[place]
        right = total[place] - left
        if regression:
            gain = left[:, 1] ** 2 / left[:, 0] + right[:, 1] ** 2 / right[:, 0]
            gain -= (total[:, 1] ** 2 / total[:, 0])[place]
        else:
            sq = lambda s: (s.astype(float) ** 2).sum(1) / s.sum(1)
            gain = sq(left) + sq(right) - sq(total)[place]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # cuts are in node order
        most = np.maximum.reduceat(gain, first)
        top = np.flatnonzero(gain == most[np.cumsum(np.r_[True, place[1:] != place[:-1]]) - 1])
        first = top[np.r_[True, place[top][1:] != place[top][:-1]]]
        named = at[cut[first]]
        better = gain[first] > best[named]
        first, named = first[better], named[better]
        best[named], feature[named] = gain[first], f
        lo, hi = values[v[cut[first]]], values[v[cut[first] + 1]]
        mid = lo + (hi - lo) / 2
        threshold[named] = np.where(mid < hi, mid, lo)
    return feature, threshold


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int, n_features: int,
              max_depth: int | None, rng: np.random.Generator, lo: np.ndarray | None = None,
              hi: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A tree of full depth as arrays; `left` is -1 in leaves, `value` holds
    each node's mean label or its class shares one after another.  A row that
    stands for several has their mean label, and their extreme ones in `lo`
    and `hi`.

    With `n_features` below all, every node draws that many features; one
    that none of them splits looks at all.  Values are ranked once, so that a
    level takes sums over their ranks and sorts no rows where they are few."""
    stats = (np.stack([w, w * y], 1).astype(float) if not n_classes
             else np.eye(n_classes, dtype=np.int64)[y.astype(int)] * w[:, None].astype(np.int64))
    lo, hi = y if lo is None else lo, y if hi is None else hi
    ranked = [_ranked(x[:, f]) for f in range(x.shape[1])]
    rows, node, n_nodes = np.arange(len(x)), np.zeros(len(x), np.int64), 1
    levels, nodes = [], 0
    while True:
        told = _node_sums(node, n_nodes, stats[rows])
        value = told[:, 1:] / told[:, :1] if not n_classes else told / told.sum(1, keepdims=True)
        level = {"feature": np.full(n_nodes, -1, np.int32), "threshold": np.zeros(n_nodes),
                 "left": np.full(n_nodes, -1, np.int32), "right": np.full(n_nodes, -1, np.int32),
                 "value": value.ravel()}
        levels.append(level)
        nodes += n_nodes
        if max_depth is not None and len(levels) > max_depth:
            break
        low, high = np.full(n_nodes, np.inf), np.full(n_nodes, -np.inf)
        np.minimum.at(low, node, lo[rows])
        np.maximum.at(high, node, hi[rows])
        open_ = (low < high)[node]
        rows, node = rows[open_], node[open_]
        if not len(rows):
            break
        allowed = None
        if n_features < x.shape[1]:
            turn = rng.random((n_nodes, x.shape[1])).argsort(1).argsort(1)
            allowed = turn < n_features
        here = stats[rows]
        if not n_classes:  # labels less their node's mean: sums lose no digits
            here[:, 1] -= here[:, 0] * value[node, 0]
        f, t = _best_splits(ranked, rows, here, node, n_nodes, not n_classes, allowed)
        none = (f < 0)
        if allowed is not None and none[node].any():
            again = np.flatnonzero(none[node])
            f2, t2 = _best_splits(ranked, rows[again], here[again], node[again], n_nodes,
                                  not n_classes, None)
            f, t = np.where(none, f2, f), np.where(none, t2, t)
        split = np.flatnonzero(f >= 0)
        keep = (f >= 0)[node]
        rows, node = rows[keep], node[keep]
        if not len(rows):
            break
        number = np.full(n_nodes, -1)
        number[split] = np.arange(len(split))
        level["feature"][split], level["threshold"][split] = f[split], t[split]
        level["left"][split] = nodes + 2 * np.arange(len(split))
        level["right"][split] = level["left"][split] + 1
        node, n_nodes = 2 * number[node] + (x[rows, f[node]] > t[node]), 2 * len(split)
    return {k: np.concatenate([lv[k] for lv in levels]) for k in levels[0]}


def tree_leaves(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf that each row of x falls into."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        inner = tree["left"][at[rows]] >= 0
        rows = rows[inner]
        if not len(rows):
            return at
        n = at[rows]
        over = x[rows, tree["feature"][n]] > tree["threshold"][n]
        at[rows] = np.where(over, tree["right"][n], tree["left"][n])


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


# --- bags -------------------------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                           0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_U64 = (1 << 64) - 1


def _rotated(h, bits: int):
    return (h << bits | h >> (64 - bits)) & _U64 if isinstance(h, int) else (
        h << np.uint64(bits) | h >> np.uint64(64 - bits))


def _mixed(h, number=int):
    """The last step of XXH64, of an int or (number=np.uint64) of an array."""
    for shift, factor in ((33, _P2), (29, _P3)):
        h = (h ^ h >> number(shift)) * number(factor)
        h = h & _U64 if number is int else h
    return h ^ h >> number(32)


def _tree_hash(seed: int, tree: int) -> int:
    """xxhash64(seed, tree), as Spark takes it of two literals."""
    h = 42
    for v in (seed, tree):
        if -(1 << 31) <= v < 1 << 31:
            h = (h + _P5 + 4) & _U64 ^ (v & 0xFFFFFFFF) * _P1 & _U64
            h = _mixed((_rotated(h, 23) * _P2 + _P3) & _U64)
        else:
            h = (h + _P5 + 8) & _U64 ^ _rotated((v & _U64) * _P2 & _U64, 31) * _P1 & _U64
            h = _mixed((_rotated(h, 27) * _P1 + _P4) & _U64)
    return h


def bag_weights(seed: int, trees: Sequence[int], row: np.ndarray) -> Iterator[np.ndarray]:
    """What `_weight` is for these rows, tree by tree."""
    row = _rotated(row.astype(np.uint64) * np.uint64(_P2), 31) * np.uint64(_P1)
    steps = np.array([math.ceil(p * (1 << 53)) for p in POISSON], np.uint64)
    # the weight of a draw by its first 12 bits, -1 where a step is among them
    first = np.arange(1 << 12, dtype=np.uint64) << np.uint64(41)
    told = np.searchsorted(steps, first, "right")
    told[np.searchsorted(steps, first + np.uint64((1 << 41) - 1), "right") > told] = -1
    told = told.astype(float)
    for t in trees:
        h = row ^ np.uint64((_tree_hash(seed, t) + _P5 + 8) & _U64)
        h = _mixed(_rotated(h, 27) * np.uint64(_P1) + np.uint64(_P4), np.uint64)
        h &= np.uint64((1 << 53) - 1)
        w = told[(h >> np.uint64(41)).astype(np.intp)]
        near = np.flatnonzero(w < 0)
        w[near] = np.searchsorted(steps, h[near], "right")
        yield w


def _places(x: np.ndarray) -> np.ndarray:
    """Each row's place among the distinct rows of x, in order."""
    place, n = np.zeros(len(x), np.int64), 1
    for column in x.T:
        if n == len(x):
            break
        values, code = _ranked(column)
        found, place = _ranked(place * len(values) + code)
        n = len(found)
    return place


def _together(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their places, where each place begins)."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    return order, np.flatnonzero(np.r_[True, place[1:] != place[:-1]])


def _merged(start: np.ndarray, y: np.ndarray, w: np.ndarray, lo: np.ndarray,
            hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(label, weight, smallest, largest label) of the rows from each start to
    the next; the label is their mean."""
    total = np.add.reduceat(w, start)
    drawn = w > 0
    lo = np.minimum.reduceat(np.where(drawn, lo, np.inf), start)
    hi = np.maximum.reduceat(np.where(drawn, hi, -np.inf), start)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.add.reduceat(w * y, start) / total
    return np.clip(mean, lo, hi), total, lo, hi  # equal labels stay as they are


def bagged(table: DataFrame, trees: Sequence[int], dims: int, seed: int, bagging: bool,
           regression: bool, blocks: bool) -> DataFrame:
    """Rows (tree, x, y, w, lo, hi) of `table` (row, y, x) with their weights in
    each tree, those of one vector (and class) in a task's share together.  With
    `blocks` a row holds many of them, x one after another."""
    share = max(TASK_ROWS, TASK_CELLS // (dims + 2))
    entries = max(1, BLOCK_CELLS // (dims + 4)) if blocks else 10_000
    kind = "array<double>" if blocks else "double"

    def column(values: np.ndarray, size: int) -> pa.Array:
        """Lists of `size` values; the last may be shorter."""
        ends = np.minimum(np.arange(0, len(values) + size, size), len(values))
        return pa.ListArray.from_arrays(ends.astype(np.int32), values)

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(held)
        x, y, row = _matrix(group.column("x")), group.column("y").to_numpy(), group.column("row").to_numpy()
        order, start = _together(_places(x if regression else np.c_[x, y]))
        x, y, row = x[order[start]], y[order], row[order]
        for t, w in zip(trees, bag_weights(seed, trees, row) if bagging else [np.ones(len(y))]):
            mean, total, lo, hi = _merged(start, y, w, y, y)
            drawn = np.flatnonzero(total)
            for a in range(0, len(drawn), entries):
                part = drawn[a:a + entries]
                n = len(part)
                numbers = [pa.array(v[part]) if not blocks else column(v[part], n) for v in (mean, total, lo, hi)]
                vectors = column(x[part].ravel(), dims * (n if blocks else 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), t, np.int32)), vectors, *numbers],
                    names=["tree", "x", "y", "w", "lo", "hi"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= share:
                yield from told(held)
                held, n = [], 0
        if n:
            yield from told(held)

    return table.select("x", "y", "row").mapInArrow(
        shares, "tree int, x array<double>, " + ", ".join(f"{c} {kind}" for c in ("y", "w", "lo", "hi")))


# --- large nodes ----------------------------------------------------------------

def _small_join(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join on (tree, node); the table is broadcast if it was counted to be
    small, else both sides are shuffled."""
    if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        table = F.broadcast(table)
    return rows.join(table, ["tree", "node"], how)


def _weight(seed: int, bagging: bool) -> Column:
    if not bagging:
        return F.lit(1)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), F.col("row")), F.lit(1 << 53)) / F.lit(
        float(1 << 53))
    return sum(((u >= p).cast("int") for p in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def _sums(classes: Sequence[float] | None) -> list[Column]:
    if classes is None:
        return [F.sum("w").cast("double").alias("s0"), F.sum(F.col("w") * F.col("y")).alias("s1")]
    return [F.sum(F.when(F.col("y") == i, F.col("w")).otherwise(0)).cast("double").alias(f"s{i}")
            for i in range(len(classes))]


def _worth(names: list[str], regression: bool) -> Column:
    """Squared sums over weight."""
    if regression:
        return F.try_divide(F.col(names[1]) * F.col(names[1]), F.col(names[0]))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return F.try_divide(sum((F.col(n) * F.col(n) for n in names[1:]),
                            F.col(names[0]) * F.col(names[0])), total)


def level_splits(rows: DataFrame, dims: int, classes: Sequence[float] | None, n_features: int,
                 seed: int) -> DataFrame:
    """The best split (tree, node, feature, threshold) of every node of `rows`
    (tree, node, w, y, x) that a drawn feature can split."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda p: F.struct(
        F.xxhash64(F.lit(seed), F.col("tree"), F.col("node"), p).alias("turn"), p.alias("pos"))))
    drawn = F.slice(order, 1, n_features) if n_features < dims else order
    long = rows.select("tree", "node", "w", "y", F.explode(F.transform(
        drawn, lambda d: F.struct(d["pos"].alias("f"), F.element_at(
            F.col("x"), d["pos"] + 1).alias("v")))).alias("e")).select(
        "tree", "node", "w", "y", "e.f", "e.v")
    steps = [i / CANDIDATES for i in range(CANDIDATES)]
    edges = stage(long.groupBy("tree", "node", "f").agg(F.array_sort(F.array_distinct(
        F.percentile_approx("v", F.lit(steps), 1000))).alias("edges")), "edges")
    joined = long.join(F.broadcast(edges) if edges.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
                       else edges, ["tree", "node", "f"])
    bucket = F.size(F.filter("edges", lambda e: e < F.col("v")))  # candidates below the value
    counted = joined.groupBy("tree", "node", "f", "edges", bucket.alias("b")).agg(*_sums(classes))
    names = [f"s{i}" for i in range(2 if classes is None else len(classes))]
    part = Window.partitionBy("tree", "node", "f")
    upto = part.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.select("tree", "node", "f", "b", "edges",
                         *[F.sum(n).over(upto).alias(f"l{n}") for n in names],
                         *[F.sum(n).over(part).alias(f"t{n}") for n in names])
    run = run.withColumns({f"r{n}": F.col(f"t{n}") - F.col(f"l{n}") for n in names})
    reg = classes is None
    gain = (_worth([f"l{n}" for n in names], reg) + _worth([f"r{n}" for n in names], reg)
            - _worth([f"t{n}" for n in names], reg))
    # the last bucket has nothing to its right, and no edge at its end
    able = run.where(F.col("b") < F.size("edges")).withColumn("gain", gain).where("gain is not null")
    return able.groupBy("tree", "node").agg(F.min_by(
        F.struct(F.col("f").alias("feature"), F.element_at("edges", F.col("b") + 1).alias("threshold")),
        F.struct(-F.col("gain"), F.col("f"), F.col("b"))).alias("s")).select(
        "tree", "node", "s.feature", "s.threshold")


def _grow_whole(table: DataFrame, trees: range, dims: int, classes, n_features: int, seed: int,
                bagging: bool, max_depth: int | None) -> DataFrame:
    """Subtrees that are whole trees, each grown by one task."""
    n_classes = 0 if classes is None else len(classes)

    def finish(key, group):
        tree = key[0].as_py()
        x, y, w, lo, hi = (group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                           for c in ("x", "y", "w", "lo", "hi"))
        x = x.reshape(len(y), dims)
        order, start = _together(_places(x if not n_classes else np.c_[x, y]))
        y, w, lo, hi = _merged(start, *(v[order] for v in (y, w, lo, hi)))
        grown = grow_tree(x[order[start]], y, w, n_classes, n_features, max_depth,
                          np.random.default_rng([seed, tree, 0]), lo, hi)
        return _tree_table(tree, "", grown)

    rows = bagged(table, trees, dims, seed, bagging, not n_classes, blocks=True)
    # so many partitions, however few bytes they have: a tree's time goes by its rows, not its bytes
    return rows.repartition(len(trees), "tree").groupBy("tree").applyInArrow(finish, TREE_SCHEMA)


def _tree_table(tree: int, node: str, grown: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node]),
                     **{k: pa.array([v], pa.list_(pa.from_numpy_dtype(v.dtype)))
                        for k, v in grown.items()}})


def _grow_batch(table: DataFrame, n_rows: int, vectors: int, trees: range, dims: int, classes,
                n_features: int, seed: int, bagging: bool, max_depth: int | None,
                task_rows: int) -> tuple[DataFrame, DataFrame]:
    """(subtrees, splits) of some trees over `table` (row, y, x) of about so
    many distinct vectors."""
    spark = table.sparkSession
    none = spark.createDataFrame([], SPLIT_SCHEMA)
    # a tree gets each vector (and class) once from each share of the table at most
    shares = table.rdd.getNumPartitions() + n_rows // max(TASK_ROWS, TASK_CELLS // (dims + 2))
    if min(n_rows, vectors * shares) <= task_rows:
        return stage(_grow_whole(table, trees, dims, classes, n_features, seed, bagging,
                                 max_depth), "trees"), none
    if 2 * vectors <= n_rows:
        found = bagged(table, trees, dims, seed, bagging, classes is None, blocks=False)
        keys = ["tree", "x"] if classes is None else ["tree", "x", "y"]
        mean = {} if classes is not None else {"y": F.greatest("lo", F.least("hi", F.col("wy") / F.col("w")))}
        rows = stage(found.groupBy(*keys).agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.min("lo").alias("lo"),
            F.max("hi").alias("hi")).withColumns(mean).select(
            "tree", F.lit("").alias("node"), "y", "x", "w", "lo", "hi"), "bags")
    else:
        rows = table.select(F.explode(F.array(*[F.lit(t) for t in trees])).alias("tree"),
                            F.lit("").alias("node"), "row", "y", "x")
        rows = rows.withColumn("w", _weight(seed, bagging)).where("w > 0").withColumns(
            {"lo": F.col("y"), "hi": F.col("y")}).drop("row")
    splits, done, depth = [], [], 0
    while max_depth is None or depth < max_depth:
        sizes = rows.groupBy("tree", "node").agg(
            F.count("*").alias("n"), (F.min("lo") < F.max("hi")).alias("mixed"))
        large = stage(sizes.where((F.col("n") > task_rows) & F.col("mixed")).select("tree", "node"), "large")
        if large.isEmpty():
            break
        big = _small_join(rows, large, "left_semi")
        found = stage(level_splits(big, dims, classes, n_features, seed), "splits")
        if n_features < dims:  # nodes that no drawn feature splits look at all of them
            rest = stage(large.join(found, ["tree", "node"], "left_anti"), "rest")
            if rest.limit(1).count():
                found = stage(found.unionByName(level_splits(
                    _small_join(rows, rest, "left_semi"), dims, classes, dims, seed)), "splits")
        splits.append(found)
        moved = _small_join(rows, found, "left")
        over = F.element_at("x", F.col("feature") + 1) > F.col("threshold")
        moved = stage(moved.select(
            "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.concat(
                "node", F.when(over, F.lit("1")).otherwise(F.lit("0")))).alias("node"),
            "y", "x", "w", "lo", "hi", F.col("feature").isNotNull().alias("on")), "rows")
        # rows of small nodes, and of large ones that nothing splits, are done
        done.append(moved.where("not on").drop("on"))
        rows, depth = moved.where("on").drop("on"), depth + 1
    small = rows
    for d in done:
        small = small.unionByName(d)
    n_classes = 0 if classes is None else len(classes)

    def finish(key, group):
        tree, node = key[0].as_py(), key[1].as_py()
        limit = None if max_depth is None else max_depth - len(node)
        rng = np.random.default_rng([seed, tree, len(node), *node.encode()])
        y, w, lo, hi = (group.column(c).to_numpy() for c in ("y", "w", "lo", "hi"))
        return _tree_table(tree, node, grow_tree(_matrix(group.column("x")), y, w, n_classes,
                                                 n_features, limit, rng, lo, hi))

    # a large node that nothing splits is a leaf, and needs its sums only
    final = small.groupBy("tree", "node").agg(F.count("*").alias("n"), *_sums(classes))
    leaf = stage(final.where(F.col("n") > task_rows), "leaves")
    names = [f"s{i}" for i in range(2 if classes is None else n_classes)]
    value = ([F.col("s1") / F.col("s0")] if classes is None else
             [F.col(n) / sum((F.col(m) for m in names[1:]), F.col(names[0])) for n in names])
    one = lambda v, t: F.array(F.lit(v).cast(t))
    leaves = leaf.select("tree", "node", one(-1, "int").alias("feature"),
                         one(0, "double").alias("threshold"), one(-1, "int").alias("left"),
                         one(-1, "int").alias("right"), F.array(*value).alias("value"))
    small = _small_join(small, leaf.select("tree", "node"), "left_anti")
    grown = small.select("tree", "node", "y", "w", "x", "lo", "hi").groupBy("tree", "node").applyInArrow(
        finish, TREE_SCHEMA).unionByName(leaves)
    for s in splits:
        none = none.unionByName(s)
    return stage(grown, "trees"), none


# --- scoring --------------------------------------------------------------------

def _route(vectors: DataFrame, splits: DataFrame, trees: int) -> DataFrame:
    """(tree, node, x): the subtree that each vector falls into in each tree."""
    at = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                        F.lit("").alias("node"), "x")
    levels = splits.agg(F.max(F.char_length("node"))).first()[0]
    for depth in range(0 if levels is None else levels + 1):
        here = splits.where(F.char_length("node") == depth)
        over = F.element_at("x", F.col("feature") + 1) > F.col("threshold")
        at = _small_join(at, here, "left").select(
            "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.concat(
                "node", F.when(over, F.lit("1")).otherwise(F.lit("0")))).alias("node"), "x")
    return at


def forest_scores(df: DataFrame, x: Column, subtrees: DataFrame, splits: DataFrame, trees: int,
                  width: int, chunk_rows: int = 50_000) -> DataFrame:
    """(x, value): mean leaf value (an array of `width`) of each distinct
    vector of `df`."""
    vectors = df.select(x.alias("x")).where("x is not null").distinct()
    at = _route(vectors, splits, trees)
    sizes = stage(at.groupBy("tree", "node").agg(
        F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("chunks")), "chunks")
    asked = _small_join(at, sizes, "inner").withColumn(
        "chunk", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int")).drop("chunks")
    model = subtrees.join(sizes, ["tree", "node"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    keys = ["tree", "node", "chunk"]

    def say(rows, tree):
        if not rows.num_rows:
            return pa.table({"x": pa.array([], pa.list_(pa.float64())),
                             "value": pa.array([], pa.list_(pa.float64()))})
        held = {k: tree.column(k)[0].values.to_numpy(zero_copy_only=False)
                for k in ("feature", "threshold", "left", "right", "value")}
        leaf = tree_leaves(held, _matrix(rows.column("x")))
        value = held["value"].reshape(-1, width)[leaf].ravel()
        return pa.table({"x": rows.column("x").combine_chunks().cast(pa.list_(pa.float64())),
                         "value": pa.ListArray.from_arrays(
                             np.arange(0, len(value) + 1, width, dtype=np.int32), value)})

    said = asked.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(
        say, "x array<double>, value array<double>")
    return said.groupBy("x").agg(F.array(*[
        F.sum(F.element_at("value", i + 1)) / F.lit(trees) for i in range(width)]).alias("value"))


# --- estimator and model ----------------------------------------------------------

class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees; one tree sees each row once",
                     TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root; -1: no limit",
                     TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy",
                                  "features that a node tries: all, sqrt or onethird",
                                  TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "regression or classification", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "labels of a fitted classifier",
                    TypeConverters.toListFloat)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column of class probabilities",
                           TypeConverters.toString)
    taskRows = Param(Params._dummy(), "taskRows", "rows of a node that one task finishes; 0: what "
                     "fills TASK_CELLS, TASK_ROWS at least", TypeConverters.toInt)
    treesAtOnce = Param(Params._dummy(), "treesAtOnce", "trees grown together", TypeConverters.toInt)


class DeepForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """A tree (numTrees = 1) or a bagged forest of full depth.  Rows must have
    a whole feature vector and label."""

    @keyword_only
    def __init__(self, *, kind="regression", numTrees=100, maxDepth=-1, featureSubsetStrategy="all",
                 featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", seed=42, taskRows=0, treesAtOnce=100):
        super().__init__()
        self._setDefault(kind="regression", numTrees=100, maxDepth=-1, featureSubsetStrategy="all",
                         probabilityCol="probability", seed=42, taskRows=0, treesAtOnce=100)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "DeepForestModel":
        get = self.getOrDefault
        classes = None
        label = F.col(get("labelCol")).cast("double")
        rows = df.select(vector_to_array(get("featuresCol")).alias("x"), label.alias("y"))
        if get("kind") == "classification":
            found = rows.select("y").distinct().limit(MAX_CLASSES + 1).collect()
            if len(found) > MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} classes")
            classes = sorted(r["y"] for r in found)
            place = F.array_position(F.lit(classes), F.col("y")) - 1
            rows = rows.withColumn("y", place.cast("double"))
        # written once: row numbers must be the same in every pass
        table = stage(rows, "train").withColumn("row", F.monotonically_increasing_id())
        n_rows, dims, vectors = table.agg(F.count("*"), F.max(F.size("x")), F.approx_count_distinct(
            F.xxhash64("x", *(["y"] if classes else [])))).first()
        if not n_rows:
            raise ValueError("no training rows")
        tried = {"all": dims, "sqrt": max(1, int(dims ** 0.5)), "onethird": max(1, dims // 3)}
        depth = None if get("maxDepth") < 0 else get("maxDepth")
        cells = dims + (len(classes) if classes else 2)
        task_rows = get("taskRows") or max(TASK_ROWS, TASK_CELLS // cells)
        subtrees, splits = None, None
        for a in range(0, get("numTrees"), get("treesAtOnce")):
            grown, cut = _grow_batch(
                table, n_rows, vectors, range(a, min(a + get("treesAtOnce"), get("numTrees"))), dims, classes,
                tried[get("featureSubsetStrategy")], get("seed"), get("numTrees") > 1, depth,
                task_rows)
            subtrees = grown if subtrees is None else subtrees.unionByName(grown)
            splits = cut if splits is None else splits.unionByName(cut)
        model = DeepForestModel()
        model.subtrees, model.splits = subtrees, freeze(splits)
        self._copyValues(model)
        model._set(classes=classes or [])
        return model


class DeepForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """Adds the prediction (mean of the trees; for classes the largest mean
    share, ties to the smaller label) and, for classes, their shares."""

    def __init__(self):
        super().__init__()
        self._setDefault(kind="regression", numTrees=100, maxDepth=-1, featureSubsetStrategy="all",
                         probabilityCol="probability", seed=42, taskRows=0, treesAtOnce=100)
        self.subtrees: DataFrame | None = None
        self.splits: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        classes = get("classes")
        x = vector_to_array(get("featuresCol"))
        scores = forest_scores(df, x, self.subtrees, self.splits, get("numTrees"),
                               max(1, len(classes)))
        scores = scores.withColumnsRenamed({"x": "_forest_x", "value": "_forest_value"})
        out = df.join(scores, x == F.col("_forest_x"), "left")
        value = F.col("_forest_value")
        if not classes:
            return out.withColumn(get("predictionCol"), F.element_at(value, 1)).drop(
                "_forest_x", "_forest_value")
        label = F.element_at(F.lit(classes), F.array_position(value, F.array_max(value)).cast("int"))
        return out.withColumn(get("predictionCol"), label).withColumn(
            get("probabilityCol"), array_to_vector(value)).drop("_forest_x", "_forest_value")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.subtrees.write.parquet(f"{path}/subtrees")
        self.model.splits.write.parquet(f"{path}/splits")


class _ModelReader(MLReader):
    def load(self, path: str) -> DeepForestModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = DeepForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.subtrees = spark.read.schema(TREE_SCHEMA).parquet(f"{path}/subtrees")
        model.splits = spark.read.schema(SPLIT_SCHEMA).parquet(f"{path}/splits")
        return model
