"""Mixing sources to target weights by a multivariate-hypergeometric splitting
tree.

1. Targets: the whole size is shared among the sources by weight; a target
   stops at `max_epochs` times its source and the excess is shared again.
2. Order: rows are permuted inside their source by a seeded digest of the
   document id, and the digest range of a source is cut into blocks, as many
   as its share of the total size asks for.  A source is drawn `base` whole
   times and once more up to a cut in this order, which falls inside one
   block: only that block's rows are ordered to find it.
3. Quotas: the tree halves the range of output shards again and again and
   splits the sources' block counts of a node between its halves by a
   multivariate hypergeometric draw, until each shard has exact block quotas.
   It works on one count per source, the recipe; documents never reach it.
   Up to `GROUPS` sources are nodes of their own.  Beyond, neighbours in order
   share a node, and each group's quotas are split among its sources by a
   tree of its own, a task a group.
4. Shards take their quotas as disjoint runs of each source's block draws, and
   each shard is shuffled locally by a second digest.

Everything that touches rows is DataFrame expressions: digests, one grouping
by (source, block), a window over each source's cut block, and joins to the
recipe, a staged table of one row a source: broadcast if it is counted to be
small, else by a salted shuffle.  The number of sources has no limit unless
the caller sets `max_sources`.

Rows: a NULL text has size 0; NULL is a source of its own, last in order;
rows of equal id and source are drawn together; repeated rows come back once
each; a NULL id is ordered as an empty one; an empty table gives no rows; texts
of any length are counted whole.
Extra input columns pass through `draw_rows` unchanged.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import internal, small_side_join, words
from quarry.operators.prefix import running_totals
from quarry.session import stage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the digest that place a row in a block.
PLACE_DIGITS = 8
#: Nodes of the first splitting tree.
GROUPS = 1024


@dataclass(frozen=True)
class Recipe:
    """A staged table of one row a source: target, draws and the shard of
    every block draw."""
    table: DataFrame
    n_shards: int


def text_size(text: Column | str) -> Column:
    """Number of words of the text (NULL: 0)."""
    return F.size(words(text)).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    """The digest that permutes the rows of a source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def block_of(key: Column, blocks: Column) -> Column:
    place = F.conv(F.substring(key, 1, PLACE_DIGITS), 16, 10).cast("long")
    return F.floor(place * blocks / F.lit(16 ** PLACE_DIGITS)).cast("int")


def share_targets(sizes: list[int], weights: list[float], max_epochs: float) -> list[float]:
    """Targets by weight, stopped at `max_epochs` times the size, the excess
    shared again by weight until none is above."""
    targets = [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    left = float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(max_epochs * sizes[i])
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def split_tree(counts: np.ndarray, edge: np.ndarray,
               seed: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, their blocks): counts[s] blocks of source s dealt to
    shards of edge[j + 1] - edge[j] blocks.  Every split of a node is a
    multivariate hypergeometric draw with its own seed."""
    todo = [(0, len(edge) - 1, np.arange(len(counts)), np.asarray(counts, np.int64))]
    while todo:
        lo, hi, at, node = todo.pop()
        if hi - lo == 1:
            yield lo, at, node
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*seed, lo, hi])
        left = rng.multivariate_hypergeometric(node, edge[mid] - edge[lo], method="marginals")
        for lo_, hi_, part in ((lo, mid, left), (mid, hi, node - left)):
            if len(at) > GROUPS:  # most sources of a large node have no block in it
                todo.append((lo_, hi_, at[part > 0], part[part > 0]))
            else:
                todo.append((lo_, hi_, at, part))


def split_quotas(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """quotas[shard][s] of counts[s] blocks of source s.  Shard sizes differ
    by one block at most."""
    total = sum(counts)
    edge = np.array([total * j // n_shards for j in range(n_shards + 1)], np.int64)
    quotas = np.zeros((n_shards, len(counts)), np.int64)
    for shard, at, node in split_tree(np.array(counts, np.int64), edge, [seed]):
        quotas[shard, at] = node
    return quotas.tolist()


def source_targets(sizes: DataFrame, total: int, weights: tuple[float, ...],
                   max_epochs: float) -> DataFrame:
    """Adds rank (NULL last) and target to (source, source_size), as
    `share_targets` over the ranked sources: each round is one aggregate."""
    ranked = running_totals(sizes.withColumn("last", F.col("source").isNull()).withColumn(
        "one", F.lit(1).cast("long")), ["last"], "source", ["one"], ["rank"])
    named = sizes.where("source IS NOT NULL").count()
    rank = F.col("rank") - 1 + F.when(F.col("last"), F.lit(named)).otherwise(0)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]),
                   F.pmod(rank, F.lit(len(weights))).cast("int"))
    rows = stage(ranked.select("source", "source_size", rank.cast("long").alias("rank"),
                               weight.alias("weight")), "sources")
    most = F.lit(max_epochs) * F.col("source_size")
    over, stopped = F.lit(False), -1
    while True:
        n, used, free = rows.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        share = F.lit(float(total - used)) * F.col("weight") / F.lit(free or 1.0)
        if n == stopped:
            return rows.withColumn("target", F.when(over, most.cast("double")).otherwise(share))
        over, stopped = share > most, n


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
             n_shards: int | None = None, shard_words: int = 8_000_000,
             blocks_per_shard: int = 16, max_sources: int | None = None,
             groups: int = GROUPS, seed: int = 20) -> Recipe:
    """The recipe for staged rows (source, size, key)."""
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    if max_sources is not None and n > max_sources:
        raise ValueError(f"a mix has at most {max_sources} sources")
    shards = n_shards or max(1, math.ceil(total / shard_words))
    per_block = float(max(1, total / (shards * blocks_per_shard)))
    size = F.col("source_size")
    base = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    plan = stage(source_targets(sizes, total, weights, max_epochs).select(
        "source", "source_size", "rank", "target", base.alias("base"),
        F.greatest(F.rint(size / F.lit(per_block)), F.lit(1)).cast("int").alias("blocks")), "plan")
    cuts = _cut_keys(rows, plan).select(F.col("source").alias("c_source"), "cut_block", "cut", "fits")
    whole = plan.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
    draws = F.col("base").cast("long") * F.col("blocks") + F.coalesce(F.col("cut_block") + 1, F.lit(0))
    drawn = stage(whole.select(
        "source", "source_size", "target", "base", "blocks", "rank",
        F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("fits", F.lit(False)).alias("fits"),
        draws.alias("n_draws"),
        F.floor(F.col("rank") * F.lit(min(n, groups)) / F.lit(max(1, n))).cast("int").alias("part")),
        "drawn")
    dealt = _dealt(drawn, n, shards, groups, seed)
    table = drawn.join(dealt.withColumnRenamed("rank", "d_rank"), F.col("rank") == F.col("d_rank"))
    return Recipe(stage(table.select("source", "source_size", "target", "base", "blocks", "cut",
                                     "fits", "shard_of"), "recipe"), shards)


def _dealt(drawn: DataFrame, n: int, shards: int, groups: int, seed: int) -> DataFrame:
    """(rank, shard_of): the shard of every block draw of each source."""
    spark = drawn.sparkSession
    counts = [0] * min(n, groups)
    for r in drawn.groupBy("part").agg(F.sum("n_draws").alias("n")).collect():  # `groups` at most
        counts[r["part"]] = r["n"]
    quotas = split_quotas(counts, shards, seed)
    parts = [(i, np.repeat(np.arange(shards), [q[i] for q in quotas]).tolist())
             for i in range(len(counts))]
    if n <= groups:  # a group is a source
        return spark.createDataFrame(parts, "rank long, shard_of array<int>")

    def split(sources: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("rank")
        shard_of: list[list[int]] = [[] for _ in range(len(sources))]
        if len(sources):
            dealt = np.asarray(quota["shard_of"].iloc[0], np.int64)
            used, many = np.unique(dealt, return_counts=True)
            edge = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
            if len(used):
                for j, at, node in split_tree(sources["n_draws"].to_numpy(np.int64), edge,
                                              [seed, int(quota["part"].iloc[0]), 1]):
                    for i, k in zip(at[node > 0].tolist(), node[node > 0].tolist()):
                        shard_of[i] += [int(used[j])] * k
        # sorted, the partial last draw of small sources would always fall to late shards
        rng = np.random.default_rng([seed, int(sources["part"].iloc[0]) if len(sources) else 0, 2])
        return pd.DataFrame({"rank": sources["rank"],
                             "shard_of": [rng.permutation(x).astype(int).tolist() for x in shard_of]})

    told = spark.createDataFrame(parts, "part int, shard_of array<int>")
    return drawn.select("part", "rank", "n_draws").groupBy("part").cogroup(
        told.groupBy("part")).applyInPandas(split, "rank long, shard_of array<int>")


def _cut_keys(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the block, key and verdict of the row at which its last,
    partial round ends: rows of smaller keys are drawn, the row itself if at
    least half of it fits.  No row: the round is empty."""
    extra = F.col("target") - F.col("base") * F.col("source_size")
    placed = small_side_join(rows, plan.select("source", "blocks", extra.alias("extra")),
                             ["source"], "inner").withColumn(
        "block", block_of(F.col("key"), F.col("blocks")))
    totals = placed.groupBy("source", "extra", "block").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    at = totals.withColumn("after", F.sum("words").over(run)).withColumn(
        "before", F.col("after") - F.col("words")).where(
        (F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("after")))
    cut_block = stage(at.select("source", F.col("block").alias("cut_block"), "before"), "cuts")
    inside = small_side_join(placed, cut_block, ["source"], "inner").where("block = cut_block")
    ties = inside.groupBy("source", "extra", "cut_block", "before", "key").agg(
        F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = ties.withColumn("after", F.col("before") + F.sum("words").over(order)).where(
        (F.col("after") - F.col("words") <= F.col("extra")) & (F.col("extra") < F.col("after")))
    return found.select("source", "cut_block", F.col("key").alias("cut"),
                        (F.col("after") * 2 - F.col("words") <= F.col("extra") * 2).alias("fits"))


def with_draws(rows: DataFrame, recipe: Recipe, source: str, key: Column) -> DataFrame:
    """Adds source_size, target and draws (the shard of each draw of the row,
    an empty array if the mix leaves it out)."""
    block = block_of(key, F.col("blocks"))
    more = (key < F.col("cut")) | ((key == F.col("cut")) & F.col("fits"))
    whole = F.transform(F.sequence(F.lit(0), F.col("base") - 1), lambda e: F.get(
        F.col("shard_of"), e * F.col("blocks") + block))
    whole = F.when(F.col("base") > 0, whole).otherwise(F.array().cast("array<int>"))
    last = F.array(F.get(F.col("shard_of"), F.col("base") * F.col("blocks") + block))
    out = small_side_join(rows, recipe.table.withColumnRenamed("source", source), [source])
    return out.select(*rows.columns, "source_size", "target",
                      F.when(more, F.concat(whole, last)).otherwise(whole).alias("draws"))


def sized_rows(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """The thin table that the plan is made from, written once."""
    return stage(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"),
                             text_size(docs[text]).alias("size"),
                             order_key(docs[doc_id], seed).alias("key")), "mix")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               source: str = "source", seed: int = 20, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws of every row."""
    rows = sized_rows(docs, doc_id, text, source, seed)
    recipe = plan_mix(rows, seed=seed, **options)
    return with_draws(rows, recipe, "source", F.col("key")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("draws")).alias("taken"), "draws")


def draw_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              source: str = "source", seed: int = 20, **options) -> DataFrame:
    """The mix itself: the rows of `docs` as often as they are drawn, dealt to
    their shards and shuffled inside each."""
    recipe = plan_mix(sized_rows(docs, doc_id, text, source, seed), seed=seed, **options)
    names = docs.columns
    inner = [internal(f"c{i}") for i in range(len(names))]
    k, shard, place = internal("key"), internal("shard"), internal("place")
    rows = docs.toDF(*inner).withColumn(k, order_key(F.col(inner[names.index(doc_id)]), seed))
    drawn = with_draws(rows, recipe, inner[names.index(source)], F.col(k))
    each = drawn.select(*inner, k, F.posexplode("draws").alias(place, shard)).withColumn(
        place, F.xxhash64(F.lit(seed), F.col(k), F.col(place)))
    # one shard a task
    dealt = each.repartitionById(recipe.n_shards, F.col(shard)).sortWithinPartitions(shard, place)
    return dealt.select(*inner).toDF(*names)
