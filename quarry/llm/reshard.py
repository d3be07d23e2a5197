"""Resharding by minimum-cost flow: the fewest bytes move to new capacities.

A layout is a folder of Parquet files, one directory for each block of a shard
(`gen=G/shard=S/block=B`), and a manifest (gen, shard, block, rows, bytes) of
the blocks that count.  `write_layout` cuts every shard into blocks of a
bounded size.  `reshard` takes the shards' sizes and new capacities, solves a
minimum-cost flow (a byte that stays costs nothing, one that moves costs one),
turns the flow into ranges of each old shard's byte sequence, and rewrites the
blocks in which a range that moves lies; all other files stay as they are and
only the manifest names them.  `read_layout` gives every row its shard and its
slot, gapless from 0.

Rows: a NULL text counts no bytes besides the one that ends each document; no
shard may be NULL; repeated rows are stored and returned as often as they stand
there; a document of any length is one row of one block;
an empty table gives a layout without blocks.  All columns of the input are
stored inside one struct, so their names can't clash.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import small_side_join
from quarry.session import scratch_uri, stage

#: Bytes of documents in a block (what one task sorts and writes) and blocks
#: in a layout: large layouts have larger blocks, so their number is bounded.
BLOCK_BYTES = 4 << 20
MAX_BLOCKS = 100_000
#: Cells of a shard in which sizes are counted before it is cut into blocks.
CELLS = 4096
BLOCK = ["gen", "shard", "block"]


# --- the flow -------------------------------------------------------------------

def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int,
                  sink: int) -> tuple[int, int, list[int]]:
    """(flow, cost, flow of each edge) of a cheapest largest flow through
    edges (from, to, capacity, cost >= 0): successive shortest paths with
    node potentials, all in whole numbers."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for a, b, cap, c in edges:
        for u, v, r, w in ((a, b, cap, c), (b, a, 0, -c)):
            graph[u].append(len(to))
            to.append(v)
            room.append(r)
            cost.append(w)
    potential, flow, spent = [0] * n, 0, 0
    while True:
        dist: list[int | None] = [None] * n
        via = [-1] * n
        dist[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if room[e] > 0:
                    step = d + cost[e] + potential[u] - potential[to[e]]
                    if dist[to[e]] is None or step < dist[to[e]]:
                        dist[to[e]], via[to[e]] = step, e
                        heapq.heappush(queue, (step, to[e]))
        if dist[sink] is None:
            return flow, spent, [room[2 * i + 1] for i in range(len(edges))]
        for v in range(n):
            if dist[v] is not None:
                potential[v] += dist[v]
        push, v = None, sink
        while v != source:
            e = via[v]
            push = room[e] if push is None else min(push, room[e])
            v = to[e ^ 1]
        v = sink
        while v != source:
            e = via[v]
            room[e] -= push
            room[e ^ 1] += push
            spent += push * cost[e]
            v = to[e ^ 1]
        flow += push


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities at most one byte apart that hold `total` bytes."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan_transfers(sizes: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, bytes) of all transfers, those that stay in place included.

    Old shard i and new shard i are one place.  All moves cost the same a
    byte, so they pass through one hub: the network has three edges a shard,
    and its flow is dealt to pairs in shard order."""
    if sum(capacities) < sum(sizes.values()):
        raise ValueError("the new shards are too small")
    old = sorted(s for s in sizes if sizes[s])
    new = range(len(capacities))
    node = {("old", s): 3 + i for i, s in enumerate(old)}
    node |= {("new", s): 3 + len(old) + s for s in new}
    edges = [(0, node["old", s], sizes[s], 0) for s in old]
    stay = {s: len(edges) + i for i, s in enumerate(s for s in old if s < len(capacities))}
    edges += [(node["old", s], node["new", s], sizes[s], 0) for s in stay]
    away = len(edges)
    edges += [(node["old", s], 2, sizes[s], 1) for s in old]
    come = len(edges)
    edges += [(2, node["new", s], capacities[s], 0) for s in new]
    edges += [(node["new", s], 1, capacities[s], 0) for s in new]
    _, _, flow = min_cost_flow(3 + len(old) + len(capacities), edges, 0, 1)
    wanted = [[s, flow[come + s]] for s in new if flow[come + s]]
    out = []
    for i, s in enumerate(old):
        if s in stay and flow[stay[s]]:
            out.append((s, s, flow[stay[s]]))
        rest = flow[away + i]
        while rest:
            got = min(rest, wanted[-1][1])
            out.append((s, wanted[-1][0], got))
            rest -= got
            wanted[-1][1] -= got
            if not wanted[-1][1]:
                wanted.pop()
    return out


# --- layouts --------------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """A folder of block files and the manifest of those that count."""
    root: str
    schema: T.StructType  # of the documents
    gen: int
    manifest: DataFrame  # gen, shard, block, rows, bytes

    @property
    def files(self) -> DataFrame:
        """Rows of all generations with their block: doc, size, row (place in
        the block), at (bytes before it in the block), was (the shard that a
        rewritten row came from)."""
        fields = T.StructType().add("doc", self.schema)
        for name in ("size", "row", "at", "was", *BLOCK):
            fields.add(name, T.IntegerType() if name in ("was", "gen", "shard") else T.LongType())
        return self.manifest.sparkSession.read.schema(fields).parquet(self.root)


def _write(rows: DataFrame, root: str, gen: int, order: list[Column]) -> DataFrame:
    """Write rows (doc, size, was, shard, block, ...) as the blocks of generation
    `gen`; returns their manifest.  One task sorts a block at a time."""
    within = Window.partitionBy("shard", "block").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "doc", "size", (F.row_number().over(within) - 1).cast("long").alias("row"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"), "was",
        "shard", "block")
    path = f"{root}/gen={gen}"
    placed.write.partitionBy("shard", "block").parquet(path)
    thin = rows.sparkSession.read.schema("size long, shard int, block long").parquet(path)
    return stage(thin
                 .groupBy("shard", "block").agg(F.count("*").alias("rows"),
                                                F.sum("size").alias("bytes"))
                 .select(F.lit(gen).alias("gen"), "shard", "block", "rows", "bytes"), "manifest")


def write_layout(docs: DataFrame, shard: Column, size: Column, key: list[Column],
                 block_bytes: int | None = None, root: str | None = None) -> Layout:
    """Write `docs` (a table) as shards `shard`, cut into blocks of about
    `block_bytes` (default: 4 MB, or a 100,000th of all bytes if that is more)
    by a hash of `key`; `size` gives a row's bytes (1 or more).

    Sizes are counted in cells of the hash.  Rows of a cell much larger than
    the others (one key repeated many times) are dealt over all blocks of
    their shard by row number, so no block outgrows a task."""
    spark = docs.sparkSession
    root = root or scratch_uri(spark, "layout")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), size.cast("long").alias("size"),
                       shard.cast("int").alias("shard"), F.xxhash64(*key).alias("hash"))
    rows = rows.withColumn("cell", F.pmod("hash", F.lit(CELLS)))
    cells = stage(rows.groupBy("shard", "cell").agg(F.sum("size").alias("bytes")), "cells")
    if block_bytes is None:
        total = cells.agg(F.sum("bytes")).first()[0] or 0
        block_bytes = max(BLOCK_BYTES, total // MAX_BLOCKS)
    shards = cells.groupBy("shard").agg(
        F.sum("bytes").alias("total"),
        F.ceil(F.sum("bytes") / F.lit(block_bytes)).alias("blocks"))
    hot = cells.join(shards, "shard").where(
        F.col("bytes") > F.greatest(F.lit(block_bytes), F.lit(4) * F.col("total") / F.lit(CELLS))
    ).select("shard", "cell", F.lit(True).alias("hot"))
    rows = small_side_join(small_side_join(rows, shards.select("shard", "blocks"), ["shard"]),
                           hot, ["shard", "cell"])
    turn = F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(
        F.shiftrightunsigned("hash", 12))
    rows = rows.withColumn("block", F.pmod(turn, F.col("blocks"))).withColumn(
        "was", F.lit(None).cast("int"))
    return Layout(root, docs.schema, 0, _write(rows, root, 0, [F.col("hash"), F.col("size")]))


def shard_sizes(layout: Layout) -> dict[int, int]:
    """Bytes of each shard: one row a shard."""
    return {r["shard"]: r["n"] for r in
            layout.manifest.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}


def reshard(layout: Layout, capacities: list[int]) -> Layout:
    """The layout for shards 0, 1, ... of those capacities in bytes.

    Every shard's sequence of blocks and rows is cut where the flow says: what
    stays comes first, then what goes to each other shard; a row goes where
    its middle byte lies.  A shard so fills its capacity up to half a document
    for each cut."""
    spark: SparkSession = layout.manifest.sparkSession
    cuts, done = [], {}
    for a, b, n in plan_transfers(shard_sizes(layout), capacities):
        lo = done.get(a, 0)
        cuts.append((a, b, lo, lo + n))
        done[a] = lo + n
    cuts = F.broadcast(spark.createDataFrame(cuts, "shard int, to int, lo long, hi long"))
    before = Window.partitionBy("shard").orderBy("gen", "block").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    pieces = layout.manifest.withColumn("start", start).join(cuts, "shard").where(
        (F.col("lo") < F.col("start") + F.col("bytes")) & (F.col("hi") > F.col("start")))
    whole = (F.col("lo") <= F.col("start")) & (F.col("hi") >= F.col("start") + F.col("bytes"))
    pieces = stage(pieces.withColumn("stays", whole & (F.col("to") == F.col("shard"))), "pieces")
    kept = pieces.where("stays").select(*BLOCK, "rows", "bytes")
    number = F.row_number().over(Window.partitionBy("to").orderBy(*BLOCK, "lo")).cast("long") - 1
    moving = pieces.where("not stays").select(
        *BLOCK, "to", "start", "lo", "hi", number.alias("new"))
    rows = small_side_join(layout.files, moving, BLOCK, "inner")
    middle = 2 * (F.col("start") + F.col("at")) + F.col("size")
    rows = rows.where((middle >= 2 * F.col("lo")) & (middle < 2 * F.col("hi")))
    gen = layout.gen + 1
    fresh = _write(rows.select("doc", "size", "row", F.col("shard").alias("was"), F.col("to").alias("shard"),
                               F.col("new").alias("block")), layout.root, gen, [F.col("row")])
    return replace(layout, gen=gen, manifest=stage(kept.unionByName(fresh), "manifest"))


def read_layout(layout: Layout) -> DataFrame:
    """doc, size, shard, slot, old_shard of every row: slots count the rows of
    a shard's blocks in order; `old_shard` is the shard before the last
    reshard."""
    before = Window.partitionBy("shard").orderBy("gen", "block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = layout.manifest.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    found = small_side_join(layout.files, blocks.select(*BLOCK, "base"), BLOCK, "inner")
    old = F.when((F.col("gen") == layout.gen) & F.col("was").isNotNull(), F.col("was"))
    return found.select("doc", "size", "shard", (F.col("base") + F.col("row")).alias("slot"),
                        old.otherwise(F.col("shard")).alias("old_shard"))


def document_size(text: Column) -> Column:
    """UTF-8 bytes of a text (NULL: none) and one that ends it."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def balance(layout: Layout, shards: int) -> Layout:
    """Reshard to that many shards of equal size."""
    return reshard(layout, even_capacities(sum(shard_sizes(layout).values()), shards))
