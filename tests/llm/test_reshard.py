"""Minimum-cost-flow resharding: cheapest flows, whole files, gapless slots."""
import itertools
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import queries as Q
from quarry.llm import reshard as R

SF = "/root/testdata/sf0.001"


def cheapest(sizes, capacities):
    """Fewest bytes moved, by trying every way to deal every byte."""
    best = None
    units = [s for s, n in sizes.items() for _ in range(n)]
    for way in itertools.product(range(len(capacities)), repeat=len(units)):
        if all(way.count(j) <= c for j, c in enumerate(capacities)):
            cost = sum(s != j for s, j in zip(units, way))
            best = cost if best is None else min(best, cost)
    return best


def test_plans_move_the_fewest_bytes():
    rnd = random.Random(5)
    for _ in range(60):
        sizes = {s: rnd.randint(0, 3) for s in range(rnd.randint(1, 3))}
        capacities = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 4))]
        if sum(capacities) < sum(sizes.values()):
            continue
        plan = R.plan_transfers(sizes, capacities)
        assert sum(n for a, b, n in plan if a != b) == cheapest(sizes, capacities)
        for s, n in sizes.items():
            assert sum(m for a, _, m in plan if a == s) == n
        for j, c in enumerate(capacities):
            assert sum(m for _, b, m in plan if b == j) <= c


def test_large_plan_is_the_sum_of_surpluses():
    rnd = random.Random(6)
    sizes = {s: rnd.randint(0, 10**12) for s in range(300)}
    capacities = R.even_capacities(sum(sizes.values()), 400)
    plan = R.plan_transfers(sizes, capacities)
    assert sum(n for a, b, n in plan if a != b) == sum(
        max(0, n - capacities[s]) for s, n in sizes.items())


def test_general_flow():
    """A cheaper way round must be found by taking flow back."""
    edges = [(0, 1, 2, 1), (0, 2, 1, 4), (1, 2, 1, 1), (1, 3, 1, 5), (2, 3, 2, 1)]
    flow, cost, each = R.min_cost_flow(4, edges, 0, 3)
    assert (flow, cost) == (3, 6 + 3 + 5) and sum(f * e[3] for f, e in zip(each, edges)) == cost


def check(found, texts, shards):
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(r.size for r in found) == sorted(
        len((t or "").encode()) + 1 for t in texts) and set(sizes) <= set(range(shards))
    return sizes


def test_given_table(spark):
    found = Q.queries()["op13_flow_reshard"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in Q.table(spark, SF, "documents").collect()}
    sizes = check(found, docs.values(), 8)
    assert {r.doc_id for r in found} == set(docs) and len(found) == len(docs)
    for r in found:
        body = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "bytes")
        assert r.old_shard == r.text_crc32 % 5 and r.grown_shard is None
    longest = max(r.size for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= longest
    old = defaultdict(int)
    for r in found:
        old[r.old_shard] += r.size
    even = sum(sizes.values()) / 8
    moved = sum(r.size for r in found if r.shard != r.old_shard)
    assert abs(moved - sum(max(0, n - even) for n in old.values())) <= 8 * longest


def test_only_affected_files_are_rewritten(spark):
    """Blocks that stay whole keep their file; a second reshard, to fewer
    shards, starts from files of two generations."""
    docs = Q.table(spark, SF, "documents")
    crc = F.crc32(F.col("text").cast("binary"))
    size = R.document_size(F.col("text"))
    one = R.write_layout(docs, crc % 3, size, [F.col("doc_id")], block_bytes=5_000)
    assert one.manifest.count() > 60
    def files(layout):
        named = layout.files.withColumn("file", F.input_file_name())
        return {r.file for r in named.join(layout.manifest, R.BLOCK).select("file").collect()}

    before = files(one)
    two = R.balance(one, 4)
    kept = files(two)
    assert len(before & kept) > len(before) / 2 and kept - before
    texts = [r.text for r in docs.collect()]
    sizes = check(R.read_layout(two).collect(), texts, 4)
    assert max(sizes.values()) - min(sizes.values()) <= 22_000
    three = R.reshard(two, [10**9, 0])
    found = R.read_layout(three)
    check(found.collect(), texts, 1)
    assert found.select("doc.*").exceptAll(docs).count() == 0
    assert found.where("old_shard = 0").count() == R.read_layout(two).where("shard = 0").count()


def test_repeated_rows_are_spread_over_blocks(spark):
    docs = spark.range(6000).select((F.col("id") % 2 * F.col("id")).alias("doc_id"),
                                    F.lit("the same text in every row").alias("text"))
    one = R.write_layout(docs, F.lit(0), R.document_size(F.col("text")),
                         [F.col("doc_id"), F.col("text")], block_bytes=10_000)
    largest = one.manifest.agg(F.max("bytes")).first()[0]
    assert largest < 30_000 and one.manifest.agg(F.sum("rows")).first()[0] == 6000


def test_awkward_rows(spark, awkward, no_rows):
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    for docs in (awkward, no_rows):
        old = R.write_layout(docs, crc % 5, R.document_size(F.col("text")), [F.col("doc_id"), crc])
        found = R.read_layout(R.balance(old, 8))
        check(found.collect(), [r.text for r in docs.collect()], 8)
        back = found.select("doc.*")
        assert back.columns == docs.columns and back.exceptAll(docs).count() == 0
