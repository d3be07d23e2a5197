from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets_share_the_whole_size(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    t = mixing.share_targets(sizes, weights, 3)
    assert abs(sum(t) - sum(sizes)) < 1e-6
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes))
    free = [x / w for x, s, w in zip(t, sizes, weights) if x < 3 * s - 1e-9]
    assert not free or max(free) - min(free) < 1e-6  # uncapped ones by weight
    for x, s, w in zip(t, sizes, weights):  # none is capped that a plain share would not fill
        assert not free or x / w <= max(free) + 1e-6


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 17), st.integers(0, 9))
def test_quotas_are_exact(counts, shards, seed):
    q = mixing.split_quotas(counts, shards, seed)
    assert [sum(x) for x in zip(*q)] == counts
    sizes = [sum(x) for x in q]
    assert max(sizes) - min(sizes) <= 1 and all(n >= 0 for x in q for n in x)
    assert q == mixing.split_quotas(counts, shards, seed)


def test_quotas_are_hypergeometric():
    """Mean and variance of a shard's share over many seeds."""
    got = np.array([mixing.split_quotas([60, 40], 4, s)[2][0] for s in range(1500)])
    assert abs(got.mean() - 15) < 0.3 and abs(got.var() - 25 * .6 * .4 * 75 / 99) < 0.7


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), None, ["a", "b", "c", "d", None][
        min(4, int(rng.integers(0, 9)))]) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_report_meets_targets_and_agrees_with_the_mix(docs):
    opts = dict(n_shards=7, blocks_per_shard=4)
    rows = mixing.mix_report(docs, **opts).collect()
    src = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target, most = Counter(), {}, defaultdict(int)
    for r in rows:
        s = src[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], most[s] = r["target"], max(most[s], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    drawn = mixing.draw_rows(docs, **opts).collect()
    assert Counter(r["doc_id"] for r in drawn) == Counter(
        {r["doc_id"]: len(r["draws"]) for r in rows if r["draws"]})
    again = mixing.mix_report(docs.repartition(5), **opts).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    shards = Counter(s for r in rows for s in r["draws"])
    assert set(shards) == set(range(7))


def test_awkward_rows(awkward, no_rows):
    rows = mixing.mix_report(awkward).collect()
    assert len(rows) == awkward.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["taken"] for r in rows if r["doc_id"] in (1, 2, 5)} == {0}
    twins = [r for r in rows if r["doc_id"] == 4]
    assert len(twins) == 2 and twins[0] == twins[1]
    mixed = mixing.draw_rows(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == sum(len(r["draws"]) for r in rows)
    assert mixing.mix_report(no_rows).count() == 0 and mixing.draw_rows(no_rows).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_report(awkward, max_sources=2)


def test_sources_have_no_limit(spark):
    """12,000 sources (each host its own): targets as shared on the driver,
    and each draw of a block in a shard."""
    rng = np.random.default_rng(4)
    size = rng.integers(0, 30, 12_000)
    rows = [(i, " ".join(["w"] * int(n)), f"host{i:05d}") for i, n in enumerate(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix_report(docs, n_shards=5).collect()}
    want = mixing.share_targets(size.tolist(), [mixing.WEIGHTS[i % 3] for i in range(12_000)], 3)
    assert len(got) == 12_000
    assert all(abs(got[i]["target"] - t) < 1e-6 for i, t in enumerate(want))
    assert all(abs(got[i]["taken"] - t) <= size[i] for i, t in enumerate(want))
    shards = Counter(s for r in got.values() for s in r["draws"])
    assert set(shards) == set(range(5)) and max(shards.values()) - min(shards.values()) < 200


def test_grouped_sources_are_dealt_alike(docs):
    """Two groups of sources: the same words are taken, whole quotas dealt."""
    opts = dict(n_shards=7, blocks_per_shard=4)
    one = {r["doc_id"]: r for r in mixing.mix_report(docs, **opts).collect()}
    two = {r["doc_id"]: r for r in mixing.mix_report(docs, groups=2, **opts).collect()}
    assert all((one[i]["taken"], one[i]["target"]) == (two[i]["taken"], two[i]["target"])
               and len(one[i]["draws"]) == len(two[i]["draws"]) for i in one)
    assert all(0 <= s < 7 for r in two.values() for s in r["draws"])
