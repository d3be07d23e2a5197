import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import simhash


def naive_fingerprint(text, k):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
          .replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "ü", "the", "of", "x1"]), max_size=30),
       st.sampled_from([" ", "\n", "\t "]))
def test_fingerprint_is_the_definition(ws, gap):
    assert simhash.fingerprint(gap.join(ws), 4) == naive_fingerprint(gap.join(ws), 4)


def brute_components(fps, max_bits):
    left, out = set(fps), {}
    while left:
        todo, seen = [min(left)], {min(left)}
        while todo:
            x = todo.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= max_bits} - seen
            seen |= near
            todo += near
        left -= seen
        out |= {x: min(seen) for x in seen}
    return out


@pytest.mark.parametrize("block_rows,small", [(4096, 64), (40, 4)])
def test_links_connect_what_is_close(spark, block_rows, small):
    """Spread and dense fingerprints, also through split buckets and forests."""
    rng = np.random.default_rng(5)
    spread = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    centre = int(rng.integers(0, 1 << 63))
    dense = {centre}
    while len(dense) < 250:
        x = list(dense)[int(rng.integers(len(dense)))]
        dense.add(x ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(0, 20))))
    fps = sorted({int(x) for x in spread} | dense)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = simhash.connected_components(simhash.links(df, 4, block_rows, small)).collect()
    found = {r["node"]: r["component"] for r in got}
    assert {x: found.get(x, x) for x in fps} == brute_components(fps, 4)


def test_block_plan_grows_with_the_input():
    for n, blocks in ((10, 5), (10**5, 6), (10**7, 7), (10**9, 8), (10**12, 9)):
        widths, take = simhash.block_plan(n, 4)
        assert sum(widths) == 64 and len(widths) == blocks and take == blocks - 4


def test_awkward_rows(awkward, no_rows):
    rows = {(r["doc_id"], r["fp"]): r["component_id"]
            for r in simhash.near_duplicates(awkward).collect()}
    assert simhash.near_duplicates(awkward).count() == awkward.count()
    assert rows[(1, 0)] == rows[(2, 0)] == rows[(5, 0)] == 1  # no word: linked at zero
    assert len({c for (d, _), c in rows.items() if d in (6, 7)}) == 1  # "one" and "ONE"
    assert rows[next(k for k in rows if k[0] is None)] == 3  # a NULL id names nothing
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None not in ids and {1, 3, 6, 8} <= set(ids)
    assert simhash.near_duplicates(no_rows).count() == 0
    assert simhash.keep_one(no_rows).columns == no_rows.columns
