"""The pipeline's stages over given, awkward and empty tables."""
import pytest

import corpus_pipeline as P
from quarry.llm import decontaminate, simhash
from quarry.llm import queries as Q
from quarry.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_take_what_is_kept(spark):
    docs = Q.table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    before = docs
    for name, step in P.STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert docs.join(before, columns, "left_anti").count() == 0, name
        sizes.append(docs.count())
        if step is P.simhash_dedup:
            found = simhash.near_duplicates(docs)
            assert found.select("component_id").distinct().count() == sizes[-1]
        if step is P.benchmark_decontamination:
            assert decontaminate.find_leaks(docs, Q.table(spark, SF, "benchmark")).count() == 0
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1] and sizes[0] > sizes[1] > sizes[2] > sizes[3]
    assert P.run(spark, SF).count() == sizes[-1]


@pytest.mark.parametrize("step", [f for _, f in P.STAGES])
def test_stages_bear_awkward_and_empty_tables(spark, awkward, no_rows, step):
    out = step(spark, awkward, SF)
    out.collect()
    none = step(spark, no_rows, SF)
    assert none.count() == 0
    if step is not P.token_output:
        assert out.columns == awkward.columns and none.columns == no_rows.columns


def test_queries_are_registered():
    names = Q.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert "pipeline" in names and set(Q.oracle_sql()) <= set(names)
