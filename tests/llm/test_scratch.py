"""Intermediate tables go after use; results and other tables stay."""

import os

import corpus_pipeline as cp
import pytest
from tests.llm.test_pipeline import corpus  # noqa: F401
from washkit.llm.common import scratch, shared_dir, stored, stored_alone


def tables(spark):
    at = shared_dir(spark).removeprefix("file://")
    return {n for n in os.listdir(at) if "-" in n}


def test_tables_of_a_scope_go_and_others_stay(spark):
    before = stored(spark.range(3), "outside")
    known = tables(spark)
    with scratch(spark):
        inner = stored(spark.range(5), "inner")
        with scratch(spark):
            stored(inner, "nested")
            assert len(tables(spark)) == len(known) + 2
        assert len(tables(spark)) == len(known) + 1 and inner.count() == 5
    assert tables(spark) == known and before.count() == 3


def test_tables_go_after_a_failure(spark):
    known = tables(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(spark.range(2), "lost")
        1 / 0  # noqa: B018
    assert tables(spark) == known


def test_a_stored_result_needs_none_of_its_tables(spark):
    known = tables(spark)
    found = stored_alone(lambda: stored(spark.range(4), "step").selectExpr("id * 2 AS id"), spark, "result")
    assert len(tables(spark) - known) == 1 and sorted(r.id for r in found.collect()) == [0, 2, 4, 6]


def test_the_pipeline_leaves_only_its_stages(spark, corpus):  # noqa: F811
    known = tables(spark)
    rows = cp.run(spark, corpus[0]).count()
    left = sorted(n.rsplit("-", 1)[0] for n in tables(spark) - known)
    assert rows > 0 and left == sorted(name.replace(" ", "-") for name, _ in cp.STAGES)
