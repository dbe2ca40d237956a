"""Plan properties that matter at scale, checked on every registered query (public explain output)."""

import contextlib
import io
import re

import pytest

from washkit.plans.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan_text(fn(spark, SMALL)) for k, fn in REGISTRY.items()}


def test_no_python_and_no_pairwise_joins(plans):
    for k, p in plans.items():
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF|MapInPandas|FlatMapGroupsInPandas", p), k
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p), k


def test_bounded_groups_never_sort_merge_join(plans):
    for k in ("box_statistics", "access_ladder", "executive_scorecard", "efficiency_histogram"):
        assert "SortMergeJoin" not in plans[k], k


def test_columns_are_pruned(plans):
    # the access view reads every order (all statuses), but only the columns it uses
    orders = [ln for ln in plans["top_countries"].splitlines() if ln.startswith("ReadSchema:") and "o_custkey" in ln]
    assert orders and all("o_totalprice" not in ln and "o_orderkey" not in ln for ln in orders)
    # json_snapshot reads only the two columns it uses from events
    schemas = [ln for ln in plans["json_snapshot"].splitlines() if ln.startswith("ReadSchema:")]
    assert schemas == ["ReadSchema: struct<event_type:string,props:string>"]


def scans(plan: str, table: str) -> int:
    """Scans of a driver table in the initial plan, before any exchange is reused."""
    return sum(f"/{table}.parquet]" in ln for ln in plan.splitlines() if ln.startswith("Location:"))


def test_yearly_kpis_read_each_fact_once_or_twice(plans):
    assert "Subquery" not in plans["executive_scorecard"]  # latest period via per-period sums + max_by, not a filter subquery
    counts = {k: (scans(plans[k], "orders"), scans(plans[k], "lineitem"), scans(plans[k], "events")) for k in
              ("executive_scorecard", "kpi_finance", "kpi_sector", "kpi_service", "access_ladder")}
    assert counts == {"executive_scorecard": (2, 2, 1), "kpi_finance": (1, 2, 0), "kpi_sector": (0, 1, 0), "kpi_service": (0, 1, 0),
                      "access_ladder": (2, 0, 0)}
