"""Period spine, growth after gaps, as-of join and months against yearly accounts."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from washkit.operators import periods as PD

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def d(y, m):
    return dt.date(y, m, 1)


def test_gaps_of_years_and_months(spark):
    df = spark.createDataFrame([("a", 2020, 1), ("a", 2023, 2), ("b", 2021, 3), (None, 2019, 4), (None, 2021, 5), ("a", None, 9)], "k string, year int, x long")
    got = sorted((r.k or "", r.year, r.x, r.present) for r in PD.with_gaps(df, ["k"], "year").collect())
    assert got == [("", 2019, 4, True), ("", 2020, None, False), ("", 2021, 5, True), ("a", 2020, 1, True), ("a", 2021, None, False), ("a", 2022, None, False), ("a", 2023, 2, True), ("b", 2021, 3, True)]
    months = spark.createDataFrame([("a", d(2020, 11), 1), ("a", d(2021, 2), 2)], "k string, date date, x long")
    assert [(r.date, r.x) for r in PD.with_gaps(months, ["k"], "date").orderBy("date").collect()] == [(d(2020, 11), 1), (d(2020, 12), None), (d(2021, 1), None), (d(2021, 2), 2)]
    quarters = PD.with_gaps(months.where("x = 1").union(spark.createDataFrame([("a", d(2021, 5), 3)], months.schema)), ["k"], "date", step=3)
    assert [(r.date, r.x) for r in quarters.orderBy("date").collect()] == [(d(2020, 11), 1), (d(2021, 2), None), (d(2021, 5), 3)]


def test_growth_is_null_after_a_gap(spark):
    df = spark.createDataFrame([("a", 2020, 100), ("a", 2022, 150), ("a", 2023, 300), ("a", None, 7)], "zone string, year int, m long")
    got = {r.year: r.m_growth_pct for r in PD.growth(df, ["zone"], "year", ["m"]).collect()}
    assert got == {2020: None, 2022: None, 2023: 100.0}
    filled = {r.year: (r.m, r.m_growth_pct, r.present) for r in PD.growth(df, ["zone"], "year", ["m"], fill=True).collect()}
    assert filled == {2020: (100, None, True), 2021: (None, None, False), 2022: (150, None, True), 2023: (300, 100.0, True)}


def test_growth_by_quarter(spark):
    df = spark.createDataFrame([("a", d(2020, 1), 10), ("a", d(2020, 4), 15), ("a", d(2020, 10), 30)], "zone string, q date, m long")
    assert {r.q.month: r.m_growth_pct for r in PD.growth(df, ["zone"], "q", ["m"], step=3).collect()} == {1: None, 4: 50.0, 10: None}


def test_spine_takes_one_shuffle_by_key(spark):
    df = spark.createDataFrame([("a", 2020, 1)], "k string, year int, x long")
    plan = PD.with_gaps(df, ["k"], "year")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 9)), max_size=8), st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 9)), max_size=8, unique=True))
def test_as_of_takes_the_latest_earlier_row(spark, lefts, rights):
    left = spark.createDataFrame([(*x, i) for i, x in enumerate(lefts)], "k string, p int, id int")
    right = spark.createDataFrame([(*x, x[1] * 10) for x in rights], "k string, q int, v int")
    got = sorted((r.id, r.as_of, r.v) for r in PD.as_of(left, right, ["k"], "p", "q", ["v"]).collect())
    want = []
    for i, (k, p) in enumerate(lefts):
        q = max((q for kk, q in rights if kk == k and q <= p), default=None)
        want.append((i, q, None if q is None else q * 10))
    assert got == want


def test_as_of_nulls(spark):
    left = spark.createDataFrame([(None, 5), ("a", None), ("a", 5)], "k string, p int")
    right = spark.createDataFrame([(None, 1, 7), ("a", 1, 8), ("a", 4, None), ("a", None, 9)], "k string, q int, v int")
    assert {(r.k, r.p, r.as_of, r.v) for r in PD.as_of(left, right, ["k"], "p", "q", ["v"]).collect()} == {(None, 5, 1, 7), ("a", None, None, None), ("a", 5, 4, None)}


def test_months_of_a_year_add_up_to_its_account(spark):
    months = [("c", d(2020, m), u) for m in range(1, 13) for u in (1.0, m * 2.0)] + [("c", d(2022, 3), 5.0), ("e", d(2019, 1), 1.0)]
    accounts = [("c", 2020, 100.0), ("c", 2020, 20.0), ("c", 2021, 36.0)]
    got = PD.month_against_year(spark.createDataFrame(months, "city string, date date, used double"), spark.createDataFrame(accounts, "city string, year int, cost double"), ["city"], "used", ["cost"]).collect()
    by_year = defaultdict(float)
    for r in got:
        by_year[r.city, r.date.year] += r.cost_month or 0
    assert round(by_year["c", 2020], 4) == 120.0 and round(by_year["c", 2021], 4) == 36.0 and by_year["e", 2019] == 0
    rows = {(r.city, r.date): r for r in got}
    assert len(rows) == len(got) == 12 + 12 + 3 + 1
    r = rows["c", d(2020, 4)]
    assert (r.present, r.used, r.account_year, r.cost_month, r.cost_per_unit) == (True, 9.0, 2020, 10.0, round(10 / 9, 6))
    assert (rows["c", d(2021, 5)].present, rows["c", d(2021, 5)].cost_per_unit) == (False, None)
    assert rows["c", d(2022, 3)].account_year == 2021 and rows["e", d(2019, 1)].account_year is None
