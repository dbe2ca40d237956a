from conftest import rows
from fixtures import access

from washkit.operators import access as A


def test_tidy_union_types_and_cleaning(spark):
    acc = access(spark)
    d = dict((f.name, f.dataType.simpleString()) for f in acc.schema.fields)
    assert d["year"] == "int" and d["safely_managed_pct"] == "double" and d["popn_total"] == "bigint"
    assert acc.count() == 9  # union row count = sum of parts
    r = rows(acc.where("zone = 'South' AND type = 'water'"))
    assert r[0]["country"] == "alba" and r[0]["unimproved_pct"] is None  # 'x' -> NULL, 'South ' trimmed
    assert set(x["type"] for x in rows(acc)) == {"water", "sewer"}
    assert "open_def_pct" in acc.columns and "surface_water_pct" in acc.columns


def test_country_summary_fixture(spark):
    got = {(r["country"], r["type"]): r for r in rows(A.country_summary(access(spark), 2024))}
    exp = {
        ("BORA", "sewer"): ((10, 27.5, 45), (9, 19.5, 30), (45, 45, 45), 2, 800),
        ("BORA", "water"): ((20, 20, 20), (25, 25, 25), (None, None, None), 1, 500),
        ("alba", "sewer"): ((25, 30, 35), (12, 16, 20), (15, 20.5, 26), 2, 2000),
        ("alba", "water"): ((30, 40, 50), (8, 8, 8), (None, None, None), 2, 2000),
    }
    assert set(got) == set(exp)
    for k, (safely, unimp, gap, zones, pop) in exp.items():
        g = got[k]
        assert (g["safely_min"], g["safely_med"], g["safely_max"]) == safely
        assert (g["unimproved_min"], g["unimproved_med"], g["unimproved_max"]) == unimp
        assert (g["sewer_gap_min"], g["sewer_gap_med"], g["sewer_gap_max"]) == gap
        assert g["zones"] == zones and g["popn_sum"] == pop
        assert g["safely_min"] <= g["safely_med"] <= g["safely_max"]


def test_surface_water_exposure_fixture(spark):
    got = {r["country"]: r for r in rows(A.surface_water_exposure(access(spark), 2024))}
    assert (got["BORA"]["pct_min"], got["BORA"]["pct_med"], got["BORA"]["pct_max"]) == (10, 10, 10)
    assert (got["BORA"]["users_min"], got["BORA"]["users_max"]) == (50, 50)
    assert (got["alba"]["pct_min"], got["alba"]["pct_med"], got["alba"]["pct_max"]) == (4, 4.5, 5)
    assert (got["alba"]["users_min"], got["alba"]["users_med"], got["alba"]["users_max"]) == (36, 45.5, 55)


def test_zone_summary_fixture(spark):
    got = {r["id"]: r for r in rows(A.zone_summary(access(spark)))}
    exp = {
        "bora-port": (60, None, 60, 2022, None),
        "bora-quay": (None, 45, 45, None, 2024),
        "bora-rural-hill": (20, 10, 15, 2024, 2024),
        "alba-north": (50, 35, 42.5, 2024, 2024),
        "alba-south": (30, 25, 27.5, 2024, 2024),
    }
    assert set(got) == set(exp)
    for k, (w, s, sa, wy, sy) in exp.items():
        g = got[k]
        assert (g["water_safely_pct"], g["sewer_safely_pct"], g["safeAccess"], g["water_year"], g["sewer_year"]) == \
            (w, s, sa, wy, sy)


def test_zone_summary_equals_latest_snapshot_outer_merge(spark):
    acc = access(spark)
    w = A.latest_snapshot(acc.where("type='water'"), ["country", "zone"], "year", ["year", "safely_managed_pct"])
    s = A.latest_snapshot(acc.where("type='sewer'"), ["country", "zone"], "year", ["year", "safely_managed_pct"])
    m = A.outer_merge(w, s)
    assert set(m.columns) >= {"year", "year_dup", "safely_managed_pct", "safely_managed_pct_dup"}
    merged = {(r["country"], r["zone"]): (r["safely_managed_pct"], r["safely_managed_pct_dup"]) for r in m.collect()}
    zs = {(r["country"], r["name"]): (r["water_safely_pct"], r["sewer_safely_pct"])
          for r in A.zone_summary(acc).collect()}
    assert merged == zs


def test_population_trend_both_semantics(spark):
    acc = access(spark)
    ours = {(r["country"], r["year"]): r["popn_total"] for r in A.population_trend(acc, 2020, 2024).collect()}
    ref = {(r["country"], r["year"]): r["popn_total"]
           for r in A.population_trend(acc, 2020, 2024, per_type_double=True).collect()}
    assert ours == {("BORA", 2022): 700, ("BORA", 2024): 800, ("alba", 2023): 1000, ("alba", 2024): 2000}
    assert ref == {("BORA", 2022): 700, ("BORA", 2024): 1300, ("alba", 2023): 1000, ("alba", 2024): 4000}


def test_access_ladder_order_and_fill(spark):
    lad = rows(A.access_ladder(access(spark), "water"), ["zone", "rung_order"])
    assert {r["year"] for r in lad} == {2024}
    north = [r for r in lad if r["zone"] == "North"]
    assert [r["level"] for r in north] == ["Surface Water", "Unimproved", "Limited", "Basic", "Safely Managed"]
    south_unimp = [r for r in lad if r["zone"] == "South" and r["level"] == "Unimproved"][0]
    assert south_unimp["pct"] == 0.0  # NULL filled with 0 before stacking
    sew = rows(A.access_ladder(access(spark), "sewer"), ["zone", "rung_order"])
    assert sew[0]["level"] == "Open Def"


def test_top_countries_latest_year_and_limit(spark):
    r = rows(A.top_countries(access(spark), "water", n=1))
    assert len(r) == 1 and r[0]["country"] == "alba" and r[0]["mean_safely_pct"] == 40.0


def test_box_statistics_linear_quartiles(spark):
    df = spark.createDataFrame([("t", float(v)) for v in [1, 2, 3, 4, 100]], "type string, safely_managed_pct double")
    r = rows(A.box_statistics(df, ["safely_managed_pct"], types=["t"]))[0]
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert (r["lower_fence"], r["upper_fence"]) == (-1.0, 7.0)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"], r["n"]) == (1.0, 4.0, 1, 5)


def test_priority_and_focus_and_tags(spark):
    acc = access(spark)
    pr = rows(A.priority_zones(acc, 2024, countries=["bora"], zone_patterns=["north"]))
    assert {(r["country"], r["zone"]) for r in pr} == {("BORA", "Rural Hill"), ("BORA", "Quay"), ("alba", "North")}
    rh = [r for r in pr if r["zone"] == "Rural Hill" and r["type"] == "sewer"][0]
    assert rh["sewer_gap_pct"] == 45.0 and rh["population"] == 500
    ft = rows(A.focus_zone_trend(acc, 2020, 2024, "rural|port"))
    assert {r["zone"] for r in ft} == {"Rural Hill", "Port"}
    ur = {r["zone"]: r["ur_tag"] for r in A.urban_rural_compare(acc, 2024, ["BORA"]).collect()}
    assert ur == {"Rural Hill": "rural", "Quay": "other"}


def test_growth_window(spark):
    df = spark.createDataFrame([("a", 2020, 100), ("a", 2021, 150), ("a", 2022, 0), ("a", 2023, 10)],
                               "zone string, year int, m long")
    g = {r["year"]: r["m_growth_pct"] for r in A.growth(df, ["zone"], "year", ["m"]).collect()}
    assert g == {2020: None, 2021: 50.0, 2022: -100.0, 2023: None}  # x/0 -> NULL


def test_access_ladders_one_pass_equals_per_type(spark):
    acc = access(spark)
    both = rows(A.access_ladders(acc, ("water", "sewer")), ["zone", "level", "rung_order"])
    per = rows(A.access_ladder(acc, "water").unionByName(A.access_ladder(acc, "sewer")),
               ["zone", "level", "rung_order"])
    assert both == per


def test_latest_snapshot_ties_and_tables_without_a_year(spark):
    rows = [("z", 2020, 1.0, 1), ("z", 2021, 2.0, 1), ("z", 2021, 3.0, 0), ("y", None, 9.0, 5)]
    df = spark.createDataFrame(rows, "zone string, year int, pct double, loaded int")
    for parts in (1, 4):
        d = df.repartition(parts)
        assert [r.pct for r in A.latest_snapshot(d, ["zone"], "year", ["pct"]).collect()] == [3.0]
        assert [r.pct for r in A.latest_snapshot(d, ["zone"], "year", ["pct"], tie_breaker=["loaded"]).collect()] == [2.0]
        got = {r.zone: r.pct for r in A.latest_snapshot(d.drop("year"), ["zone"], None, ["pct"], tie_breaker=["loaded"]).collect()}
        assert got == {"z": 2.0, "y": 9.0}


def test_registered_inputs_reach_every_branch(spark):
    from washkit.plans.queries import REGISTRY

    sf = "/root/testdata/sf0.001"
    assert REGISTRY["zone_unmatched"](spark, sf).count() > 0
    merged = REGISTRY["snapshot_merge"](spark, sf)
    assert merged.where("year IS NULL").count() > 0 and merged.where("year_dup IS NULL").count() > 0
    assert {r[0] for r in REGISTRY["urban_rural_compare"](spark, sf).select("ur_tag").distinct().collect()} == {"rural", "urban", "other"}
    assert REGISTRY["access_union"](spark, sf).agg({"popn_total": "sum"}).first()[0] == spark.read.parquet(f"{sf}/orders.parquet").count()
