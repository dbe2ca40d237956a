import json

from pyspark.sql import functions as F

from washkit.operators import catalogue as CG
from washkit.operators import finance as FN
from washkit.operators import geo as G
from washkit.sources import files

LEDGER = ("year int, month int, zone string, total_operating_revenues double, total_operating_expenditures double, "
          "collection_efficiency double, personnel_expenditure_pct double, total_billing double, "
          "total_collection double, om_cost_coverage double")


def ledger(spark):
    data = [
        (2023, 1, "A", 100.0, 50.0, 90.0, 10.0, 100.0, 90.0, 200.0),
        (2023, 2, "B", 200.0, 100.0, 80.0, 20.0, 200.0, 160.0, 200.0),
        (2024, 1, "A", 300.0, 150.0, 70.0, 30.0, 300.0, 210.0, 200.0),
        (2024, 2, "A", 400.0, 200.0, 60.0, None, 400.0, 240.0, 200.0),
    ]
    return spark.createDataFrame(data, LEDGER)


def test_ledger_headline_and_totals(spark):
    h = ledger(spark)
    r = FN.ledger_headline(h).collect()[0]
    assert (r["latest_year"], r["total_revenue"], r["total_expenditure"]) == (2024, 700.0, 350.0)
    assert r["mean_collection_efficiency"] == 75.0 and r["mean_personnel_pct"] == 20.0
    yt = {(x["year"], x["measure"]): x["amount"] for x in FN.yearly_totals(h).collect()}
    assert yt == {(2023, "revenue"): 300.0, (2023, "expenditure"): 150.0, (2024, "revenue"): 700.0,
                  (2024, "expenditure"): 350.0}


def test_zone_stats_share_fit_heatmap(spark):
    h = ledger(spark)
    zs = {r["zone"]: r for r in FN.zone_statistics(h, "2023-02-01", "2024-01-31").collect()}
    assert set(zs) == {"A", "B"} and zs["A"]["mean_revenue"] == 300.0
    sh = {r["zone"]: r["share_pct"] for r in FN.share_of_total(h, "zone", FN.EXP).collect()}
    assert abs(sum(sh.values()) - 100.0) < 1e-9 and sh["B"] == 20.0
    fit = FN.revenue_expenditure_fit(h).collect()[0]
    assert (fit["slope"], fit["intercept"], fit["r2"], fit["n"]) == (0.5, 0.0, 1.0, 4)
    hm = FN.efficiency_heatmap(h, [2023, 2024])
    assert hm.columns == ["month", "y2023", "y2024"]
    assert {r["month"]: (r["y2023"], r["y2024"]) for r in hm.collect()} == {1: (90.0, 70.0), 2: (80.0, 60.0)}


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = {r["bin"]: r["n"] for r in FN.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 4: 1} and sum(h.values()) == 5
    one = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert FN.histogram(one, "x", 30).collect()[0]["n"] == 2


def test_billing_and_debt_aging(spark):
    bills = spark.createDataFrame([
        ("c1", "2001-07-31", 100.0, 100.0), ("c2", "2001-07-01", 100.0, 50.0),
        ("c3", "2001-05-01", 100.0, 0.0), ("c4", "2001-08-02", 100.0, 0.0)],
        "customer_id string, d string, billed double, paid double").select(
        "customer_id", F.to_date("d").alias("date"), "billed", "paid")
    b = FN.billing_collection(bills).collect()[0]
    assert (b["billed"], b["collected"], b["outstanding"], b["collection_pct"]) == (400.0, 150.0, 250.0, 37.5)
    ag = {r["bucket"]: (r["outstanding"], r["share_pct"]) for r in FN.debt_aging(bills, "2001-08-01").collect()}
    assert ag == {"0-30 days": (0.0, 0.0), "31-60 days": (50.0, round(50 / 150 * 100, 6)),
                  "90+ days": (100.0, round(100 / 150 * 100, 6))}


def test_production_summary(spark):
    p = spark.createDataFrame([("2024-01-01", "s", 10.0, 20.0), ("2024-01-01", "s", 5.0, 20.0),
                               ("2024-01-02", "s", 3.0, 10.0)],
                              "d string, source string, production_m3 double, service_hours double") \
        .select(F.to_date("d").alias("date"), "source", "production_m3", "service_hours")
    r = FN.production_summary(p).collect()[0]
    assert (r["total_m3"], r["avg_daily_m3"], r["mean_service_hours"], r["days"]) == (18.0, 9.0, 15.0, 2)


def catalogue(spark):
    return spark.createDataFrame([
        ("Access", "Safely managed water", "share of people", "Annual", "Zone", "Yes", None, "Access Ladder",
         "Sanitation Access Ladder"),
        ("Access", "Basic water", "share", "Annual", "Zone", "Somewhat", "Yes", "Access Ladder", "Water Access Ladder"),
        ("Finance", "Collection", "collected over billed", "Monthly", "City", "No", "Yes", "Governance & Finance",
         "Zeta custom"),
        ("Finance", "Opex", "operating cost", "Quarterly", "City", None, "Somewhat", "Governance & Finance",
         "Alpha custom"),
    ], "domain string, indicator string, description string, frequency string, granularity string, jmp string, "
       "iwa string, section string, subcategory string")


def test_catalogue_counts_alignment_filter(spark):
    c = catalogue(spark)
    cnt = {(r["dimension"], r["value"]): r["n"] for r in CG.catalogue_counts(c).collect()}
    assert cnt[("frequency", "Annual")] == 2 and cnt[("domain", "Finance")] == 2
    od = [(r["value"], r["n"]) for r in CG.catalogue_counts(c, ["frequency"], ordered=True).collect()]
    assert od == [("Annual", 2), ("Monthly", 1), ("Quarterly", 1)]
    fw = {(r["dimension"], r["value"]): r["n"] for r in CG.catalogue_counts(c, ["jmp"]).collect()}
    assert fw == {("jmp", "Yes"): 1, ("jmp", "Somewhat"): 1, ("jmp", "No"): 1}  # the NULL is not a value
    al = {(r["framework"], r["status"]): r["indicators"] for r in CG.framework_alignment(c, ["jmp", "iwa"]).collect()}
    assert al == {("jmp", "Yes"): 1, ("jmp", "Somewhat"): 1, ("iwa", "Yes"): 2, ("iwa", "Somewhat"): 1}
    f = CG.apply_filters(c, search="WATER", domains=["Access"], frameworks=["jmp"])
    assert {r["indicator"] for r in f.collect()} == {"Safely managed water", "Basic water"}
    assert CG.apply_filters(c, search="cost|billed", frequencies=[]).count() == 2
    assert CG.apply_filters(c, frameworks=["jmp", "iwa"]).count() == 1
    t = CG.cadence_totals(c).collect()[0]
    assert (t["total"], t["monthly"], t["quarterly"], t["annual"]) == (4, 1, 1, 2)


def test_section_listing_declared_then_alpha(spark):
    c = catalogue(spark)
    got = {(r["section"], r["subcategory"]): r["ordinal"] for r in CG.section_subcategory_listing(c).collect()}
    assert got[("Access Ladder", "Water Access Ladder")] == 1
    assert got[("Access Ladder", "Sanitation Access Ladder")] == 2
    assert got[("Governance & Finance", "Alpha custom")] == 1 and got[("Governance & Finance", "Zeta custom")] == 2
    dv = {(r["field"], r["value"]) for r in CG.distinct_values(c, ["frequency", "jmp"]).collect()}
    assert ("jmp", "Yes") in dv and len([x for x in dv if x[0] == "jmp"]) == 3


def _geojson(tmp_path):
    feats = [
        {"type": "Feature", "properties": {"name": "North", "country": "Alba", "safeAccess": 42.5},
         "geometry": {"type": "Polygon", "coordinates": [[[1.0, 10.0], [3.0, 10.0], [3.0, 12.0], [1.0, 10.0]]]}},
        {"type": "Feature", "properties": {"name": "Limbo", "country": "Alba"},
         "geometry": {"type": "Polygon", "coordinates": [[[-1.0, 8.0], [0.0, 9.0], [-1.0, 8.0]]]}},
    ]
    p = tmp_path / "zones.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=2))
    return str(p)


def test_geojson_extent_and_enrichment(spark, tmp_path):
    poly = files.read_geojson_polygons(spark, _geojson(tmp_path))
    assert poly.count() == 2 and poly.where("name='North'").collect()[0]["properties"]["safeAccess"] == "42.5"
    shapes = poly.select("name", "country", G.flatten_polygon(F.col("rings")).alias("ring"))
    ext = {r["name"]: r for r in G.zone_extent(shapes).collect()}
    assert (ext["North"]["min_lon"], ext["North"]["max_lat"]) == (1.0, 12.0)
    assert (ext["North"]["centre_lon"], ext["North"]["centre_lat"]) == (1.0, 10.0)
    metrics = spark.createDataFrame([(" alba ", "NORTH", 42.5)], "country string, name string, safeAccess double")
    en = {r["name"]: r for r in G.enrich_zones(metrics, G.zone_extent(shapes), ["safeAccess"]).collect()}
    assert en["North"]["matched"] and en["North"]["safeAccess"] == 42.5 and not en["Limbo"]["matched"]
    assert [r["name"] for r in G.unmatched_zones(metrics, shapes).collect()] == ["Limbo"]


def test_enrichment_band(spark, tmp_path):
    poly = files.read_geojson_polygons(spark, _geojson(tmp_path))
    shapes = poly.select("name", "country")
    m = spark.createDataFrame([("Alba", "North", 85.0), ("Alba", "Limbo", 60.0)],
                              "country string, name string, safeAccess double")
    got = {r["name"]: r["band"] for r in G.enrich_zones(m, shapes, ["safeAccess"], band_col="safeAccess").collect()}
    assert got == {"North": "good", "Limbo": "warn"}
    none = G.enrich_zones(m.where("name = 'North'"), shapes, ["safeAccess"], band_col="safeAccess")
    assert {r["name"]: r["band"] for r in none.collect()} == {"North": "good", "Limbo": "none"}


def test_unpaid_bills_count_in_full(spark):
    bills = spark.createDataFrame([("z", "2024-01-01", 100.0, None), ("z", "2024-01-01", 50.0, 20.0)], "zone string, date string, billed double, paid double") \
        .selectExpr("zone", "CAST(date AS DATE) AS date", "billed", "paid")
    rows = FN.debt_aging(bills, "2024-02-01").collect()
    assert sum(float(r["outstanding"]) for r in rows) == 130.0
