import datetime as dt

from pyspark.sql import functions as F

from washkit.operators import kpi as K
from washkit.operators import service as S

SVC_COLS = ("country string, city string, zone string, year int, month int, households long, w_supplied double, "
            "total_consumption double, metered double, tests_conducted_chlorine long, test_passed_chlorine long, "
            "test_conducted_ecoli long, tests_passed_ecoli long, complaints long, resolved long, "
            "sewer_connections long, public_toilets long, popn_total long, metered_connections long, active_connections long")


def svc(spark):
    data = [
        ("C", "X", "z1", 2024, 1, 100, 1000.0, 800.0, 500.0, 10, 9, 10, 10, 4, 2, 50, 3, 400, 70, 90),
        ("C", "X", "z1", 2024, 2, 100, 1000.0, 700.0, None, 10, 10, 0, 0, 0, 0, 60, 3, 400, None, 90),
        ("C", "X", "z2", 2024, 1, 50, 500.0, 500.0, 100.0, 5, 5, 5, 4, 2, 2, 10, 1, 200, 20, 40),
    ]
    return S.prepare_service(spark.createDataFrame(data, SVC_COLS))


def test_rates_and_series(spark):
    s = svc(spark)
    r = {(x["zone"], x["month"]): x for x in s.collect()}
    assert r[("z1", 1)]["water_quality_rate"] == 95.0 and r[("z1", 1)]["nrw_rate"] == 20.0
    assert r[("z1", 2)]["water_quality_rate"] is None  # 0 e-coli tests -> NULL half -> NULL
    assert r[("z1", 2)]["complaint_resolution_rate"] is None
    ts = {x["date"]: x for x in S.service_time_series(s).collect()}
    jan, feb = ts[dt.date(2024, 1, 1)], ts[dt.date(2024, 2, 1)]
    assert jan["w_supplied"] == 1500.0 and jan["metered"] == 600.0 and feb["metered"] == 0.0
    assert jan["nrw_rate"] == 10.0  # mean of row rates (20, 0), not ratio of sums (300/1500=20)
    assert jan["public_toilets"] == 4


def test_last_non_null_per_column(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, None), (2, 1, None)], "k int, d int, v int")
    got = {r["k"]: (r["d"], r["v"]) for r in S.last_non_null(df, ["k"], "d").collect()}
    assert got == {1: (2, 10), 2: (1, None)}


def test_latest_by_zone_and_kpis(spark):
    s = svc(spark)
    lz = {r["zone"]: r for r in S.service_latest_by_zone(s).collect()}
    assert lz["z1"]["date"] == dt.date(2024, 2, 1)
    assert lz["z1"]["metered"] == 500.0  # last non-null, from January
    assert lz["z1"]["water_quality_rate"] == 95.0
    k = {r["kpi"]: r for r in S.service_kpis(s).collect()}
    assert k["nrw_rate"]["value"] == 15.0 and k["nrw_rate"]["status"] == "good"  # mean(30, 0)
    assert k["water_quality_rate"]["value"] == 92.5 and k["water_quality_rate"]["status"] == "warn"
    f = S.service_filtered(s, "C", "All", "z2").collect()
    assert len(f) == 1 and f[0]["w_supplied"] == 500.0


def test_ratio_kpis_ratio_of_sums(spark):
    s = svc(spark)
    got = {(r["zone"], r["kpi_id"]): r["value"] for r in
           K.ratio_kpis(s, ["zone"], [K.BY_ID["F3"], K.BY_ID["C4"], K.BY_ID["C7"]]).collect()}
    assert got[("z1", "F3")] == 25.0  # (2000-1500)/2000
    assert got[("z1", "C4")] == 50.0
    assert abs(got[("z2", "C7")] - 2.5 * 1000 / 30) < 1e-6


def test_data_quality_status(spark):
    s = svc(spark)
    got = {(r["zone"], r["kpi_id"]): r["status"] for r in
           K.data_quality(s, ["zone"], [K.BY_ID["F7"], K.BY_ID["C4"]]).collect()}
    assert got[("z1", "F7")] == "partial" and got[("z2", "F7")] == "complete"
    df = spark.createDataFrame([(None, 1)], "metered_connections long, active_connections long")
    assert K.data_quality(df, [], [K.BY_ID["F7"]]).collect()[0]["status"] == "missing"


def test_sanitation_chain_worked_example(spark):
    df = spark.createDataFrame([("C", 150.0, 68.0, 43.0, 12.0, 60000, 12000, 16400, 120.0, 34.0)],
                               "country string, w_supplied double, ww_collected double, ww_treated double, ww_reused double, "
                               "households long, sewer_connections long, hh_emptied long, fs_treated double, fs_reused double")
    got = {(r["stream"], r["stage"]): r["pct"] for r in K.sanitation_chain(df, ["country"]).collect()}
    assert round(got[("wastewater", "treated")], 1) == 63.2
    assert got[("wastewater", "reused")] == 8.0  # of the water supplied
    assert round(got[("faecal_sludge", "emptied")], 1) == 34.2  # of 48000 non-sewered households
    assert round(got[("faecal_sludge", "reused")], 1) == 28.3
    kpis = {r["kpi_id"]: r["value"] for r in
            K.ratio_kpis(df, ["country"], [K.BY_ID[i] for i in ("S1", "S2", "S3", "S4", "S5")]).collect()}
    assert [round(kpis[i], 1) for i in ("S1", "S2", "S3", "S4", "S5")] == [63.2, 8.0, 34.2, 28.3, 27.9]


def test_documented_inputs_of_service_and_budget_kpis(spark):
    df = spark.createDataFrame([("x", 6, 200, 40.0, 900.0, 3000, 30, 40, 18, 24, 80.0, 100.0)],
                               "zone string, blocks long, sewer_connections long, sewer_length double, total_consumption double, "
                               "popn_total long, metered_connections long, active_connections long, public_toilets long, "
                               "public_spaces long, actual_expenditure double, wash_budget double")
    ids = ("C6", "C6_km", "C7", "F7", "S6", "F12", "F12_pct")
    got = {r["kpi_id"]: r["value"] for r in K.ratio_kpis(df, ["zone"], [K.BY_ID[i] for i in ids]).collect()}
    assert got == {"C6": 30.0, "C6_km": 15.0, "C7": 10.0, "F7": 75.0, "S6": 75.0, "F12": 20.0, "F12_pct": 80.0}


def test_scorecard_direction(spark):
    h = spark.createDataFrame([("F3", 2024, 20.0), ("F1", 2024, 90.0), ("F4", 2024, 0.8)],
                              "kpi_id string, period int, value double")
    got = {r["kpi_id"]: r for r in K.scorecard(h, [K.BY_ID[i] for i in ("F3", "F1", "F4")]).collect()}
    assert got["F3"]["status"] == "good" and got["F3"]["delta"] == -5.0  # lower is better
    assert got["F1"]["status"] == "bad" and got["F1"]["target"] == 95.0
    assert got["F4"]["status"] == "none"  # no target


def test_registry_table(spark):
    t = K.registry_table(spark)
    assert t.count() == len(K.REGISTRY)
    assert t.where(F.col("kpi_id") == "F2").collect()[0]["target"] == 150.0
