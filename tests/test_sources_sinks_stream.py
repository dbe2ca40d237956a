import os

import pytest
from pyspark.sql import functions as F

from washkit.operators import access as A
from washkit.operators import service as S
from washkit.sources import files, sinks
from washkit.sources import standins as V
from washkit.streaming import service_stream as SS

SMALL = "/root/testdata/sf0.001"
# Optional folder with real access CSVs and zone GeoJSON files; files are recognised by content.
SAMPLE_DIR = os.environ.get("WASHKIT_SAMPLE_DATA", "")


def _sample(kind: str) -> str | None:
    """Path of the sample file of a kind: 'water'/'sewer' CSV by header, 'polygons'/'points' GeoJSON."""
    if not SAMPLE_DIR or not os.path.isdir(SAMPLE_DIR):
        return None
    for name in sorted(os.listdir(SAMPLE_DIR)):
        path = os.path.join(SAMPLE_DIR, name)
        if name.lower().endswith(".csv"):
            with open(path, encoding="utf-8", errors="replace") as fh:
                head = fh.readline()
            if kind == "water" and head.startswith("country,zone,year,w_"):
                return path
            if kind == "sewer" and head.startswith("country,zone,year,s_"):
                return path
        elif name.lower().endswith(".geojson"):
            with open(path, encoding="utf-8", errors="replace") as fh:
                text = fh.read(4000)
            if kind == "polygons" and '"Polygon"' in text:
                return path
            if kind == "points" and '"Point"' in text:
                return path
    return None


HAVE_SAMPLE = all(_sample(k) for k in ("water", "sewer", "polygons", "points"))
needs_sample = pytest.mark.skipif(not HAVE_SAMPLE, reason="set WASHKIT_SAMPLE_DATA to a folder with sample files")


def test_csv_loader_tolerant_and_typed(spark, tmp_path):
    w = tmp_path / "water.csv"
    w.write_text("country,zone,year,w_safely_managed,w_safely_managed_pct,w_basic,w_basic_pct,w_limited,w_limited_pct,"
                 "w_unimproved,w_unimproved_pct,surface_water,surface_water_pct,w_other_pct,popn_total,households,"
                 "municipal_coverage,type\n"
                 " malawi ,Old Town,2020,84242,13.54,373256,59.98,84187,13.53,56868,07.06,23742,3.82,-0.0,622294,"
                 "147839,70177,w_access\n")
    acc = files.load_access_csv(spark, str(w), str(tmp_path / "missing.csv"))
    r = acc.collect()
    assert len(r) == 1 and r[0]["country"] == "malawi" and r[0]["unimproved_pct"] == 7.06 and r[0]["type"] == "water"
    assert r[0]["year"] == 2020 and r[0]["popn_total"] == 622294
    empty = files.read_csv(spark, str(tmp_path / "nope.csv"), "a STRING", tolerant=True)
    assert empty.count() == 0 and empty.columns == ["a"]


def test_json_document_defaults(spark, tmp_path):
    p = tmp_path / "scene.json"
    p.write_text('{\n "collection_efficiency": 78.0,\n "zones": [{"name": "a", "ladder": {"safely": 40.0}}]\n}')
    df = files.read_json_document(spark, str(p), "collection_efficiency DOUBLE, nrw DOUBLE, "
                                  "zones ARRAY<STRUCT<name: STRING, ladder: STRUCT<safely: DOUBLE>>>",
                                  defaults={"nrw": 25.0})
    r = df.collect()[0]
    assert r["collection_efficiency"] == 78.0 and r["nrw"] == 25.0
    z = df.select(F.inline("zones")).select("name", "ladder.safely").collect()
    assert z[0]["name"] == "a" and z[0]["safely"] == 40.0


def test_sinks_round_trip(spark, tmp_path):
    acc = files.tidy_access(*V.access_sources(V.Tables(spark, SMALL)))
    summ = A.country_summary(acc, 2001)
    csv_dir = sinks.write_csv(summ, str(tmp_path / "summary_csv"), single_file=True)
    back = spark.read.option("header", True).csv(csv_dir)
    assert back.count() == summ.count() and set(back.columns) == set(summ.columns)
    pq = sinks.write_result(acc, str(tmp_path), "access", partition_by=["year"])
    again = spark.read.parquet(pq)
    assert again.count() == acc.count()
    assert again.where("year = 2001").count() == acc.where("year = 2001").count()


def test_streaming_series_equals_batch(spark, tmp_path):
    svc = V.service_month(V.Tables(spark, SMALL))
    src = tmp_path / "src"
    # two arrival batches of the same stand-in rows
    svc.where("year < 1999").write.parquet(str(src / "part1"))
    svc.where("year >= 1999").write.parquet(str(src / "part2"))
    schema = svc.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    q = SS.start_monthly_series(spark, str(src / "*"), schema, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                                allowed_lateness="0 days")
    q.awaitTermination(120)
    streamed = {r["date"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["date"]: r for r in S.service_time_series(S.prepare_service(svc)).collect()}
    # append mode emits every month the watermark has passed: all but the newest one
    assert len(streamed) >= len(batch) - 1 and len(streamed) > 0
    for d, r in streamed.items():
        assert r.asDict() == batch[d].asDict()


@needs_sample
def test_sample_access_files_regression(spark):
    """Regression values of FIXTURES.md §3 on the sample access files."""
    acc = files.load_access_csv(spark, _sample("water"), _sample("sewer"))
    assert acc.count() == 180
    cs = {(r["country"], r["type"]): r for r in A.country_summary(acc, 2024).collect()}
    u = cs[("Uganda", "sewer")]
    assert (u["safely_min"], u["safely_med"], u["safely_max"]) == (33.51, 34.265, 37.73)
    assert (u["sewer_gap_min"], u["sewer_gap_med"], u["sewer_gap_max"]) == (12.86, 13.61, 16.04)
    assert u["zones"] == 4 and u["popn_sum"] == 2245301
    assert cs[("malawi", "water")]["unimproved_med"] == 8.975
    top = {r["country"]: r["mean_safely_pct"] for r in A.top_countries(acc, "water").collect()}
    assert top == {"lesotho": 46.636667, "cameroon": 43.711429, "Uganda": 42.265, "malawi": 11.8175}
    mc = {r["year"]: r["municipal_coverage"] for r in A.municipal_coverage_trend(acc).collect()}
    assert mc[2020] == 102375.722222 and mc[2024] == 120953.222222
    pt = {(r["country"], r["year"]): r["popn_total"] for r in
          A.population_trend(acc, 2020, 2024, per_type_double=True).collect()}
    assert pt[("Uganda", 2020)] == 4000000 and pt[("malawi", 2024)] == 2604358
    zs = {r["name"]: r["safeAccess"] for r in A.zone_summary(acc).collect()}
    assert zs["Kawempe"] == 37.21 and zs["Maseru Urban Council"] == 45.535 and zs["Lumbadzi"] == 17.02


@needs_sample
def test_sample_geojson_extent(spark):
    from washkit.operators import geo as G
    poly = files.read_geojson_polygons(spark, _sample("polygons"))
    assert poly.count() == 18
    shapes = poly.select("name", "country", G.flatten_polygon(F.col("rings")).alias("ring"))
    r = G.zone_extent(shapes).collect()[0]
    assert round(r["centre_lat"], 6) == -12.75294 and round(r["centre_lon"], 6) == 22.629788
    acc = files.load_access_csv(spark, _sample("water"), _sample("sewer"))
    metrics = A.zone_summary(acc)
    miss = [x["name"] for x in G.unmatched_zones(metrics, poly).collect()]
    assert miss == ["Limbadzi"]
    pts = files.read_geojson_points(spark, _sample("points"))
    assert pts.count() == 18 and pts.where("lon IS NULL OR lat IS NULL").count() == 0


def test_ledger_csv_loader(spark, tmp_path):
    p = tmp_path / "ledger.csv"
    p.write_text("Year,Month,Zone,Total Operating Revenues,Total Operating Expenditures,Collection Efficiency,"
                 "Personnel Expenditure as Percentage of O&M Costs,Total Water & Sewerage Billing,Total Collection,"
                 "Operation & Maintenance Cost Coverage\n"
                 "2023,1, Zone A ,100,50,90,10,100,90,200\n2023,2,Zone B,bad,100,80,20,200,160,200\n")
    df = files.read_ledger_csv(spark, str(p))
    r = {x["zone"]: x for x in df.collect()}
    assert r["Zone A"]["total_operating_revenues"] == 100.0 and r["Zone A"]["year"] == 2023
    assert r["Zone B"]["total_operating_revenues"] is None


@needs_sample
def test_sample_access_files_more_values(spark):
    acc = files.load_access_csv(spark, _sample("water"), _sample("sewer"))
    sw = {r["country"]: r for r in A.surface_water_exposure(acc, 2024).collect()}
    exp = {"Uganda": (2.1, 2.62, 3.76, 3475.96, 15262.56, 26068.72),
           "cameroon": (1.09, 1.66, 2.08, 2697.15, 5475.58, 22437.23),
           "lesotho": (1.29, 1.34, 4.7, 867.81, 2893.59, 4654.65),
           "malawi": (2.31, 2.54, 2.78, 428.64, 7379.68, 16683.44)}
    for c, e in exp.items():
        r = sw[c]
        got = (r["pct_min"], r["pct_med"], r["pct_max"], r["users_min"], r["users_med"], r["users_max"])
        assert tuple(round(x, 2) for x in got) == e
    top = {r["country"]: r["mean_safely_pct"] for r in A.top_countries(acc, "sewer").collect()}
    assert top == {"cameroon": 37.854286, "Uganda": 34.9425, "lesotho": 31.013333, "malawi": 24.5325}
    zs = {r["name"]: r["safeAccess"] for r in A.zone_summary(acc).collect()}
    exp_zs = {"Central": 38.08, "Kawempe": 37.21, "Nakawa": 42.385, "Rubaga": 36.74, "Yaounde 1": 38.73,
              "Yaounde 2": 43.44, "Yaounde 3": 41.16, "Yaounde 4": 40.57, "Yaounde 5": 40.14, "Yaounde 6": 40.615,
              "Yaounde 7": 40.825, "Maseru Rural Council": 36.28, "Maseru Urban Council": 45.535,
              "Rural Hinterland": 34.66, "Capital Hill": 20.055, "Kanengo": 15.295, "Lumbadzi": 17.02,
              "Old Town": 20.33}
    assert zs == exp_zs


@needs_sample
def test_sample_geojson_safe_access_golden(spark):
    """The polygons store safeAccess per zone; ours, joined on normalised names (J2), agree."""
    from washkit.operators import geo as G
    acc = files.load_access_csv(spark, _sample("water"), _sample("sewer"))
    poly = files.read_geojson_polygons(spark, _sample("polygons")).withColumn(
        "stored", F.col("properties").getItem("safeAccess").cast("double"))
    en = G.enrich_zones(A.zone_summary(acc), poly.select("name", "country", "stored"), ["safeAccess"]).collect()
    matched = [r for r in en if r["matched"]]
    assert len(en) == 18 and len(matched) == 17
    assert all(abs(r["stored"] - r["safeAccess"]) <= 0.006 for r in matched)


def test_write_results_round_trip(spark, tmp_path):
    from washkit.plans.export import write_results
    from washkit.plans.queries import REGISTRY
    keys = ["country_summary", "service_time_series", "debt_aging"]
    paths = write_results(spark, SMALL, str(tmp_path / "results"), keys)
    for k in keys:
        back = spark.read.parquet(paths[k])
        orig = REGISTRY[k](spark, SMALL)
        assert back.count() == orig.count() and set(back.columns) == set(orig.columns)
    with pytest.raises(KeyError):
        write_results(spark, SMALL, str(tmp_path / "x"), ["no_such_key"])


def test_parallel_arrays_document(spark, tmp_path):
    p = tmp_path / "quality.json"
    p.write_text('{"city": "X", "series": {"months": ["2024-01", "2024-02", "2024-03"],\n'
                 ' "dwq": [96.5, 94.0, 97.1], "hours": [22, 21]}}')
    doc = files.read_json_document(
        spark, str(p), "city STRING, series STRUCT<months: ARRAY<STRING>, dwq: ARRAY<DOUBLE>, hours: ARRAY<INT>>")
    rows = files.parallel_arrays_to_rows(doc, ["series.months", "series.dwq", "series.hours"], ["city"]).collect()
    assert [(r["city"], r["months"], r["dwq"], r["hours"]) for r in rows] == [
        ("X", "2024-01", 96.5, 22), ("X", "2024-02", 94.0, 21), ("X", "2024-03", 97.1, None)]


def test_sector_document_struct_to_long(spark, tmp_path):
    p = tmp_path / "sector.json"
    p.write_text('{"year": 2030, "budget": {"water_pct": 2.5, "sanitation_pct": 1.5, "wash_disbursed_pct": 60},\n'
                 ' "water_stress_pct": 40, "water_use_efficiency": {"agri": 2.0, "manufacturing": 9.5}}')
    doc = files.read_json_document(spark, str(p), "year INT, budget STRUCT<water_pct: DOUBLE, sanitation_pct: DOUBLE, "
                                   "wash_disbursed_pct: DOUBLE>, water_stress_pct DOUBLE, "
                                   "water_use_efficiency STRUCT<agri: DOUBLE, manufacturing: DOUBLE>")
    b = {r["metric"]: r["value"] for r in files.struct_to_long(doc, "budget", ["year"]).collect()}
    assert b == {"water_pct": 2.5, "sanitation_pct": 1.5, "wash_disbursed_pct": 60.0}
    e = files.struct_to_long(doc, "water_use_efficiency", ["year"], name="sector").collect()
    assert {(r["year"], r["sector"], r["value"]) for r in e} == {(2030, "agri", 2.0), (2030, "manufacturing", 9.5)}


def test_typed_csv_loaders(spark, tmp_path):
    b = tmp_path / "bills.csv"
    b.write_text("customer_id,date,billed,paid\n c1 ,2024-01-31,100.5,100\nc2,not-a-date,x,0\n")
    bills = files.read_billing_csv(spark, str(b))
    assert dict((f.name, f.dataType.simpleString()) for f in bills.schema.fields) == \
        {"customer_id": "string", "date": "date", "billed": "double", "paid": "double"}
    r = {x["customer_id"]: x for x in bills.collect()}
    assert str(r["c1"]["date"]) == "2024-01-31" and r["c1"]["billed"] == 100.5
    assert r["c2"]["date"] is None and r["c2"]["billed"] is None
    s = tmp_path / "service.csv"
    s.write_text("country,city,zone,year,month,households,w_supplied,total_consumption,metered,"
                 "tests_conducted_chlorine,test_passed_chlorine,test_conducted_ecoli,tests_passed_ecoli,complaints,"
                 "resolved,sewer_connections,public_toilets\n"
                 "A,B,Z,2024,1,100,1000,800,,10,9,10,10,4,2,50,3\n")
    svc = files.read_service_csv(spark, str(s))
    ts = S.service_time_series(S.prepare_service(svc)).collect()[0]
    assert ts["nrw_rate"] == 20.0 and ts["metered"] == 0.0
    p = tmp_path / "prod.csv"
    p.write_text("date,source,production_m3,service_hours\n2024-01-01,well,10,20\n")
    assert files.read_production_csv(spark, [str(p), str(tmp_path / "missing.csv")], tolerant=True).count() == 1


def test_csv_columns_are_taken_by_header_name(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("date,extra,customer_id,paid,billed\n2024-01-01,x,c1,100.0,10.0\n")
    b.write_text("billed,customer_id\nabc,c2\n5,c3\n")
    got = files.read_csv(spark, [str(a), str(b)], "customer_id STRING, date DATE, billed DOUBLE, paid DOUBLE").collect()
    assert sorted((r.customer_id, str(r.date), r.billed, r.paid) for r in got) == [
        ("c1", "2024-01-01", 10.0, 100.0), ("c2", "None", None, None), ("c3", "None", 5.0, None)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(a), "other STRING")


def test_csv_files_with_equal_headers_are_one_scan(spark, tmp_path):
    schema = "customer_id STRING, billed DOUBLE, year INT"
    paths = []
    for i in range(6):
        at = tmp_path / f"f {i}.csv"
        at.write_text(f"customer_id,billed\nc{i},{i}\n" if i % 2 else f"billed,customer_id\n{i},c{i}\nbad,\n")
        paths.append(str(at))
    got = files.read_csv(spark, paths, schema)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    rows = [(f"c{i}", float(i), None) for i in range(6)] + [(None, None, None)] * 3
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    # folders keep their partition columns, a path given again counts again, empty files hold nothing
    for base, year in (("d1", 2020), ("d2", 2021)):
        (tmp_path / base / f"year={year}").mkdir(parents=True)
        (tmp_path / base / f"year={year}" / "x.csv").write_text("customer_id,billed\nk,1\n")
    (tmp_path / "empty.csv").write_text("")
    more = files.read_csv(spark, [str(tmp_path / "d1"), paths[1], str(tmp_path / "d2"), paths[1], str(tmp_path / "empty.csv")], schema).collect()
    assert sorted(map(tuple, more), key=str) == [("c1", 1.0, None), ("c1", 1.0, None), ("k", 1.0, 2020), ("k", 1.0, 2021)]


def test_absent_json_document_gives_defaults(spark, tmp_path):
    schema = "nrw DOUBLE, budget STRUCT<water: DOUBLE, other: DOUBLE>"
    defaults = {"nrw": 45.0, "budget": {"water": 60.0}}
    assert files.read_json_document(spark, str(tmp_path / "none.json"), schema, defaults).collect()[0].asDict(True) == {"nrw": 45.0, "budget": {"water": 60.0, "other": None}}
    (tmp_path / "d.json").write_text('{"budget": {"other": 1.5}}')
    assert files.read_json_document(spark, str(tmp_path / "d.json"), schema, defaults).collect()[0].asDict(True) == {"nrw": 45.0, "budget": {"water": 60.0, "other": 1.5}}


def test_geojson_points(spark, tmp_path):
    (tmp_path / "p.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"country": "A", "zone": "z"}, "geometry": {"type": "Point", "coordinates": [1.5, -2.0]}}]}')
    assert [tuple(r) for r in files.read_geojson_points(spark, str(tmp_path / "p.geojson")).select("country", "zone", "lon", "lat").collect()] == [("A", "z", 1.5, -2.0)]


def test_every_order_reaches_the_access_table_and_new_files_are_read(spark, tmp_path):
    from washkit.plans.queries import REGISTRY, access_table

    total = access_table(spark, SMALL).agg(F.sum("popn_total")).first()[0]
    assert total == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert "access_union" in REGISTRY
    one = spark.range(5).select(F.col("id").alias("x"))
    one.write.parquet(str(tmp_path / "t.parquet"))
    assert V.Tables(spark, str(tmp_path)).t.count() == 5
    one.write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert V.Tables(spark, str(tmp_path)).t.count() == 10


def test_leaves_of_documents_of_unknown_nesting(spark):
    docs = [(1, '{"a":{"b":[1,{"c":"x","d":null}],"e":{}},"f":true,"g":[],"h":"{}"}'), (2, "no json"), (3, None), (4, "7"), (5, "null"), (6, '{"a":{"a":{"a":{"a":1}}}}'), (7, "[]"), (8, '[[1.5],["t"]]')]
    df = spark.createDataFrame(docs, "id int, doc string")
    got = {(r.id, r.path): r.value for r in files.document_leaves(df, "doc", ["id"]).collect()}
    assert got == {(1, "a.b[0]"): "1", (1, "a.b[1].c"): "x", (1, "f"): "true", (1, "h"): "{}", (4, ""): "7", (6, "a.a.a.a"): "1", (8, "[0][0]"): "1.5", (8, "[1][0]"): "t"}
    cut = {(r.id, r.path): r.value for r in files.document_leaves(df.where("id = 6"), "doc", ["id"], depth=2).collect()}
    assert cut == {(6, "a.a"): '{"a":{"a":1}}'}


def test_sector_documents(spark):
    from washkit.operators import kpi as K
    docs = [("A", '{"resources":{"renewable":200,"withdrawals":50},"use":[{"sector":"farms","output":9,"used":3},{"sector":"towns","output":5,"used":0},{"sector":"new"}],"disaster":{"loss":[1,2.5]}}'),
            ("B", '{"resources":{"renewable":0,"withdrawals":5},"disaster":{"loss":4}}'), ("C", "{"), ("D", '{"use":[],"resources":{}}'), ("E", '{"use":[{"sector":"x","output":"n/a","used":2}]}')]
    df = spark.createDataFrame(docs, "city string, document string")
    got = {(r.city, r.kpi, r.sector): r.value for r in K.sector_document_kpis(df, "document", ["city"]).collect()}
    assert got == {("A", "stress", None): 25.0, ("A", "loss", None): 3.5, ("A", "use_efficiency", "farms"): 3.0, ("A", "use_efficiency", "towns"): None, ("A", "use_efficiency", "new"): None,
                   ("B", "stress", None): None, ("B", "loss", None): 4.0, ("E", "stress", None): None, ("E", "loss", None): None, ("E", "use_efficiency", "x"): None}


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_incremental_results(spark, tmp_path):
    rows = spark.createDataFrame(V.service_month(V.Tables(spark, SMALL)).where("year < 1997").collect(), V.service_month(V.Tables(spark, SMALL)).schema)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        SS.start_incremental_results(spark, src, schema, out).awaitTermination()

    def batch(df):
        return {tuple(sorted(r.asDict().items())) for r in S.service_time_series(S.prepare_service(df)).collect()}

    def result():
        return {tuple(sorted(r.asDict().items())) for r in spark.read.parquet(out).drop("year", "month").collect()}

    late = (F.col("year") == 1995) & (F.col("month") == 3) & (F.col("zone") == "R")
    rows.where(~late & (F.col("year") == 1995)).coalesce(1).write.mode("append").parquet(src)
    run()
    first = _files(out)
    assert result() == batch(rows.where(~late & (F.col("year") == 1995)))
    rows.where(late).coalesce(1).write.mode("append").parquet(src)  # late rows of one month
    run()
    assert result() == batch(rows.where("year = 1995"))
    now = _files(out)
    changed = {p for p in set(first) | set(now) if first.get(p) != now.get(p)}
    assert changed and all("year=1995/month=3/" in p for p in changed)
    rows.where("year = 1996").coalesce(2).write.mode("append").parquet(src)
    run()
    assert result() == batch(rows)
    before = result()
    sinks.replace_partitions(spark.createDataFrame(spark.read.parquet(out).where("year = 1996").collect(), spark.read.parquet(out).schema), out, ["year", "month"])
    assert result() == before  # a repeated write changes nothing
