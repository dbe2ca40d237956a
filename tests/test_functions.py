from pyspark.sql import functions as F

from washkit.functions import columns as C
from washkit.functions import predicates as P


def test_urban_rural_tag(spark):
    df = spark.createDataFrame([(z,) for z in ["Rural Hill", "Port", None, "Maseru Rural Council",
                                                "Maseru Urban Council", "Kawempe"]], "zone string")
    got = {r["zone"]: r["t"] for r in df.select("zone", C.urban_rural_tag(F.col("zone")).alias("t")).collect()}
    assert got == {"Rural Hill": "rural", "Port": "other", None: "unknown", "Maseru Rural Council": "rural",
                   "Maseru Urban Council": "urban", "Kawempe": "urban"}


def test_slug_and_label(spark):
    df = spark.createDataFrame([("Uganda", "Yaounde 1"), (None, None), ("--", "!!")], "c string, z string")
    got = [r[0] for r in df.select(C.zone_slug(F.col("c"), F.col("z"))).collect()]
    assert got == ["uganda-yaounde-1", "na-zone", "zone"]
    lab = spark.createDataFrame([("safely_managed_pct",), ("open_def_pct",)], "c string")
    assert [r[0] for r in lab.select(C.level_label(F.col("c"))).collect()] == ["Safely Managed", "Open Def"]


def test_ratios_null_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 4.0)], "a double, b double")
    got = [r[0] for r in df.select(C.safe_ratio(F.col("a"), F.col("b"), 100.0)).collect()]
    assert got == [None, None, None, 75.0]
    g = [r[0] for r in df.select(C.guarded_ratio(F.col("a"), F.col("b"))).collect()]
    assert g == [1.0, 0.0, None, 0.75]


def test_lenient_number_and_month_date(spark):
    df = spark.createDataFrame([("07.06", 2024, 2), ("x", 2024, 13), (None, None, 1)], "s string, y int, m int")
    r = df.select(C.lenient_number("s").alias("v"), C.month_date(F.col("y"), F.col("m")).alias("d")).collect()
    assert r[0]["v"] == 7.06 and r[1]["v"] is None and r[2]["v"] is None
    assert str(r[0]["d"]) == "2024-02-01" and r[1]["d"] is None


def test_month_range_and_cascade(spark):
    df = spark.createDataFrame([("2001-01-15",), ("2001-03-01",), ("2001-05-01",)], "d string").select(
        F.to_date("d").alias("d"))
    assert df.where(P.month_range("d", "2001-02", "2001-04-30")).count() == 1
    assert df.where(P.month_range("d", None, None)).count() == 3
    assert df.where(P.month_range("d", "not a date", None)).count() == 0  # unparseable bound matches nothing
    t = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "country string, zone string")
    assert P.cascade(t, country="A", zone="All").count() == 2
    assert P.cascade(t, country=None, zone="x").count() == 2


def test_search_and_alignment(spark):
    t = spark.createDataFrame([("Water Quality", "Yes", None), ("Sewer", "Somewhat", "No")],
                              "indicator string, f1 string, f2 string")
    assert t.where(P.any_column_matches(["indicator"], "WATER|sew")).count() == 2
    assert t.where(P.any_column_matches(["indicator"], "w.ter", literal=True)).count() == 0
    assert t.where(P.aligned_with(["f1"])).count() == 2
    assert t.where(P.aligned_with(["f1", "f2"])).count() == 0
    assert t.where(P.aligned_with([])).count() == 2


def test_strip_prefix_and_recode(spark):
    df = spark.createDataFrame([("w_access",), ("s_access",), ("other",)], "w_type string")
    out = C.strip_prefix(df)
    assert out.columns == ["type"]
    assert [r[0] for r in out.select(C.recode("type", C.TYPE_RECODE)).collect()] == ["water", "sewer", "other"]
