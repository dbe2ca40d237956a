"""Hand-made mini-fixture (edge cases: padded text, unparseable number, NULLs, zone in one table only,
older latest year, a type without a gap column). All values arrive as text."""

WATER = [
    # country, zone, year, safely %, unimproved %, surface %, pop
    (" alba ", "North", "2023", "40.0", "10.0", None, "1000"),
    ("alba", "North", "2024", "50.0", "8.0", "5.0", "1100"),
    ("alba", "South ", "2024", "30.0", "x", "4.0", "900"),
    ("BORA", "Rural Hill", "2024", "20.0", "25.0", "10.0", "500"),
    ("BORA", "Port", "2022", "60.0", "5.0", None, "700"),
]
SEWER = [
    # country, zone, year, safely %, unimproved %, open def %, pop
    ("alba", "North", "2024", "35.0", "12.0", "3.0", "1100"),
    ("alba", "South", "2024", "25.0", "20.0", "6.0", "900"),
    ("BORA", "Rural Hill", "2024", "10.0", "30.0", "15.0", "500"),
    ("BORA", "Quay", "2024", "45.0", "9.0", None, "300"),
]


def water_df(spark):
    return spark.createDataFrame(
        [r + ("w_access",) for r in WATER],
        "country string, zone string, year string, w_safely_managed_pct string, w_unimproved_pct string, "
        "surface_water_pct string, popn_total string, type string",
    )


def sewer_df(spark):
    return spark.createDataFrame(
        [r + ("s_access",) for r in SEWER],
        "country string, zone string, year string, s_safely_managed_pct string, s_unimproved_pct string, "
        "open_def_pct string, popn_total string, type string",
    )


def access(spark):
    from washkit.sources.files import tidy_access
    return tidy_access(water_df(spark), sewer_df(spark))
