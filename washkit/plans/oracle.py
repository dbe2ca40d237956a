"""DuckDB SQL oracles, one per registered query.

Written independently of the Spark code (e.g. ``row_number`` + full outer join
where Spark uses a conditional ``max_by``), over the same parquet views the
driver registers. Stand-in views are repeated here as CTEs. Float statistics are
rounded the same way on both sides; ratios keep the operand order of the Spark
expression so both engines do identical IEEE operations.
"""

from __future__ import annotations

from washkit.plans import params as X

# --------------------------------------------------------------------------- stand-in views
ACCESS_CTE = """
pc AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, if(coalesce(o_orderstatus, '') = 'O', 'O', 'F') AS status, count(*) AS n,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS p1,
         count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS p2,
         count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS p3,
         count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS p4,
         count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS p5
  FROM orders GROUP BY 1, 2, 3),
cnt AS (
  SELECT r_name AS country,
         n_name || if(n_nationkey % 5 = 4 AND status = 'O', ' OLD TOWN',
                      if(n_nationkey % 8 = 3, ' KAMPALA', if(n_nationkey % 4 = 1, ' RURAL', if(n_nationkey % 4 = 2, ' URBAN', '')))) AS zone,
         year, status, sum(n) AS n, sum(p1) AS p1, sum(p2) AS p2,
         sum(p3) AS p3, sum(p4) AS p4, sum(p5) AS p5, count(*) AS hh
  FROM pc JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4),
access AS (
  SELECT country, zone, year,
         CAST(p1 AS BIGINT) AS safely_managed, 1e2 * p1 / n AS safely_managed_pct,
         CAST(p2 AS BIGINT) AS basic, 1e2 * p2 / n AS basic_pct,
         CAST(p3 AS BIGINT) AS limited, 1e2 * p3 / n AS limited_pct,
         CAST(p4 AS BIGINT) AS unimproved, 1e2 * p4 / n AS unimproved_pct,
         CASE WHEN status = 'F' THEN CAST(p5 AS BIGINT) END AS surface_water,
         CASE WHEN status = 'F' THEN 1e2 * p5 / n END AS surface_water_pct,
         0e0 AS other_pct, CAST(n AS BIGINT) AS popn_total, CAST(hh AS BIGINT) AS households,
         CASE WHEN status = 'F' THEN CAST(p1 + p2 AS BIGINT) END AS municipal_coverage,
         CASE WHEN status = 'F' THEN 'water' ELSE 'sewer' END AS type,
         CASE WHEN status = 'O' THEN CAST(p5 AS BIGINT) END AS open_def,
         CASE WHEN status = 'O' THEN 1e2 * p5 / n END AS open_def_pct
  FROM cnt)
"""

Y = X.LATEST_YEAR
T0, T1 = X.TREND_START, X.TREND_END


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _latest(type_value: str, prefix: str) -> str:
    return f"""
{prefix} AS (
  SELECT country, zone, year AS {prefix}_year, safely_managed_pct AS {prefix}_safely_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY country, zone ORDER BY year DESC) AS rn
    FROM access WHERE type = '{type_value}' AND year IS NOT NULL) WHERE rn = 1)"""


def _ladder_sql(type_value: str) -> str:
    low = ("surface_water_pct", "Surface Water") if type_value == "water" else ("open_def_pct", "Open Def")
    rungs = [low, ("unimproved_pct", "Unimproved"), ("limited_pct", "Limited"), ("basic_pct", "Basic"),
             ("safely_managed_pct", "Safely Managed")]
    src = (f"(SELECT * FROM access WHERE lower(type) = '{type_value}' AND year = "
           f"(SELECT max(year) FROM access WHERE lower(type) = '{type_value}'))")
    parts = [f"SELECT country, zone, year, type, '{label}' AS level, {i + 1} AS rung_order, coalesce({col}, 0e0) AS pct "
             f"FROM {src}"
             for i, (col, label) in enumerate(rungs)]
    return "\nUNION ALL\n".join(parts)


def _box_long() -> str:
    parts = [f"SELECT type, '{m}' AS measure, {m} AS value FROM access"
             for m in ("safely_managed_pct", "basic_pct", "limited_pct", "unimproved_pct")]
    return "long AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL)"


def _growth_cols(measures: list[str]) -> str:
    out = []
    for m in measures:
        out.append(f"CAST(g.{m} AS BIGINT) AS {m}")
        out.append(f"round(CAST(g.{m} - p.{m} AS DOUBLE) / nullif(CAST(p.{m} AS DOUBLE), 0) * 1e2, 6) AS {m}_growth_pct")
    return ", ".join(out)


SQL: dict[str, str] = {}

SQL["country_summary"] = _with(ACCESS_CTE) + f"""
SELECT country, type,
  min(safely_managed_pct) AS safely_min, round(median(safely_managed_pct), 6) AS safely_med, max(safely_managed_pct) AS safely_max,
  min(open_def_pct) AS open_def_min, round(median(open_def_pct), 6) AS open_def_med, max(open_def_pct) AS open_def_max,
  min(unimproved_pct) AS unimproved_min, round(median(unimproved_pct), 6) AS unimproved_med, max(unimproved_pct) AS unimproved_max,
  min(unimproved_pct + open_def_pct) AS sewer_gap_min, round(median(unimproved_pct + open_def_pct), 6) AS sewer_gap_med,
  max(unimproved_pct + open_def_pct) AS sewer_gap_max,
  count(DISTINCT zone) AS zones, CAST(coalesce(sum(popn_total), 0) AS BIGINT) AS popn_sum
FROM access WHERE year = {Y} AND country IS NOT NULL AND type IS NOT NULL
GROUP BY country, type
"""

_SW = f"""sw AS (SELECT country, zone, year, surface_water_pct, popn_total, surface_water_pct / 1e2 * popn_total AS users
  FROM access WHERE year = {Y} AND type = 'water' AND surface_water_pct IS NOT NULL AND popn_total IS NOT NULL)"""

SQL["surface_water_zones"] = _with(ACCESS_CTE, _SW) + """
SELECT country, zone, year, surface_water_pct, popn_total, round(users, 6) AS surface_users_est FROM sw
"""

SQL["surface_water_exposure"] = _with(ACCESS_CTE, _SW) + """
SELECT country, min(surface_water_pct) AS pct_min, round(median(surface_water_pct), 6) AS pct_med,
  max(surface_water_pct) AS pct_max, round(min(users), 6) AS users_min, round(median(users), 6) AS users_med,
  round(max(users), 6) AS users_max
FROM sw GROUP BY country
"""

SQL["population_trend"] = _with(ACCESS_CTE) + f"""
SELECT country, year, CAST(coalesce(sum(p), 0) AS BIGINT) AS popn_total FROM (
  SELECT country, zone, year, max(popn_total) AS p FROM access
  WHERE year BETWEEN {T0} AND {T1} AND country IS NOT NULL AND year IS NOT NULL GROUP BY country, zone, year)
GROUP BY country, year
"""

SQL["municipal_coverage_trend"] = _with(ACCESS_CTE) + """
SELECT type, year, round(avg(municipal_coverage), 6) AS municipal_coverage FROM access
WHERE municipal_coverage IS NOT NULL AND year IS NOT NULL GROUP BY type, year
"""

SQL["top_countries"] = _with(ACCESS_CTE) + f"""
SELECT country, round(avg(safely_managed_pct), 6) AS mean_safely_pct FROM access
WHERE lower(type) = 'water' AND year = (SELECT max(year) FROM access WHERE lower(type) = 'water' AND year IS NOT NULL)
  AND safely_managed_pct IS NOT NULL
GROUP BY country ORDER BY avg(safely_managed_pct) DESC, country LIMIT {X.TOP_N}
"""

SQL["latest_snapshot"] = _with(ACCESS_CTE) + """
SELECT country, zone, year, safely_managed_pct, basic_pct, surface_water_pct, popn_total FROM (
  SELECT *, row_number() OVER (PARTITION BY country, zone ORDER BY year DESC) AS rn
  FROM access WHERE type = 'water' AND year IS NOT NULL) WHERE rn = 1
"""

SQL["zone_summary"] = _with(ACCESS_CTE, _latest("water", "water"), _latest("sewer", "sewer")) + """
, m AS (
  SELECT coalesce(water.country, sewer.country) AS country, coalesce(water.zone, sewer.zone) AS zone,
         water_year, water_safely_pct, sewer_year, sewer_safely_pct
  FROM water FULL OUTER JOIN sewer ON water.country = sewer.country AND water.zone = sewer.zone),
s AS (SELECT *, trim(regexp_replace(lower(coalesce(country, 'na') || '-' || coalesce(zone, 'zone')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM m)
SELECT CASE WHEN slug = '' THEN 'zone' ELSE slug END AS id, zone AS name, country,
  round(CASE WHEN water_safely_pct IS NULL THEN sewer_safely_pct WHEN sewer_safely_pct IS NULL THEN water_safely_pct
             ELSE (water_safely_pct + sewer_safely_pct) / 2e0 END, 6) AS safeAccess,
  water_safely_pct, sewer_safely_pct, water_year, sewer_year
FROM s
"""

SQL["access_ladder"] = _with(ACCESS_CTE) + _ladder_sql("water") + "\nUNION ALL\n" + _ladder_sql("sewer")

SQL["box_statistics"] = _with(ACCESS_CTE, _box_long()) + """
, st AS (SELECT type, measure, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
               quantile_cont(value, 0.75) AS q3 FROM long GROUP BY type, measure),
f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lf, q3 + 1.5e0 * (q3 - q1) AS uf FROM st)
SELECT f.type, f.measure, f.n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(lf, 6) AS lower_fence, round(uf, 6) AS upper_fence,
  min(value) FILTER (WHERE value BETWEEN lf AND uf) AS whisker_low,
  max(value) FILTER (WHERE value BETWEEN lf AND uf) AS whisker_high,
  count(*) FILTER (WHERE NOT (value BETWEEN lf AND uf)) AS n_outliers
FROM f JOIN long ON f.type = long.type AND f.measure = long.measure
GROUP BY f.type, f.measure, f.n, q1, med, q3, lf, uf
"""

SQL["focus_zone_trend"] = _with(ACCESS_CTE) + f"""
SELECT country, type, zone, year, safely_managed_pct FROM access
WHERE year BETWEEN {T0} AND {T1}
  AND (coalesce(regexp_matches(zone, '{X.FOCUS_ZONE_PATTERN}', 'i'), false)
       OR coalesce(upper(country) IN ({", ".join(repr(c) for c in X.FOCUS_COUNTRIES)}), false))
"""

SQL["urban_rural_compare"] = _with(ACCESS_CTE) + f"""
SELECT country, zone, type, safely_managed_pct, open_def_pct, unimproved_pct,
  CASE WHEN zone IS NULL THEN 'unknown' WHEN contains(lower(zone), 'rural') THEN 'rural'
       WHEN contains(lower(zone), 'urban') THEN 'urban'
       WHEN regexp_matches(lower(zone), 'yaounde|douala|kawempe|kampala|maseru|lilongwe|blantyre') THEN 'urban'
       ELSE 'other' END AS ur_tag
FROM access WHERE year = {Y} AND upper(country) IN ({", ".join(repr(c) for c in X.COMPARE_COUNTRIES)})
"""

_pairs = " OR ".join(f"(upper(country) = '{c}' AND regexp_matches(zone, '{p}', 'i'))" for c, p in X.PRIORITY_PAIRS)
_pats = " OR ".join(f"regexp_matches(zone, '{p}', 'i')" for p in X.PRIORITY_ZONE_PATTERNS)
SQL["priority_zones"] = _with(ACCESS_CTE) + f"""
SELECT country, zone, type, CAST(round(CAST(popn_total AS DOUBLE), 0) AS BIGINT) AS population,
  round(safely_managed_pct, 1) AS safely_managed_pct, round(open_def_pct, 1) AS open_def_pct,
  round(unimproved_pct, 1) AS unimproved_pct, round(unimproved_pct + open_def_pct, 1) AS sewer_gap_pct
FROM access WHERE year = {Y}
  AND (upper(country) IN ({", ".join(repr(c) for c in X.PRIORITY_COUNTRIES)}) OR {_pats} OR {_pairs})
ORDER BY country, zone, type
"""

SQL["access_union"] = _with(ACCESS_CTE) + "SELECT * FROM access"

SQL["coverage_growth"] = _with(ACCESS_CTE) + f"""
, g AS (SELECT country, zone, type, year, sum(municipal_coverage) AS municipal_coverage, sum(households) AS households,
               sum(popn_total) AS popn_total FROM access GROUP BY country, zone, type, year)
SELECT g.country, g.zone, g.type, g.year, {_growth_cols(["municipal_coverage", "households", "popn_total"])}
FROM g LEFT JOIN g p ON p.country = g.country AND p.zone = g.zone AND p.type = g.type AND p.year = g.year - 1
"""


# =========================================================================== service
SERVICE_CTE = """
svc AS (
  SELECT r_name AS country, n_name AS city, l_returnflag AS zone, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS households, sum(l_linenumber)::BIGINT AS popn_total,
         sum(l_quantity) AS w_supplied,
         CAST(sum(CAST(floor((l_quantity * (1e0 - l_discount)) * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / 1e4 AS total_consumption,
         sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS metered,
         count(*) FILTER (WHERE l_linenumber <= 5) AS active_connections,
         count(*) FILTER (WHERE l_linenumber <= 5 AND l_tax > 2e-2) AS metered_connections,
         count(*) FILTER (WHERE l_linenumber <= 4) AS tests_conducted_chlorine,
         count(*) FILTER (WHERE l_linenumber <= 4 AND l_tax <= 6e-2) AS test_passed_chlorine,
         count(*) FILTER (WHERE l_linenumber >= 2) AS test_conducted_ecoli,
         count(*) FILTER (WHERE l_linenumber >= 2 AND l_discount > 2e-2) AS tests_passed_ecoli,
         count(*) FILTER (WHERE l_quantity > 25) AS complaints,
         count(*) FILTER (WHERE l_quantity > 25 AND l_linestatus = 'F') AS resolved,
         count(*) FILTER (WHERE l_quantity > 45) AS blocks,
         sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS sewer_length,
         count(*) FILTER (WHERE l_linestatus = 'O') AS sewer_connections,
         CAST(sum(CAST(floor(l_quantity * (1e0 - l_tax) * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / 1e4 AS ww_collected,
         CAST(sum(CAST(floor(l_quantity * (1e0 - l_tax) * (1e0 - l_discount) * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / 1e4 AS ww_treated,
         CAST(sum(CAST(floor(l_quantity * l_discount * 1e4 + 5e-1) AS BIGINT)) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) / 1e4 AS ww_reused,
         count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount >= 5e-2) AS hh_emptied,
         sum(l_quantity) FILTER (WHERE l_linenumber >= 3) AS fs_treated,
         sum(l_quantity) FILTER (WHERE l_linenumber >= 5) AS fs_reused,
         count(*) FILTER (WHERE l_linenumber = 1) AS public_toilets,
         count(*) FILTER (WHERE l_linenumber <= 2) AS public_spaces
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4, 5),
sp AS (
  SELECT *, make_date(year, month, 1) AS date,
    (CAST(test_passed_chlorine AS DOUBLE) / nullif(CAST(tests_conducted_chlorine AS DOUBLE), 0) * 1e2
     + CAST(tests_passed_ecoli AS DOUBLE) / nullif(CAST(test_conducted_ecoli AS DOUBLE), 0) * 1e2) / 2e0 AS water_quality_rate,
    CAST(resolved AS DOUBLE) / nullif(CAST(complaints AS DOUBLE), 0) * 1e2 AS complaint_resolution_rate,
    (w_supplied - total_consumption) / nullif(w_supplied, 0) * 1e2 AS nrw_rate,
    CAST(sewer_connections AS DOUBLE) / nullif(CAST(households AS DOUBLE), 0) * 1e2 AS sewer_coverage_rate
  FROM svc)
"""

_RATES = ["water_quality_rate", "complaint_resolution_rate", "nrw_rate", "sewer_coverage_rate"]
_SVC_INT = ["households", "popn_total", "active_connections", "metered_connections", "blocks", "hh_emptied", "public_spaces",
            "tests_conducted_chlorine", "test_passed_chlorine", "test_conducted_ecoli",
            "tests_passed_ecoli", "complaints", "resolved", "sewer_connections", "public_toilets"]
_SVC_DBL = ["w_supplied", "total_consumption", "metered", "sewer_length", "ww_collected", "ww_treated", "ww_reused",
            "fs_treated", "fs_reused"]


def _series(where: str = "") -> str:
    rates = ", ".join(f"round(avg({r}), 6) AS {r}" for r in _RATES)
    return f"""
SELECT date, round(coalesce(sum(w_supplied), 0e0), 6) AS w_supplied,
  round(coalesce(sum(total_consumption), 0e0), 6) AS total_consumption,
  round(coalesce(sum(metered), 0e0), 6) AS metered, {rates},
  CAST(coalesce(sum(public_toilets), 0) AS BIGINT) AS public_toilets
FROM sp {where} GROUP BY date
"""


def _dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _ratio_kpi_sql(src: str, by: list[str], formulas, digits: int = 6) -> str:
    """Long-form KPI values (by..., kpi_id, value) of (id, numerator, denominator or None, scale)."""
    sums = ", ".join(f"sum({num}) AS n{i}" + (f", sum({den}) AS d{i}" if den is not None else "")
                     for i, (_, num, den, _) in enumerate(formulas))
    keys = ", ".join(by)
    parts = [
        (f"SELECT {keys}, '{k}' AS kpi_id, round(CAST(n{i} AS DOUBLE) / nullif(CAST(d{i} AS DOUBLE), 0) * "
         f"{_dbl(scale)}, {digits}) AS value FROM g") if den is not None else
        (f"SELECT {keys}, '{k}' AS kpi_id, round(CAST(n{i} AS DOUBLE) * {_dbl(scale)}, {digits}) AS value FROM g")
        for i, (k, _, den, scale) in enumerate(formulas)
    ]
    return f"g AS (SELECT {keys}, {sums} FROM {src} GROUP BY {keys})\n" + "\nUNION ALL\n".join(parts)


# Formulas written out here, not taken from the library: (id, numerator, denominator, scale).
_SERVICE_KPIS = [
    ("B4", "sewer_connections", "households", 100),
    ("C1", "test_passed_chlorine + tests_passed_ecoli", "tests_conducted_chlorine + test_conducted_ecoli", 100),
    ("C4", "resolved", "complaints", 100),
    ("C6", "blocks", "sewer_connections", 1000),
    ("C6_km", "blocks", "sewer_length", 100),
    ("C7", "total_consumption", "popn_total", 1000 / 30),
    ("F3", "w_supplied - total_consumption", "w_supplied", 100),
    ("F7", "metered_connections", "active_connections", 100),
]
_SANITATION_KPIS = [
    ("S1", "ww_treated", "ww_collected", 100),
    ("S2", "ww_reused", "w_supplied", 100),
    ("S3", "hh_emptied", "households - sewer_connections", 100),
    ("S4", "fs_reused", "fs_treated", 100),
    ("S5", "ww_reused", "ww_treated", 100),
    ("S6", "public_toilets", "public_spaces", 100),
]
_ACCESS_KPIS = [
    ("A_safely", "safely_managed", "popn_total", 100), ("A_basic", "basic", "popn_total", 100),
    ("A_limited", "limited", "popn_total", 100), ("A_unimproved", "unimproved", "popn_total", 100),
    ("A_surface", "surface_water", "popn_total", 100), ("A_open_def", "open_def", "popn_total", 100),
    ("B1", "municipal_coverage", "popn_total", 100),
]
_GOVERNANCE_KPIS = [
    ("G1", "active_providers", "total_providers", 100), ("G2", "active_licensed", "total_licensed", 100),
    ("G4", "training_budget", "wash_budget", 100), ("N1", "water_budget", "wash_budget", 100),
    ("G6", "total_staff", None, 1), ("AH", "assets_good", "assets_total", 100),
]


SQL["service_time_series"] = _with(SERVICE_CTE) + _series()

SQL["service_filtered"] = _with(SERVICE_CTE) + _series(
    f"WHERE country = '{X.SERVICE_COUNTRY}' AND zone = '{X.SERVICE_ZONE}'")

_last_cols = ", ".join(
    (f"round(arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL), 6) AS {c}" if c in _SVC_DBL + _RATES
     else f"arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}")
    for c in ["year", "month"] + _SVC_INT + _SVC_DBL + _RATES)
SQL["service_latest_by_zone"] = _with(SERVICE_CTE) + f"""
SELECT country, city, zone, max(date) AS date, {_last_cols} FROM sp GROUP BY country, city, zone
"""

_targets = [("nrw_rate", 25.0, False, "bad"), ("water_quality_rate", 95.0, True, "warn"),
            ("sewer_coverage_rate", 80.0, True, "warn"), ("complaint_resolution_rate", 90.0, True, "warn")]
SQL["service_kpis"] = _with(SERVICE_CTE) + """
, lt AS (SELECT country, city, zone, """ + ", ".join(
    f"arg_max({r}, date) FILTER (WHERE {r} IS NOT NULL) AS {r}" for r in _RATES) + """
  FROM sp GROUP BY country, city, zone),
ga AS (SELECT """ + ", ".join(f"avg({r}) AS {r}" for r in _RATES) + """ FROM lt)
""" + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS kpi, round({k}, 6) AS value, {t!r}e0 AS target, {str(up).lower()} AS higher_is_better, "
    f"CASE WHEN {k} IS NULL THEN 'none' WHEN {k} {'>=' if up else '<='} {t!r}e0 THEN 'good' ELSE '{miss}' END AS status FROM ga"
    for k, t, up, miss in _targets)

SQL["kpi_service"] = _with(SERVICE_CTE) + ", " + _ratio_kpi_sql("sp", ["country", "city", "date"], _SERVICE_KPIS)
SQL["kpi_sanitation"] = _with(SERVICE_CTE) + ", " + _ratio_kpi_sql("sp", ["country", "city", "year"], _SANITATION_KPIS)

_chain = [
    ("wastewater", "collected", 1, "collected", "NULL"),
    ("wastewater", "treated", 2, "treated", "treated / nullif(collected, 0) * 1e2"),
    ("wastewater", "reused", 3, "reused", "reused / nullif(supplied, 0) * 1e2"),
    ("faecal_sludge", "non_sewered", 1, "non_sewered", "NULL"),
    ("faecal_sludge", "emptied", 2, "emptied", "emptied / nullif(non_sewered, 0) * 1e2"),
    ("faecal_sludge", "treated", 3, "fs_treated", "NULL"),
    ("faecal_sludge", "reused", 4, "fs_reused", "fs_reused / nullif(fs_treated, 0) * 1e2"),
]
SQL["sanitation_chain"] = _with(SERVICE_CTE) + """
, ch AS (SELECT country, sum(ww_collected) AS collected, sum(ww_treated) AS treated, sum(ww_reused) AS reused,
    sum(w_supplied) AS supplied, CAST(sum(households - sewer_connections) AS DOUBLE) AS non_sewered,
    CAST(sum(hh_emptied) AS DOUBLE) AS emptied, sum(fs_treated) AS fs_treated, sum(fs_reused) AS fs_reused
  FROM sp GROUP BY country)
""" + "\nUNION ALL\n".join(
    f"SELECT country, '{s}' AS stream, '{g}' AS stage, {o} AS stage_order, round({v}, 6) AS volume, "
    f"round(CAST({p} AS DOUBLE), 6) AS pct FROM ch" for s, g, o, v, p in _chain)

SQL["data_quality"] = _with(SERVICE_CTE) + "\n" + "\nUNION ALL\n".join(
    f"""SELECT country, '{k}' AS kpi_id, count(*) AS n_rows,
  count(*) FILTER (WHERE ({num}) IS NOT NULL AND ({den}) IS NOT NULL) AS n_complete,
  CASE WHEN count(*) FILTER (WHERE ({num}) IS NOT NULL AND ({den}) IS NOT NULL) = count(*) THEN 'complete'
       WHEN count(*) FILTER (WHERE ({num}) IS NOT NULL AND ({den}) IS NOT NULL) > 0 THEN 'partial'
       ELSE 'missing' END AS status
FROM sp GROUP BY country""" for k, num, den, _ in _SERVICE_KPIS + _SANITATION_KPIS)


# =========================================================================== ledger / billing / production
LEDGER_CTE = """
le AS (SELECT l_orderkey, sum(CAST(floor((l_extendedprice * (1e0 - l_discount)) * 1e4 + 5e-1) AS BIGINT)) AS exp
       FROM lineitem GROUP BY l_orderkey),
lo AS (
  SELECT c_mktsegment AS zone, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(sum(CAST(floor((o_totalprice) * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / 1e4 AS rev, CAST(sum(exp) AS DOUBLE) / 1e4 AS exp,
         CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN exp END) AS DOUBLE) / 1e4 AS staff,
         CAST(sum(CAST(floor((CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN o_totalprice * 5e-1 ELSE 0e0 END) * 1e4 + 5e-1) AS BIGINT))
              AS DOUBLE) / 1e4 AS paid
  FROM orders LEFT JOIN le ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3),
ledger AS (
  SELECT year, month, zone, rev AS total_operating_revenues, exp AS total_operating_expenditures,
         1e2 * paid / nullif(rev, 0) AS collection_efficiency,
         1e2 * coalesce(staff, 0e0) / nullif(exp, 0) AS personnel_expenditure_pct,
         rev AS total_billing, paid AS total_collection, 1e2 * rev / nullif(exp, 0) AS om_cost_coverage
  FROM lo)
"""
BILLING_CTE = """
bills AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS billed,
         CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN o_totalprice * 5e-1 ELSE 0e0 END AS paid
  FROM orders)
"""
PRODUCTION_CTE = """
prod AS (
  SELECT CAST(ts AS DATE) AS date, event_type AS source, CAST(sum(CAST(floor((value) * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / 1e4 AS production_m3,
         CAST(count(DISTINCT hour(ts)) AS DOUBLE) AS service_hours
  FROM events GROUP BY 1, 2)
"""

def _msum(x: str) -> str:
    """Exact money sum (DECIMAL(28,4)), as the operators do."""
    return f"sum(CAST({x} AS DECIMAL(28,4)))"


def _mdbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


SQL["revenue_by_year_zone"] = _with(LEDGER_CTE) + f"""
SELECT year, zone, {_mdbl(_msum("total_operating_revenues"))} AS revenue FROM ledger GROUP BY year, zone
"""

SQL["yearly_totals"] = _with(LEDGER_CTE) + """
, yt AS (SELECT year, CAST(sum(CAST(total_operating_revenues AS DECIMAL(28,4))) AS DOUBLE) AS revenue,
               CAST(sum(CAST(total_operating_expenditures AS DECIMAL(28,4))) AS DOUBLE) AS expenditure
        FROM ledger GROUP BY year)
SELECT year, 'revenue' AS measure, revenue AS amount FROM yt
UNION ALL SELECT year, 'expenditure' AS measure, expenditure AS amount FROM yt
"""

SQL["ledger_headline"] = _with(LEDGER_CTE) + """
SELECT (SELECT max(year) FROM ledger) AS latest_year,
  (SELECT CAST(sum(CAST(total_operating_revenues AS DECIMAL(28,4))) AS DOUBLE) FROM ledger
   WHERE year = (SELECT max(year) FROM ledger)) AS total_revenue,
  (SELECT CAST(sum(CAST(total_operating_expenditures AS DECIMAL(28,4))) AS DOUBLE) FROM ledger
   WHERE year = (SELECT max(year) FROM ledger)) AS total_expenditure,
  round((SELECT avg(collection_efficiency) FROM ledger WHERE year IS NOT NULL), 6) AS mean_collection_efficiency,
  round((SELECT avg(personnel_expenditure_pct) FROM ledger WHERE year IS NOT NULL), 6) AS mean_personnel_pct
"""

SQL["zone_statistics"] = _with(LEDGER_CTE) + f"""
SELECT zone,
  round(CAST(sum(CAST(total_operating_revenues AS DECIMAL(28,4))) AS DOUBLE) / count(total_operating_revenues), 4) AS mean_revenue,
  CAST(min(CAST(total_operating_revenues AS DECIMAL(28,4))) AS DOUBLE) AS min_revenue,
  CAST(max(CAST(total_operating_revenues AS DECIMAL(28,4))) AS DOUBLE) AS max_revenue
FROM ledger WHERE make_date(year, month, 1) BETWEEN DATE '{X.LEDGER_RANGE[0]}' AND DATE '{X.LEDGER_RANGE[1]}'
GROUP BY zone
"""

SQL["efficiency_heatmap"] = _with(LEDGER_CTE) + "SELECT month, " + ", ".join(
    f"round(avg(collection_efficiency) FILTER (WHERE year = {y}), 6) AS y{y}" for y in X.LEDGER_YEARS
) + " FROM ledger GROUP BY month"

SQL["efficiency_histogram"] = _with(LEDGER_CTE) + f"""
, b AS (SELECT min(collection_efficiency) AS lo, (max(collection_efficiency) - min(collection_efficiency)) / {X.HIST_BINS}e0 AS w
       FROM ledger WHERE collection_efficiency IS NOT NULL),
x AS (SELECT CASE WHEN w = 0 THEN 0
                  ELSE least(CAST(floor((collection_efficiency - lo) / w) AS INTEGER), {X.HIST_BINS - 1}) END AS bin, lo, w
      FROM ledger CROSS JOIN b WHERE collection_efficiency IS NOT NULL)
SELECT bin, round(any_value(lo) + bin * any_value(w), 6) AS bin_lo, round(any_value(lo) + (bin + 1) * any_value(w), 6) AS bin_hi,
  count(*) AS n
FROM x GROUP BY bin
"""

SQL["revenue_expenditure_fit"] = _with(LEDGER_CTE) + """
SELECT round(regr_slope(total_operating_expenditures, total_operating_revenues), 6) AS slope,
  round(regr_intercept(total_operating_expenditures, total_operating_revenues), 2) AS intercept,
  round(regr_r2(total_operating_expenditures, total_operating_revenues), 6) AS r2,
  CAST(regr_count(total_operating_expenditures, total_operating_revenues) AS BIGINT) AS n
FROM ledger
"""

SQL["share_of_total"] = _with(LEDGER_CTE) + """
SELECT zone, CAST(sum(CAST(total_operating_expenditures AS DECIMAL(28,4))) AS DOUBLE) AS amount,
  round(CAST(sum(CAST(total_operating_expenditures AS DECIMAL(28,4))) AS DOUBLE)
        / nullif(CAST((SELECT sum(CAST(total_operating_expenditures AS DECIMAL(28,4))) FROM ledger) AS DOUBLE), 0) * 1e2, 6)
    AS share_pct
FROM ledger GROUP BY zone
"""

SQL["billing_vs_collection_by_zone"] = _with(LEDGER_CTE) + """
, z AS (SELECT zone, CAST(sum(CAST(total_billing AS DECIMAL(28,4))) AS DOUBLE) AS billing,
              CAST(sum(CAST(total_collection AS DECIMAL(28,4))) AS DOUBLE) AS collection,
              round(sum(om_cost_coverage), 6) AS om_cost_coverage FROM ledger GROUP BY zone)
SELECT zone, 'billing' AS measure, billing AS amount FROM z
UNION ALL SELECT zone, 'collection', collection FROM z
UNION ALL SELECT zone, 'om_cost_coverage', om_cost_coverage FROM z
"""

SQL["billing_collection"] = _with(BILLING_CTE) + """
SELECT year, CAST(b AS DOUBLE) AS billed, CAST(c AS DOUBLE) AS collected, CAST(b - c AS DOUBLE) AS outstanding,
  round(CAST(c AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) * 1e2, 6) AS collection_pct,
  round(CAST(b - c AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) * 1e2, 6) AS uncollected_pct
FROM (SELECT CAST(year(date) AS INTEGER) AS year, sum(CAST(billed AS DECIMAL(28,4))) AS b,
             sum(CAST(paid AS DECIMAL(28,4))) AS c FROM bills GROUP BY 1)
"""

SQL["debt_aging"] = _with(BILLING_CTE) + f"""
, ag AS (SELECT date_diff('day', date, DATE '{X.AS_OF}') AS age, billed - paid AS outstanding
        FROM bills WHERE date <= DATE '{X.AS_OF}'),
bk AS (SELECT CASE WHEN age BETWEEN 0 AND 30 THEN '0-30 days' WHEN age BETWEEN 31 AND 60 THEN '31-60 days'
                   WHEN age BETWEEN 61 AND 90 THEN '61-90 days' WHEN age >= 91 THEN '90+ days' END AS bucket,
              CASE WHEN age BETWEEN 0 AND 30 THEN 1 WHEN age BETWEEN 31 AND 60 THEN 2
                   WHEN age BETWEEN 61 AND 90 THEN 3 WHEN age >= 91 THEN 4 END AS bucket_order, outstanding FROM ag)
SELECT bucket, bucket_order, CAST(sum(CAST(outstanding AS DECIMAL(28,4))) AS DOUBLE) AS outstanding,
  round(CAST(sum(CAST(outstanding AS DECIMAL(28,4))) AS DOUBLE)
        / nullif(CAST((SELECT sum(CAST(outstanding AS DECIMAL(28,4))) FROM ag) AS DOUBLE), 0) * 1e2, 6) AS share_pct
FROM bk GROUP BY bucket, bucket_order
"""

SQL["production_summary"] = _with(PRODUCTION_CTE) + """
SELECT CAST(year(date) AS INTEGER) AS year, source, round(sum(production_m3), 6) AS total_m3,
  round(avg(production_m3), 6) AS avg_daily_m3, round(avg(service_hours), 6) AS mean_service_hours, count(*) AS days
FROM prod GROUP BY 1, 2
"""

CITY_YEAR_CTE = """
ps AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year,
              sum(CAST(floor((l_extendedprice) * 1e4 + 5e-1) AS BIGINT)) AS wash_budget,
              sum(CAST(floor((l_extendedprice * l_discount) * 1e4 + 5e-1) AS BIGINT)) AS training_budget,
              sum(CAST(floor((CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0e0 END) * 1e4 + 5e-1) AS BIGINT)) AS water_budget,
              sum(CAST(floor((l_extendedprice * (1e0 - l_discount)) * 1e4 + 5e-1) AS BIGINT)) AS actual_expenditure,
              sum(CAST(floor((l_extendedprice * (1e0 + l_tax)) * 1e4 + 5e-1) AS BIGINT)) AS output_value,
              count(*) AS lines, count(*) FILTER (WHERE l_returnflag <> 'R') AS good
       FROM lineitem GROUP BY 1, 2),
a AS (SELECT n_name AS city, year, count(*) AS active_providers, count(*) FILTER (WHERE s_acctbal > 0) AS active_licensed,
             CAST(sum(wash_budget) AS DOUBLE) / 1e4 AS wash_budget, CAST(sum(training_budget) AS DOUBLE) / 1e4 AS training_budget,
             CAST(sum(water_budget) AS DOUBLE) / 1e4 AS water_budget,
             CAST(sum(actual_expenditure) AS DOUBLE) / 1e4 AS actual_expenditure, CAST(sum(output_value) AS DOUBLE) / 1e4 AS output_value, sum(lines) AS total_staff,
             CAST(sum(good) AS BIGINT) AS assets_good, CAST(sum(lines) AS BIGINT) AS assets_total
      FROM ps JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT n_name AS city, count(*) AS total_providers, count(*) FILTER (WHERE s_acctbal > 0) AS total_licensed
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
cy AS (SELECT a.*, b.total_providers, b.total_licensed FROM a JOIN b ON a.city = b.city)
"""

SQL["kpi_finance"] = _with(BILLING_CTE, LEDGER_CTE, SERVICE_CTE, CITY_YEAR_CTE) + """
, bq AS (SELECT CAST(year(date) AS INTEGER) AS year, sum(paid) AS n, sum(billed) AS d FROM bills GROUP BY 1),
ly AS (SELECT year, sum(total_operating_revenues) AS rev, sum(total_operating_expenditures) AS exp FROM ledger GROUP BY year),
sy AS (SELECT year, sum(w_supplied - total_consumption) AS n, sum(w_supplied) AS d FROM sp GROUP BY year),
by_year AS (SELECT year, sum(wash_budget - actual_expenditure) AS v, sum(actual_expenditure) AS e, sum(wash_budget) AS b FROM cy GROUP BY year)
SELECT year, 'F1' AS kpi_id, round(n / nullif(d, 0) * 1e2, 6) AS value FROM bq
UNION ALL SELECT year, 'F2', round(rev / nullif(exp, 0) * 1e2, 6) FROM ly
UNION ALL SELECT year, 'F4', round(exp / nullif(rev, 0) * 1e0, 6) FROM ly
UNION ALL SELECT year, 'F12', round(v, 6) FROM by_year
UNION ALL SELECT year, 'F12_pct', round(e / nullif(b, 0) * 1e2, 6) FROM by_year
UNION ALL SELECT year, 'F3', round(n / nullif(d, 0) * 1e2, 6) FROM sy
"""


def _score_row(kid: str, name: str, target: str, up: bool, src: str, num: str, den: str, scale: float) -> str:
    val = f"round(CAST(sum({num}) AS DOUBLE) / nullif(CAST(sum({den}) AS DOUBLE), 0) * {_dbl(scale)}, 6)"
    return f"""SELECT '{kid}' AS kpi_id, '{name}' AS name, year AS period, v AS value, {target} AS target,
  {str(up).lower()} AS higher_is_better, round(v - {target}, 6) AS delta,
  CASE WHEN v IS NULL THEN 'none' WHEN v {'>=' if up else '<='} {target} THEN 'good' ELSE 'bad' END AS status
FROM (SELECT max(year) AS year, {val} AS v FROM {src} WHERE year = (SELECT max(year) FROM {src}))"""


SQL["executive_scorecard"] = _with(ACCESS_CTE, BILLING_CTE, LEDGER_CTE, SERVICE_CTE, PRODUCTION_CTE, CITY_YEAR_CTE) + """
, b2 AS (SELECT *, CAST(year(date) AS INTEGER) AS year FROM bills),
p2 AS (SELECT *, CAST(year(date) AS INTEGER) AS year FROM prod)
""" + "\nUNION ALL\n".join([
    _score_row("A_safely_water", "Safely managed water", "60e0", True, "access", "CASE WHEN type = 'water' THEN safely_managed END",
               "CASE WHEN type = 'water' THEN popn_total END", 100.0),
    _score_row("A_safely_sanitation", "Safely managed sanitation", "70e0", True, "access", "CASE WHEN type = 'sewer' THEN safely_managed END",
               "CASE WHEN type = 'sewer' THEN popn_total END", 100.0),
    _score_row("F1", "Collection efficiency", "95e0", True, "b2", "paid", "billed", 100.0),
    _score_row("F2", "Operating cost coverage", "150e0", True, "ledger", "total_operating_revenues", "total_operating_expenditures", 100.0),
    _score_row("F3", "Non-revenue water", "25e0", False, "sp", "w_supplied - total_consumption", "w_supplied", 100.0),
    _score_row("C1", "Water quality compliance", "95e0", True, "sp", "test_passed_chlorine + tests_passed_ecoli", "tests_conducted_chlorine + test_conducted_ecoli", 100.0),
    _score_row("C2", "Continuity (hours/day)", "22e0", True, "p2", "service_hours", "1", 1.0),
    _score_row("AH", "Asset health", "80e0", True, "cy", "assets_good", "assets_total", 100.0),
])


# =========================================================================== catalogue / documents
CATALOGUE_CTE = """
cat AS (
  SELECT p_partkey AS id, p_type AS domain, p_name AS indicator, p_name || ' of type ' || p_type AS description,
         CASE p_size % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Quarterly' ELSE 'Monthly' END AS frequency,
         CASE WHEN p_size % 2 = 0 THEN 'Zone' ELSE 'City' END AS granularity,
         CASE WHEN p_retailprice >= 975 THEN 'Yes' WHEN p_retailprice >= 950 THEN 'Somewhat' ELSE 'No' END AS jmp,
         CASE WHEN p_size <= 10 THEN 'Yes' WHEN p_size <= 25 THEN 'Somewhat' WHEN p_size <= 40 THEN 'No' END AS amcow,
         CASE WHEN p_type = 'SMALL' THEN 'Somewhat' ELSE 'No' END AS iwa,
         p_brand AS section, split_part(p_name, ' ', 1) AS subcategory
  FROM part)
"""


def _in(vals) -> str:
    return ", ".join(repr(v) for v in vals)


SQL["catalogue_counts"] = _with(CATALOGUE_CTE) + "\nUNION ALL\n".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM cat GROUP BY {d}"
    for d in ("frequency", "domain", "section"))

SQL["catalogue_totals"] = _with(CATALOGUE_CTE) + """
SELECT count(*) AS total, count(*) FILTER (WHERE frequency = 'Monthly') AS monthly,
  count(*) FILTER (WHERE frequency = 'Quarterly') AS quarterly, count(*) FILTER (WHERE frequency = 'Annual') AS annual
FROM cat
"""

SQL["framework_alignment"] = _with(CATALOGUE_CTE) + "\nUNION ALL\n".join(
    f"SELECT '{fw}' AS framework, coalesce({fw}, 'No') AS status, count(*) AS indicators FROM cat "
    f"WHERE coalesce({fw}, 'No') IN ('Yes', 'Somewhat') GROUP BY 2" for fw in X.FRAMEWORKS)

_search = " OR ".join(f"coalesce(regexp_matches(lower({c}), '{X.CATALOGUE_SEARCH}'), false)"
                      for c in ("indicator", "description", "domain", "section"))
_fw = " AND ".join(f"coalesce({fw} IN ('Yes', 'Somewhat'), false)" for fw in X.CATALOGUE_FRAMEWORKS)
SQL["catalogue_filter"] = _with(CATALOGUE_CTE) + f"""
SELECT * FROM cat WHERE ({_search}) AND domain IN ({_in(X.CATALOGUE_DOMAINS)})
  AND frequency IN ({_in(X.CATALOGUE_FREQUENCIES)}) AND {_fw}
"""

SQL["section_subcategory_listing"] = _with(CATALOGUE_CTE) + """
SELECT section, subcategory, count(*) AS indicators,
  string_agg(DISTINCT frequency, ', ' ORDER BY frequency) AS cadences,
  CAST(row_number() OVER (PARTITION BY section ORDER BY rank, subcategory) AS INTEGER) AS ordinal
FROM (SELECT cat.*, coalesce(declared.rank, 99) AS rank
      FROM cat LEFT JOIN (VALUES ('Brand#1', 'small', 1), ('Brand#1', 'hot', 2), ('Brand#12', 'red', 1),
                                 ('Brand#13', 'old', 1), ('Brand#13', 'new', 2), ('Brand#13', 'cold', 3)) declared(s, sub, rank)
      ON section = s AND subcategory = sub)
GROUP BY section, subcategory, rank
"""

SQL["distinct_values"] = _with(CATALOGUE_CTE) + "\nUNION\n".join(
    f"SELECT '{c}' AS field, {c} AS value FROM cat WHERE {c} IS NOT NULL"
    for c in ("domain", "frequency", "granularity", "section"))

_dsearch = " OR ".join(f"coalesce(regexp_matches(lower({c}), '{X.DOCUMENT_SEARCH}'), false)" for c in X.DOCUMENT_COLUMNS)
SQL["catalogue_search"] = f"SELECT doc_id, source, lang, n_chars FROM documents WHERE {_dsearch}"


# =========================================================================== geometry / json
SHAPES_CTE = """
sh AS (SELECT vec_id, n_name AS name, lower(r_name) AS country, embedding
       FROM embeddings JOIN nation ON label = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pts AS (SELECT name, country, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(1, len(embedding))) AS i FROM sh),
box AS (SELECT name, country, min(v) FILTER (WHERE i % 2 = 1) AS min_lon, min(v) FILTER (WHERE i % 2 = 0) AS min_lat,
               max(v) FILTER (WHERE i % 2 = 1) AS max_lon, max(v) FILTER (WHERE i % 2 = 0) AS max_lat
        FROM pts GROUP BY name, country),
ext AS (SELECT *, ((SELECT min(min_lon) FROM box) + (SELECT max(max_lon) FROM box)) / 2e0 AS centre_lon,
               ((SELECT min(min_lat) FROM box) + (SELECT max(max_lat) FROM box)) / 2e0 AS centre_lat FROM box)
"""

SQL["zone_extent"] = _with(SHAPES_CTE) + "SELECT * FROM ext"

SQL["zone_enrichment"] = _with(SHAPES_CTE, ACCESS_CTE, _latest("water", "water"), _latest("sewer", "sewer")) + """
, zs AS (
  SELECT coalesce(water.country, sewer.country) AS country, coalesce(water.zone, sewer.zone) AS name,
         water_safely_pct, sewer_safely_pct,
         round(CASE WHEN water_safely_pct IS NULL THEN sewer_safely_pct WHEN sewer_safely_pct IS NULL THEN water_safely_pct
                    ELSE (water_safely_pct + sewer_safely_pct) / 2e0 END, 6) AS safeAccess
  FROM water FULL OUTER JOIN sewer ON water.country = sewer.country AND water.zone = sewer.zone)
SELECT ext.*, zs.safeAccess, zs.water_safely_pct, zs.sewer_safely_pct, zs.name IS NOT NULL AS matched,
  CASE WHEN zs.safeAccess IS NULL THEN 'none' WHEN zs.safeAccess >= 80 THEN 'good' WHEN zs.safeAccess >= 60 THEN 'warn'
       ELSE 'bad' END AS band
FROM ext LEFT JOIN zs ON lower(trim(ext.country)) = lower(trim(zs.country)) AND lower(trim(ext.name)) = lower(trim(zs.name))
"""

SQL["json_snapshot"] = """
SELECT event_type, count(*) AS events, count(k) AS with_k, CAST(sum(coalesce(k, 0)) AS BIGINT) AS sum_k,
  round(avg(k), 6) AS mean_k
FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
GROUP BY event_type
"""

# =========================================================================== KPI registry keys
SQL["kpi_access"] = _with(ACCESS_CTE) + ", " + _ratio_kpi_sql("access", ["country", "type", "year"], _ACCESS_KPIS)

SQL["kpi_governance"] = _with(CITY_YEAR_CTE) + ", " + _ratio_kpi_sql(
    "cy", ["city", "year"], _GOVERNANCE_KPIS)

SQL["kpi_sector"] = _with(CITY_YEAR_CTE) + """
SELECT city, year, 'water' AS component, round(water_budget, 6) AS amount,
  round(water_budget / nullif(wash_budget, 0) * 1e2, 6) AS share_pct FROM cy
UNION ALL SELECT city, year, 'training', round(training_budget, 6), round(training_budget / nullif(wash_budget, 0) * 1e2, 6) FROM cy
UNION ALL SELECT city, year, 'other', round(wash_budget - water_budget - training_budget, 6),
  round((wash_budget - water_budget - training_budget) / nullif(wash_budget, 0) * 1e2, 6) FROM cy
"""

SQL["kpi_cross_table"] = _with(CITY_YEAR_CTE, SERVICE_CTE) + """
, l AS (SELECT city, year, sum(output_value) AS output_value FROM cy GROUP BY city, year),
r AS (SELECT city, year, sum(total_consumption) AS water_used FROM svc GROUP BY city, year)
SELECT l.city, l.year, 'N5' AS kpi_id, round(output_value / nullif(water_used, 0) * 1e0, 6) AS value
FROM l JOIN r ON l.city = r.city AND l.year = r.year
"""

SQL["service_month_range"] = _with(SERVICE_CTE) + _series(
    f"WHERE date >= DATE '{X.SERVICE_MONTHS[0]}-01' AND date <= DATE '{X.SERVICE_MONTHS[1]}-01'")

SQL["revenue_share_in_zone"] = _with(LEDGER_CTE) + f"""
SELECT year, CAST(sum(CAST(total_operating_revenues AS DECIMAL(28,4))) AS DOUBLE) AS amount,
  round(CAST(sum(CAST(total_operating_revenues AS DECIMAL(28,4))) AS DOUBLE)
        / nullif(CAST((SELECT sum(CAST(total_operating_revenues AS DECIMAL(28,4))) FROM ledger
                       WHERE zone = '{X.SHARE_ZONE}') AS DOUBLE), 0) * 1e2, 6) AS share_pct
FROM ledger WHERE zone = '{X.SHARE_ZONE}' GROUP BY year
"""

SQL["service_menus"] = _with(SERVICE_CTE) + "\nUNION\n".join(
    f"SELECT '{c}' AS field, {c} AS value FROM svc WHERE {c} IS NOT NULL" for c in ("country", "city", "zone"))

SQL["zone_unmatched"] = _with(SHAPES_CTE, ACCESS_CTE) + """
SELECT vec_id, name, country FROM sh
WHERE NOT EXISTS (SELECT 1 FROM access a
                  WHERE lower(trim(a.country)) = lower(trim(sh.country)) AND lower(trim(a.zone)) = lower(trim(sh.name))
                    AND a.year IS NOT NULL)
"""


def _latest_rows(type_value: str, cols: str) -> str:
    return f"""(SELECT country, zone, {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY country, zone ORDER BY year DESC) AS rn
  FROM access WHERE type = '{type_value}' AND year IS NOT NULL) WHERE rn = 1)"""


SQL["snapshot_merge"] = _with(ACCESS_CTE) + f"""
SELECT coalesce(w.country, s.country) AS country, coalesce(w.zone, s.zone) AS zone,
  w.year, w.safely_managed_pct, w.unimproved_pct,
  s.year AS year_dup, s.safely_managed_pct AS safely_managed_pct_dup, s.unimproved_pct AS unimproved_pct_dup,
  s.open_def_pct
FROM {_latest_rows("water", "year, safely_managed_pct, unimproved_pct")} w
FULL OUTER JOIN {_latest_rows("sewer", "year, safely_managed_pct, unimproved_pct, open_def_pct")} s
  ON w.country = s.country AND w.zone = s.zone
"""

SQL["box_statistics_distributed"] = SQL["box_statistics"]

# =========================================================================== periods, menus, matching, geometry
SQL["billing_growth"] = """
WITH b AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) AS billed,
    CAST(sum(CAST(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN o_totalprice * 0.5e0 ELSE 0e0 END AS DECIMAL(28,4))) AS DOUBLE) AS paid
  FROM orders GROUP BY 1, 2),
spine AS (SELECT customer_id, CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM b GROUP BY customer_id)
SELECT s.customer_id, s.year, b.billed, round((b.billed - p.billed) / nullif(p.billed, 0) * 1e2, 6) AS billed_growth_pct,
  b.paid, round((b.paid - p.paid) / nullif(p.paid, 0) * 1e2, 6) AS paid_growth_pct, b.year IS NOT NULL AS present
FROM spine s LEFT JOIN b ON b.customer_id = s.customer_id AND b.year = s.year LEFT JOIN b p ON p.customer_id = s.customer_id AND p.year = s.year - 1
"""

SQL["kpi_month_against_year"] = _with(CITY_YEAR_CTE, SERVICE_CTE) + """
, m AS (SELECT city, make_date(year, month, 1) AS date, sum(total_consumption) AS used FROM svc GROUP BY 1, 2),
spine AS (SELECT city, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS date FROM m GROUP BY city),
j AS (
  SELECT s.city, s.date, m.date IS NOT NULL AS present, m.used,
    (SELECT max(year) FROM cy WHERE cy.city = s.city AND cy.year <= year(s.date)) AS account_year
  FROM spine s LEFT JOIN m ON m.city = s.city AND m.date = s.date)
SELECT j.city, date, present, round(used, 6) AS total_consumption, account_year, round(actual_expenditure / 12e0, 6) AS actual_expenditure_month, round(output_value / 12e0, 6) AS output_value_month,
  round(actual_expenditure / 12e0 / nullif(used, 0), 6) AS actual_expenditure_per_unit, round(output_value / 12e0 / nullif(used, 0), 6) AS output_value_per_unit
FROM j LEFT JOIN cy ON cy.city = j.city AND cy.year = j.account_year
"""

SQL["service_cascade"] = _with(SERVICE_CTE) + """
SELECT 0 AS level, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS zone, count(*) AS n FROM svc
UNION ALL SELECT 1, country, NULL, NULL, count(*) FROM svc GROUP BY country
UNION ALL SELECT 2, country, city, NULL, count(*) FROM svc GROUP BY country, city
UNION ALL SELECT 3, country, city, zone, count(*) FROM svc GROUP BY country, city, zone
"""

SQL["points_in_zones"] = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
corner AS (SELECT vec_id, label, i, 10e0 * v[1] + 4.5e0 + 2e0 * v[2 * i + 1] AS x, 40e0 * v[2] + 12e0 + 2e0 * v[2 * i + 2] AS y FROM v, unnest(range(1, 32)) AS t(i)),
edge AS (SELECT a.vec_id, a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.vec_id = b.vec_id AND b.i = a.i % 31 + 1),
box AS (SELECT vec_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM corner GROUP BY vec_id),
p AS (SELECT c_custkey AS id, c_acctbal / 1000e0 AS lon, c_nationkey + (c_acctbal - floor(c_acctbal)) AS lat FROM customer),
near AS (SELECT id, lon, lat, vec_id FROM p JOIN box ON lon >= a AND lon <= b AND lat >= c AND lat <= d),
hit AS (
  SELECT id, near.vec_id, label FROM near JOIN edge ON edge.vec_id = near.vec_id
  GROUP BY id, near.vec_id, label HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1)
SELECT id, vec_id, n_name AS name, lower(r_name) AS country FROM hit JOIN nation ON label = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

SQL["zone_name_matches"] = _with(SHAPES_CTE, ACCESS_CTE) + """
, l AS (SELECT DISTINCT lower(trim(country)) AS country, lower(trim(name)) AS name FROM sh),
r AS (SELECT DISTINCT lower(trim(country)) AS country, lower(trim(zone)) AS match FROM access WHERE year IS NOT NULL),
d AS (SELECT l.country, name, match, levenshtein(name, match) AS distance FROM l JOIN r ON l.country = r.country WHERE levenshtein(name, match) <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY country, name ORDER BY distance, match) AS rn FROM d)
SELECT l.country, l.name, b.match, CAST(b.distance AS INTEGER) AS distance FROM l LEFT JOIN b ON b.country = l.country AND b.name = l.name AND rn = 1
"""

SQL["sector_documents"] = _with(CITY_YEAR_CTE) + """
SELECT city, year, 'stress' AS kpi, CAST(NULL AS VARCHAR) AS sector, round((actual_expenditure - training_budget) / nullif(wash_budget, 0) * 1e2, 6) AS value FROM cy
UNION ALL SELECT city, year, 'loss', NULL, round(training_budget + actual_expenditure, 6) FROM cy
UNION ALL SELECT city, year, 'use_efficiency', 'water', round(output_value / nullif(water_budget, 0), 6) FROM cy
UNION ALL SELECT city, year, 'use_efficiency', 'training', round(output_value / nullif(training_budget, 0), 6) FROM cy WHERE year % 2 = 0
"""
