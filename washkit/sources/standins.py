"""Stand-in inputs built from the driver's TPC-H-style tables.

The reference reads small utility tables (access, monthly service, ledger, billing,
production, provider registers, indicator catalogue, zone geometry). The driver
only ships ``region nation customer supplier part orders lineitem events
documents embeddings ...``, so each function here reshapes those tables into
rows with the schema an operator expects. The views only give rows in that
schema; the KPI work is done by the operators in :mod:`washkit.operators`.

Scale notes (100 TB): a fact table is joined to its dimension (supplier or
customer, then nation/region) and aggregated on low-cardinality attributes, so
partial aggregation collapses every hot key map-side before the only large
shuffle. Join strategy is the planner's: a side is broadcast only when its size
estimate (parquet file sizes) is under ``spark.sql.autoBroadcastJoinThreshold``
or when AQE measures the materialised side under it at run time; beyond that
the join is sort-merge and AQE splits skewed partitions. (Measured at sf0.1:
an explicit count-then-broadcast check costs an extra job and was slower.)

Each view is one Spark SQL text over the base DataFrames (``spark.sql(text, orders=df)``):
one parse and analysis on the JVM instead of hundreds of Python-to-JVM calls per query.
Amounts with decimals (at most 4 here) are summed as fixed-point integers (ten-thousandths,
``floor(x * 10000 + 0.5)``) and divided back at the end, so a view's values do not depend on
summation order; this is cheaper per row than a DECIMAL cast.
Where a distinct count is needed (customers per zone, suppliers per city) the
fact is first reduced at (foreign key, period) grain instead, which turns the
distinct count into a plain count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from washkit.session import table_path

# Fixed mapping of the stand-ins: the five order priorities play the five ladder rungs.
PRIORITY_RUNGS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@dataclass
class Tables:
    """Lazy parquet tables of one scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "sf_dir"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(table_path(self.sf_dir, name))
        return self._cache[name]


def _sql(t: Tables, text: str, *names: str) -> DataFrame:
    return t.spark.sql(text, **{n: getattr(t, n) for n in names})


# --------------------------------------------------------------------------- access
_RUNG_COUNTS = ",\n".join(
    f"count_if(o_orderpriority = '{p}') AS p{i + 1}" for i, p in enumerate(PRIORITY_RUNGS))

# Zone names that reach every branch of the urban/rural tag (Kampala is one of its fixed centres), zones that
# have rows of one type only, and zones that no outline is named after.
_ZONE = """CASE WHEN n_nationkey % 5 = 4 AND status = 'O' THEN concat(n_name, ' OLD TOWN')
            WHEN n_nationkey % 4 = 1 THEN concat(n_name, ' RURAL')
            WHEN n_nationkey % 4 = 2 THEN concat(n_name, ' URBAN')
            WHEN n_nationkey % 8 = 3 THEN concat(n_name, ' KAMPALA') ELSE n_name END"""

_ACCESS_COUNTS = f"""
SELECT r_name AS country, {_ZONE} AS zone, year, status, sum(n) AS n, sum(p1) AS p1, sum(p2) AS p2, sum(p3) AS p3,
       sum(p4) AS p4, sum(p5) AS p5, count(1) AS hh
FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'F' END AS status,
             count(1) AS n, {_RUNG_COUNTS}
      FROM {{orders}}
      GROUP BY o_custkey, CAST(year(o_orderdate) AS INT), CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'F' END) per_cust
JOIN {{customer}} ON o_custkey = c_custkey
JOIN {{nation}} ON c_nationkey = n_nationkey
JOIN {{region}} ON n_regionkey = r_regionkey
GROUP BY r_name, {_ZONE}, year, status
"""


def _access_counts(t: Tables) -> DataFrame:
    """Orders per (region, nation, year, status) with one count per priority. Every order counts
    once: status ``O`` is the sewer side, any other status the water side.

    ``households`` = distinct customers: orders are first reduced to one row per
    (customer, year, status), so it is a plain count afterwards (no distinct aggregate).
    """
    return _sql(t, _ACCESS_COUNTS, "orders", "customer", "nation", "region")


def water_access(t: Tables, counts: DataFrame | None = None) -> DataFrame:
    """Rows shaped like the water access source (prefixed columns, ``type = 'w_access'``)."""
    g = counts if counts is not None else _access_counts(t)
    return g.where("status = 'F'").selectExpr(
        "country", "zone", "year",
        "p1 AS w_safely_managed", "100D * p1 / n AS w_safely_managed_pct",
        "p2 AS w_basic", "100D * p2 / n AS w_basic_pct",
        "p3 AS w_limited", "100D * p3 / n AS w_limited_pct",
        "p4 AS w_unimproved", "100D * p4 / n AS w_unimproved_pct",
        "p5 AS surface_water", "100D * p5 / n AS surface_water_pct",
        "0D AS w_other_pct", "n AS popn_total", "hh AS households", "p1 + p2 AS municipal_coverage",
        "'w_access' AS type",
    )


def sewer_access(t: Tables, counts: DataFrame | None = None) -> DataFrame:
    """Rows shaped like the sewer access source (``type = 's_access'``)."""
    g = counts if counts is not None else _access_counts(t)
    return g.where("status = 'O'").selectExpr(
        "country", "zone", "year",
        "p1 AS s_safely_managed", "100D * p1 / n AS s_safely_managed_pct",
        "p2 AS s_basic", "100D * p2 / n AS s_basic_pct",
        "p3 AS s_limited", "100D * p3 / n AS s_limited_pct",
        "p4 AS s_unimproved", "100D * p4 / n AS s_unimproved_pct",
        "p5 AS open_def", "100D * p5 / n AS open_def_pct",
        "0D AS s_other_pct", "n AS popn_total", "hh AS households",
        "'s_access' AS type",
    )


def access_sources(t: Tables) -> tuple[DataFrame, DataFrame]:
    counts = _access_counts(t)
    return water_access(t, counts), sewer_access(t, counts)


def tidy_access_rows(t: Tables) -> DataFrame:
    """The rows of ``tidy_access(*access_sources(t))`` in one projection: both sides come from one read of the
    orders and one aggregate, where the union of two filtered sources reads and aggregates them twice."""
    water, sewer = "status = 'F'", "status = 'O'"
    return _access_counts(t).selectExpr(
        "country", "zone", "year",
        "p1 AS safely_managed", "100D * p1 / n AS safely_managed_pct", "p2 AS basic", "100D * p2 / n AS basic_pct",
        "p3 AS limited", "100D * p3 / n AS limited_pct", "p4 AS unimproved", "100D * p4 / n AS unimproved_pct",
        f"CASE WHEN {water} THEN p5 END AS surface_water", f"CASE WHEN {water} THEN 100D * p5 / n END AS surface_water_pct",
        "0D AS other_pct", "n AS popn_total", "hh AS households", f"CASE WHEN {water} THEN p1 + p2 END AS municipal_coverage",
        f"CASE WHEN {water} THEN 'water' ELSE 'sewer' END AS type",
        f"CASE WHEN {sewer} THEN p5 END AS open_def", f"CASE WHEN {sewer} THEN 100D * p5 / n END AS open_def_pct",
    )


# --------------------------------------------------------------------------- service
_SERVICE_MONTH = """
SELECT r_name AS country, n_name AS city, l_returnflag AS zone,
       CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
       count(1) AS households,
       sum(l_linenumber) AS popn_total,
       sum(l_quantity) AS w_supplied,
       sum(floor(l_quantity * (1D - l_discount) * 10000D + 0.5D)) / 10000D AS total_consumption,
       sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS metered,
       count_if(l_linenumber <= 5) AS active_connections,
       count_if(l_linenumber <= 5 AND l_tax > 0.02D) AS metered_connections,
       count_if(l_linenumber <= 4) AS tests_conducted_chlorine,
       count_if(l_linenumber <= 4 AND l_tax <= 0.06D) AS test_passed_chlorine,
       count_if(l_linenumber >= 2) AS test_conducted_ecoli,
       count_if(l_linenumber >= 2 AND l_discount > 0.02D) AS tests_passed_ecoli,
       count_if(l_quantity > 25) AS complaints,
       count_if(l_quantity > 25 AND l_linestatus = 'F') AS resolved,
       count_if(l_quantity > 45) AS blocks,
       sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS sewer_length,
       count_if(l_linestatus = 'O') AS sewer_connections,
       sum(floor(l_quantity * (1D - l_tax) * 10000D + 0.5D)) / 10000D AS ww_collected,
       sum(floor(l_quantity * (1D - l_tax) * (1D - l_discount) * 10000D + 0.5D)) / 10000D AS ww_treated,
       sum(CASE WHEN l_linestatus = 'F' THEN floor(l_quantity * l_discount * 10000D + 0.5D) END) / 10000D AS ww_reused,
       count_if(l_linestatus = 'F' AND l_discount >= 0.05D) AS hh_emptied,
       sum(CASE WHEN l_linenumber >= 3 THEN l_quantity END) AS fs_treated,
       sum(CASE WHEN l_linenumber >= 5 THEN l_quantity END) AS fs_reused,
       count_if(l_linenumber = 1) AS public_toilets,
       count_if(l_linenumber <= 2) AS public_spaces
FROM {lineitem}
JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
GROUP BY r_name, n_name, l_returnflag, CAST(year(l_shipdate) AS INT), CAST(month(l_shipdate) AS INT)
"""


def service_month(t: Tables) -> DataFrame:
    """Monthly service rows: country = supplier region, city = supplier nation, zone = return flag.
    Every input of the service and sanitation KPIs has its own expression under its documented name."""
    return _sql(t, _SERVICE_MONTH, "lineitem", "supplier", "nation", "region")


# --------------------------------------------------------------------------- finance
_PAID = "CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN o_totalprice * 0.5D ELSE 0D END"


def billing(t: Tables) -> DataFrame:
    """One bill per order: F fully paid, P half paid, O unpaid."""
    return t.orders.selectExpr(
        "CAST(o_custkey AS STRING) AS customer_id", "CAST(o_orderdate AS DATE) AS date",
        "o_totalprice AS billed", f"{_PAID} AS paid",
    )


_LEDGER = f"""
SELECT year, month, zone,
       rev AS total_operating_revenues,
       exp AS total_operating_expenditures,
       try_divide(100D * paid, rev) AS collection_efficiency,
       try_divide(100D * coalesce(staff, 0D), exp) AS personnel_expenditure_pct,
       rev AS total_billing,
       paid AS total_collection,
       try_divide(100D * rev, exp) AS om_cost_coverage
FROM (
  SELECT c_mktsegment AS zone, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
         sum(floor(o_totalprice * 10000D + 0.5D)) / 10000D AS rev, sum(exp) / 10000D AS exp,
         sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN exp END) / 10000D AS staff,
         sum(floor(({_PAID}) * 10000D + 0.5D)) / 10000D AS paid
  FROM {{orders}}
  LEFT JOIN (SELECT l_orderkey, sum(floor(l_extendedprice * (1D - l_discount) * 10000D + 0.5D)) AS exp
             FROM {{lineitem}} GROUP BY l_orderkey) e ON o_orderkey = l_orderkey
  JOIN {{customer}} ON o_custkey = c_custkey
  GROUP BY c_mktsegment, CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT)) g
"""


def ledger(t: Tables) -> DataFrame:
    """Zone-month ledger: zone = market segment; expenditure = discounted line value of the orders
    (lines summed per order first, so the order join moves one row per order)."""
    return _sql(t, _LEDGER, "orders", "lineitem", "customer")


_PRODUCTION = """
SELECT date, source, sum(v) / 10000D AS production_m3, CAST(count(1) AS DOUBLE) AS service_hours
FROM (SELECT CAST(ts AS DATE) AS date, event_type AS source, hour(ts) AS h, sum(floor(value * 10000D + 0.5D)) AS v
      FROM {events} GROUP BY CAST(ts AS DATE), event_type, hour(ts)) hourly
GROUP BY date, source
"""


def production(t: Tables) -> DataFrame:
    """Daily production per source: source = event type; service hours = hours with a reading."""
    return _sql(t, _PRODUCTION, "events")


_CITY_YEAR = """
SELECT a.city, a.year, a.active_providers, b.total_providers, a.active_licensed, b.total_licensed,
       a.wash_budget, a.training_budget, a.water_budget, a.actual_expenditure, a.output_value, a.total_staff,
       a.assets_good, a.total_staff AS assets_total, a.w_supplied, a.total_consumption,
       a.tests_conducted_chlorine, a.test_passed_chlorine, a.test_conducted_ecoli, a.tests_passed_ecoli
FROM (
  SELECT n_name AS city, year, count(1) AS active_providers, count_if(s_acctbal > 0) AS active_licensed,
         CAST(sum(CAST(wash_budget AS DECIMAL(38,0))) AS DOUBLE) / 10000D AS wash_budget, CAST(sum(CAST(training_budget AS DECIMAL(38,0))) AS DOUBLE) / 10000D AS training_budget,
         CAST(sum(CAST(water_budget AS DECIMAL(38,0))) AS DOUBLE) / 10000D AS water_budget,
         CAST(sum(CAST(actual_expenditure AS DECIMAL(38,0))) AS DOUBLE) / 10000D AS actual_expenditure,
         CAST(sum(CAST(output_value AS DECIMAL(38,0))) AS DOUBLE) / 10000D AS output_value, sum(lines) AS total_staff, sum(good) AS assets_good,
         sum(supplied) AS w_supplied, CAST(sum(CAST(consumed AS DECIMAL(38,0))) AS DOUBLE) / 10000D AS total_consumption,
         sum(chlorine) AS tests_conducted_chlorine, sum(chlorine_passed) AS test_passed_chlorine,
         sum(ecoli) AS test_conducted_ecoli, sum(ecoli_passed) AS tests_passed_ecoli
  FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year,
               sum(floor(l_extendedprice * 10000D + 0.5D)) AS wash_budget,
               sum(floor(l_extendedprice * l_discount * 10000D + 0.5D)) AS training_budget,
               sum(floor(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0D END * 10000D + 0.5D)) AS water_budget,
               sum(floor(l_extendedprice * (1D - l_discount) * 10000D + 0.5D)) AS actual_expenditure,
               sum(floor(l_extendedprice * (1D + l_tax) * 10000D + 0.5D)) AS output_value,
               count(1) AS lines, count_if(l_returnflag <> 'R') AS good,
               sum(l_quantity) AS supplied, sum(floor(l_quantity * (1D - l_discount) * 10000D + 0.5D)) AS consumed,
               count_if(l_linenumber <= 4) AS chlorine, count_if(l_linenumber <= 4 AND l_tax <= 0.06D) AS chlorine_passed,
               count_if(l_linenumber >= 2) AS ecoli, count_if(l_linenumber >= 2 AND l_discount > 0.02D) AS ecoli_passed
        FROM {lineitem} GROUP BY l_suppkey, CAST(year(l_shipdate) AS INT)) per_supp
  JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} ON s_nationkey = n_nationkey
  GROUP BY n_name, year) a
JOIN (
  SELECT n_name AS city, count(1) AS total_providers, count_if(s_acctbal > 0) AS total_licensed
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name) b
ON a.city = b.city
"""


def city_year(t: Tables) -> DataFrame:
    """Provider register per (city, year): providers = suppliers, licensed = positive balance,
    active = shipped that year (lines reduced per (supplier, year) first, so "distinct active
    suppliers" is a plain count). Outer sums are DECIMAL, so no city's total overflows. The year's water volumes and
    quality tests are those of :func:`service_month` summed, so yearly KPIs of both need one read of the lines."""
    return _sql(t, _CITY_YEAR, "lineitem", "supplier", "nation")


# --------------------------------------------------------------------------- catalogue
def catalogue(t: Tables) -> DataFrame:
    """Indicator catalogue rows: one per part; three framework alignment columns."""
    return t.part.selectExpr(
        "p_partkey AS id", "p_type AS domain", "p_name AS indicator",
        "concat_ws(' ', p_name, 'of type', p_type) AS description",
        "CASE p_size % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Quarterly' ELSE 'Monthly' END AS frequency",
        "CASE WHEN p_size % 2 = 0 THEN 'Zone' ELSE 'City' END AS granularity",
        "CASE WHEN p_retailprice >= 975 THEN 'Yes' WHEN p_retailprice >= 950 THEN 'Somewhat' ELSE 'No' END AS jmp",
        "CASE WHEN p_size <= 10 THEN 'Yes' WHEN p_size <= 25 THEN 'Somewhat' WHEN p_size <= 40 THEN 'No' END AS amcow",
        "CASE WHEN p_type = 'SMALL' THEN 'Somewhat' ELSE 'No' END AS iwa",
        "p_brand AS section", "split(p_name, ' ')[0] AS subcategory",
    )


# --------------------------------------------------------------------------- geometry
_ZONE_SHAPES = """
SELECT vec_id, n_name AS name, lower(r_name) AS country, CAST(embedding AS ARRAY<DOUBLE>) AS ring
FROM {embeddings}
JOIN {nation} ON label = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""


def zone_shapes(t: Tables) -> DataFrame:
    """Zone outlines: each embedding row is one ring of 32 (lon, lat) pairs; zone = nation of the label."""
    return _sql(t, _ZONE_SHAPES, "embeddings", "nation", "region")


_ZONE_OUTLINES = """
SELECT vec_id, n_name AS name, lower(r_name) AS country,
       array(transform(sequence(1, 31), i -> array(10D * v[0] + 4.5D + 2D * v[2 * i], 40D * v[1] + 12D + 2D * v[2 * i + 1]))) AS rings
FROM (SELECT vec_id, label, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM {embeddings})
JOIN {nation} ON label = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""


def zone_outlines(t: Tables) -> DataFrame:
    """Small zone outlines spread over a map: the first pair of an embedding places a ring of 31 corners."""
    return _sql(t, _ZONE_OUTLINES, "embeddings", "nation", "region")


def connection_points(t: Tables) -> DataFrame:
    """A point for each customer: longitude from the balance, latitude from the nation and the balance's cents."""
    return t.customer.selectExpr("c_custkey AS id", "c_acctbal / 1000D AS lon", "c_nationkey + (c_acctbal - floor(c_acctbal)) AS lat")


_SECTOR_DOCUMENTS = """
SELECT city, year, to_json(named_struct(
         'resources', named_struct('renewable', wash_budget, 'withdrawals', actual_expenditure - training_budget),
         'use', CASE WHEN year % 2 = 0 THEN array(named_struct('sector', 'water', 'output', output_value, 'used', water_budget), named_struct('sector', 'training', 'output', output_value, 'used', training_budget))
                     ELSE array(named_struct('sector', 'water', 'output', output_value, 'used', water_budget)) END,
         'disaster', named_struct('loss', array(training_budget, actual_expenditure)))) AS document
FROM {city_year}
"""


def sector_documents(t: Tables) -> DataFrame:
    """A nested JSON document for each city and year: resources, a list of sectors, losses."""
    return t.spark.sql(_SECTOR_DOCUMENTS, city_year=city_year(t))
