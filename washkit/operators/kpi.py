"""KPI formula registry and the operators driven by it.

One generic operator, :func:`ratio_kpis`, computes ``sum(num) / sum(den) * scale``
per group for any registry entries -- a single partial aggregate (all sums at once)
followed by an unpivot, whatever the number of KPIs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washkit.functions import columns as C
from washkit.sources.files import document_leaves


@dataclass(frozen=True)
class Kpi:
    id: str
    name: str
    table: str          # stand-in / input table the formula reads
    num: str            # SQL expression summed as numerator
    den: str | None     # SQL expression summed as denominator; None = a plain sum (counts, losses)
    scale: float = 100.0
    higher_is_better: bool | None = True
    target: float | None = None
    section: str = ""


# Targets from the reference's benchmarks and headline cards (NRW <= 25 %,
# water quality >= 95 %, supply >= 22 h/day, collection >= 95 %, O&M cost coverage >= 150 %,
# treatment >= 80 %, complaint resolution >= 90 %, safely managed water >= 60 %, safely managed
# sanitation >= 70 %, asset health >= 80).
REGISTRY: list[Kpi] = [
    # access ladder shares (zone-year)
    Kpi("A_safely", "Safely managed share", "access", "safely_managed", "popn_total", section="access"),
    Kpi("A_basic", "Basic share", "access", "basic", "popn_total", section="access"),
    Kpi("A_limited", "Limited share", "access", "limited", "popn_total", higher_is_better=False, section="access"),
    Kpi("A_unimproved", "Unimproved share", "access", "unimproved", "popn_total", higher_is_better=False, section="access"),
    Kpi("A_surface", "Surface water share", "access", "surface_water", "popn_total", higher_is_better=False, section="access"),
    Kpi("A_open_def", "Open defecation share", "access", "open_def", "popn_total", higher_is_better=False, section="access"),
    Kpi("B1", "Water coverage", "access", "municipal_coverage", "popn_total", section="access"),
    Kpi("A_safely_water", "Safely managed water", "access", "CASE WHEN type = 'water' THEN safely_managed END",
        "CASE WHEN type = 'water' THEN popn_total END", target=60.0, section="headline"),
    Kpi("A_safely_sanitation", "Safely managed sanitation", "access", "CASE WHEN type = 'sewer' THEN safely_managed END",
        "CASE WHEN type = 'sewer' THEN popn_total END", target=70.0, section="headline"),
    # service (zone/city-month)
    Kpi("B4", "Sewered connections", "service", "sewer_connections", "households", section="service"),
    Kpi("C1", "Water quality compliance", "service", "test_passed_chlorine + tests_passed_ecoli",
        "tests_conducted_chlorine + test_conducted_ecoli", target=95.0, section="service"),
    Kpi("C4", "Complaint resolution", "service", "resolved", "complaints", target=90.0, section="service"),
    Kpi("C6", "Sewer blockages per 1000 connections", "service", "blocks", "sewer_connections", scale=1000.0,
        higher_is_better=False, section="service"),
    Kpi("C6_km", "Sewer blockages per 100 km", "service", "blocks", "sewer_length", higher_is_better=False,
        section="service"),
    Kpi("C7", "Consumption l/c/d", "service", "total_consumption", "popn_total", scale=1000.0 / 30.0,
        higher_is_better=None, section="service"),
    Kpi("F3", "Non-revenue water", "service", "w_supplied - total_consumption", "w_supplied", higher_is_better=False,
        target=25.0, section="service"),
    Kpi("F7", "Metered connections", "service", "metered_connections", "active_connections", section="service"),
    # sanitation chain (city-month)
    Kpi("S1", "Wastewater treated", "service", "ww_treated", "ww_collected", target=80.0, section="sanitation"),
    Kpi("S2", "Water reused", "service", "ww_reused", "w_supplied", section="sanitation"),
    Kpi("S3", "Faecal sludge emptied", "service", "hh_emptied", "households - sewer_connections", section="sanitation"),
    Kpi("S4", "Treated faecal sludge reused", "service", "fs_reused", "fs_treated", section="sanitation"),
    Kpi("S5", "Treated wastewater reused", "service", "ww_reused", "ww_treated", section="sanitation"),
    Kpi("S6", "Public toilets functional", "service", "public_toilets", "public_spaces", section="sanitation"),
    # finance
    Kpi("F1", "Collection efficiency", "billing", "paid", "billed", target=95.0, section="finance"),
    Kpi("F2", "Operating cost coverage", "ledger", "total_operating_revenues", "total_operating_expenditures",
        target=150.0, section="finance"),
    Kpi("F4", "Working ratio", "ledger", "total_operating_expenditures", "total_operating_revenues", scale=1.0,
        higher_is_better=False, section="finance"),
    Kpi("F12", "Budget variance (allocated - actual)", "city_year", "wash_budget - actual_expenditure", None, scale=1.0,
        higher_is_better=None, section="finance"),
    Kpi("F12_pct", "Budget execution (actual / allocated)", "city_year", "actual_expenditure", "wash_budget",
        higher_is_better=None, section="finance"),
    # production
    Kpi("C2", "Continuity (hours/day)", "production", "service_hours", "1", scale=1.0, target=22.0, section="service"),
    # governance / sector (city-year)
    Kpi("G1", "Active providers", "city_year", "active_providers", "total_providers", section="governance"),
    Kpi("G2", "Active licensed providers", "city_year", "active_licensed", "total_licensed", section="governance"),
    Kpi("G4", "Human-capital investment", "city_year", "training_budget", "wash_budget", section="governance"),
    Kpi("N1", "Budget to water", "city_year", "water_budget", "wash_budget", section="sector"),
    # cross-table (J3): output value per m3 of water used, city_year joined to service at (city, year);
    # for one economic sector give it that sector's rows
    Kpi("N5", "Water use efficiency (value per m3)", "city_year+service", "output_value", "water_used",
        scale=1.0, section="cross"),
    # Spec-only indicators: same formula shape, inputs named after the documented tables
    # (city_month, national_accounts, service extensions). Tested on fixtures.
    Kpi("C3", "24x7 supply", "service_ext", "connections_24x7", "active_connections", section="spec"),
    Kpi("C5", "Complaint turnaround (days)", "complaints", "days_to_resolve", "1", scale=1.0,
        higher_is_better=False, section="spec"),
    Kpi("F5", "Staff per 1000 connections", "city_month", "w_staff + san_staff", "active_connections", scale=1000.0,
        higher_is_better=False, section="spec"),
    Kpi("F6", "Staff cost share of opex", "national_accounts+city_month", "staff_cost", "opex",
        higher_is_better=False, section="spec"),
    Kpi("F8", "WTP utilisation", "service_ext", "wtp_used", "wtp_capacity", section="spec"),
    Kpi("F9", "STP utilisation", "service_ext", "ww_treated", "ww_capacity", section="spec"),
    Kpi("F10", "FSTP utilisation", "service_ext", "fs_treated", "fstp_capacity", section="spec"),
    # propoor_popn is documented as a proportion of the population, san_allocation as a percent of the budget:
    # both are weighted means, so groups of several rows add up
    Kpi("F11", "Pro-poor financing", "city_month", "propoor_popn * popn_total", "popn_total", section="spec"),
    Kpi("N2", "Budget to sanitation", "national_accounts", "san_allocation * budget_allocated", "budget_allocated",
        scale=1.0, section="spec"),
    Kpi("N3", "Budget disbursed", "national_accounts", "budget_disbursed", "budget_allocated", section="spec"),
    Kpi("N4", "Water stress", "national_accounts", "water_withdrawals", "water_resources", higher_is_better=False,
        section="spec"),
    Kpi("N6", "Disaster loss", "national_accounts", "disaster_loss", None, scale=1.0, higher_is_better=False,
        section="spec"),
    Kpi("G3", "WTPs inspected", "national_accounts", "inspected_wtps", None, scale=1.0, section="spec"),
    Kpi("G5", "Staff trained", "national_accounts", "trained_staff", None, scale=1.0, section="spec"),
    Kpi("G6", "Staff", "city_year", "total_staff", None, scale=1.0, higher_is_better=None, section="spec"),
    Kpi("AH", "Asset health", "city_year", "assets_good", "assets_total", target=80.0, section="spec"),
    Kpi("WD", "Women in decision-making", "service_ext", "f_workforce", "workforce", section="spec"),
]
BY_ID = {k.id: k for k in REGISTRY}


_r = C.rounded


def lookup(key: Column, mapping: dict, dtype: str) -> Column:
    """Typed CASE lookup of a small fixed mapping (key -> value); unknown keys give NULL."""
    out = F.lit(None).cast(dtype)
    for k, v in mapping.items():
        out = F.when(key == F.lit(k), F.lit(v).cast(dtype)).otherwise(out)
    return out


def kpis_for(section: str | None = None, table: str | None = None) -> list[Kpi]:
    return [k for k in REGISTRY if (section is None or k.section == section) and (table is None or k.table == table)]


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a (small, fixed-size) DataFrame, e.g. for joins in SQL."""
    rows = [(k.id, k.name, k.table, k.num, k.den, float(k.scale), k.higher_is_better, k.target, k.section)
            for k in REGISTRY]
    return spark.createDataFrame(rows, "kpi_id string, name string, source string, numerator string, "
                                       "denominator string, scale double, higher_is_better boolean, target double, "
                                       "section string")


def ratio_kpis(df: DataFrame, by: Sequence[str], kpis: Sequence[Kpi], *, digits: int | None = 6,
               guarded: bool = False) -> DataFrame:
    """Generic KPI: ``try_divide(sum(num), sum(den)) * scale`` per group, long form
    ``(by..., kpi_id, value)``. All sums go into one aggregate (map-side partial sums).
    ``guarded=True`` floors the denominator at 1 instead (P18) -- the provider cards' rule."""
    aggs = []
    for i, k in enumerate(kpis):
        aggs.append(F.sum(F.expr(k.num)).alias(f"__n{i}"))
        if k.den is not None:
            aggs.append(F.sum(F.expr(k.den)).alias(f"__d{i}"))
    g = df.groupBy(*by).agg(*aggs)

    def value(i: int, k: Kpi) -> Column:
        if k.den is None:
            return F.col(f"__n{i}").cast("double") * F.lit(float(k.scale))
        if guarded:
            return C.guarded_ratio(F.col(f"__n{i}"), F.col(f"__d{i}"), k.scale)
        return C.safe_ratio(F.col(f"__n{i}"), F.col(f"__d{i}"), k.scale)

    vals = g.select(*by, *[_r(value(i, k), digits).alias(k.id) for i, k in enumerate(kpis)])
    return vals.unpivot(list(by), [k.id for k in kpis], "kpi_id", "value")


def data_quality(df: DataFrame, by: Sequence[str], kpis: Sequence[Kpi]) -> DataFrame:
    """Per group and KPI, rows with both numerator and denominator present:
    all -> 'complete', some -> 'partial', none -> 'missing'."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, k in enumerate(kpis):
        present = F.expr(k.num).isNotNull() & (F.expr(k.den).isNotNull() if k.den is not None else F.lit(True))
        aggs.append(F.count_if(present).alias(f"__c{i}"))
    g = df.groupBy(*by).agg(*aggs)
    items = [F.struct(F.lit(k.id).alias("kpi_id"), F.col("__rows").alias("n_rows"), F.col(f"__c{i}").alias("n_complete"))
             for i, k in enumerate(kpis)]
    long = g.select(*by, F.inline(F.array(*items)))
    status = (F.when(F.col("n_complete") == F.col("n_rows"), "complete")
              .when(F.col("n_complete") > 0, "partial").otherwise("missing"))
    return long.withColumn("status", status)


def combine_inputs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_cols: Sequence[str],
                   right_cols: Sequence[str], how: str = "inner") -> DataFrame:
    """KPI inputs from two tables at one grain (e.g. city, year).

    Each side is first summed to ``keys`` -- a partial aggregate, so hot keys collapse
    map-side -- and the join then moves one row per key and side, never raw rows. Both sides
    come out of their aggregates hash-partitioned on the keys, so the join adds no shuffle.
    """
    lsum = left.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in left_cols])
    rsum = right.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in right_cols])
    return lsum.join(rsum, list(keys), how)


# --------------------------------------------------------------------------- A31
def sanitation_chain(svc: DataFrame, by: Sequence[str] = ("country",), *, digits: int | None = 6) -> DataFrame:
    """Sanitation and reuse chain in long form (stream, stage, order, volume, pct).

    wastewater: collected -> treated (% of collected) -> reused (% of water supplied);
    faecal sludge: non-sewered households -> emptied (% of non-sewered) -> treated -> reused (% of treated).
    Columns: ``ww_collected``, ``ww_treated``, ``ww_reused``, ``w_supplied``; ``households`` less
    ``sewer_connections`` (null counts as none) are non-sewered; ``hh_emptied``, ``fs_treated``, ``fs_reused``.
    """
    non_sewered = F.col("households") - F.coalesce("sewer_connections", F.lit(0))
    g = svc.groupBy(*by).agg(
        F.sum("ww_collected").alias("collected"), F.sum("ww_treated").alias("treated"),
        F.sum("ww_reused").alias("reused"), F.sum("w_supplied").alias("supplied"),
        F.sum(non_sewered).cast("double").alias("non_sewered"), F.sum("hh_emptied").cast("double").alias("emptied"),
        F.sum("fs_treated").cast("double").alias("fs_treated"), F.sum("fs_reused").cast("double").alias("fs_reused"),
    )
    none = F.lit(None).cast("double")

    def item(stream, stage, order, vol, pct):
        return F.struct(F.lit(stream).alias("stream"), F.lit(stage).alias("stage"), F.lit(order).alias("stage_order"),
                        _r(F.col(vol), digits).alias("volume"), _r(pct, digits).alias("pct"))

    items = [
        item("wastewater", "collected", 1, "collected", none),
        item("wastewater", "treated", 2, "treated", C.safe_ratio(F.col("treated"), F.col("collected"), 100.0)),
        item("wastewater", "reused", 3, "reused", C.safe_ratio(F.col("reused"), F.col("supplied"), 100.0)),
        item("faecal_sludge", "non_sewered", 1, "non_sewered", none),
        item("faecal_sludge", "emptied", 2, "emptied", C.safe_ratio(F.col("emptied"), F.col("non_sewered"), 100.0)),
        item("faecal_sludge", "treated", 3, "fs_treated", none),
        item("faecal_sludge", "reused", 4, "fs_reused", C.safe_ratio(F.col("fs_reused"), F.col("fs_treated"), 100.0)),
    ]
    return g.select(*by, F.inline(F.array(*items)))


# --------------------------------------------------------------------------- A32 / A33
def governance_kpis(city_year: DataFrame, *, guarded: bool = False, digits: int | None = 6) -> DataFrame:
    """Per (city, year) active-provider %, active-licensed %, human-capital investment %,
    budget to water %, the staff headcount (G6) and asset health (good / total), long form. Compliance flags (licence,
    tariff, levy, reporting) are document booleans, read with ``files.read_json_document``."""
    kp = [BY_ID[i] for i in ("G1", "G2", "G4", "N1", "G6", "AH")]
    return ratio_kpis(city_year, ["city", "year"], kp, digits=digits, guarded=guarded)


def sector_budget_shares(city_year: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """Budget split per (city, year) in long form: water, training and other, each with its share %."""
    other = F.col("wash_budget") - F.col("water_budget") - F.col("training_budget")
    items = [
        F.struct(F.lit(name).alias("component"), _r(c, digits).alias("amount"),
                 _r(C.safe_ratio(c, F.col("wash_budget"), 100.0), digits).alias("share_pct"))
        for name, c in (("water", F.col("water_budget")), ("training", F.col("training_budget")), ("other", other))
    ]
    return city_year.select("city", "year", F.inline(F.array(*items)))


def sector_document_kpis(df: DataFrame, document: str, by: Sequence[str], *, digits: int | None = 6) -> DataFrame:
    """A33, environment half, from a JSON document column: (by..., kpi, sector, value) with water stress
    (withdrawals / renewable * 100), use efficiency of each sector (output / used) and disaster loss.

    The document is parsed once, to leaves with their paths (:func:`washkit.sources.files.document_leaves`), so
    its nesting need not be declared: sectors are a list of any length, a loss one number or several. A
    document that lacks a part, or is no JSON, gives that KPI as NULL or not at all.
    """
    leaves = document_leaves(df, document, by)
    number = F.col("value").try_cast("double")

    def part(path: str) -> Column:
        return F.sum(F.when(F.col("path") == path, number))

    sector = F.regexp_extract("path", r"^use\[(\d+)\]\.", 1)
    whole = leaves.groupBy(*by).agg(part("resources.withdrawals").alias("w"), part("resources.renewable").alias("r"),
                                    F.sum(F.when(F.col("path").rlike(r"^disaster\.loss(\[\d+\])?$"), number)).alias("loss"))
    none = F.lit(None).cast("string")
    totals = whole.select(*by, F.inline(F.array(F.struct(F.lit("stress").alias("kpi"), none.alias("sector"), C.safe_ratio(F.col("w"), F.col("r"), 100.0).alias("value")),
                                                F.struct(F.lit("loss").alias("kpi"), none.alias("sector"), F.col("loss").alias("value")))))
    used = leaves.where(sector != "").groupBy(*by, sector.alias("__i")).agg(
        F.max(F.when(F.col("path").endswith("].sector"), F.col("value"))).alias("sector"),
        F.sum(F.when(F.col("path").endswith("].output"), number)).alias("o"), F.sum(F.when(F.col("path").endswith("].used"), number)).alias("u"))
    sectors = used.select(*by, F.lit("use_efficiency").alias("kpi"), "sector", C.safe_ratio(F.col("o"), F.col("u")).alias("value"))
    return totals.unionByName(sectors).withColumn("value", _r(F.col("value"), digits))


# --------------------------------------------------------------------------- A34
def latest_period_kpis(df: DataFrame, period_col: str, kpis: Sequence[Kpi], *, digits: int | None = 6) -> DataFrame:
    """KPIs of the latest period, ``(period, kpi_id, value)``.

    One pass: the KPI sums per period (a partial aggregate, one row per period), then per KPI
    the row of the largest period (``max_by`` over those few rows). No scalar subquery, so the
    input is not read twice.
    """
    return latest_by_kpi(per_period_kpis(df, period_col, kpis, digits=digits))


def per_period_kpis(df: DataFrame, period_col: str, kpis: Sequence[Kpi], *, digits: int | None = 6) -> DataFrame:
    """``(period, kpi_id, value)`` for every period (one partial aggregate)."""
    per = ratio_kpis(df.where(F.col(period_col).isNotNull()), [period_col], kpis, digits=digits)
    return per.withColumnRenamed(period_col, "period")


def latest_by_kpi(per_period: DataFrame) -> DataFrame:
    """Row of the largest period per KPI (``max_by`` over one row per period and KPI). KPIs of
    several sources can be unioned first, so one small aggregate serves them all."""
    latest = per_period.groupBy("kpi_id").agg(
        F.max_by(F.struct(F.col("period"), F.col("value")), F.col("period")).alias("__r"))
    return latest.select(F.col("__r.period").alias("period"), "kpi_id", F.col("__r.value").alias("value"))


def scorecard(headline: DataFrame, kpis: Sequence[Kpi], *, digits: int | None = 6) -> DataFrame:
    """P19 + A34: attach target, direction, delta and status to (period, kpi_id, value) rows.

    Targets come from the fixed registry as a CASE lookup (bounded size), so no join is needed.
    """
    ids = {k.id: k for k in kpis}
    kid = F.col("kpi_id")
    # Lookups become columns first; status and delta then reference the columns (a CASE used
    # several times right after an unpivot trips subexpression codegen in Spark 4.1).
    base = headline.select(
        "kpi_id", "period", "value",
        lookup(kid, {k.id: k.name for k in ids.values()}, "string").alias("name"),
        lookup(kid, {k.id: k.target for k in ids.values()}, "double").alias("target"),
        lookup(kid, {k.id: k.higher_is_better for k in ids.values()}, "boolean").alias("higher_is_better"),
    )
    t, u, v = F.col("target"), F.col("higher_is_better"), F.col("value")
    status = (F.when(v.isNull() | t.isNull(), "none")
              .when(u & (v >= t), "good").when(~u & (v <= t), "good").otherwise("bad"))
    return base.select("kpi_id", "name", "period", "value", "target", "higher_is_better",
                       _r(v - t, digits).alias("delta"), status.alias("status"))
