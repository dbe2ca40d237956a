"""Registered queries: ``key -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables through a stand-in view
(:mod:`washkit.sources.standins`) and runs one library operator on it. The SQL
oracle of every key lives in :mod:`washkit.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washkit.functions import predicates as P
from washkit.operators import access as A
from washkit.operators import catalogue as CG
from washkit.operators import finance as FN
from washkit.operators import geo as G
from washkit.operators import kpi as K
from washkit.operators import matching as M
from washkit.operators import periods as PD
from washkit.operators import service as S
from washkit.plans import params as X
from washkit.sources import files
from washkit.sources import standins as V

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[key] = fn
        return fn
    return deco


def access_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy access table of the water/sewer stand-ins, from one read of the orders (the rows of
    :func:`q_access_union`, as a test shows)."""
    return V.tidy_access_rows(V.Tables(spark, sf_dir))


# --------------------------------------------------------------------------- access
@register("country_summary")
def q_country_summary(spark, sf_dir):
    return A.country_summary(access_table(spark, sf_dir), X.LATEST_YEAR, sketched=True)


@register("surface_water_exposure")
def q_surface_water_exposure(spark, sf_dir):
    return A.surface_water_exposure(access_table(spark, sf_dir), X.LATEST_YEAR, sketched=True)


@register("surface_water_zones")
def q_surface_water_zones(spark, sf_dir):
    return A.surface_water_zones(access_table(spark, sf_dir), X.LATEST_YEAR)


@register("population_trend")
def q_population_trend(spark, sf_dir):
    return A.population_trend(access_table(spark, sf_dir), X.TREND_START, X.TREND_END)


@register("municipal_coverage_trend")
def q_municipal_coverage_trend(spark, sf_dir):
    return A.municipal_coverage_trend(access_table(spark, sf_dir))


@register("top_countries")
def q_top_countries(spark, sf_dir):
    return A.top_countries(access_table(spark, sf_dir), "water", X.TOP_N)


@register("latest_snapshot")
def q_latest_snapshot(spark, sf_dir):
    acc = access_table(spark, sf_dir)
    water = acc.where("type = 'water'")
    return A.latest_snapshot(water, ["country", "zone"], "year",
                             ["year", "safely_managed_pct", "basic_pct", "surface_water_pct", "popn_total"])


@register("zone_summary")
def q_zone_summary(spark, sf_dir):
    return A.zone_summary(access_table(spark, sf_dir))


@register("access_ladder")
def q_access_ladder(spark, sf_dir):
    return A.access_ladders(access_table(spark, sf_dir), X.ACCESS_TYPES)


@register("box_statistics")
def q_box_statistics(spark, sf_dir):
    return A.box_statistics(access_table(spark, sf_dir), types=X.ACCESS_TYPES, distributed=True)


@register("focus_zone_trend")
def q_focus_zone_trend(spark, sf_dir):
    return A.focus_zone_trend(access_table(spark, sf_dir), X.TREND_START, X.TREND_END, X.FOCUS_ZONE_PATTERN,
                              X.FOCUS_COUNTRIES)


@register("urban_rural_compare")
def q_urban_rural_compare(spark, sf_dir):
    return A.urban_rural_compare(access_table(spark, sf_dir), X.LATEST_YEAR, X.COMPARE_COUNTRIES)


@register("priority_zones")
def q_priority_zones(spark, sf_dir):
    return A.priority_zones(access_table(spark, sf_dir), X.LATEST_YEAR, countries=X.PRIORITY_COUNTRIES,
                            zone_patterns=X.PRIORITY_ZONE_PATTERNS, country_zone_pairs=X.PRIORITY_PAIRS)


@register("access_union")
def q_access_union(spark, sf_dir):
    """U1 + P1-P4: the two prefixed sources, normalised and united by column name."""
    return files.tidy_access(*V.access_sources(V.Tables(spark, sf_dir)))


@register("coverage_growth")
def q_coverage_growth(spark, sf_dir):
    return A.coverage_growth(access_table(spark, sf_dir))


# --------------------------------------------------------------------------- service
def service_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.service_month(V.Tables(spark, sf_dir))


def service_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly service rows with date and per-row rates (P12 + P17)."""
    return S.prepare_service(service_rows(spark, sf_dir))


@register("service_time_series")
def q_service_time_series(spark, sf_dir):
    return S.service_time_series(service_table(spark, sf_dir))


@register("service_latest_by_zone")
def q_service_latest_by_zone(spark, sf_dir):
    return S.service_latest_by_zone(service_table(spark, sf_dir))


@register("service_kpis")
def q_service_kpis(spark, sf_dir):
    return S.service_kpis(service_table(spark, sf_dir))


@register("service_filtered")
def q_service_filtered(spark, sf_dir):
    return S.service_filtered(service_table(spark, sf_dir), X.SERVICE_COUNTRY, X.SERVICE_CITY, X.SERVICE_ZONE)


@register("kpi_service")
def q_kpi_service(spark, sf_dir):
    return K.ratio_kpis(service_table(spark, sf_dir), ["country", "city", "date"], K.kpis_for("service", "service"))


@register("kpi_sanitation")
def q_kpi_sanitation(spark, sf_dir):
    return K.ratio_kpis(service_table(spark, sf_dir), ["country", "city", "year"], K.kpis_for("sanitation"))


@register("sanitation_chain")
def q_sanitation_chain(spark, sf_dir):
    return K.sanitation_chain(service_table(spark, sf_dir), ["country"])


@register("data_quality")
def q_data_quality(spark, sf_dir):
    return K.data_quality(service_table(spark, sf_dir), ["country"], K.kpis_for(table="service"))


# --------------------------------------------------------------------------- ledger
def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ledger(V.Tables(spark, sf_dir))


def billing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.billing(V.Tables(spark, sf_dir))


def production_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.production(V.Tables(spark, sf_dir))


@register("revenue_by_year_zone")
def q_revenue_by_year_zone(spark, sf_dir):
    return FN.revenue_by_year_zone(ledger_table(spark, sf_dir))


@register("yearly_totals")
def q_yearly_totals(spark, sf_dir):
    return FN.yearly_totals(ledger_table(spark, sf_dir))


@register("ledger_headline")
def q_ledger_headline(spark, sf_dir):
    return FN.ledger_headline(ledger_table(spark, sf_dir))


@register("zone_statistics")
def q_zone_statistics(spark, sf_dir):
    return FN.zone_statistics(ledger_table(spark, sf_dir), *X.LEDGER_RANGE)


@register("efficiency_heatmap")
def q_efficiency_heatmap(spark, sf_dir):
    return FN.efficiency_heatmap(ledger_table(spark, sf_dir), X.LEDGER_YEARS)


@register("efficiency_histogram")
def q_efficiency_histogram(spark, sf_dir):
    return FN.efficiency_histogram(ledger_table(spark, sf_dir), X.HIST_BINS)


@register("revenue_expenditure_fit")
def q_revenue_expenditure_fit(spark, sf_dir):
    return FN.revenue_expenditure_fit(ledger_table(spark, sf_dir))


@register("share_of_total")
def q_share_of_total(spark, sf_dir):
    return FN.share_of_total(ledger_table(spark, sf_dir), "zone", FN.EXP)


@register("billing_vs_collection_by_zone")
def q_billing_vs_collection_by_zone(spark, sf_dir):
    return FN.billing_vs_collection_by_zone(ledger_table(spark, sf_dir))


# --------------------------------------------------------------------------- billing / production
@register("billing_collection")
def q_billing_collection(spark, sf_dir):
    return FN.billing_collection(billing_table(spark, sf_dir))


@register("debt_aging")
def q_debt_aging(spark, sf_dir):
    return FN.debt_aging(billing_table(spark, sf_dir), X.AS_OF)


@register("production_summary")
def q_production_summary(spark, sf_dir):
    return FN.production_summary(production_table(spark, sf_dir))


#: Collection efficiency from the ledger, whose billing and collection are the orders' bills summed: one read serves F1, F2 and F4.
_F1_LEDGER = replace(K.BY_ID["F1"], table="ledger", num="total_collection", den="total_billing")


@register("kpi_finance")
def q_kpi_finance(spark, sf_dir):
    ledger = K.ratio_kpis(ledger_table(spark, sf_dir), ["year"], [_F1_LEDGER, *(K.BY_ID[i] for i in ("F2", "F4"))])
    register_ = K.ratio_kpis(city_year_table(spark, sf_dir), ["year"], [K.BY_ID[i] for i in ("F12", "F12_pct", "F3")])
    return ledger.unionByName(register_)


@register("executive_scorecard")
def q_executive_scorecard(spark, sf_dir):
    kpis = {"access": ["A_safely_water", "A_safely_sanitation"], "ledger": ["F1", "F2"], "city_year": ["F3", "C1", "AH"], "production": ["C2"]}
    sources = {
        "access": access_table(spark, sf_dir),
        "ledger": ledger_table(spark, sf_dir),
        "city_year": city_year_table(spark, sf_dir),
        "production": production_table(spark, sf_dir).withColumn("year", F.year("date")),
    }
    by_id = {**K.BY_ID, "F1": _F1_LEDGER}
    per = None
    for src, ids in kpis.items():
        part = K.per_period_kpis(sources[src], "year", [by_id[i] for i in ids])
        per = part if per is None else per.unionByName(part)
    return K.scorecard(K.latest_by_kpi(per), [by_id[i] for ids in kpis.values() for i in ids])


# --------------------------------------------------------------------------- catalogue / documents
def catalogue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.catalogue(V.Tables(spark, sf_dir))


@register("catalogue_counts")
def q_catalogue_counts(spark, sf_dir):
    return CG.catalogue_counts(catalogue_table(spark, sf_dir))


@register("catalogue_totals")
def q_catalogue_totals(spark, sf_dir):
    return CG.cadence_totals(catalogue_table(spark, sf_dir))


@register("framework_alignment")
def q_framework_alignment(spark, sf_dir):
    return CG.framework_alignment(catalogue_table(spark, sf_dir), X.FRAMEWORKS)


@register("catalogue_filter")
def q_catalogue_filter(spark, sf_dir):
    cat = catalogue_table(spark, sf_dir)
    return CG.apply_filters(cat, search=X.CATALOGUE_SEARCH, domains=X.CATALOGUE_DOMAINS,
                            frequencies=X.CATALOGUE_FREQUENCIES, frameworks=X.CATALOGUE_FRAMEWORKS)


@register("section_subcategory_listing")
def q_section_subcategory_listing(spark, sf_dir):
    return CG.section_subcategory_listing(catalogue_table(spark, sf_dir), X.SUBCATEGORY_ORDER)


@register("distinct_values")
def q_distinct_values(spark, sf_dir):
    return CG.distinct_values(catalogue_table(spark, sf_dir), ["domain", "frequency", "granularity", "section"])


@register("catalogue_search")
def q_catalogue_search(spark, sf_dir):
    docs = V.Tables(spark, sf_dir).documents
    hits = CG.apply_filters(docs, search=X.DOCUMENT_SEARCH, search_columns=X.DOCUMENT_COLUMNS)
    return hits.select("doc_id", "source", "lang", "n_chars")


# --------------------------------------------------------------------------- geometry / json
@register("zone_extent")
def q_zone_extent(spark, sf_dir):
    return G.zone_extent(shapes_table(spark, sf_dir))


@register("zone_enrichment")
def q_zone_enrichment(spark, sf_dir):
    shapes = G.zone_extent(shapes_table(spark, sf_dir))
    metrics = A.zone_summary(access_table(spark, sf_dir))
    return G.enrich_zones(metrics, shapes, ["safeAccess", "water_safely_pct", "sewer_safely_pct"], band_col="safeAccess")


@register("json_snapshot")
def q_json_snapshot(spark, sf_dir):
    ev = files.parse_json_column(V.Tables(spark, sf_dir).events, "props", "k BIGINT", prefix="props_")
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count("props_k").alias("with_k"),
        F.sum(F.coalesce(F.col("props_k"), F.lit(0))).alias("sum_k"),
        F.round(F.avg("props_k"), 6).alias("mean_k"),
    )


# --------------------------------------------------------------------------- KPI registry keys
@register("kpi_access")
def q_kpi_access(spark, sf_dir):
    return K.ratio_kpis(access_table(spark, sf_dir), ["country", "type", "year"], K.kpis_for("access"))


def city_year_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.city_year(V.Tables(spark, sf_dir))


def shapes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.zone_shapes(V.Tables(spark, sf_dir))


@register("kpi_governance")
def q_kpi_governance(spark, sf_dir):
    return K.governance_kpis(city_year_table(spark, sf_dir))


@register("kpi_sector")
def q_kpi_sector(spark, sf_dir):
    return K.sector_budget_shares(city_year_table(spark, sf_dir))


@register("kpi_cross_table")
def q_kpi_cross_table(spark, sf_dir):
    """J3 + N5: output value (city_year) per m3 consumed (service) at (city, year)."""
    used = service_rows(spark, sf_dir).withColumnRenamed("total_consumption", "water_used")
    both = K.combine_inputs(city_year_table(spark, sf_dir), used, ["city", "year"], ["output_value"], ["water_used"])
    return K.ratio_kpis(both, ["city", "year"], [K.BY_ID["N5"]])


@register("service_month_range")
def q_service_month_range(spark, sf_dir):
    """F3 + A6: series over an inclusive month range given as text bounds."""
    svc = service_table(spark, sf_dir)
    return S.service_time_series(svc.where(P.month_range("date", *X.SERVICE_MONTHS)))


@register("revenue_share_in_zone")
def q_revenue_share_in_zone(spark, sf_dir):
    """Revenue by year within one zone, as a share of the zone's total."""
    led = ledger_table(spark, sf_dir)
    return FN.share_of_total(led.where(F.col("zone") == X.SHARE_ZONE), "year", FN.REV)


@register("service_menus")
def q_service_menus(spark, sf_dir):
    """A37 over service rows: distinct countries, cities and zones for option menus."""
    return CG.distinct_values(service_rows(spark, sf_dir), ["country", "city", "zone"])


@register("zone_unmatched")
def q_zone_unmatched(spark, sf_dir):
    """J2 report: zone shapes whose normalised (country, name) has no access metrics (left anti join)."""
    return G.unmatched_zones(A.zone_summary(access_table(spark, sf_dir)), shapes_table(spark, sf_dir)) \
        .select("vec_id", "name", "country")


@register("snapshot_merge")
def q_snapshot_merge(spark, sf_dir):
    """A9 + J1: latest water and latest sewer snapshot per (country, zone), full outer join,
    clashing right-side columns suffixed ``_dup``."""
    acc = access_table(spark, sf_dir)
    cols = ["year", "safely_managed_pct", "unimproved_pct"]
    w = A.latest_snapshot(acc.where(F.col("type") == "water"), ["country", "zone"], "year", cols)
    s = A.latest_snapshot(acc.where(F.col("type") == "sewer"), ["country", "zone"], "year", cols + ["open_def_pct"])
    return A.outer_merge(w, s)


@register("billing_growth")
def q_billing_growth(spark, sf_dir):
    """W1 on a series with gaps: a customer's bills per year against the year before, years without bills as rows."""
    bills = billing_table(spark, sf_dir).withColumn("year", F.year("date"))
    per = bills.groupBy("customer_id", "year").agg(*[FN.money_sum(c).alias(c) for c in ("billed", "paid")])
    return PD.growth(per, ["customer_id"], "year", ["billed", "paid"], fill=True)


@register("kpi_month_against_year")
def q_kpi_month_against_year(spark, sf_dir):
    """J3 across grains: monthly consumption of a city against its yearly accounts."""
    return PD.month_against_year(service_table(spark, sf_dir), city_year_table(spark, sf_dir), ["city"], "total_consumption", ["actual_expenditure", "output_value"])


@register("service_cascade")
def q_service_cascade(spark, sf_dir):
    """Options of the country, city and zone menus, each level with its rows."""
    return CG.cascading_menu(service_rows(spark, sf_dir), S.ZONE_KEYS)


@register("points_in_zones")
def q_points_in_zones(spark, sf_dir):
    """J2 by geometry: every connection point with the outlines it lies in."""
    t = V.Tables(spark, sf_dir)
    return G.locate_points(V.connection_points(t), V.zone_outlines(t), ["vec_id", "name", "country"]).select("id", "vec_id", "name", "country")


@register("zone_name_matches")
def q_zone_name_matches(spark, sf_dir):
    """J2 by near name: the metric zone nearest to each outline's name, within two edits, in its country."""
    metrics = A.zone_summary(access_table(spark, sf_dir))
    return M.match_names(shapes_table(spark, sf_dir), metrics, block=["country"])


@register("box_statistics_distributed")
def q_box_statistics_distributed(spark, sf_dir):
    """The same as box_statistics: the key stays for comparison with earlier rounds."""
    return A.box_statistics(access_table(spark, sf_dir), types=X.ACCESS_TYPES, distributed=True)


@register("sector_documents")
def q_sector_documents(spark, sf_dir):
    """Stress, use efficiency by sector and loss, each out of one nested document a city and year."""
    return K.sector_document_kpis(V.sector_documents(V.Tables(spark, sf_dir)), "document", ["city", "year"])
