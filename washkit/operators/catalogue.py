"""Indicator-catalogue operators (A11, A12, A36, A37) and search/filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washkit.functions import predicates as P

SEARCH_COLUMNS = ["indicator", "description", "domain", "section"]
COUNT_DIMENSIONS = ["frequency", "domain", "section"]

# Fixed declared order of subcategories within each catalogue section.
SECTION_SUBCATEGORY_ORDER = {
    "Access Ladder": ["Water Access Ladder", "Sanitation Access Ladder"],
    "Coverage & Expansion": ["Water Coverage & Expansion", "Sanitation Expansion"],
    "Operational Performance": [
        "Network Efficiency & Quality",
        "Demand & Service Levels",
        "Sanitation Service Delivery",
        "Infrastructure Utilisation",
        "Customer Service & Reliability",
    ],
    "Resilience & Resource Efficiency": ["Resource Circularity", "Resilience & Environment"],
    "Governance & Finance": [
        "Financial Performance",
        "Financial Management",
        "Public Finance",
        "Inclusive Governance",
        "Asset & Provider Health",
        "Workforce & Capacity",
    ],
}


def catalogue_counts(cat: DataFrame, dimensions: Sequence[str] = COUNT_DIMENSIONS, *, ordered: bool = False) -> DataFrame:
    """Row counts per value of each dimension, long form (dimension, value, n); missing
    values are not counted (as a value count does).

    One scan: the dimensions are unpivoted (narrow) and counted in a single aggregate.
    ``ordered=True`` sorts each dimension's values by descending count, then value (T2).
    """
    long = cat.select(*dimensions).unpivot([], list(dimensions), "dimension", "value")
    out = long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy("dimension", F.desc("n"), "value") if ordered else out


def cadence_totals(cat: DataFrame) -> DataFrame:
    """A11 (hero totals): total indicators and the count per cadence in one row."""
    return cat.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("frequency") == "Monthly").alias("monthly"),
        F.count_if(F.col("frequency") == "Quarterly").alias("quarterly"),
        F.count_if(F.col("frequency") == "Annual").alias("annual"),
    )


def framework_alignment(cat: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """Per framework, count of 'Yes' and of 'Somewhat' (missing = 'No'); zero counts omitted."""
    long = cat.select(*frameworks).unpivot([], list(frameworks), "framework", "status")
    long = long.withColumn("status", F.coalesce(F.col("status"), F.lit("No")))
    return long.where(F.col("status").isin("Yes", "Somewhat")).groupBy("framework", "status").agg(
        F.count(F.lit(1)).alias("indicators")
    )


def apply_filters(cat: DataFrame, *, search: str | None = None, domains: Sequence[str] | None = None,
                  frequencies: Sequence[str] | None = None, granularities: Sequence[str] | None = None,
                  frameworks: Sequence[str] | None = None, search_columns: Sequence[str] = SEARCH_COLUMNS,
                  literal: bool = False) -> DataFrame:
    """F7 + F11 + F12: search term (regex over the search columns, lower-cased), membership
    lists (empty = all), and framework alignment (AND of Yes/Somewhat)."""
    cond = F.lit(True)
    if search:
        cond = cond & P.any_column_matches(search_columns, search, literal)
    cond = cond & P.member_of("domain", domains) & P.member_of("frequency", frequencies)
    cond = cond & P.member_of("granularity", granularities) & P.aligned_with(frameworks)
    return cat.where(cond)


def section_subcategory_listing(cat: DataFrame, declared: Mapping[str, Sequence[str]] = SECTION_SUBCATEGORY_ORDER
                                ) -> DataFrame:
    """Per (section, subcategory): indicator count and sorted distinct cadences, with an
    ordinal inside the section -- declared subcategories first (declared order), then the rest
    alphabetically.

    The declared order is a literal map (fixed size); the ordinal window runs over the
    aggregated (section, subcategory) rows, one small partition per section.
    """
    g = cat.groupBy("section", "subcategory").agg(
        F.count(F.lit(1)).alias("indicators"),
        F.array_join(F.sort_array(F.collect_set("frequency")), ", ").alias("cadences"),
    )
    pairs = [x for s, subs in declared.items() for i, sub in enumerate(subs) for x in (F.lit(f"{s}\u0000{sub}"), F.lit(i + 1))]
    pos = F.create_map(*pairs)[F.concat_ws("\u0000", F.col("section"), F.col("subcategory"))] if pairs else F.lit(None)
    w = Window.partitionBy("section").orderBy(F.col("__pos").asc_nulls_last(), F.col("subcategory"))
    return g.withColumn("__pos", pos).withColumn("ordinal", F.row_number().over(w).cast("int")).drop("__pos")


def distinct_values(cat: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct option values per column, long form (field, value), NULLs dropped."""
    long = cat.select(*columns).unpivot([], list(columns), "field", "value")
    return long.where(F.col("value").isNotNull()).distinct()


def cascading_menu(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """The options of cascading menus, (level, ``levels``..., n): the number of rows under each
    choice of the first ``level`` columns, deeper ones NULL; level 0 is "All".

    One rollup: every level comes from one scan and one aggregate, whose rows are reduced map-side. A
    NULL value is no option: its rows count in the levels above it only.
    """
    depth = F.lit(len(levels)) - F.bit_count(F.grouping_id())
    menu = df.rollup(*levels).agg(depth.cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
    known = F.lit(True)
    for i, c in enumerate(levels):
        known = known & (F.col(c).isNotNull() | (F.col("level") <= i))
    return menu.where(known).select("level", *levels, "n")


def menu_options(menu: DataFrame, levels: Sequence[str], chosen: Sequence[str]) -> DataFrame:
    """(option, n) of the menu after ``chosen`` values of the first levels, from :func:`cascading_menu`."""
    at = menu.where(F.col("level") == len(chosen) + 1)
    for c, v in zip(levels, chosen):
        at = at.where(F.col(c) == F.lit(v))
    return at.select(F.col(levels[len(chosen)]).alias("option"), "n")
