"""Access and coverage operators over the tidy access table.

Input columns (see :func:`washkit.sources.files.tidy_access`): ``country, zone,
year, type, safely_managed[_pct], basic[_pct], limited[_pct], unimproved[_pct],
surface_water[_pct] (water), open_def[_pct] (sewer), other_pct, popn_total,
households, municipal_coverage (water)``.

Statistics are rounded to ``digits`` places (default 6) so results compare
exactly across engines; pass ``digits=None`` for raw doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washkit.functions import columns as C
from washkit.functions import predicates as P
from washkit.operators.periods import growth

# Fixed ladder rung orders (lowest rung first).
WATER_LADDER = ["surface_water_pct", "unimproved_pct", "limited_pct", "basic_pct", "safely_managed_pct"]
SEWER_LADDER = ["open_def_pct", "unimproved_pct", "limited_pct", "basic_pct", "safely_managed_pct"]
BOX_MEASURES = ["safely_managed_pct", "basic_pct", "limited_pct", "unimproved_pct"]


_r = C.rounded


#: Size parameter of the quantile sketches: exact up to this many values of a group, beyond it the
#: rank of the result is off by at most about 0.13 % of the group's values (KLL, single-sided, 99 %).
SKETCH = 4096


def _median(c: Column, exact: bool) -> Column:
    return F.median(c) if exact else F.percentile_approx(c, 0.5, 10000)


def sketch_median(sketch: Column) -> Column:
    """Median of a KLL sketch of doubles: the mean of the two middle values, which the ranks of one
    half and just above it give; NULL without values."""
    low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(rank)) for rank in (0.5, 0.5 + 1e-5))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, (low + high) / F.lit(2.0))


def _sketched(grouped, aggs: list[Column], meds: dict[str, Column], digits: int | None) -> DataFrame:
    """``aggs`` and the medians of ``meds`` from mergeable sketches of bounded size: one aggregate,
    reduced map-side, so no group's values meet in one task."""
    sketches = [F.kll_sketch_agg_double(c.cast("double"), F.lit(SKETCH)).alias(f"__s_{n}") for n, c in meds.items()]
    out = grouped.agg(*aggs, *sketches)
    return out.withColumns({n: _r(sketch_median(F.col(f"__s_{n}")), digits) for n in meds}).drop(*[f"__s_{n}" for n in meds])


def _distributed_medians(d: DataFrame, keys: list[str], cols: dict[str, Column], digits: int | None) -> DataFrame:
    """Exact medians of several columns per group via distributed selection (one long table)."""
    from washkit.operators.quantiles import exact_percentiles
    long = d.select(*keys, *[c.alias(n) for n, c in cols.items()]).unpivot(keys, list(cols), "__m", "__x")
    med = exact_percentiles(long, keys + ["__m"], "__x", [0.5])
    wide = med.groupBy(*keys).pivot("__m", list(cols)).agg(F.max("p0"))
    return wide.select(*keys, *[_r(F.col(n), digits).alias(n) for n in cols])


# --------------------------------------------------------------------------- A1
def country_summary(access: DataFrame, year: int, *, exact: bool = True, distributed: bool = False, sketched: bool = False,
                    digits: int | None = 6) -> DataFrame:
    """A1: per (country, type) in one year: min/median/max of safely managed, open
    defecation, unimproved and sewer gap %; distinct zones; population sum (0 when all NULL).

    One hash aggregate. The year predicate is applied before aggregating: Catalyst moves it
    below unions and aggregates to the scan, and parquet applies it there when ``year`` is a
    stored column. ``exact=False`` swaps the exact median (a per-group map of distinct
    values, merged in one task per group) for ``percentile_approx`` on very large groups;
    ``distributed=True`` keeps it exact via :mod:`washkit.operators.quantiles`; ``sketched=True``
    merges sketches, exact for groups of up to ``SKETCH`` rows.
    """
    d = access.where(P.equals("year", year)).withColumn("sewer_gap_pct", C.sewer_gap(access))
    d = d.where(F.col("country").isNotNull() & F.col("type").isNotNull())
    aggs, meds = [], {}
    for name, src in (("safely", "safely_managed_pct"), ("open_def", "open_def_pct"),
                      ("unimproved", "unimproved_pct"), ("sewer_gap", "sewer_gap_pct")):
        c = C.col_or_null(d, src) if src != "sewer_gap_pct" else F.col(src)
        aggs += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
        if distributed or sketched:
            meds[f"{name}_med"] = c
        else:
            aggs.append(_r(_median(c, exact), digits).alias(f"{name}_med"))
    aggs += [
        F.count_distinct("zone").alias("zones"),
        F.coalesce(F.sum("popn_total"), F.lit(0)).cast("bigint").alias("popn_sum"),
    ]
    if sketched:
        return _sketched(d.groupBy("country", "type"), aggs, meds, digits)
    out = d.groupBy("country", "type").agg(*aggs)
    if distributed:
        out = out.join(_distributed_medians(d, ["country", "type"], meds, digits), ["country", "type"], "left")
    return out


# --------------------------------------------------------------------------- A2
def surface_water_zones(access: DataFrame, year: int, *, digits: int | None = 6) -> DataFrame:
    """A2 (rows): water rows of one year with surface % and population present, plus estimated users."""
    d = access.where(P.equals("year", year) & (F.col("type") == "water"))
    d = d.where(P.not_null(["surface_water_pct", "popn_total"]))
    return d.select("country", "zone", "year", "surface_water_pct", "popn_total",
                    _r(C.surface_users(d), digits).alias("surface_users_est"))


def surface_water_exposure(access: DataFrame, year: int, *, exact: bool = True, distributed: bool = False, sketched: bool = False,
                           digits: int | None = 6) -> DataFrame:
    """A2 (ranges): per country min/median/max of surface % and estimated users
    (``distributed=True``: exact medians without merging a country in one task; ``sketched=True``:
    merged sketches, exact for countries of up to ``SKETCH`` rows)."""
    z = surface_water_zones(access, year, digits=None)
    meds = {"pct_med": F.col("surface_water_pct"), "users_med": F.col("surface_users_est")}
    aggs = [F.min("surface_water_pct").alias("pct_min"), F.max("surface_water_pct").alias("pct_max"),
            _r(F.min("surface_users_est"), digits).alias("users_min"),
            _r(F.max("surface_users_est"), digits).alias("users_max")]
    if not distributed and not sketched:
        aggs += [_r(_median(c, exact), digits).alias(n) for n, c in meds.items()]
    out = _sketched(z.groupBy("country"), aggs, meds, digits) if sketched else z.groupBy("country").agg(*aggs)
    if distributed:
        out = out.join(_distributed_medians(z, ["country"], meds, digits), ["country"], "left")
    return out.select("country", "pct_min", "pct_med", "pct_max", "users_min", "users_med", "users_max")


# --------------------------------------------------------------------------- A3
def population_trend(access: DataFrame, start: int, end: int, *, per_type_double: bool = False) -> DataFrame:
    """A3: population by (country, year) over a closed year range.

    Default counts each (country, zone, year) once (largest reported population of the
    zone that year). ``per_type_double=True`` reproduces the reference, which adds the
    water and the sewer row of a zone.
    """
    d = access.where(P.year_between("year", start, end)).where(F.col("country").isNotNull() & F.col("year").isNotNull())
    if not per_type_double:
        d = d.groupBy("country", "zone", "year").agg(F.max("popn_total").alias("popn_total"))
    return d.groupBy("country", "year").agg(F.coalesce(F.sum("popn_total"), F.lit(0)).cast("bigint").alias("popn_total"))


# --------------------------------------------------------------------------- A4
def municipal_coverage_trend(access: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """A4: mean municipal coverage by (type, year), rows with missing values dropped first."""
    d = access.where(P.not_null(["municipal_coverage", "year"]))
    keys = ["type", "year"] if "type" in d.columns else ["year"]
    return d.groupBy(*keys).agg(_r(F.avg("municipal_coverage"), digits).alias("municipal_coverage"))


# --------------------------------------------------------------------------- A5
def top_countries(access: DataFrame, type_value: str | None, n: int = 10, *, digits: int | None = 6) -> DataFrame:
    """A5: latest year (of the selected type), mean safely managed % per country, top ``n``.

    The latest year is a scalar subquery; the top-n is a ``TakeOrderedAndProject`` over
    the per-country aggregate (one row per country), never a full sort.
    """
    d = access
    if type_value:
        d = d.where(P.iequals("type", type_value))
    d = P.latest_only(d.where(F.col("year").isNotNull()), "year")
    g = d.where(F.col("safely_managed_pct").isNotNull()).groupBy("country").agg(
        F.avg("safely_managed_pct").alias("mean_safely_pct")
    )
    return g.orderBy(F.desc("mean_safely_pct"), F.asc("country")).limit(n).select(
        "country", _r(F.col("mean_safely_pct"), digits).alias("mean_safely_pct")
    )


# --------------------------------------------------------------------------- A9 / W2
def latest_snapshot(df: DataFrame, keys: Sequence[str], order_col: str | None = "year", columns: Sequence[str] | None = None,
                    tie_breaker: Sequence[str] = ()) -> DataFrame:
    """The row with the largest ``order_col`` per key. Ties go to the largest ``tie_breaker`` columns,
    or else the largest row, so one row of each key wins whatever order rows arrive in.

    ``order_col=None`` (a table without a year) keeps one row of each key by ``tie_breaker`` alone, such
    as a load time: a distributed table has no file order that could say which row is the last.

    Implemented as ``max_by(struct(...), struct(order, tie...))`` -- a partial aggregate, so a key
    holding a third of all rows is reduced map-side instead of being sorted in one task.
    """
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    if order_col is not None and order_col not in cols:
        cols = [order_col] + cols
    payload = F.struct(*[F.col(c) for c in cols])
    first = [] if order_col is None else [order_col]
    ordering = F.struct(*first, *tie_breaker, payload.alias("row"))
    rows = df if order_col is None else df.where(F.col(order_col).isNotNull())
    g = rows.groupBy(*keys).agg(F.max_by(payload, ordering).alias("__row"))
    return g.select(*keys, *[F.col("__row")[c].alias(c) for c in cols])


def outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None, suffix: str = "_dup") -> DataFrame:
    """Full outer equi-join on the key columns both sides have (``country, zone``, else ``zone``);
    clashing non-key columns of the right side get ``suffix``; ``country`` is coalesced when it
    is not a key."""
    if keys is None:
        keys = [k for k in ("country", "zone") if k in left.columns and k in right.columns] or ["zone"]
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    r = right.withColumnsRenamed({c: c + suffix for c in clash})
    out = left.join(r, list(keys), "full_outer")
    if "country" not in keys and "country" + suffix in out.columns:
        out = out.withColumn("country", F.coalesce("country", "country" + suffix)).drop("country" + suffix)
    return out


# --------------------------------------------------------------------------- A10
def zone_summary(access: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """A10: latest water and latest sewer snapshot per (country, zone), side by side, with
    ``safeAccess`` = mean of the two safely managed shares (P9) and a slug id (P10).

    The reference does two latest-row selections and a full outer merge (J1). Here both
    snapshots come out of ONE aggregate on (country, zone): a conditional ``max_by`` per type
    ignores rows of the other type (NULL ordering), and a zone present in only one type gets
    NULLs for the other -- the same rows as the outer merge, with one shuffle and no join.
    Repeated rows of a zone's latest year give the largest value.
    """
    def latest(type_value: str, c: str) -> Column:
        is_t = F.col("type") == type_value
        return F.max_by(F.when(is_t, F.col(c)), F.when(is_t & F.col("year").isNotNull(), F.struct("year", c)))

    g = access.where(F.col("year").isNotNull()).groupBy("country", "zone").agg(
        F.max(F.when(F.col("type") == "water", F.col("year"))).alias("water_year"),
        latest("water", "safely_managed_pct").alias("water_safely_pct"),
        F.max(F.when(F.col("type") == "sewer", F.col("year"))).alias("sewer_year"),
        latest("sewer", "safely_managed_pct").alias("sewer_safely_pct"),
    )
    return g.select(
        C.zone_slug(F.col("country"), F.col("zone")).alias("id"),
        F.col("zone").alias("name"),
        "country",
        _r(C.mean_ignoring_null(F.col("water_safely_pct"), F.col("sewer_safely_pct")), digits).alias("safeAccess"),
        "water_safely_pct", "sewer_safely_pct", "water_year", "sewer_year",
    )


# --------------------------------------------------------------------------- A27
def access_ladder(access: DataFrame, type_value: str) -> DataFrame:
    """Latest year of one type; missing rungs as 0; rungs unpivoted in ladder order
    with a display label (P14) and the rung position."""
    d = access.where(P.iequals("type", type_value))
    d = P.latest_only(d.where(F.col("year").isNotNull()), "year")
    rungs = WATER_LADDER if type_value.lower().startswith("water") else SEWER_LADDER
    d = d.select("country", "zone", "year", "type", *[C.col_or_null(d, r) for r in rungs]).fillna(0.0, subset=rungs)
    long = d.unpivot(["country", "zone", "year", "type"], rungs, "rung", "pct")
    order = F.array_position(F.array(*[F.lit(r) for r in rungs]), F.col("rung")).cast("int")
    return long.select("country", "zone", "year", "type", C.level_label(F.col("rung")).alias("level"),
                       order.alias("rung_order"), "pct")


def access_ladders(access: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """A27 for every type present (or the listed ``types``) in one pass: each type's own latest year,
    its own rung order (types that do not start with ``water`` take the sewer ladder).

    With listed types the per-type latest year has at most ``len(types)`` rows (a proven bound) and is
    sent to the rows; otherwise the planner chooses by measured size. All rung columns are unpivoted
    once and each type keeps only the rungs of its ladder.
    """
    d = access.withColumn("__t", F.lower("type")).where(F.col("__t").isNotNull() & F.col("year").isNotNull())
    if types is not None:
        d = d.where(F.col("__t").isin([t.lower() for t in types]))
    latest = d.groupBy("__t").agg(F.max("year").alias("__y"))
    d = d.join(latest if types is None else F.broadcast(latest), "__t").where(F.col("year") == F.col("__y"))
    rungs = list(dict.fromkeys(WATER_LADDER + SEWER_LADDER))
    d = d.select("__t", "country", "zone", "year", "type", *[C.col_or_null(d, r) for r in rungs]) \
        .fillna(0.0, subset=rungs)
    long = d.unpivot(["__t", "country", "zone", "year", "type"], rungs, "rung", "pct")
    water_pos = F.array_position(F.array(*[F.lit(r) for r in WATER_LADDER]), F.col("rung"))
    sewer_pos = F.array_position(F.array(*[F.lit(r) for r in SEWER_LADDER]), F.col("rung"))
    pos = F.when(F.col("__t").startswith("water"), water_pos).otherwise(sewer_pos).cast("int")
    return long.withColumn("rung_order", pos).where(F.col("rung_order") > 0).select(
        "country", "zone", "year", "type", C.level_label(F.col("rung")).alias("level"), "rung_order", "pct")


# --------------------------------------------------------------------------- A19
def box_statistics(access: DataFrame, measures: Sequence[str] = BOX_MEASURES, *,
                   types: Sequence[str] | None = None, exact: bool = True, distributed: bool = False,
                   digits: int | None = 6) -> DataFrame:
    """Per (type, measure) five-number summary: linear-interpolated quartiles, 1.5 IQR
    fences, whiskers (most extreme points inside the fences) and outlier count.

    Pass 1 aggregates quartiles per group (one row each), which pass 2 joins to the points to aggregate
    whiskers. All types present take part, or the listed ``types``: that bounds the quartiles at
    ``len(types) * len(measures)`` rows, which are then sent to the points; without it the planner
    chooses by measured size. NaN counts as missing. ``distributed=True`` computes the exact
    quartiles with :func:`washkit.operators.quantiles.bracketed_percentiles` instead of ``percentile``
    (same values; no group's distinct values are merged in one task).
    """
    d = access if types is None else access.where(F.col("type").isin(list(types)))
    long = d.select("type", *measures).unpivot(["type"], list(measures), "measure", "value").where(
        F.col("type").isNotNull() & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    )
    if distributed:
        from washkit.operators.quantiles import bracketed_percentiles
        stats = bracketed_percentiles(long, ["type", "measure"], "value", [0.25, 0.5, 0.75],
                                      groups=None if types is None else len(types) * len(measures)).select(
            "type", "measure", F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"))
    else:
        q = F.percentile(F.col("value"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if exact else \
            F.percentile_approx(F.col("value"), [0.25, 0.5, 0.75], 10000)
        stats = long.groupBy("type", "measure").agg(q.alias("q")).select(
            "type", "measure", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    stats = stats.withColumn("iqr", F.col("q3") - F.col("q1"))
    stats = stats.withColumns({
        "lower_fence": F.col("q1") - F.lit(1.5) * F.col("iqr"),
        "upper_fence": F.col("q3") + F.lit(1.5) * F.col("iqr"),
    })
    j = long.join(stats if types is None else F.broadcast(stats), ["type", "measure"])
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    carried = ("q1", "median", "q3", "lower_fence", "upper_fence")
    out = j.groupBy("type", "measure").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(c).alias(c) for c in carried],
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return out.select(
        "type", "measure", "n",
        *[_r(F.col(c), digits).alias(c) for c in carried],
        "whisker_low", "whisker_high", "n_outliers",
    )


# --------------------------------------------------------------------------- A28
def focus_zone_trend(access: DataFrame, start: int, end: int, zone_pattern: str,
                     countries: Sequence[str] = ()) -> DataFrame:
    """Safely managed % series of focus zones (regex on zone, case-insensitive) or countries."""
    d = access.where(P.year_between("year", start, end))
    cond = P.imatches("zone", zone_pattern)
    if countries:
        cond = cond | F.coalesce(F.upper(F.col("country")).isin([c.upper() for c in countries]), F.lit(False))
    return d.where(cond).select("country", "type", "zone", "year", "safely_managed_pct")


# --------------------------------------------------------------------------- A29
def urban_rural_compare(access: DataFrame, year: int, countries: Sequence[str]) -> DataFrame:
    """One year, urban/rural tag per zone (P11), for the listed countries (case-insensitive)."""
    d = access.where(P.equals("year", year)).where(
        F.coalesce(F.upper(F.col("country")).isin([c.upper() for c in countries]), F.lit(False))
    )
    return d.select("country", "zone", "type", "safely_managed_pct", "open_def_pct", "unimproved_pct",
                    C.urban_rural_tag(F.col("zone")).alias("ur_tag"))


# --------------------------------------------------------------------------- A30
def priority_zones(access: DataFrame, year: int, *, countries: Sequence[str] = (), zone_patterns: Sequence[str] = (),
                   country_zone_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Priority predicate (F10), sewer gap (P7), display names, % to 1 place, population to integer."""
    d = access.where(P.equals("year", year)).where(P.priority_zone(countries, zone_patterns, country_zone_pairs))
    d = d.withColumn("sewer_gap_pct", C.sewer_gap(d))
    return d.select(
        "country", "zone", "type",
        F.round(F.col("popn_total").cast("double"), 0).try_cast("bigint").alias("population"),
        F.round("safely_managed_pct", 1).alias("safely_managed_pct"),
        F.round("open_def_pct", 1).alias("open_def_pct"),
        F.round("unimproved_pct", 1).alias("unimproved_pct"),
        F.round("sewer_gap_pct", 1).alias("sewer_gap_pct"),
    ).orderBy("country", "zone", "type")


# --------------------------------------------------------------------------- W1
def coverage_growth(access: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """Growth of municipal coverage, connections (households) and population per zone and
    type against the year before; NULL where that year is missing."""
    return growth(access, ["country", "zone", "type"], "year", ["municipal_coverage", "households", "popn_total"],
                  digits=digits)
