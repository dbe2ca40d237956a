"""Finance operators: utility ledger (zone x month), billing and production.

Ledger columns: ``year, month, zone, total_operating_revenues,
total_operating_expenditures, collection_efficiency, personnel_expenditure_pct,
total_billing, total_collection, om_cost_coverage``. Money sums are rounded to
four places and ratios to ``digits`` places by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washkit.functions import columns as C

REV, EXP = "total_operating_revenues", "total_operating_expenditures"
# Fixed debt-aging buckets: (label, lowest age in days, highest age in days or None).
AGING_BUCKETS = [("0-30 days", 0, 30), ("31-60 days", 31, 60), ("61-90 days", 61, 90), ("90+ days", 91, None)]


_r = C.rounded


# Money is summed exactly: each amount (at most 4 decimals: prices, half-paid bills, discounted
# line values) is cast to DECIMAL(28,4) and Spark adds decimals without rounding, so totals do
# not depend on summation order at any scale. Results are returned as doubles.
MONEY = "decimal(28,4)"


def msum(c: Column | str) -> Column:
    """Exact sum of a money column (DECIMAL)."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(MONEY))


def _money(c: Column) -> Column:
    """A money result as a double rounded to 4 places (exact for decimal inputs)."""
    return F.round(c, 4).cast("double")


def money_sum(c: Column | str) -> Column:
    """Exact sum of a money column as a double."""
    return _money(msum(c))


def with_date(ledger: DataFrame) -> DataFrame:
    """Month date of each ledger row."""
    return ledger.withColumn("date", C.month_date(F.col("year"), F.col("month")))


# --------------------------------------------------------------------------- A13
def revenue_by_year_zone(ledger: DataFrame) -> DataFrame:
    """Revenue per (year, zone)."""
    return ledger.groupBy("year", "zone").agg(_money(msum(REV)).alias("revenue"))


# --------------------------------------------------------------------------- A14
def yearly_totals(ledger: DataFrame) -> DataFrame:
    """Revenue and expenditure per year in long form (year, measure, amount)."""
    g = ledger.groupBy("year").agg(_money(msum(REV)).alias("revenue"), _money(msum(EXP)).alias("expenditure"))
    return g.unpivot(["year"], ["revenue", "expenditure"], "measure", "amount")


# --------------------------------------------------------------------------- A15
def ledger_headline(ledger: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """Latest-year revenue and expenditure totals; mean collection efficiency and mean
    personnel % over all rows.

    Two aggregation levels and no join: per-year partial sums, then one global aggregate
    picks the latest year's totals with ``max_by`` and combines the mean parts.
    """
    per_year = ledger.where(F.col("year").isNotNull()).groupBy("year").agg(
        msum(REV).alias("rev"), msum(EXP).alias("exp"),
        F.sum("collection_efficiency").alias("eff_sum"), F.count("collection_efficiency").alias("eff_n"),
        F.sum("personnel_expenditure_pct").alias("pers_sum"), F.count("personnel_expenditure_pct").alias("pers_n"),
    )
    return per_year.agg(
        F.max("year").alias("latest_year"),
        _money(F.max_by("rev", "year")).alias("total_revenue"),
        _money(F.max_by("exp", "year")).alias("total_expenditure"),
        _r(C.safe_ratio(F.sum("eff_sum"), F.sum("eff_n")), digits).alias("mean_collection_efficiency"),
        _r(C.safe_ratio(F.sum("pers_sum"), F.sum("pers_n")), digits).alias("mean_personnel_pct"),
    )


# --------------------------------------------------------------------------- A16
def zone_statistics(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """F4 + A16: inclusive date-range filter, then mean / min / max revenue per zone."""
    d = with_date(ledger)
    if start is not None:
        d = d.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        d = d.where(F.col("date") <= F.to_date(F.lit(end)))
    return d.groupBy("zone").agg(
        _money(msum(REV).cast("double") / F.count(REV)).alias("mean_revenue"),
        _money(F.min(F.col(REV).cast(MONEY))).alias("min_revenue"),
        _money(F.max(F.col(REV).cast(MONEY))).alias("max_revenue"),
    )


# --------------------------------------------------------------------------- A17
def efficiency_heatmap(ledger: DataFrame, years: list[int] | None = None, *, digits: int | None = 6) -> DataFrame:
    """Pivot month x year -> mean collection efficiency (columns ``y<year>``).

    Pass ``years`` to skip the extra job Spark runs to discover the pivot values.
    """
    g = ledger.groupBy("month").pivot("year", years).agg(_r(F.avg("collection_efficiency"), digits))
    return g.toDF("month", *[f"y{c}" for c in g.columns[1:]])


# --------------------------------------------------------------------------- A18
def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] with ``bins`` bins (the max falls in the last bin).

    The bounds are ONE scalar subquery (a global partial aggregate returning a struct), bound
    to a column once so every use reads the same result; binning is a narrow projection and
    counting a partial aggregate. Each bin's bounds ride along as ``max`` of a per-group constant.
    """
    d = df.where(F.col(column).isNotNull())
    bounds = d.select(F.struct(F.min(column).alias("lo"),
                               ((F.max(column) - F.min(column)) / F.lit(float(bins))).alias("w")).alias("b")).scalar()
    x = d.select(F.col(column).alias("__x")).withColumn("__b", bounds)
    lo, width = F.col("__b.lo"), F.col("__b.w")
    raw = F.floor(F.try_divide(F.col("__x") - lo, width)).cast("int")
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
    g = x.select(b.alias("bin"), lo.alias("lo"), width.alias("w")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("w").alias("w"))
    return g.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_hi"), "n")


def efficiency_histogram(ledger: DataFrame, bins: int = 30, *, digits: int | None = 6) -> DataFrame:
    h = histogram(ledger, "collection_efficiency", bins)
    return h.select("bin", _r(F.col("bin_lo"), digits).alias("bin_lo"), _r(F.col("bin_hi"), digits).alias("bin_hi"), "n")


# --------------------------------------------------------------------------- A20
def revenue_expenditure_fit(ledger: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """Ordinary least squares of expenditure on revenue (slope, intercept, R^2, n)."""
    y, x = F.col(EXP), F.col(REV)
    return ledger.agg(
        _r(F.regr_slope(y, x), digits).alias("slope"),
        _r(F.regr_intercept(y, x), 2).alias("intercept"),
        _r(F.regr_r2(y, x), digits).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


# --------------------------------------------------------------------------- A21 / W3
def share_of_total(df: DataFrame, by: str, value: str, *, digits: int | None = 6) -> DataFrame:
    """Per-group total and its percentage of the grand total.

    The grand total is a scalar subquery over the grouped rows (a global partial aggregate, whose
    input exchange is reused), not ``sum() OVER ()``, so no step moves all groups into one task
    however many groups there are, and the rows are read once.
    """
    g = df.groupBy(by).agg(msum(value).alias("amount"))
    total = g.select(F.sum("amount")).scalar()
    return g.select(by, _money(F.col("amount")).alias("amount"),
                    _r(C.safe_ratio(F.col("amount"), total, 100.0), digits).alias("share_pct"))


# --------------------------------------------------------------------------- A35
def billing_vs_collection_by_zone(ledger: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """Billing, collection and summed O&M coverage per zone, long form (zone, measure, amount)."""
    g = ledger.groupBy("zone").agg(
        _money(msum("total_billing")).alias("billing"),
        _money(msum("total_collection")).alias("collection"),
        _r(F.sum("om_cost_coverage"), digits).alias("om_cost_coverage"),
    )
    return g.unpivot(["zone"], ["billing", "collection", "om_cost_coverage"], "measure", "amount")


# --------------------------------------------------------------------------- A22
def billing_collection(bills: DataFrame, by: str = "year", *, digits: int | None = 6) -> DataFrame:
    """Billed, collected, outstanding, collection % and uncollected % per period."""
    d = bills.withColumn("year", F.year("date"))
    g = d.groupBy(by).agg(msum("billed").alias("billed"), msum("paid").alias("collected"))
    return g.select(
        by, _money(F.col("billed")).alias("billed"), _money(F.col("collected")).alias("collected"),
        _money(F.col("billed") - F.col("collected")).alias("outstanding"),
        _r(C.safe_ratio(F.col("collected"), F.col("billed"), 100.0), digits).alias("collection_pct"),
        _r(C.safe_ratio(F.col("billed") - F.col("collected"), F.col("billed"), 100.0), digits).alias("uncollected_pct"),
    )


# --------------------------------------------------------------------------- A23
def debt_aging(bills: DataFrame, as_of: str, *, digits: int | None = 6) -> DataFrame:
    """Outstanding (billed - paid, a missing amount counting 0) of bills dated on or before
    ``as_of`` by age bucket, with each bucket's share of all outstanding debt (grand total as a scalar subquery)."""
    d = bills.where(F.col("date") <= F.to_date(F.lit(as_of))).select(
        F.datediff(F.to_date(F.lit(as_of)), F.col("date")).alias("age"),
        (F.coalesce("billed", F.lit(0)) - F.coalesce("paid", F.lit(0))).alias("outstanding"),
    )
    bucket = None
    order = None
    for i, (label, lo, hi) in enumerate(AGING_BUCKETS):
        cond = (F.col("age") >= lo) & (F.col("age") <= hi) if hi is not None else F.col("age") >= lo
        bucket = F.when(cond, F.lit(label)) if bucket is None else bucket.when(cond, F.lit(label))
        order = F.when(cond, F.lit(i + 1)) if order is None else order.when(cond, F.lit(i + 1))
    g = d.groupBy(bucket.alias("bucket"), order.alias("bucket_order")).agg(msum("outstanding").alias("outstanding"))
    total = g.select(F.sum("outstanding")).scalar()
    return g.select("bucket", "bucket_order", _money(F.col("outstanding")).alias("outstanding"),
                    _r(C.safe_ratio(F.col("outstanding"), total, 100.0), digits).alias("share_pct"))


# --------------------------------------------------------------------------- A24
def production_summary(prod: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """Per (year, source): total production, average daily production, mean service hours, days.

    Readings are first summed per (date, source) so the daily average is over days, not readings.
    """
    daily = prod.groupBy("date", "source").agg(F.sum("production_m3").alias("m3"),
                                              F.avg("service_hours").alias("hours"))
    return daily.groupBy(F.year("date").alias("year"), "source").agg(
        _r(F.sum("m3"), digits).alias("total_m3"),
        _r(F.avg("m3"), digits).alias("avg_daily_m3"),
        _r(F.avg("hours"), digits).alias("mean_service_hours"),
        F.count(F.lit(1)).alias("days"),
    )
