"""Service-quality operators over monthly (country, city, zone) service rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washkit.functions import columns as C
from washkit.functions import predicates as P

RATE_COLS = ["water_quality_rate", "complaint_resolution_rate", "nrw_rate", "sewer_coverage_rate"]
ZONE_KEYS = ["country", "city", "zone"]

# Fixed KPI targets of the service page: (kpi, target, higher_is_better, status when missed).
# A missed NRW target is flagged red ('bad'); the other three amber ('warn').
SERVICE_TARGETS = [
    ("nrw_rate", 25.0, False, "bad"),
    ("water_quality_rate", 95.0, True, "warn"),
    ("sewer_coverage_rate", 80.0, True, "warn"),
    ("complaint_resolution_rate", 90.0, True, "warn"),
]


_r = C.rounded


def prepare_service(df: DataFrame) -> DataFrame:
    """P12 + P17: month date from (year, month) and the four per-row rates."""
    return C.service_rates(df.withColumn("date", C.month_date(F.col("year"), F.col("month"))))


def service_time_series(svc: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """Per month, sums of volumes and toilets, and the MEAN OF ROW RATES (not ratio of sums).

    Sums of all-NULL volumes are 0 (pandas semantics); means skip NULL rates.
    """
    return svc.groupBy("date").agg(
        _r(F.coalesce(F.sum("w_supplied"), F.lit(0.0)), digits).alias("w_supplied"),
        _r(F.coalesce(F.sum("total_consumption"), F.lit(0.0)), digits).alias("total_consumption"),
        _r(F.coalesce(F.sum("metered"), F.lit(0.0)), digits).alias("metered"),
        *[_r(F.avg(c), digits).alias(c) for c in RATE_COLS],
        F.coalesce(F.sum("public_toilets"), F.lit(0)).cast("bigint").alias("public_toilets"),
    )


def last_non_null(df: DataFrame, keys: Sequence[str], order_col: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per key, for EACH column the value at the latest ``order_col`` among rows where that
    column is not NULL (pandas ``groupby().last()``), plus the latest ``order_col`` itself.

    ``max_by(c, CASE WHEN c IS NOT NULL THEN order END)``: rows with a NULL ordering are skipped,
    and the whole thing is one partial aggregate (skew-safe, no sort of the group).
    """
    cols = [c for c in (columns if columns is not None else df.columns) if c not in keys and c != order_col]
    aggs = [F.max(order_col).alias(order_col)]
    for c in cols:
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def service_latest_by_zone(svc: DataFrame, *, digits: int | None = 6) -> DataFrame:
    """A7 on prepared service rows, rates rounded."""
    out = last_non_null(svc, ZONE_KEYS, "date")
    if digits is None:
        return out
    dbl = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: _r(F.col(c), digits) for c in dbl})


def service_kpis(svc: DataFrame, targets=SERVICE_TARGETS, *, digits: int | None = 6) -> DataFrame:
    """A8 + P19: mean over zones of the latest rates, each against its target and direction.

    One partial aggregate for the latest rows, one global aggregate (a single row), then a
    one-row explode into (kpi, value, target, higher_is_better, status).
    """
    latest = last_non_null(svc, ZONE_KEYS, "date", RATE_COLS)
    g = latest.agg(*[F.avg(k).alias(k) for k, *_ in targets])
    items = [
        F.struct(
            F.lit(k).alias("kpi"),
            _r(F.col(k), digits).alias("value"),
            F.lit(t).alias("target"),
            F.lit(up).alias("higher_is_better"),
            F.when(C.band(F.col(k), t, None, up) == "bad", F.lit(miss))
            .otherwise(C.band(F.col(k), t, None, up)).alias("status"),
        )
        for k, t, up, miss in targets
    ]
    return g.select(F.inline(F.array(*items)))


def service_filtered(svc: DataFrame, country: str | None = None, city: str | None = None, zone: str | None = None,
                     *, digits: int | None = 6) -> DataFrame:
    """F6 + A6: cascading country -> city -> zone filter ('All' or None = no filter), then the series again."""
    return service_time_series(P.cascade(svc, country=country, city=city, zone=zone), digits=digits)
