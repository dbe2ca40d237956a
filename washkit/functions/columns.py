"""Derived-column expressions (all JVM-side built-ins, no Python UDF).

Each function returns a ``Column`` or a renamed/projected ``DataFrame`` and is
safe to use inside whole-stage codegen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values taken from the reference's semantics -------------------------
# Prefixes carried by the water and sewer access sources.
ACCESS_PREFIX_PATTERN = r"^(w_|s_)"
# Source type codes and the service names they map to.
TYPE_RECODE = {"w_access": "water", "s_access": "sewer"}
# Zone names that count as urban when neither "rural" nor "urban" appears.
URBAN_CENTRES = ["yaounde", "douala", "kawempe", "kampala", "maseru", "lilongwe", "blantyre"]
# ---------------------------------------------------------------------------


def rounded(c: Column, digits: int | None) -> Column:
    """Round to ``digits`` places; ``None`` keeps the raw double."""
    return F.round(c, digits) if digits is not None else c


def col_or_null(df: DataFrame, name: str, dtype: T.DataType = T.DoubleType()) -> Column:
    """The column if it exists, else a typed NULL under that name."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None).cast(dtype).alias(name)


def strip_prefix(df: DataFrame, pattern: str = ACCESS_PREFIX_PATTERN) -> DataFrame:
    """Drop a leading prefix from column names (metadata only, no data pass)."""
    return df.toDF(*[re.sub(pattern, "", c) for c in df.columns])


def clean_text(c: Column | str, lower: bool = False) -> Column:
    """Trim (and optionally lower-case) a text key."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.trim(c)
    return F.lower(c) if lower else c


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Map listed values; anything not listed passes through unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v)))
    return c if expr is None else expr.otherwise(c)


def lenient_number(c: Column | str, dtype: str = "double") -> Column:
    """Text that does not parse becomes NULL (``try_cast``; plain cast raises under ANSI)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast(dtype)


def coerce_columns(df: DataFrame, cols: Iterable[str], dtype: str = "double") -> DataFrame:
    """Apply P4 to the listed columns that exist and are not already of ``dtype``."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    changes = {c: lenient_number(c, dtype) for c in cols if c in fields and fields[c] != dtype}
    return df.withColumns(changes) if changes else df


def safe_ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """Ratio with x/0, 0/0 and NULL inputs all giving NULL."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r * F.lit(float(scale)) if scale != 1.0 else r


def guarded_ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """Denominator floored at 1 (NULL denominator stays NULL)."""
    d = F.when(den.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(1.0), den.cast("double")))
    return num.cast("double") / d * F.lit(float(scale))


def sewer_gap(df: DataFrame) -> Column:
    """Unimproved % + open defecation %; NULL when either is NULL."""
    return col_or_null(df, "unimproved_pct") + col_or_null(df, "open_def_pct")


def surface_users(df: DataFrame) -> Column:
    """Estimated surface-water users."""
    return col_or_null(df, "surface_water_pct") / F.lit(100.0) * col_or_null(df, "popn_total")


def mean_ignoring_null(a: Column, b: Column) -> Column:
    """Mean of two values, skipping a missing one; NULL only when both are missing."""
    return (F.coalesce(a, b) + F.coalesce(b, a)) / F.lit(2.0)


def zone_slug(country: Column, zone: Column) -> Column:
    """P10: lower(country-zone), runs of non-alphanumerics to '-', trimmed; 'zone' if empty."""
    base = F.lower(F.concat(F.coalesce(country, F.lit("na")), F.lit("-"), F.coalesce(zone, F.lit("zone"))))
    slug = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("zone")).otherwise(slug)


def urban_rural_tag(zone: Column, centres: Iterable[str] = URBAN_CENTRES) -> Column:
    """Unknown / rural / urban / other. Checks run in this order, so 'X Rural Council' is rural."""
    z = F.lower(zone)
    centre_pattern = "|".join(re.escape(c) for c in centres)
    return (
        F.when(zone.isNull(), "unknown")
        .when(z.contains("rural"), "rural")
        .when(z.contains("urban"), "urban")
        .when(z.rlike(centre_pattern), "urban")
        .otherwise("other")
    )


def month_date(year: Column, month: Column) -> Column:
    """First day of the month (NULL for impossible months)."""
    ok = month.between(1, 12) & year.between(1, 9999)
    return F.when(ok, F.make_date(year, month, F.lit(1)))


def level_label(c: Column) -> Column:
    """P14: 'safely_managed_pct' -> 'Safely Managed'."""
    return F.initcap(F.replace(F.regexp_replace(c, "_pct", ""), F.lit("_"), F.lit(" ")))


def service_rates(df: DataFrame) -> DataFrame:
    """The four per-row service rates (percent); division by zero gives NULL."""
    return df.withColumns(
        {
            "water_quality_rate": (
                safe_ratio(F.col("test_passed_chlorine"), F.col("tests_conducted_chlorine"), 100.0)
                + safe_ratio(F.col("tests_passed_ecoli"), F.col("test_conducted_ecoli"), 100.0)
            )
            / F.lit(2.0),
            "complaint_resolution_rate": safe_ratio(F.col("resolved"), F.col("complaints"), 100.0),
            "nrw_rate": safe_ratio(F.col("w_supplied") - F.col("total_consumption"), F.col("w_supplied"), 100.0),
            "sewer_coverage_rate": safe_ratio(F.col("sewer_connections"), F.col("households"), 100.0),
        }
    )


def band(value: Column, good: float, warn: float | None = None, higher_is_better: bool = True) -> Column:
    """P19: 'good' / 'warn' / 'bad' by threshold and direction; NULL value -> 'none'."""
    if higher_is_better:
        g = value >= F.lit(good)
        w = value >= F.lit(warn) if warn is not None else F.lit(False)
    else:
        g = value <= F.lit(good)
        w = value <= F.lit(warn) if warn is not None else F.lit(False)
    return F.when(value.isNull(), "none").when(g, "good").when(w, "warn").otherwise("bad")


def reuse_estimate(households: Column, reuse_pct: Column) -> Column:
    """Households reached by faecal-sludge reuse, rounded to whole households."""
    return F.round(households * reuse_pct / F.lit(100.0), 0).try_cast("bigint")
