"""Row predicates (F1-F14). ``None`` or an empty list always means "no filter"."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def equals(c: Column | str, value) -> Column:
    """equality (pushed to the parquet scan when ``c`` is a plain column)."""
    return _c(c) == F.lit(value)


def year_between(c: Column | str, start: int | None, end: int | None) -> Column:
    """closed range; an open side is no bound."""
    c = _c(c)
    conds = []
    if start is not None:
        conds.append(c >= F.lit(start))
    if end is not None:
        conds.append(c <= F.lit(end))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def month_range(c: Column | str, start: str | None, end: str | None) -> Column:
    """inclusive month range on a date/timestamp column.

    Bounds are text (``'2001-03'`` or ``'2001-03-15'``). Either side may be ``None``.
    A bound that does not parse matches nothing (same as the reference's empty result).
    """
    c = _c(c).cast("timestamp")
    conds = []
    for bound, op in ((start, "ge"), (end, "le")):
        if bound is None or bound == "":
            continue
        ts = F.coalesce(F.try_to_timestamp(F.lit(bound), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.lit(bound), F.lit("yyyy-MM")))
        cmp = c >= ts if op == "ge" else c <= ts
        conds.append(F.coalesce(cmp, F.lit(False)))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def latest_only(df: DataFrame, col: str = "year") -> DataFrame:
    """keep rows at the global maximum of ``col`` (scalar subquery, one extra aggregate)."""
    return df.where(F.col(col) == df.select(F.max(col)).scalar())


def cascade(df: DataFrame, **levels: str | None) -> DataFrame:
    """chained optional equality filters, e.g. ``cascade(df, country='X', city='All', zone=None)``."""
    for col, value in levels.items():
        if value is not None and value != ALL:
            df = df.where(F.col(col) == F.lit(value))
    return df


def member_of(c: Column | str, values: Sequence | None) -> Column:
    """membership; empty list = no filter."""
    if not values:
        return F.lit(True)
    return _c(c).isin(list(values))


def iequals(c: Column | str, value: str) -> Column:
    """F8: case-insensitive equality."""
    return F.lower(_c(c)) == F.lit(value.lower())


def imatches(c: Column | str, pattern: str) -> Column:
    """case-insensitive regex search; NULL text -> false."""
    return F.coalesce(_c(c).rlike("(?i)" + pattern), F.lit(False))


def any_column_matches(cols: Iterable[str], term: str, literal: bool = False) -> Column:
    """OR over columns of a lower-cased search term, used as a regex (or as plain text)."""
    t = term.lower()
    conds = []
    for c in cols:
        low = F.lower(F.col(c))
        m = low.contains(t) if literal else low.rlike(t)
        conds.append(F.coalesce(m, F.lit(False)))
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def aligned_with(frameworks: Sequence[str] | None, accepted: Sequence[str] = ("Yes", "Somewhat")) -> Column:
    """AND over frameworks of ``column in (Yes, Somewhat)``; NULL counts as not aligned."""
    if not frameworks:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(fw).isin(list(accepted)), F.lit(False)) for fw in frameworks])


def not_null(cols: Iterable[str]) -> Column:
    """every listed column present."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))


def priority_zone(
    countries: Sequence[str] = (),
    zone_patterns: Sequence[str] = (),
    country_zone_pairs: Sequence[tuple[str, str]] = (),
) -> Column:
    """upper(country) in list, OR zone matches a pattern, OR (country AND zone pattern) pair."""
    conds: list[Column] = []
    if countries:
        conds.append(F.coalesce(F.upper(F.col("country")).isin([c.upper() for c in countries]), F.lit(False)))
    for p in zone_patterns:
        conds.append(imatches("zone", re.escape(p)))
    for country, p in country_zone_pairs:
        conds.append(F.coalesce(F.upper(F.col("country")) == F.lit(country.upper()), F.lit(False)) & imatches("zone", re.escape(p)))
    return reduce(lambda a, b: a | b, conds, F.lit(False))
