"""Period operators: the spine of a series with gaps, growth against the period before, and joins
of tables whose periods differ (months against yearly accounts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washkit.functions import columns as C


def _moved(period: Column, kind: str, steps: int) -> Column:
    """``period`` moved by ``steps``: units of a number, months of a date."""
    return F.add_months(period, steps) if kind == "date" else (period + F.lit(steps)).cast(kind)


def with_gaps(df: DataFrame, keys: Sequence[str], period: str, step: int = 1) -> DataFrame:
    """One row for each key and period from the key's first period to its last, with ``present``.

    ``df`` has one row a key and period (a number, or a date stepped in months). Each row fills the
    gap up to the next one with ``sequence``, other columns NULL, so the spine takes the one shuffle
    by key that the following windows need anyway, and no join. Rows without a period are dropped:
    they have no place in a series.
    """
    kind = df.schema[period].dataType.simpleString()
    following = F.lead(period).over(Window.partitionBy(*keys).orderBy(period))
    last = F.greatest(F.col(period), _moved(F.col("__next"), kind, -step))
    width = F.make_ym_interval(F.lit(0), F.lit(step)) if kind == "date" else F.lit(step).cast(kind)
    d = df.where(F.col(period).isNotNull()).withColumn("__next", following)
    filled = F.when(F.col("__next").isNull(), F.array(period)).otherwise(F.sequence(F.col(period), last, width))
    d = d.select("*", F.posexplode(filled).alias("__i", "__period"))
    own = F.col("__i") == 0
    return d.select(*[F.col("__period").alias(c) if c == period else F.col(c) if c in keys else F.when(own, F.col(c)).alias(c) for c in df.columns], own.alias("present"))


def growth(df: DataFrame, keys: Sequence[str], period: str, measures: Sequence[str], *, step: int = 1, fill: bool = False, digits: int | None = 6) -> DataFrame:
    """Growth % against the period before, per key: ``(x - previous) / previous * 100``.

    Measures are first summed to one row per (key, period) -- partial aggregation, skew-safe -- so
    each window partition holds one key's periods only, never raw rows. The period before is
    ``step`` earlier (a number's units, a date's months): after a gap growth is NULL, not the growth
    of several periods. ``fill`` adds the missing periods as rows, with ``present`` false. Rows
    without a period are left out.
    """
    g = df.where(F.col(period).isNotNull()).groupBy(*keys, period).agg(*[F.sum(m).alias(m) for m in measures])
    if fill:
        g = with_gaps(g, keys, period, step)
    kind = g.schema[period].dataType.simpleString()
    w = Window.partitionBy(*keys).orderBy(period)
    expected = _moved(F.col(period), kind, -step)
    cols = []
    for m in measures:
        before = F.when(F.lag(period).over(w) == expected, F.lag(m).over(w))
        cols += [F.col(m), C.rounded(C.safe_ratio(F.col(m) - before, before, 100.0), digits).alias(f"{m}_growth_pct")]
    return g.select(*keys, period, *cols, *(["present"] if fill else []))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_period: str, right_period: str, columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of the latest ``right`` row of its keys whose period is not later,
    and that row's period as ``as_of``; NULL where there is none.

    One shuffle by key: both sides are united and the last right row is carried forward by a
    window, so no range join compares rows pair by pair. ``right`` has one row a key and period;
    the periods are of one type. NULL values of the taken row stay NULL. NULL keys match NULL keys.
    """
    carried = F.struct(F.col(right_period).alias("as_of"), *columns)
    lefts = left.select(F.struct("*").alias("__left"), *keys, F.col(left_period).alias("__p"), F.lit(1).alias("__side"))
    rights = right.where(F.col(right_period).isNotNull()).select(*keys, F.col(right_period).alias("__p"), F.lit(0).alias("__side"), carried.alias("__right"))
    w = Window.partitionBy(*keys).orderBy("__p", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("__r", F.last("__right", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__left.*", F.when(F.col("__p").isNotNull(), F.col("__r.as_of")).alias("as_of"),
                                           *[F.when(F.col("__p").isNotNull(), F.col(f"__r.{c}")).alias(c) for c in columns])


def month_against_year(months: DataFrame, accounts: DataFrame, keys: Sequence[str], used: str, amounts: Sequence[str], *, digits: int | None = 6) -> DataFrame:
    """J3 across grains: monthly rows (keys, date, ``used``) against yearly accounts (keys, year, ``amounts``).

    Months are summed to one row per (keys, month) and every month from the first to the last gets a
    row (:func:`with_gaps`). Each takes the account of its year, else the latest earlier one
    (``account_year`` says which), and of its amounts a twelfth: twelve months add up to the year, so
    nothing is counted twice however many rows a month has. ``<amount>_per_unit`` is that twelfth by
    what was used in the month; NULL for months without use.
    """
    m = months.where(F.col("date").isNotNull()).groupBy(*keys, "date").agg(F.sum(used).alias(used))
    m = with_gaps(m, keys, "date").withColumn("year", F.year("date"))
    a = accounts.groupBy(*keys, "year").agg(*[F.sum(c).alias(c) for c in amounts])
    both = as_of(m, a, keys, "year", "year", amounts).withColumnRenamed("as_of", "account_year")
    month = {c: F.col(c) / F.lit(12.0) for c in amounts}
    return both.select(*keys, "date", "present", C.rounded(F.col(used), digits).alias(used), "account_year", *[C.rounded(v, digits).alias(f"{c}_month") for c, v in month.items()],
                       *[C.rounded(C.safe_ratio(v, F.col(used)), digits).alias(f"{c}_per_unit") for c, v in month.items()])
