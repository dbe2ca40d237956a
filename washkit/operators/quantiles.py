"""Exact percentiles without gathering a group into one task.

``F.percentile``/``F.median`` are exact but keep, per group, a map of every distinct value and
merge it in one task per group -- fine for zone-year tables, not for a group holding a third of
100 TB. :func:`exact_percentiles` returns the same numbers (linear interpolation between the
ranks ``floor`` and ``ceil`` of ``p * (n - 1)``, with Spark's own interpolation arithmetic) by
selection on an order-preserving integer of the value:

1. one partial aggregate to (group, integer, count): repeated values collapse map-side;
2. four levels of 16 bits each: the counts of a prefix's at most 65,536 next digits are summed, a
   running sum over those rows tells in which digit each wanted rank lies, and only that prefix goes
   to the next level. After the fourth the integer, so the value, is known.

The number of levels is fixed, whatever the values are. Nothing runs while the query is defined, and
no row count, sample or checkpoint decides anything; every level reads the one exchange of step 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of an integer that are still open after each level.
LEVELS = (48, 32, 16, 0)

_TINY, _NORMAL, _ONE = 2.0**-1074, 2.0**-1022, 2**52


def ordered_long(x: Column) -> Column:
    """An integer that orders doubles as their values do (equal for 0.0 and -0.0); NaN is not allowed.

    It is ``sign * (exponent field * 2**52 + mantissa)``. The exponent guessed from a logarithm is
    put right by comparison, and scaling by a power of two is exact.
    """
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    low = F.pow(F.lit(2.0), guess)
    e = F.greatest(F.least(F.when(a < low, guess - 1).when(a / 2 >= low, guess + 1).otherwise(guess), F.lit(1023)), F.lit(-1022))
    normal = (e + 1023) * F.lit(_ONE) + ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(_ONE))).cast("long")
    size = F.when(a == float("inf"), F.lit(2047 * _ONE)).when(a >= _NORMAL, normal).otherwise((a / F.lit(_TINY)).cast("long"))
    return F.when(x < 0, -size).otherwise(size)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *,
                      groups: int | None = None) -> DataFrame:
    """Exact percentiles per group: ``keys`` + ``n`` + one column ``p<i>`` per probability.

    Null and NaN values are missing; a group without values gives no row. A null key is a group.
    ``groups`` is the caller's proof that there are at most so many groups: each level then has at most
    ``2 * len(probs)`` prefixes a group, which are sent to every task where that is under 10,000 rows.
    Otherwise the planner chooses by size.
    """
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    counts = v.groupBy(*keys, ordered_long(F.col("__v")).alias("__k")).agg(F.count("*").alias("__c"), F.min("__v").alias("__v"))

    def narrowed(hist: DataFrame, group: list[str], targets: Column) -> DataFrame:
        """Digits that hold a target, with the ranks counted from the digit's first row."""
        w = Window.partitionBy(*group).orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
        before = F.col("__cum") - F.col("__c")
        kept = F.transform(F.filter("__t", lambda t: (t["rank"] >= before) & (t["rank"] < F.col("__cum"))),
                           lambda t: F.struct(t["q"].alias("q"), t["high"].alias("high"), (t["rank"] - before).alias("rank")))
        return hist.withColumn("__cum", F.sum("__c").over(w)).withColumn("__t", targets).withColumn("__t", kept) \
            .where(F.size("__t") > 0).select(*keys, "__n", F.col("__d").alias("__p"), "__t", "__v")

    def rank(p: float, high: bool) -> Column:
        at = F.lit(float(p)) * (F.col("__n") - 1).cast("double")
        return (F.ceil(at) if high else F.floor(at)).cast("long")

    wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(high).alias("high"), rank(p, high).alias("rank"))
                       for i, p in enumerate(probs) for high in (False, True)])
    first = counts.groupBy(*keys, F.shiftright("__k", LEVELS[0]).alias("__d")).agg(F.sum("__c").alias("__c"), F.min("__v").alias("__v"))
    found = narrowed(first.withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys))), keys, wanted)
    sent = groups is not None and groups * 2 * len(probs) < 10_000
    for above, below in zip(LEVELS, LEVELS[1:]):
        found = F.broadcast(found) if sent else found
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys] + [F.shiftright("c.__k", above) == F.col("f.__p")]
        inside = counts.alias("c").join(found.alias("f"), same).select(
            *[F.col(f"c.{k}").alias(k) for k in keys], "c.__k", "c.__c", "c.__v", "f.__n", "f.__p", "f.__t")
        hist = inside.groupBy(*keys, "__p", F.shiftright("__k", below).alias("__d")).agg(
            F.sum("__c").alias("__c"), F.min("__v").alias("__v"), F.first("__n").alias("__n"), F.first("__t").alias("__t"))
        found = narrowed(hist, [*keys, "__p"], F.col("__t"))
    ends = found.select(*keys, "__n", "__v", F.inline("__t"))
    sides = [F.max(F.when((F.col("q") == i) & (F.col("high") == F.lit(high)), F.col("__v"))).alias(f"__{i}{high}")
             for i in range(len(probs)) for high in (False, True)]
    wide = ends.groupBy(*keys, F.col("__n").alias("n")).agg(*sides)

    def interpolated(i: int, p: float) -> Column:
        """Spark's percentile arithmetic: (higher - at) * low value + (at - lower) * high value."""
        at = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        lower, higher = F.floor(at), F.ceil(at)
        return F.when(lower == higher, F.col(f"__{i}False")).otherwise(
            (higher - at) * F.col(f"__{i}False") + (at - lower) * F.col(f"__{i}True"))

    return wide.select(*keys, "n", *[interpolated(i, p).alias(f"p{i}") for i, p in enumerate(probs)])


#: Size of the sketches that bracket a percentile, and how far from it the bracket's ends are, in
#: shares of a group. A sketch's ranks are off by more than 0.13 % once in a hundred times; the
#: bracket is five times as wide to each side, so a rank outside of it is not to be expected.
SKETCH, SLACK = 4096, 0.0065


def bracketed_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *, groups: int | None = None) -> DataFrame:
    """The result of :func:`exact_percentiles` from two reads of ``df`` and no running sum over a whole group.

    The first read merges a sketch a group (bounded, reduced map-side), which gives each
    percentile's bracket: all values of a group of up to ``SKETCH``, else those up to ``SLACK`` of the
    group's ranks to both sides. The second counts what lies below each bracket and each value inside
    it; a running sum over a bracket's values (about a hundredth of a group at most, repeated values
    being one) finds the two ranks. Should a rank lie outside its bracket after all, the percentile is
    NULL, never a wrong number.
    """
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    at = [(max(p - SLACK, 0.0), min(p + SLACK, 1.0)) for p in probs]
    sketch = F.kll_sketch_agg_double("__v", F.lit(SKETCH))
    ends = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), sketch.alias("__s"))
    small = F.col("__n") <= SKETCH
    brackets = F.array(*[F.struct(F.lit(i).alias("q"), F.when(small, F.col("__min")).otherwise(F.kll_sketch_get_quantile_double("__s", F.lit(lo))).alias("lo"),
                                  F.when(small, F.col("__max")).otherwise(F.kll_sketch_get_quantile_double("__s", F.lit(hi))).alias("hi")) for i, (lo, hi) in enumerate(at)])
    ends = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", brackets.alias("__b"))
    ends = F.broadcast(ends) if groups is not None and groups < 10_000 else ends
    j = v.join(ends, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    met = F.transform(F.filter("__b", lambda b: F.col("__v") <= b["hi"]), lambda b: F.struct(b["q"].alias("q"), F.when(F.col("__v") >= b["lo"], F.col("__v")).alias("x")))
    counts = j.select(*keys, "__n", F.inline(met)).groupBy(*keys, "__n", "q", "x").agg(F.count(F.lit(1)).alias("__c"))
    cum = F.sum("__c").over(Window.partitionBy(*keys, "q").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("__cum", cum)

    def place(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__n") - 1).cast("double")

    def found(i: int, rank: Column) -> Column:
        rank = rank.cast("long")
        return F.max(F.when((F.col("q") == i) & (rank >= F.col("__cum") - F.col("__c")) & (rank < F.col("__cum")), F.col("x")))

    wide = ranked.groupBy(*keys, "__n").agg(*[found(i, F.floor(place(p))).alias(f"__l{i}") for i, p in enumerate(probs)], *[found(i, F.ceil(place(p))).alias(f"__h{i}") for i, p in enumerate(probs)])

    def interpolated(i: int, p: float) -> Column:
        lower, higher = F.floor(place(p)), F.ceil(place(p))
        return F.when(lower == higher, F.col(f"__l{i}")).otherwise((higher - place(p)) * F.col(f"__l{i}") + (place(p) - lower) * F.col(f"__h{i}"))

    return wide.select(*keys, F.col("__n").alias("n"), *[interpolated(i, p).alias(f"p{i}") for i, p in enumerate(probs)])
