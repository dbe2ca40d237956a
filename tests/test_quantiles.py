"""Distributed exact percentiles equal Spark's in-memory exact percentile."""

from pyspark.sql import functions as F

from washkit.operators.quantiles import exact_percentiles

PROBS = [0.25, 0.5, 0.75, 0.9]


def _reference(df, keys, value):
    q = F.percentile(F.col(value), F.array(*[F.lit(p) for p in PROBS]))
    r = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    return {tuple(x[k] for k in keys): (x["n"], list(x["q"])) for x in r.collect()}


def _check(df, keys, value, **kw):
    got = {tuple(x[k] for k in keys): (x["n"], [x[f"p{i}"] for i in range(len(PROBS))])
           for x in exact_percentiles(df, keys, value, PROBS, **kw).collect()}
    exp = _reference(df, keys, value)
    assert set(got) == set(exp)
    for k in exp:
        assert got[k][0] == exp[k][0]
        for a, b in zip(got[k][1], exp[k][1]):
            assert abs(a - b) <= 1e-9 * max(1.0, abs(b)), (k, got[k], exp[k])


def test_skewed_groups_with_duplicates(spark):
    # group 'hot' holds a third of the rows; heavy duplicates and a long tail
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string")))
        .alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(None))
        .when(F.col("id") % 4 == 0, F.lit(42.0))
        .otherwise(F.pow(F.col("id") % 1000, 1.7) / F.lit(3.0)).alias("x"))
    _check(df, ["g"], "x")


def test_single_value_and_tiny_groups(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 5.0), ("b", 1.0), ("c", 2.0), ("c", 8.0), ("d", None)],
                               "g string, x double")
    _check(df, ["g"], "x")


def test_default_settings_match(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.sin(F.col("id").cast("double")).alias("x"))
    _check(df, ["g"], "x")


def test_box_statistics_distributed_equals_in_memory(spark):
    from washkit.operators import access as A
    from washkit.plans.queries import access_table
    acc = access_table(spark, "/root/testdata/sf0.001")
    a = sorted(tuple(r) for r in A.box_statistics(acc).collect())
    b = sorted(tuple(r) for r in A.box_statistics(acc, distributed=True).collect())
    assert a == b


def test_summaries_distributed_equal_in_memory(spark):
    from washkit.operators import access as A
    from washkit.plans.queries import access_table
    acc = access_table(spark, "/root/testdata/sf0.001")
    for fn in (A.country_summary, A.surface_water_exposure):
        a = sorted((sorted(r.asDict().items()) for r in fn(acc, 2001).collect()), key=repr)
        b = sorted((sorted(r.asDict().items()) for r in fn(acc, 2001, distributed=True).collect()), key=repr)
        assert a == b


def test_extreme_value_range(spark):
    # values 2^0 .. 2^59 (and negatives), duplicated: every exponent is its own prefix
    df = spark.range(6000).select(F.lit("g").alias("g"),
                                  (F.pow(F.lit(2.0), F.col("id") % 60) * F.when(F.col("id") % 7 == 0, -1).otherwise(1))
                                  .alias("x"))
    _check(df, ["g"], "x")


def test_nan_is_missing_and_null_keys_are_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 4.0), (None, 7.0), (None, 9.0), ("b", float("nan"))], "g string, x double")
    got = {r["g"]: (r["n"], r["p0"]) for r in exact_percentiles(df, ["g"], "x", [0.5]).collect()}
    assert got == {"a": (2, 2.5), None: (2, 8.0)}


def test_ordered_long_orders_every_kind_of_double(spark):
    import sys

    import numpy as np

    from washkit.operators.quantiles import ordered_long

    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2**63 - 1, 4000, dtype=np.int64).view(np.float64)
    bits = bits[np.isfinite(bits)]
    edges = [0.0, 5e-324, 1e-310, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2), sys.float_info.max, float("inf")]
    edges += [2.0**i for i in range(-1074, 1024)] + [float(np.nextafter(2.0**i, 0)) for i in range(-1000, 1024, 7)]
    xs = sorted({float(x) for x in [*bits, *edges]} | {-float(x) for x in [*bits, *edges] if x})
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r[0]: r[1] for r in df.select("x", ordered_long(F.col("x"))).collect()}
    keys = [got[x] for x in xs]
    assert all(a < b for a, b in zip(keys, keys[1:]))
    want = np.array([abs(x) for x in xs]).view(np.int64)
    assert [abs(k) for k in keys] == want.tolist()


def test_bracketed_percentiles_equal_selection(spark):
    from washkit.operators.quantiles import bracketed_percentiles
    big = spark.range(200000, numPartitions=5).select((F.col("id") % 2).cast("string").alias("g"), F.pow((F.col("id") * 7919 % 100003).cast("double"), F.lit(1.5)).alias("x"))
    odd = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -0.0), ("b", 0.0), ("b", float("inf")), ("b", float("-inf")), ("c", None), ("d", float("nan")), (None, 5.0), (None, 6.0), (None, 6.0), ("e", 3.0)], "g string, x double")
    few = spark.range(30000, numPartitions=3).select(F.lit("f").alias("g"), (F.col("id") % 3).cast("double").alias("x"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for df in (big, odd, few):
        a = sorted((tuple(r) for r in exact_percentiles(df, ["g"], "x", probs).collect()), key=repr)
        for groups in (None, 10):
            assert sorted((tuple(r) for r in bracketed_percentiles(df, ["g"], "x", probs, groups=groups).collect()), key=repr) == a


def test_box_statistics_reads_its_input_three_times(spark):
    from washkit.operators import access as A
    from washkit.plans.queries import access_table
    plan = A.box_statistics(access_table(spark, "/root/testdata/sf0.001"), types=("water", "sewer"), distributed=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("o_orderpriority") and plan.count("FileScan parquet [o_custkey") <= 3


def test_one_projection_gives_the_union(spark):
    from washkit.plans.queries import REGISTRY, access_table
    small = "/root/testdata/sf0.001"
    one, union = access_table(spark, small), REGISTRY["access_union"](spark, small)
    assert one.dtypes == union.dtypes
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, union.collect()), key=repr)
