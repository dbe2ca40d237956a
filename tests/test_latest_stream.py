"""A7 over a stream: last values per zone equal the batch operator's after late rows, expiry and repeats."""

import datetime as dt

from pyspark.sql import functions as F

from washkit.operators import service as S
from washkit.sources import standins as V
from washkit.streaming import latest_stream as LS

SMALL = "/root/testdata/sf0.001"


def _ddl(df):
    return df.schema.simpleString()[len("struct<"):-1].replace(":", " ")


def _key(r):
    return tuple(r[k] for k in S.ZONE_KEYS)


def _by_zone(df):
    return {_key(r): r.asDict() for r in df.select(sorted(df.columns)).collect()}


def _service(spark):
    """Stand-in months with holes: a column's last value is often older than its zone's last row."""
    svc = V.service_month(V.Tables(spark, SMALL))
    hole = F.pmod(F.xxhash64("country", "city", "zone", "year", "month"), F.lit(3))
    return svc.withColumns({"metered": F.when(hole != 0, F.col("metered")), "households": F.when(hole != 1, F.col("households")),
                            "blocks": F.lit(None).cast("bigint"), "big": F.col("households") + F.lit(2**60 + 1)})


def _run(spark, src, svc, out, **limits):
    q = LS.start_latest_by_zone(spark, str(src / "*"), _ddl(svc), str(out), **limits)
    q.awaitTermination(240)
    assert q.exception() is None


def test_streamed_latest_rows_equal_batch_after_late_rows(spark, tmp_path):
    svc = _service(spark).cache()
    early, late = F.col("year") < 1996, (F.col("year") < 1996) & (F.col("month") == 5)
    src, out = tmp_path / "src", tmp_path / "out"
    svc.where(early & ~late).coalesce(1).write.parquet(str(src / "a"))
    _run(spark, src, svc, out, allowed_lateness="4000 days")
    first = LS.latest_rows(spark.read.parquet(str(out)), S.ZONE_KEYS, "date")
    assert _by_zone(first) == _by_zone(S.last_non_null(S.prepare_service(svc.where(early & ~late)), S.ZONE_KEYS, "date"))
    # the second run starts from the checkpoint; months of May come years late
    svc.where(~early).coalesce(1).write.parquet(str(src / "b"))
    svc.where(late).coalesce(1).write.parquet(str(src / "c"))
    _run(spark, src, svc, out, allowed_lateness="4000 days")
    results = spark.read.parquet(str(out))
    want = _by_zone(S.last_non_null(S.prepare_service(svc), S.ZONE_KEYS, "date"))
    assert _by_zone(LS.latest_rows(results, S.ZONE_KEYS, "date")) == want
    assert any(r["big"] is not None and r["big"] > 2**60 for r in want.values())
    assert _by_zone(LS.latest_rows(LS.compact(results, S.ZONE_KEYS, "date"), S.ZONE_KEYS, "date")) == want


def _rows(spark, rows):
    return spark.createDataFrame([(z, d, a, b) for z, d, a, b in rows], "zone string, date date, a double, b bigint")


def test_expired_state_and_dropped_rows(spark, tmp_path):
    d = dt.date
    waves = [
        [("x", d(2020, 1, 1), 1.5, None), ("x", d(2020, 2, 1), None, 7), ("y", d(2020, 1, 1), float("nan"), 1), (None, d(2020, 1, 1), 2.0, 2), ("z", None, 9.0, 9)],
        [("y", d(2021, 6, 1), None, 3)],  # the watermark moves on ...
        [("y", d(2021, 7, 1), None, None)],  # ... and x is long silent
        [("x", d(2021, 8, 1), None, 8), ("x", d(2019, 1, 1), 99.0, 99)],  # x anew; a row too late to be accepted
    ]
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"

    def keep(changes, number):
        changes.withColumn("batch", F.lit(number)).write.mode("append").parquet(str(out))

    for n, wave in enumerate(waves):
        _rows(spark, wave).coalesce(1).write.parquet(str(src / f"w{n}"))
        stream = spark.readStream.schema("zone string, date date, a double, b bigint").parquet(str(src / "*"))
        q = LS.latest_changes(stream, ["zone"], "date", allowed_lateness="30 days", expire_after_days=60, salts=1) \
            .writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(ckpt)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        if n == 2:
            assert sum(s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"]) < 3  # x and the null zone are gone
    table = spark.read.parquet(str(out))
    assert table.where("zone = 'x'").orderBy(F.desc("batch")).first()["a"] is None  # the new state has no older value
    got = {r["zone"]: (r["date"], repr(r["a"]), r["b"]) for r in LS.latest_rows(table, ["zone"], "date").collect()}
    assert got == {"x": (d(2021, 8, 1), "1.5", 8), "y": (d(2021, 7, 1), "nan", 3), None: (d(2020, 1, 1), "2.0", 2)}
