"""A6 over Structured Streaming: monthly service series from a stream of service rows.

The batch operator :func:`washkit.operators.service.service_time_series` and this
streaming form share the same aggregate expressions. Event time is the month
date; the watermark lets Spark finalise a month once rows more than
``allowed_lateness`` behind the newest month stop being accepted, so state stays
bounded (one row of partial sums per open month).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from washkit.operators import service as S
from washkit.sources import sinks


def monthly_series(stream: DataFrame, allowed_lateness: str = "62 days", *, digits: int | None = 6) -> DataFrame:
    """Watermarked streaming aggregate of prepared service rows by month.

    Sums and the row-rate means are the same as the batch series; in append mode a month
    is emitted once, after the watermark passes it.
    """
    prepared = S.prepare_service(stream).withColumn("event_time", F.col("date").cast("timestamp"))
    return S.service_time_series(prepared.withWatermark("event_time", allowed_lateness)
                                 .withColumn("date", F.col("event_time")), digits=digits) \
        .withColumn("date", F.col("date").cast("date"))


def start_monthly_series(spark: SparkSession, source_dir: str, schema: str, sink_dir: str,
                         checkpoint_dir: str | None = None, *, available_now: bool = True,
                         allowed_lateness: str = "62 days") -> StreamingQuery:
    """Run :func:`monthly_series` from parquet files arriving in ``source_dir`` into parquet
    files in ``sink_dir`` (append mode, exactly-once via the checkpoint).

    The checkpoint defaults to ``_checkpoint`` in ``sink_dir``, so each stream has its own and a
    restarted driver resumes where it stopped.
    """
    ckpt = checkpoint_dir or sink_dir.rstrip("/") + "/_checkpoint"
    src = spark.readStream.schema(schema).parquet(source_dir)
    w = (monthly_series(src, allowed_lateness).writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_incremental_results(spark: SparkSession, source_dir: str, schema: str, result_dir: str, *, checkpoint_dir: str | None = None,
                              available_now: bool = True) -> StreamingQuery:
    """S8 kept up to date from arriving files: the monthly series as a table partitioned by year and month.

    A batch says which months its rows touch; the series of exactly those months is computed anew
    from all rows in ``source_dir`` (whose months are read by a pushed-down filter) and replaces their
    partitions, so late rows correct a month, untouched months keep their files, and a batch that is
    run again after a failure writes the same rows. Files are taken to stay in ``source_dir``.
    """
    def refresh(batch: DataFrame, _: int) -> None:
        months = batch.select("year", "month").where("year IS NOT NULL AND month IS NOT NULL").distinct()
        rows = spark.read.schema(schema).parquet(source_dir).join(months, ["year", "month"], "left_semi")
        series = S.service_time_series(S.prepare_service(rows))
        sinks.replace_partitions(series.withColumns({"year": F.year("date"), "month": F.month("date")}), result_dir, ["year", "month"])

    ckpt = checkpoint_dir or result_dir.rstrip("/") + "_checkpoint"
    w = spark.readStream.schema(schema).parquet(source_dir).writeStream.foreachBatch(refresh).option("checkpointLocation", ckpt)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
