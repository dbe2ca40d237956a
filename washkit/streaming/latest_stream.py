"""A7 / W2 over Structured Streaming: the last value of every column per key, from keyed state.

The batch operator is :func:`washkit.operators.service.last_non_null`. Here a key's state holds, for
each column, the last value that is not NULL and its place in the order. A micro-batch gives a row for
every key it touched, appended to a result table under the batch's number; :func:`latest_rows` reads
that table as the batch operator's rows. Each column carries its own place, so the reader's merge is
right whatever order the rows came in, and also after a key's state has expired and begun anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from washkit.operators import service as S
from washkit.sources import sinks

_LAST = "newest bigint, at array<bigint>, values array<string>"
_NEVER = -(1 << 63)


def _keep_last(expire_after_ms: int, width: int):
    """State function: chunks of (at, values) of one key -> its last value and place of every column."""

    def run(key: tuple, chunks: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        newest, at, values = state.get if state.exists else (_NEVER, [None] * width, [None] * width)
        at, values = list(at), list(values)
        for chunk in chunks:
            place = chunk["at"].to_numpy(np.int64)
            cells = np.array([list(v) for v in chunk["values"]], object).reshape(len(chunk), width)
            order = np.where(pd.notna(cells), place[:, None], _NEVER)
            best = order.argmax(axis=0) if len(chunk) else []
            for j, i in enumerate(best):
                if order[i, j] != _NEVER and (at[j] is None or order[i, j] > at[j]):
                    at[j], values[j] = int(order[i, j]), cells[i, j]
            newest = max(newest, int(place.max(initial=_NEVER)))
        state.update((newest, at, values))
        state.setTimeoutTimestamp(max(newest // 1000 + expire_after_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{f"k{i}": [v] for i, v in enumerate(key)}, "newest": [newest], "at": [at], "values": [values]})

    return run


def latest_changes(rows: DataFrame, keys: Sequence[str], order_col: str, *, allowed_lateness: str = "62 days", expire_after_days: int = 400,
                   salts: int = 8) -> DataFrame:
    """Streaming rows ``(keys..., order_col, columns..., at)``: for every key that a micro-batch touched, the last
    value that is not NULL of each column, ``at`` being a struct of their places (microseconds).

    Rows more than ``allowed_lateness`` behind the newest are not accepted, nor are rows without an order.
    A key without rows for ``expire_after_days`` behind the watermark loses its state. A key's rows are dealt
    over ``salts`` states, so a key that holds a third of a stream is no single task's work; each gives its own row.
    Values travel as text, which keeps NULL apart from NaN and 64-bit integers whole. Keys are text.
    """
    columns = [f for f in rows.schema.fields if f.name not in keys and f.name != order_col]
    when = F.col(order_col).cast("timestamp")
    shaped = rows.where(F.col(order_col).isNotNull()).select(
        *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)],
        F.pmod(F.xxhash64(*[c.name for c in columns], order_col), F.lit(salts)).cast("string").alias(f"k{len(keys)}"),
        when.alias("event_time"), F.unix_micros(when).alias("at"), F.array(*[F.col(c.name).cast("string") for c in columns]).alias("values"))
    names = [f"k{i}" for i in range(len(keys) + 1)]
    last = shaped.withWatermark("event_time", allowed_lateness).groupBy(*names).applyInPandasWithState(
        _keep_last(expire_after_days * 86_400_000, len(columns)), ", ".join(f"{n} string" for n in names) + ", " + _LAST, _LAST,
        "update", GroupStateTimeout.EventTimeTimeout)
    return last.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        F.timestamp_micros("newest").cast(rows.schema[order_col].dataType).alias(order_col),
        *[F.get("values", F.lit(j)).cast(c.dataType).alias(c.name) for j, c in enumerate(columns)],
        F.struct(*[F.get("at", F.lit(j)).alias(c.name) for j, c in enumerate(columns)]).alias("at"))


def start_latest_by_zone(spark: SparkSession, source_dir: str, schema: str, result_dir: str, *, checkpoint_dir: str | None = None, available_now: bool = True,
                         max_files: int | None = None, **limits) -> StreamingQuery:
    """Keep the result table of :func:`latest_changes` for service rows arriving as parquet files in ``source_dir``.

    A micro-batch owns the partition ``batch=<its number>``, so one that is run again after a failure
    replaces what it wrote. ``limits`` go to :func:`latest_changes`.
    """
    reader = spark.readStream.schema(schema)
    rows = S.prepare_service((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source_dir))
    ckpt = checkpoint_dir or result_dir.rstrip("/") + "_checkpoint"

    def keep(changes: DataFrame, number: int) -> None:
        sinks.replace_partitions(changes.withColumn("batch", F.lit(number)), result_dir, ["batch"])

    w = latest_changes(rows, S.ZONE_KEYS, "date", **limits).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ckpt)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def latest_rows(results: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """The rows of :func:`washkit.operators.service.last_non_null` from a result table of :func:`latest_changes`:
    per key and column the value of the largest place (one partial aggregate)."""
    columns = [f.name for f in results.schema["at"].dataType.fields]
    return results.groupBy(*keys).agg(F.max(order_col).alias(order_col), *[F.max_by(F.col(c), F.col("at")[c]).alias(c) for c in columns])


def compact(results: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """A result table's rows reduced to one per key, in the same shape: what a growing table may be
    replaced by, as :func:`latest_rows` gives the same rows from it."""
    columns = [f.name for f in results.schema["at"].dataType.fields]
    places = F.struct(*[F.max(F.when(F.col(c).isNotNull(), F.col("at")[c])).alias(c) for c in columns])
    return results.groupBy(*keys).agg(F.max(order_col).alias(order_col), *[F.max_by(F.col(c), F.col("at")[c]).alias(c) for c in columns], places.alias("at"))
