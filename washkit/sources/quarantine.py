"""S2 with a reject table: what a declared schema cannot take is set aside, not lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEM = "array<struct<column: string, value: string, expected: string>>"
REJECT = f"file string, row long, record string, problems {PROBLEM}"
_BAD = "__malformed"


def _problem(column: Column | None, value: Column | None, expected: Column) -> Column:
    text = F.lit(None).cast("string")
    return F.struct((text if column is None else column).alias("column"), (text if value is None else value).alias("value"), expected.alias("expected"))


def _marked(spark: SparkSession, path: str, fields: list[T.StructField], required: Sequence[str]) -> DataFrame:
    """A path's records: the declared columns, where each was read, and what is wrong with it."""
    options = {"header": True, "mode": "PERMISSIVE", "ignoreCorruptFiles": True, "ignoreMissingFiles": True, "columnPruning": False}
    names = spark.read.options(**options).csv(path).columns
    own = {c.strip().lstrip("﻿"): c for c in names}
    if names and not any(f.name in own for f in fields):
        raise ValueError(f"{path}: none of the columns {[f.name for f in fields]} in the header {names}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _BAD]])
    raw = spark.read.options(**options).option("columnNameOfCorruptRecord", _BAD).schema(schema).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    text = {f.name: F.col(f"`{own[f.name]}`") if f.name in own else F.lit(None).cast("string") for f in fields}
    missing = {f.name: F.coalesce(F.trim(text[f.name]), F.lit("")) == "" for f in fields}
    value = {f.name: F.trim(text[f.name]) if isinstance(f.dataType, T.StringType) else F.when(~missing[f.name], F.trim(text[f.name]).try_cast(f.dataType)) for f in fields}
    problems = [F.when(F.col(_BAD).isNotNull(), _problem(None, None, F.lit(f"{len(names)} fields")))]
    for f in fields:
        wrong = ~missing[f.name] & value[f.name].isNull()
        problems.append(F.when(wrong, _problem(F.lit(f.name), text[f.name], F.lit(f.dataType.simpleString()))))
        if f.name in required:
            problems.append(F.when(missing[f.name], _problem(F.lit(f.name), text[f.name], F.lit("a value"))))
    record = F.coalesce(F.col(_BAD), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])))
    return raw.select(*[value[f.name].alias(f.name) for f in fields], "__file", "__block", "__id", record.alias("__record"), F.array_compact(F.array(*problems)).alias("__problems"))


def read_csv_quarantined(spark: SparkSession, paths: str | Sequence[str], schema: str, *, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of header CSVs with a declared schema.

    good: the declared columns of the records that it takes. rejected: (file, row, record, problems),
    one row for each other record: one with too few or too many fields, one with text that does not
    parse as a column's type, or without a value in a ``required`` column. ``row`` counts a file's
    records from 1. Every record read is in one of the two. An absent column and empty text are
    NULL, no fault. A path that does not exist is a rejected row without row number and record;
    an unreadable file loses its unreadable part only (see :func:`read_files`).

    Row numbers need no sort of the records: rows are numbered within the block they were read in,
    and the blocks of a file before it are counted in one aggregate with a row per block.
    """
    fields = T.StructType.fromDDL(schema).fields
    marked, absent = _all_marked(spark, paths, fields, required)
    columns = [f.name for f in fields]
    lost = spark.createDataFrame([(p, None, None, [(None, None, "a readable path")]) for p in absent], REJECT)
    if marked is None:
        return spark.createDataFrame([], schema), lost
    blocks = marked.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    bad = marked.where(F.size("__problems") > 0).join(blocks, ["__file", "__block"])
    rejected = bad.select(F.col("__file").alias("file"), (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("row"), F.col("__record").alias("record"),
                          F.col("__problems").cast(PROBLEM).alias("problems"))
    return marked.where(F.size("__problems") == 0).select(*columns), rejected.unionByName(lost)


def _all_marked(spark: SparkSession, paths: str | Sequence[str], fields: list[T.StructField], required: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    marked, absent = None, []
    for path in [paths] if isinstance(paths, str) else list(paths):
        try:
            part = _marked(spark, path, fields, required)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            absent.append(path)
            continue
        marked = part if marked is None else marked.unionByName(part)
    return marked, absent


def read_files(spark: SparkSession, paths: str | Sequence[str], schema: str, *, required: Sequence[str] = ()) -> DataFrame:
    """(file, bytes, rows, rejected, status) of every file under ``paths``: ``good``, ``rejects`` where
    some records are rejected, ``no rows`` where none could be read (an empty, header-only or
    unreadable file). Paths that do not exist have the status ``absent``."""
    fields = T.StructType.fromDDL(schema).fields
    marked, absent = _all_marked(spark, paths, fields, required)
    none = spark.createDataFrame([(p, None, 0, 0, "absent") for p in absent], "file string, bytes long, rows long, rejected long, status string")
    if marked is None:
        return none
    present = [p for p in ([paths] if isinstance(paths, str) else paths) if p not in absent]
    listed = spark.read.format("binaryFile").load(present).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))
    seen = marked.groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("__problems") > 0).alias("rejected"))
    files = listed.join(seen, "file", "left").fillna(0, ["rows", "rejected"])
    status = F.when(F.col("rows") == 0, "no rows").when(F.col("rejected") > 0, "rejects").otherwise("good")
    return files.select("file", "bytes", "rows", "rejected", status.alias("status")).unionByName(none)
