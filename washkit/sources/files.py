"""File loaders (S1-S5): CSV, JSON documents and GeoJSON feature collections.

All readers take an explicit schema; nothing is inferred, so a 100 TB directory
is listed once and never sampled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washkit.functions import columns as C
from washkit.sources import schemas as S


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, *, tolerant: bool = False) -> DataFrame:
    """Header CSV with a declared schema.

    Columns are taken by header name, path by path (the files of one path share a header):
    order does not matter, further columns are ignored, absent ones are NULL, text that does not
    parse is NULL. A path with none of the declared columns is an error. ``tolerant=True``
    skips missing or unreadable files (S2); a missing path then yields an empty, typed frame
    instead of an error. A header is read for each path, but paths of single files with equal headers
    are one scan, so the plan grows with the number of different headers; a folder, a pattern and a
    path given again are a scan of their own.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    fields = T.StructType.fromDDL(schema).fields
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if tolerant:
        reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    scans: dict[tuple, tuple[DataFrame, list[str]]] = {}
    for i, path in enumerate(paths):
        try:
            raw = reader.csv(path)
        except AnalysisException:
            if not tolerant:
                raise
            continue
        listed = raw.inputFiles()
        alone = raw.columns and len(listed) == 1 and unquote(listed[0]).rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1] and path not in paths[:i]
        scans.setdefault(tuple(raw.columns) if alone else (i,), (raw, []))[1].append(path)
    out = None
    for raw, same in scans.values():
        names = {c.strip().lstrip("\ufeff"): c for c in raw.columns}
        if raw.columns and not any(f.name in names for f in fields):
            raise ValueError(f"{', '.join(same)}: none of the columns {[f.name for f in fields]} in the header {raw.columns}")
        if len(same) > 1:
            raw = reader.schema(raw.schema).csv(same)
        part = raw.select([(F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in fields])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def normalise_access(df: DataFrame) -> DataFrame:
    """P1-P4 on one access source in a single projection: strip w_/s_ prefixes, trim keys,
    recode the type, coerce counts to BIGINT and percentages to DOUBLE (bad text -> NULL)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for src in df.columns:
        name = re.sub(C.ACCESS_PREFIX_PATTERN, "", src)
        c = F.col(f"`{src}`")
        if name in ("country", "zone"):
            c = C.clean_text(c)
        elif name == "type":
            c = C.recode(C.clean_text(c, lower=True), C.TYPE_RECODE)
        elif name == "year" and types[src] != "int":
            c = C.lenient_number(c, "int")
        elif name in S.ACCESS_COUNT_COLS and types[src] != "bigint":
            c = C.lenient_number(c, "bigint")
        elif name.endswith("_pct") and types[src] != "double":
            c = C.lenient_number(c, "double")
        out.append(c.alias(name))
    return df.select(*out)


def tidy_access(water: DataFrame | None, sewer: DataFrame | None) -> DataFrame:
    """Union of the normalised water and sewer sources by column name.

    Columns present on one side only (surface water, open defecation, municipal
    coverage) are NULL on the other. Narrow: no shuffle.
    """
    parts = [normalise_access(d) for d in (water, sewer) if d is not None]
    if not parts:
        raise ValueError("no access source given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def load_access_csv(spark: SparkSession, water_path: str | None, sewer_path: str | None) -> DataFrame:
    """S1 + S2 + U1: read both access CSVs (missing files skipped) and return the tidy table."""
    water = read_csv(spark, water_path, S.WATER_ACCESS, tolerant=True) if water_path else None
    sewer = read_csv(spark, sewer_path, S.SEWER_ACCESS, tolerant=True) if sewer_path else None
    return tidy_access(water, sewer)


def read_json_document(
    spark: SparkSession, path: str, schema: str | T.StructType, defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """S3: multi-line JSON documents with a declared schema; absent fields take defaults. An absent
    document gives one typed row of defaults."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("ignoreMissingFiles", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = spark.createDataFrame([(None,) * len(kind.fields)], T.StructType([T.StructField(f.name, f.dataType, True) for f in kind.fields]))
    return apply_defaults(df, defaults or {})


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill NULL fields from literal defaults; a mapping is the defaults of a struct's fields."""
    def filled(c, kind, v):
        if isinstance(v, Mapping) and isinstance(kind, T.StructType):
            return F.struct(*[(filled(c[f.name], f.dataType, v[f.name]) if f.name in v else c[f.name]).alias(f.name) for f in kind.fields])
        return F.coalesce(c, F.lit(v).cast(kind))

    kinds = {f.name: f.dataType for f in df.schema.fields}
    changes = {k: filled(F.col(k), kinds[k], v) for k, v in defaults.items() if k in kinds}
    return df.withColumns(changes) if changes else df


def parse_json_column(df: DataFrame, column: str, schema: str, defaults: Mapping[str, object] | None = None,
                      prefix: str = "") -> DataFrame:
    """S3 over a text column: ``from_json`` into typed fields, with defaults for missing keys."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    st = df.select(parsed.alias("__j")).schema["__j"].dataType  # the declared struct, as Spark parsed it
    fields = {prefix + f.name: parsed.getField(f.name) for f in st.fields}
    out = df.withColumns(fields)
    return apply_defaults(out, {prefix + k: v for k, v in (defaults or {}).items()})


def read_geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection -> one row per feature: name, country, properties map, rings."""
    raw = spark.read.schema(S.GEO_POLYGONS).option("multiLine", True).json(path)
    feats = raw.select(F.explode("features").alias("f"))
    return feats.select(
        F.col("f.properties").getItem("name").alias("name"),
        F.col("f.properties").getItem("country").alias("country"),
        F.col("f.properties").getItem("city").alias("city"),
        F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("rings"),
    )


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features -> country, zone, lon, lat."""
    raw = spark.read.schema(S.GEO_POINTS).option("multiLine", True).json(path)
    feats = raw.select(F.explode("features").alias("f"))
    return feats.select(
        F.col("f.properties").getItem("country").alias("country"),
        F.col("f.properties").getItem("zone").alias("zone"),
        F.element_at("f.geometry.coordinates", 1).alias("lon"),
        F.element_at("f.geometry.coordinates", 2).alias("lat"),
    )


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV with its display headers, renamed to snake case (P5) and typed."""
    src = ", ".join(f"`{k}` STRING" for k in S.LEDGER_RENAME)
    df = read_csv(spark, path, src).withColumnsRenamed(S.LEDGER_RENAME)
    types = dict(f.split(" ") for f in S.LEDGER.split(", "))
    return df.select([C.lenient_number(c, t.lower()).alias(c) if t != "STRING" else F.trim(c).alias(c)
                      for c, t in types.items()])


def read_catalogue(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Indicator catalogue table (CSV with display headers, or parquet with snake-case names).

    Framework cells of '', '—' or NULL all mean "not aligned" and become NULL (counted as No).
    """
    if fmt == "csv":
        headers = ["Domain", "Indicator", "Description", "Frequency", "Granularity", *S.FRAMEWORK_RENAME,
                   "Section", "Subcategory"]
        src = ", ".join(f"`{h}` STRING" for h in headers)
        df = read_csv(spark, path, src)
        df = df.toDF(*[S.FRAMEWORK_RENAME.get(h, h.lower()) for h in headers])
    else:
        df = spark.read.schema(S.CATALOGUE).parquet(path)
    fws = list(S.FRAMEWORK_RENAME.values())
    clean = {c: F.when(F.trim(F.col(c)).isin("", "\u2014"), F.lit(None)).otherwise(F.trim(F.col(c))) for c in fws}
    return df.withColumns(clean)


def parallel_arrays_to_rows(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Documents holding parallel arrays (one element per period) -> one row per position.

    ``arrays_zip`` pairs the i-th elements (shorter arrays pad with NULL) and ``inline`` emits a
    row per position, per document, inside the task that read it -- no shuffle.
    """
    zipped = F.arrays_zip(*[F.col(a).alias(a.split(".")[-1]) for a in arrays])
    return df.select(*keep, F.inline(zipped))


def struct_to_long(df: DataFrame, struct_col: str, keep: Sequence[str] = (), *, name: str = "metric",
                   value: str = "value", value_type: str = "double") -> DataFrame:
    """Nested document struct -> long (keep..., metric, value): one row per struct field.

    A narrow ``select`` of the struct's fields (cast to one type) and an ``unpivot``.
    """
    fields = df.select(f"{struct_col}.*").columns
    flat = df.select(*keep, *[F.col(f"{struct_col}.{f}").cast(value_type).alias(f) for f in fields])
    return flat.unpivot(list(keep), fields, name, value)


def document_leaves(df: DataFrame, column: str, keep: Sequence[str] = (), *, depth: int = 6) -> DataFrame:
    """(keep..., path, value): one row for each leaf of a JSON text column whose nesting is unknown.

    The text is parsed once as VARIANT (no schema is declared or inferred) and opened level by level
    with ``variant_explode_outer``, which leaves a leaf as it is: members give ``name``, elements
    ``name[i]``. Values are text; empty objects and lists, JSON nulls and text that is no JSON give no
    row. What is nested more than ``depth`` levels is given as JSON text. One chain over one read:
    rows are independent, nothing is shuffled.
    """
    tvf = df.sparkSession.tvf
    rows = df.select(*keep, F.lit("").alias("__path"), F.try_parse_json(F.col(column)).alias("__v")).where("__v IS NOT NULL")
    for _ in range(depth):
        part = tvf.variant_explode_outer(F.col("__v").outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__x"))
        member = F.concat(F.col("__path"), F.when(F.col("__path") == "", "").otherwise("."), F.col("__key"))
        element = F.concat(F.col("__path"), F.lit("["), F.col("__pos").cast("string"), F.lit("]"))
        name = F.when(F.col("__pos").isNull(), F.col("__path")).when(F.col("__key").isNull(), element).otherwise(member)
        rows = rows.lateralJoin(part).select(*keep, name.alias("__path"), F.coalesce("__x", "__v").alias("__v"))
    value = F.coalesce(F.try_variant_get(F.col("__v"), "$", "string"), F.to_json(F.col("__v")))
    empty = F.schema_of_variant(F.col("__v")).isin("OBJECT<>", "ARRAY<VOID>")
    return rows.where(~F.is_variant_null(F.col("__v")) & ~empty).select(*keep, F.col("__path").alias("path"), value.alias("value"))


def read_typed_csv(spark: SparkSession, path: str | Sequence[str], ddl: str, *, tolerant: bool = False) -> DataFrame:
    """Header CSV read as text, then each column coerced to its declared type (P4: bad text ->
    NULL, text keys trimmed). ``ddl`` is ``"name TYPE, ..."`` as in :mod:`washkit.sources.schemas`."""
    cols = [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]
    raw = read_csv(spark, path, ", ".join(f"`{n}` STRING" for n, _ in cols), tolerant=tolerant)
    out = []
    for n, t in cols:
        t = t.strip().lower()
        out.append((F.trim(F.col(n)) if t == "string" else C.lenient_number(F.trim(F.col(n)), t)).alias(n))
    return raw.select(*out)


def read_service_csv(spark: SparkSession, path: str | Sequence[str], **kw) -> DataFrame:
    """Monthly service table (country, city, zone, year, month, volumes, tests, complaints, ...)."""
    return read_typed_csv(spark, path, S.SERVICE_MONTH, **kw)


def read_billing_csv(spark: SparkSession, path: str | Sequence[str], **kw) -> DataFrame:
    """Customer bills (customer_id, date, billed, paid)."""
    return read_typed_csv(spark, path, S.BILLING, **kw)


def read_production_csv(spark: SparkSession, path: str | Sequence[str], **kw) -> DataFrame:
    """Daily production per source (date, source, production_m3, service_hours)."""
    return read_typed_csv(spark, path, S.PRODUCTION, **kw)
