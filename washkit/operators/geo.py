"""Zone geometry operators (A25 extents, J2 metrics-to-polygon join)."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from washkit.functions.columns import band

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry the ray test with them


def _ring_extent(ring: Column) -> list[Column]:
    """min/max lon and lat of one flat ring ``[lon0, lat0, lon1, lat1, ...]`` -- array
    higher-order functions, evaluated per row in the JVM (no explode)."""
    idx = F.sequence(F.lit(0), F.size(ring) - 1)
    lons = F.filter(F.transform(idx, lambda i: F.when(i % 2 == 0, ring[i])), lambda x: x.isNotNull())
    lats = F.filter(F.transform(idx, lambda i: F.when(i % 2 == 1, ring[i])), lambda x: x.isNotNull())
    return [F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)]


def flatten_polygon(rings: Column) -> Column:
    """GeoJSON Polygon coordinates ``[[[lon, lat], ...], ...]`` -> flat ``[lon, lat, lon, lat, ...]``."""
    return F.flatten(F.flatten(rings))


def zone_extent(shapes: DataFrame, key: str = "name", ring_col: str = "ring") -> DataFrame:
    """Bounding box per zone and the overall centre (mid-point of the global box).

    Per-row extents come from array functions; zone boxes are a partial min/max aggregate;
    the centre is one global aggregate over the boxes, read as a single scalar subquery.
    """
    lo_lon, lo_lat, hi_lon, hi_lat = _ring_extent(F.col(ring_col))
    rows = shapes.select(key, *[c for c in ("country",) if c in shapes.columns],
                         lo_lon.alias("a"), lo_lat.alias("b"), hi_lon.alias("c"), hi_lat.alias("d"))
    keys = [key] + [c for c in ("country",) if c in shapes.columns]
    box = rows.groupBy(*keys).agg(F.min("a").alias("min_lon"), F.min("b").alias("min_lat"),
                                  F.max("c").alias("max_lon"), F.max("d").alias("max_lat"))
    centre = box.select(F.struct(
        ((F.min("min_lon") + F.max("max_lon")) / F.lit(2.0)).alias("lon"),
        ((F.min("min_lat") + F.max("max_lat")) / F.lit(2.0)).alias("lat")).alias("c")).scalar()
    return box.withColumn("__c", centre).withColumns(
        {"centre_lon": F.col("__c.lon"), "centre_lat": F.col("__c.lat")}).drop("__c")


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


# Fixed map band thresholds: >= 80 good, >= 60 warn, else bad; missing -> none.
MAP_BAND_GOOD, MAP_BAND_WARN = 80.0, 60.0


def enrich_zones(metrics: DataFrame, shapes: DataFrame, metric_cols: list[str],
                 band_col: str | None = None) -> DataFrame:
    """Zone metrics joined to zone shapes on case/space-normalised (country, zone name).

    Left join from the shapes so every polygon keeps its row; ``matched`` says whether the
    metrics side had the zone; ``band_col`` adds the map colour band of that metric. Join strategy is left to the planner (broadcast when its size
    estimate is under the threshold, sort-merge otherwise).
    """
    m = metrics.select(_norm(F.col("country")).alias("__c"), _norm(F.col("name")).alias("__z"),
                       F.lit(True).alias("__hit"), *metric_cols)
    s = shapes.withColumns({"__c": _norm(F.col("country")), "__z": _norm(F.col("name"))})
    j = s.join(m, ["__c", "__z"], "left")
    out = j.withColumn("matched", F.coalesce(F.col("__hit"), F.lit(False))).drop("__c", "__z", "__hit")
    if band_col is not None:  # P19 map colour band of one metric
        out = out.withColumn("band", band(F.col(band_col), MAP_BAND_GOOD, MAP_BAND_WARN))
    return out


def unmatched_zones(metrics: DataFrame, shapes: DataFrame) -> DataFrame:
    """J2 report: shapes whose normalised (country, name) has no metrics row (``left_anti``)."""
    m = metrics.select(_norm(F.col("country")).alias("__c"), _norm(F.col("name")).alias("__z"))
    s = shapes.withColumns({"__c": _norm(F.col("country")), "__z": _norm(F.col("name"))})
    return s.join(m, ["__c", "__z"], "left_anti").drop("__c", "__z")


# --------------------------------------------------------------------------- J2 by geometry
#: Levels of the grid: cells are squares with sides of 2 ** level.
MIN_LEVEL, MAX_LEVEL = -40, 60


def _edges(rings: Column) -> Column:
    """All edges of a polygon's rings, each ring closed, as (x1, y1, x2, y2)."""
    def of(ring: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
            return F.struct(F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"), F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2"))
        return F.transform(F.when(F.size(ring) > 0, F.sequence(F.lit(0), F.size(ring) - 1)).otherwise(F.array().cast("array<int>")), edge)
    return F.flatten(F.transform(rings, of))


def ring_pairs(flat: Column) -> Column:
    """Flat ring ``[lon, lat, lon, lat, ...]`` -> ``[[lon, lat], ...]``."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: F.array(flat[i * 2], flat[i * 2 + 1]))


#: Points and shapes of one cell that a task tests in one go; fuller cells are split into such blocks.
POINTS, SHAPES = 32768, 2048
#: Points from which the edges of a shape are tested one by one, each on the points at its height only.
TALL = 256
#: Hits written in one go, bar those of the last shape.
HITS = 1 << 17


def _odd(lon: np.ndarray, lat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Ray test of points sorted by ``lat``: an odd number of edges (rows x1, y1, x2, y2) crosses the
    ray from the point to the east. NaN counts as the largest number, as in Spark."""
    x1, y1, x2, y2 = edges
    with np.errstate(all="ignore"):
        if len(lat) < TALL or not np.isfinite(edges).all():
            x, y = lon[:, None], lat[:, None]
            crosses = (~(y1 <= y) != ~(y2 <= y)) & ~(x >= (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            return np.count_nonzero(crosses, axis=1) % 2 == 1
        odd = np.zeros(len(lat), bool)
        first, last = np.searchsorted(lat, np.minimum(y1, y2)), np.searchsorted(lat, np.maximum(y1, y2))
        for k in np.flatnonzero(first < last).tolist():
            at = slice(first[k], last[k])
            odd[at] ^= lon[at] < (x2[k] - x1[k]) * (lat[at] - y1[k]) / (y2[k] - y1[k]) + x1[k]
        return odd


#: A cell, a block of its points and a block of its shapes: what a task tests in one go.
UNIT = ("__level", "__cx", "__cy", "__np", "__ns")


def _units(batches):
    """Arrow tables of one unit each, from batches sorted by unit."""
    import pyarrow as pa

    held, last = [], None
    for b in batches:
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in UNIT], axis=1)
        cut = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if s < e:
                if held and (keys[s] != last).any():
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(s, e - s))
                last = keys[s]
    if held:
        yield pa.Table.from_batches(held)


def _located(names: list[str]):
    """Rows of points and shapes, sorted by unit -> the points of each unit with its shapes that they lie in."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def joined(points, shapes, at: list, of: list, n: list):
            rows = [(points, np.concatenate(at)), (shapes, np.repeat(of, n))]
            cols = [c for t, i in rows for c in t.take(pa.array(i)).combine_chunks().flatten()]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for u in _units(batches):
            own = pc.is_valid(u.column("x"))
            points, shapes = u.filter(own).combine_chunks(), u.filter(pc.invert(own)).combine_chunks()
            lat = points.column("y").to_numpy()
            by_lat = np.argsort(lat, kind="stable")
            lat, lon = lat[by_lat], points.column("x").to_numpy()[by_lat]
            box = [shapes.column(c).to_numpy() for c in ("minx", "maxx", "miny", "maxy")]
            low, high = np.searchsorted(lat, box[2], "left"), np.searchsorted(lat, box[3], "right")
            edges = shapes.column("edges").combine_chunks()
            ends, parts = edges.offsets.to_numpy(), np.stack([c.to_numpy() for c in edges.values.flatten()])
            at, of, n, held = [], [], [], 0
            for k in np.flatnonzero(low < high).tolist():
                x = lon[low[k]:high[k]]
                near = low[k] + np.flatnonzero((x >= box[0][k]) & ~(x > box[1][k]))
                if not len(near):
                    continue
                hit = by_lat[near[_odd(lon[near], lat[near], parts[:, ends[k]:ends[k + 1]])]]
                if len(hit):
                    at.append(hit)
                    of.append(k)
                    n.append(len(hit))
                    held += len(hit)
                if held >= HITS:
                    yield joined(points.column("point"), shapes.column("shape"), at, of, n)
                    at, of, n, held = [], [], [], 0
            if held:
                yield joined(points.column("point"), shapes.column("shape"), at, of, n)

    return run


def locate_points(points: DataFrame, shapes: DataFrame, columns: Sequence[str], *, lon: str = "lon", lat: str = "lat", rings: str = "rings",
                  keep: Sequence[str] = ()) -> DataFrame:
    """J2 by geometry (S4 with S5): every point with ``columns`` of each shape that it lies in.

    A shape is indexed in the grid whose cells are as large as its bounding box, so it falls into at
    most four cells whatever its size; a point is looked up in its cell of every grid in use (at
    most ``MAX_LEVEL - MIN_LEVEL + 1``, mostly a few). Cells are counted: those with points and shapes
    are split into units of about ``POINTS`` points and ``SHAPES`` shapes, so a hot cell is many
    units and every block of its points meets every block of its shapes once. In a unit the bounding
    box and then the exact ray test decide, over all rings (a hole is outside; a point on an edge
    belongs to one side). ``keep`` names columns that identify a point (not NULL): points in no shape are then kept, with
    NULLs. Points without coordinates lie in none; shapes without rings hold none.
    """
    s = shapes.select(*columns, _edges(F.col(rings)).alias("__edges")).where(F.size("__edges") > 0)
    ends = {"x": F.transform("__edges", lambda e: e["x1"]), "y": F.transform("__edges", lambda e: e["y1"])}  # rings are closed: each corner starts an edge
    s = s.withColumns({f"__{f}{k}": getattr(F, f"array_{f}")(ends[k]) for k in "xy" for f in ("min", "max")})
    width = F.greatest(F.col("__maxx") - F.col("__minx"), F.col("__maxy") - F.col("__miny"))
    level = F.when(width > 0, F.greatest(F.least(F.ceil(F.log2(width)).cast("int"), F.lit(MAX_LEVEL)), F.lit(MIN_LEVEL))).otherwise(F.lit(MIN_LEVEL))
    s = s.withColumns({"__level": level, "__r": F.rand(1)})
    size = F.pow(F.lit(2.0), F.col("__level"))
    for k in "xy":
        s = s.withColumn(f"__c{k}", F.explode(F.sequence(F.floor(F.col(f"__min{k}") / size), F.floor(F.col(f"__max{k}") / size))))
    levels = s.select(F.collect_set("__level")).scalar()
    here = F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(F.col(lon).cast("double")) & ~F.isnan(F.col(lat).cast("double"))
    at = points.where(here).withColumn("__r", F.rand(2)).select("*", F.explode(levels).alias("__level"))
    at = at.withColumns({"__cx": F.floor(F.col(lon) / size), "__cy": F.floor(F.col(lat) / size)})
    cell = ["__level", "__cx", "__cy"]
    cells = s.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(SHAPES)).alias("__ns")).join(at.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(POINTS)).alias("__np")), cell)

    def units(rows: DataFrame, own: str, others: str, *cols: Column) -> DataFrame:
        """The rows once in each unit of their block: (cell, block of points, block of shapes)."""
        block = {own: F.floor(F.col("__r") * F.col(own)), others: F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))}
        rows = rows.join(cells, cell).withColumn(own, block[own]).withColumn(others, block[others])
        return rows.select(*UNIT, *cols)

    whole = F.filter("__edges", lambda e: e["x1"].isNotNull() & e["y1"].isNotNull() & e["x2"].isNotNull() & e["y2"].isNotNull())
    edges = F.transform(whole, lambda e: F.struct(*(e[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))))
    point, shape = F.struct(*(F.col(c) for c in points.columns)), F.struct(*columns)
    rows = units(at, "__np", "__ns", F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"), point.alias("point")).unionByName(
        units(s, "__ns", "__np", edges.alias("edges"), shape.alias("shape"), *[F.col(f"__{f}{k}").cast("double").alias(f"{f}{k}") for k in "xy" for f in ("min", "max")]), allowMissingColumns=True)
    schema = StructType([*points.schema.fields, *shapes.select(*columns).schema.fields])
    found = rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_located(schema.names), schema)
    return found.unionByName(points.join(found.select(*keep).distinct(), list(keep), "left_anti"), allowMissingColumns=True) if keep else found
