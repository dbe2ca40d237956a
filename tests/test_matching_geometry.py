"""Near-name join, point-in-polygon join, cascading menus and sketched medians, against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from washkit.operators import access as A
from washkit.operators import catalogue as CG
from washkit.operators import geo as G
from washkit.operators import matching as M


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_a_misspelt_zone_finds_its_name(spark):
    left = spark.createDataFrame([("Malawi", "Limbadzi"), ("malawi ", "Kawale"), ("Malawi", "Nowhere"), ("Uganda", "Lumbadzi"), ("Malawi", None)], "country string, name string")
    right = spark.createDataFrame([("malawi", "Lumbadzi"), ("malawi", "KAWALE "), ("malawi", "Area  25"), ("uganda", "Kampala")], "country string, name string")
    got = {(r.country, r.name): (r.match, r.distance) for r in M.match_names(left, right, block=["country"]).collect()}
    assert got == {("malawi", "limbadzi"): ("lumbadzi", 1), ("malawi", "kawale"): ("kawale", 0), ("malawi", "nowhere"): (None, None), ("uganda", "lumbadzi"): (None, None)}


@pytest.mark.parametrize(("most", "q", "letters"), [(1, 2, "ab"), (2, 2, "abc"), (2, 3, "abcdef"), (3, 2, "abé")])
def test_names_against_all_pairs(spark, most, q, letters):
    rnd = random.Random(most * 10 + q)
    names = [["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(60)] for _ in range(2)]
    left, right = (spark.createDataFrame([(n, i % 3) for i, n in enumerate(x)], "name string, b int").withColumn("b", F.col("b").cast("string")) for x in names)
    for block in ([], ["b"]):
        got = {(r.name, *[r[b] for b in block]): (r.match, r.distance) for r in M.match_names(left, right, block=block, most=most, q=q).collect()}
        want = {}
        for i, n in enumerate(names[0]):
            near = [(distance(n, m), m) for j, m in enumerate(names[1]) if not block or i % 3 == j % 3]
            best = min((x for x in near if x[0] <= most), default=(None, None))
            want[(n, *([str(i % 3)] if block else []))] = (best[1], best[0])
        assert got == want


def test_null_block_is_a_block(spark):
    left = spark.createDataFrame([(None, "alpha")], "b string, name string")
    right = spark.createDataFrame([(None, "alpho"), ("x", "alpha")], "b string, name string")
    assert [tuple(r) for r in M.match_names(left, right, block=["b"]).collect()] == [(None, "alpha", "alpho", 1)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_points_in_polygons_against_all_pairs(spark):
    rnd = random.Random(4)
    shapes = []
    for k in range(40):
        x, y, size = rnd.uniform(-50, 50), rnd.uniform(-50, 50), 10 ** rnd.uniform(-3, 2)
        rings = [[[x + rnd.uniform(-size, size), y + rnd.uniform(-size, size)] for _ in range(rnd.randint(3, 9))]]
        if k % 4 == 0:
            rings.append([[x - size / 9, y - size / 9], [x + size / 9, y - size / 9], [x + size / 9, y + size / 9], [x - size / 9, y + size / 9], [x - size / 9, y - size / 9]])
        shapes.append((k, rings))
    shapes += [(100, [[[-60.0, -60.0], [60.0, -60.0], [60.0, 60.0], [-60.0, 60.0]]]), (101, []), (102, [[]]), (103, [[[1.0, 1.0]]]), (104, None)]
    points = [(i, rnd.uniform(-70, 70), rnd.uniform(-70, 70)) for i in range(300)] + [(900 + k, s[1][0][0][0], s[1][0][0][1]) for k, s in enumerate(shapes[:40])]
    points += [(2000, None, 1.0), (2001, 1.0, None), (2002, float("nan"), 0.0), (2003, 0.0, 0.0)]
    s = spark.createDataFrame(shapes, "shape int, rings array<array<array<double>>>")
    p = spark.createDataFrame(points, "id int, lon double, lat double").repartition(3)
    want = {(i, k) for i, x, y in points for k, rings in shapes if rings and x is not None and y is not None and x == x and inside(x, y, rings)}
    found = G.locate_points(p, s, ["shape"])
    got = [(r.id, r["shape"]) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(want) > 250
    left = [(r.id, r["shape"]) for r in G.locate_points(p, s, ["shape"], keep=["id"]).collect()]
    assert sorted(x for x in left if x[1] is not None) == sorted(want) and len(left) == len(set(left))
    assert {i for i, k in left if k is None} == {i for i, _, _ in points} - {i for i, _ in want}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_hot_cell_is_tested_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "POINTS", 150)
    monkeypatch.setattr(G, "SHAPES", 10)
    rnd = random.Random(9)
    points = [(i % 900, 0.25 + rnd.random() / 2, 0.25 + rnd.random() / 2, None if i % 5 else "p") for i in range(1000)]
    shapes = [(k % 35, None if k % 3 else k, [[[rnd.random(), rnd.random()] for _ in range(31)] + [[0.01, 0.01], [0.99, 0.99]]]) for k in range(40)]
    shapes += [(99, 99, [[[0.1, 0.1], [0.9, 0.1], [None, 0.9], [0.1, 0.9]]])]
    want = sorted(str((i, x, y, note, k, n)) for i, x, y, note in points for k, n, rings in shapes[:40] if inside(x, y, rings))
    found = G.locate_points(spark.createDataFrame(points, "id int, lon double, lat double, note string").repartition(3),
                            spark.createDataFrame(shapes, "shape int, n long, rings array<array<array<double>>>").repartition(2), ["shape", "n"])
    assert found.columns == ["id", "lon", "lat", "note", "shape", "n"]
    # candidate pairs are no rows: points and shapes meet inside the blocks
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(tuple(r)) for r in found.where("shape < 99").collect()) == want and len(want) > 10000


def test_the_ray_test_by_edges_is_that_by_points():
    rnd = np.random.default_rng(3)
    for corners in (rnd.random((31, 2)), rnd.integers(0, 4, (12, 2)).astype(float)):
        edges = np.concatenate([corners, np.roll(corners, -1, axis=0)], axis=1).T
        lat, lon = np.sort(np.r_[rnd.random(2000) * 3, corners[:, 1]]), np.r_[rnd.random(2000) * 3, corners[:, 0]]
        small = np.concatenate([G._odd(lon[i:i + 100], lat[i:i + 100], edges) for i in range(0, len(lat), 100)])
        want = [inside(x, y, [corners.tolist()]) for x, y in zip(lon.tolist(), lat.tolist(), strict=True)]
        assert len(lat) > G.TALL and (G._odd(lon, lat, edges) == small).all() and small.tolist() == want and 0 < sum(want) < len(want)


def test_geojson_zones_hold_their_points(spark, tmp_path):
    from washkit.sources import files
    (tmp_path / "z.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"Limbadzi","country":"Malawi"},"geometry":{"type":"Polygon","coordinates":[[[33.0,-14.0],[34.0,-14.0],[34.0,-13.0],[33.0,-13.0],[33.0,-14.0]]]}}]}')
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"zone":"Lumbadzi","country":"malawi"},"geometry":{"type":"Point","coordinates":[33.5,-13.5]}}, {"type":"Feature","properties":{"zone":"Away","country":"malawi"},"geometry":{"type":"Point","coordinates":[30.0,-13.5]}}]}')
    zones = files.read_geojson_polygons(spark, str(tmp_path / "z.geojson"))
    points = files.read_geojson_points(spark, str(tmp_path / "p.geojson"))
    assert [(r.zone, r.name) for r in G.locate_points(points, zones, ["name"]).collect()] == [("Lumbadzi", "Limbadzi")]


def test_cascading_menu(spark):
    rows = [("A", "x", "1"), ("A", "x", "2"), ("A", "y", None), ("B", None, "3"), (None, "z", "4"), ("A", "x", "1")]
    df = spark.createDataFrame(rows, "country string, city string, zone string")
    menu = CG.cascading_menu(df, ["country", "city", "zone"])
    assert {tuple(r) for r in menu.collect()} == {(0, None, None, None, 6), (1, "A", None, None, 4), (1, "B", None, None, 1), (2, "A", "x", None, 3), (2, "A", "y", None, 1), (3, "A", "x", "1", 2), (3, "A", "x", "2", 1)}
    levels = ["country", "city", "zone"]
    assert {tuple(r) for r in CG.menu_options(menu, levels, ["A"]).collect()} == {("x", 3), ("y", 1)}
    assert {tuple(r) for r in CG.menu_options(menu, levels, ["A", "x"]).collect()} == {("1", 2), ("2", 1)}
    assert CG.cascading_menu(df.limit(0), levels).collect() in ([], [(0, None, None, None, 0)])


def test_sketched_medians(spark):
    rnd = random.Random(2)
    rows = [(c, "water", 2024, f"z{i}", rnd.uniform(0, 100), rnd.uniform(0, 100), rnd.uniform(0, 100), 10) for c, n in (("A", 1), ("B", 2), ("C", 999), ("D", 1000)) for i in range(n)]
    rows.append(("E", "water", 2024, "z", None, None, None, 5))
    acc = spark.createDataFrame(rows, "country string, type string, year int, zone string, safely_managed_pct double, unimproved_pct double, surface_water_pct double, popn_total long") \
        .withColumn("open_def_pct", F.lit(None).cast("double"))
    got = {r.country: r for r in A.country_summary(acc, 2024, sketched=True).collect()}
    assert {c: r.asDict() for c, r in got.items()} == {r.country: r.asDict() for r in A.country_summary(acc, 2024).collect()}
    for c in "ABCD":
        assert got[c].safely_med == round(statistics.median(r[4] for r in rows if r[0] == c), 6)
    assert got["E"].safely_med is None
    assert {r for r in A.surface_water_exposure(acc, 2024, sketched=True).collect()} == {r for r in A.surface_water_exposure(acc, 2024).collect()}


def test_sketch_error_bound_on_a_large_group(spark):
    n = 300000
    acc = spark.range(n, numPartitions=6).select(F.lit("A").alias("country"), F.lit("water").alias("type"), F.lit(2024).alias("year"), F.col("id").cast("string").alias("zone"),
                                               ((F.col("id") * 7919) % n).cast("double").alias("safely_managed_pct"), F.lit(1.0).alias("unimproved_pct"), F.lit(1.0).alias("open_def_pct"), F.lit(1).alias("popn_total"))
    out = A.country_summary(acc, 2024, sketched=True)
    assert abs(out.first().safely_med / n - 0.5) < 0.0013
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg_double" in plan
