"""Nearest cells, polygons, projection and distance against brute force and known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polynya.functions import geodesy as geo
from polynya.operators import spatial as sp
from polynya.operators.joins import block_counts, blocked_join
from polynya.plans import fields
from tests.conftest import rows

PIXEL, CAMP = (-63.77872, 67.47679), (-63.78953, 67.47973)


def brute(points, cells):
    out = []
    for pid, x, y in points:
        d, cid = min(((cx - x) ** 2 + (cy - y) ** 2, cid) for cid, cx, cy in cells)
        out.append((pid, cid, round(math.sqrt(d), 9)))
    return sorted(out)


@pytest.mark.parametrize("layout", ["even", "clump", "copies", "line"])
def test_nearest_is_exact(spark, layout):
    rng = random.Random(3)
    spread = lambda: (rng.uniform(-50, 50), rng.uniform(-20, 20))
    cells = [(i, *spread()) for i in range(600)]
    if layout == "clump":  # most cells within a tiny spot
        cells += [(1000 + i, 7 + rng.random() * 1e-3, 7 + rng.random() * 1e-3) for i in range(1200)]
    if layout == "copies":  # one place many times: the lowest id answers
        cells += [(2000 + i, 3.0, 3.0) for i in range(500)]
    if layout == "line":
        cells = [(i, float(i % 50), 0.0) for i in range(300)]
    points = [(i, *spread()) for i in range(80)] + [(900, 7.0, 7.0), (901, 3.0, 3.0), (902, 500.0, -500.0), (903, 7.0, 7.0)]
    c = spark.createDataFrame(cells, "cid int, x double, y double")
    p = spark.createDataFrame(points, "pid int, px double, py double")
    got = sp.nearest(p, c, ("px", "py"), ("x", "y"), "cid", leaf_rows=100)
    assert rows(got.select("pid", "cid", F.round("distance", 9))) == brute(points, cells)


def test_nearest_without_cells_or_place(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0)], "cid int, x double, y double")
    p = spark.createDataFrame([(1, None, 2.0), (2, 3.0, 4.0)], "pid int, px double, py double")
    assert rows(sp.nearest(p, c, ("px", "py"), ("x", "y"), "cid"), "pid", "cid", "distance") == [(1, None, None), (2, 1, 5.0)]
    assert rows(sp.nearest(p, c.limit(0), ("px", "py"), ("x", "y"), "cid"), "pid", "cid") == [(1, None), (2, None)]


def test_distances_of_camp_and_pixel(spark):
    one = spark.range(1).select(
        *[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), (*PIXEL, *CAMP))]
    )
    metres = one.select(geo.geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert metres == pytest.approx(566.737, abs=1e-3)
    x1, y1 = geo.SEA_ICE.forward(F.col("a"), F.col("b"))
    x2, y2 = geo.SEA_ICE.forward(F.col("c"), F.col("d"))
    flat = one.select(F.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)).first()[0]
    assert flat == pytest.approx(571.434, abs=1e-3)
    assert one.select(geo.geodesic_m(F.col("a"), F.col("b"), F.col("a"), F.col("b"))).first()[0] == 0.0


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-63.8, 67.5), (-45.0, 89.0), (120.0, 60.0)], "lon double, lat double")
    x, y = geo.SEA_ICE.forward(F.col("lon"), F.col("lat"))
    back = df.select("lon", "lat", *[c.alias(n) for n, c in zip("xy", geo.SEA_ICE.inverse(x, y))])
    for r in back.collect():
        assert (r["x"] - r["lon"]) % 360 == pytest.approx(0, abs=1e-9) or (r["x"] - r["lon"]) % 360 == pytest.approx(360, abs=1e-9)
        assert r["y"] == pytest.approx(r["lat"], abs=1e-9)


SQUARE = [("sq", False, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
HOLE = [("sq", True, i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)])]


def test_polygon_with_hole(spark):
    v = spark.createDataFrame(SQUARE + HOLE, "poly_id string, hole boolean, seq int, x double, y double")
    area = sp.polygon_area(v, ["poly_id"], ["poly_id"], "hole", divisor=1.0)
    assert rows(area) == [("sq", 15.0)]
    edges = sp.ring_edges(v, ["poly_id", "hole"])
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.0, 3.9), (4, 5.0, 1.0), (5, -1.0, 1.5)], "id int, x double, y double")
    assert rows(sp.inside_polygons(pts, "id", "x", "y", edges)) == [(1, "sq"), (3, "sq")]
    assert rows(sp.polygon_mask(pts, "id", "x", "y", edges), "id") == [(2,)]
    assert rows(sp.polygon_mask(pts, "id", "x", "y", edges, crop=False), "id") == [(2,), (4,), (5,)]


def test_ring_area_split_over_blocks(spark):
    n = 400
    ring = [("c", False, i, math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    v = spark.createDataFrame(ring, "poly_id string, hole boolean, seq int, x double, y double")
    want = n / 2 * math.sin(2 * math.pi / n)
    for limit in (1, 6):
        got = sp.polygon_area(v, ["poly_id"], ["poly_id"], "hole", divisor=1.0, blocks=limit).first()["area"]
        assert got == pytest.approx(want)


def test_bins_cover_the_axis(spark):
    table = sp.bin_rows(spark, 36).collect()
    total = sum(r["nbin"] for r in table)
    bins = spark.range(1, total + 1).withColumnRenamed("id", "bin_num")
    out = sp.bin_lookup(bins, 36)
    assert out.count() == total
    edge = out.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    assert edge[0] == -87.5 and edge[1] == 87.5 and edge[2] > -180 and edge[3] < 180


def test_reproject_of_a_constant_is_constant(spark):
    g = spark.range(400).select(
        (F.col("id") % 20).cast("int").alias("ix"), F.floor(F.col("id") / 20).cast("int").alias("iy")
    ).selectExpr("ix", "iy", "-60 + 0.5D * ix AS lon", "65 + 0.25D * iy AS lat", "7.0D AS value")
    out = sp.reproject(g, geo.SEA_ICE, 20_000.0, -60.0, 65.0, 0.5, 0.25)
    stats = out.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).first()
    assert stats[0] > 100 and stats[1] == pytest.approx(7.0) and stats[2] == pytest.approx(7.0)


def test_polygons_of_mixed_sizes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rings = {i: rng.uniform(0, 100, 2) + rng.uniform(-1, 1, (3, 2)) * 10.0 ** rng.integers(-2, 3) for i in range(40)}
    edges = [
        (i, *map(float, (*ring[k], *ring[(k + 1) % 3]))) for i, ring in rings.items() for k in range(3)
    ]
    points = [(n, *map(float, rng.uniform(-20, 120, 2))) for n in range(300)]
    points += [(300 + i, *map(float, ring.mean(0))) for i, ring in rings.items()] + [(400, float("nan"), 1.0)]
    want = set()
    for n, x, y in points:
        for i in rings:
            crossed = [
                1 for j, x1, y1, x2, y2 in edges
                if j == i and (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
            ]
            if len(crossed) % 2:
                want.add((n, i))
    found = sp.inside_polygons(
        spark.createDataFrame(points, "n int, x double, y double"), "n", "x", "y",
        spark.createDataFrame(edges, "poly_id int, x1 double, y1 double, x2 double, y2 double"),
    )
    assert {tuple(r) for r in found.collect()} == want and len(want) > 40


def test_arrays_are_turned_and_cropped(spark):
    from polynya.sources.grids import crop_arrays, grid_to_cells

    lon, lat = [float(x) for x in range(0, 360, 30)], [50.0, 60.0, 70.0]
    cells = [100.0 * j + i for j in range(3) for i in range(12)]
    df = spark.createDataFrame([(1, lon, lat, cells), (2, lon, lat, None), (3, [], [], [])],
                               "id int, lon array<double>, lat array<double>, v array<double>")
    for west, east in ((-70.0, 40.0), (290.0, 400.0)):
        got = crop_arrays(df, "lon", "lat", ["v"], west, east, 55.0, 90.0).orderBy("id").collect()
        assert [x % 360 for x in got[0]["lon"]] == [300.0, 330.0, 0.0, 30.0] and got[0]["lat"] == [60.0, 70.0]
        assert got[0]["v"] == [110.0, 111.0, 100.0, 101.0, 210.0, 211.0, 200.0, 201.0]
        assert got[2]["v"] == [] and got[2]["lon"] == []
    seam = crop_arrays(df.filter("id = 1"), "lon", "lat", ["v"], 150.0, -150.0, 0.0, 55.0)
    out = rows(grid_to_cells(seam, ["id"], "lon", "lat", "v"), "lon", "value")
    assert out == [(-150.0, 7.0), (150.0, 5.0), (180.0, 6.0)]


def test_hot_cell_of_a_wind_grid_is_dealt_over_tasks(spark):
    stations = spark.range(40).selectExpr("id AS station", "70.0D AS lat", "-45.0D + id % 2 AS lon")
    records = spark.range(30).selectExpr(
        "id AS at", "array(0.0D, 45.0D, 315.0D) AS lon", "array(68.0D, 70.0D) AS lat",
        "transform(sequence(0, 5), i -> 1.0D * id + i) AS uwnd", "transform(sequence(0, 5), i -> 0.5D * i) AS vwnd",
    )
    wind = fields.wind_from_arrays(stations, records, "at", (-90.0, -40.0, 64.0, 90.0), 45.0, 2.0, digits=3)
    want = [(s, t, t + 5.0, 2.5, round(math.hypot(t + 5.0, 2.5), 3)) for s in range(40) for t in range(30)]
    assert rows(wind, "station", "at", "uwnd", "vwnd", "speed") == sorted(want)
    left = spark.createDataFrame([(1, i % 70) for i in range(90)] + [(2, 0), (None, 1)], "k int, a int")
    right = spark.createDataFrame([(1, i % 50) for i in range(80)] + [(3, 0), (None, 1)], "k int, b int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = blocked_join(left, right, ["k"], rows=8)
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert rows(got, "k", "a", "b") == rows(left.join(right, "k"), "k", "a", "b")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_geodesic_steps_are_worked_out_once(spark):
    def vincenty(lon1, lat1, lon2, lat2):
        f, t = geo.FLATTENING, math.radians
        u1, u2, l = math.atan((1 - f) * math.tan(t(lat1))), math.atan((1 - f) * math.tan(t(lat2))), t(lon2 - lon1)
        lam = l
        for _ in range(21):
            sl, cl = math.sin(lam), math.cos(lam)
            ss = math.hypot(math.cos(u2) * sl, math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * cl)
            cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * cl
            sa = math.cos(u1) * math.cos(u2) * sl / ss
            c2, sg = 1 - sa * sa, math.atan2(ss, cs)
            mid = cs - 2 * math.sin(u1) * math.sin(u2) / c2
            c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            lam = l + (1 - c) * f * sa * (sg + c * ss * (mid + c * cs * (2 * mid * mid - 1)))
        u = c2 * (geo.A**2 - geo.B**2) / geo.B**2
        a, b = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768)), u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        third = b / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)
        return geo.B * a * (sg - b * ss * (mid + b / 4 * (cs * (2 * mid * mid - 1) - third)))

    rng = random.Random(8)
    places = [(rng.uniform(-180, 180), rng.uniform(-80, 80), rng.uniform(-20, 20), rng.uniform(-60, 60)) for _ in range(50)]
    places = [(a, b, a + c, max(-85.0, min(85.0, b + d))) for a, b, c, d in places]
    metres = geo.geodesic_m(*map(F.col, "abcd")).alias("m")
    got = spark.createDataFrame(places, "a double, b double, c double, d double").select("*", metres)
    assert got._jdf.queryExecution().analyzed().expressions().last().numberedTreeString().count("\n") < 2000
    for r in got.collect():
        assert r["m"] == pytest.approx(vincenty(*r[:4]), abs=1e-3)
    nothing = spark.sql("SELECT 1D AS a, CAST(NULL AS DOUBLE) AS b, 1D AS c, 2D AS d")
    assert nothing.select(metres).first()[0] is None


def test_products_of_a_hot_key_take_copies_in_proportion_to_its_rows(spark):
    def sides(n, m):
        return spark.range(n).selectExpr("1 AS k"), spark.range(m).selectExpr("1 AS k")

    for n, m in ((10_000, 100_000), (40_000, 400_000)):
        (_, a, b), = block_counts(*sides(n, m), ["k"]).collect()
        assert n * b + m * a <= n + m + 2 * math.sqrt(n * m * 256)
        assert a * b >= 256
    assert block_counts(*sides(600, 1100), ["k"]).collect() == [(1, 2, 3)]
    left = spark.createDataFrame([(1, i % 70, None if i % 9 else "x") for i in range(90)] + [(2, 0, "y"), (None, 1, "z")], "k int, a int, c string")
    right = spark.createDataFrame([(i % 50, 1) for i in range(80)] + [(0, 2), (0, 2), (3, 3), (1, None)], "b int, k int")
    for most, run in ((4, 3), (1, 8), (64, 256)):
        got = blocked_join(left, right, ["k"], rows=8, most=most, run=run)
        want = left.join(right, "k")
        assert got.columns == want.columns and got.count() == want.count()
        assert got.exceptAll(want).count() == 0
    keys = left.select("k")
    assert blocked_join(keys, right, ["k"], rows=8).groupBy("k", "b").count().exceptAll(keys.join(right, "k").groupBy("k", "b").count()).count() == 0


def test_wind_of_many_stations_takes_little_disk(spark, tmp_path):
    stations = spark.range(1200).selectExpr(
        "id AS station", "69.0D + (id * 37 % 190) / 100D AS lat", "-60.0D + (id * 53 % 1500) / 100D AS lon"
    )
    records = spark.range(1500).selectExpr(
        "id AS at", "array(0.0D, 315.0D) AS lon", "array(70.0D) AS lat",
        "array(0.0D, sin(id)) AS uwnd", "array(0.0D, cos(id * id)) AS vwnd",
    )
    wind = fields.wind_from_arrays(stations, records, "at", (-90.0, -40.0, 64.0, 90.0), 45.0, 2.0, digits=9)
    wind.write.parquet(f"{tmp_path}/wind")
    assert spark.read.parquet(f"{tmp_path}/wind").count() == 1_800_000
    assert sum(p.stat().st_size for p in (tmp_path / "wind").glob("*.parquet")) < 1_800_000
