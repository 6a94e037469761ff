"""Nearest cells, cells in polygons, regular grids, binned products, reprojection, areas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from polynya.functions.geodesy import PolarStereographic
from polynya.functions.scalars import clamp, known
from polynya.operators.ordered import Ordered
from polynya.operators.scale import durable, null_safe_join

LEAF_ROWS = 256
MAX_LEVELS = 13


def nearest(
    points: DataFrame,
    cells: DataFrame,
    point_xy: tuple[str, str],
    cell_xy: tuple[str, str],
    cell_id: str,
    out: str = "distance",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Add to every point the id and planar distance of its nearest cell (lowest id on ties).

    Exact, with no pairing of all points and cells: the cells are laid in nested tiles (each
    level cuts a side by four), and each point walks down the levels keeping only tiles that
    can still hold its nearest cell. Tile tables hold one row per occupied tile, so a crowded
    tile is one row until the last level; levels are added until the leaves are small. The
    tiles a point still considers are written after each level, which keeps the plan flat.
    """
    px, py = point_xy
    cx, cy = cell_xy
    spots = (
        cells.filter(known(F.col(cx)) & known(F.col(cy)))
        .groupBy(F.col(cx).cast("double").alias("_cx"), F.col(cy).cast("double").alias("_cy"))
        .agg(F.min(cell_id).alias("_cid"))
    )
    box = spots.agg(
        F.min("_cx").alias("x0"), F.min("_cy").alias("y0"), F.max("_cx").alias("x1"),
        F.max("_cy").alias("y1"), F.count(F.lit(1)).alias("n"),
    ).first()
    if not box["n"]:
        kind = dict(cells.dtypes)[cell_id]
        return points.withColumns({cell_id: F.lit(None).cast(kind), out: F.lit(None).cast("double")})
    side = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) * 1.001 or 1.0
    unit = spots.withColumns(
        {"_u": (F.col("_cx") - box["x0"]) / side, "_v": (F.col("_cy") - box["y0"]) / side}
    )

    def tile(level: int) -> list[Column]:
        n = float(4**level)
        return [
            F.floor(F.col("_u") * n).alias("_i"),
            F.floor(F.col("_v") * n).alias("_j"),
        ]

    levels = max(1, math.ceil(math.log(max(box["n"] / leaf_rows, 1), 16)))
    while levels < MAX_LEVELS:
        fullest = unit.groupBy(*tile(levels)).count().agg(F.max("count")).first()[0]
        if fullest <= leaf_rows:
            break
        levels = min(MAX_LEVELS, levels + max(1, math.ceil(math.log(fullest / leaf_rows, 16))))

    places = points.select(F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py")).filter(
        F.col("_px").isNotNull() & F.col("_py").isNotNull()
    ).distinct()
    front = places.withColumns({"_i": F.lit(0).cast("bigint"), "_j": F.lit(0).cast("bigint")})
    for level in range(1, levels + 1):
        occupied = unit.groupBy(*tile(level)).agg(
            F.min("_cx").alias("_xa"), F.max("_cx").alias("_xb"),
            F.min("_cy").alias("_ya"), F.max("_cy").alias("_yb"),
        )
        child = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_c")
        children = front.select("_px", "_py", "_i", "_j", child).select(
            "_px", "_py",
            (F.col("_i") * 4 + F.col("_c") % 4).alias("_i"),
            (F.col("_j") * 4 + F.floor(F.col("_c") / 4)).alias("_j"),
        )
        found = children.join(occupied, ["_i", "_j"])
        x, y = F.col("_px"), F.col("_py")
        near_x = F.greatest(F.col("_xa") - x, x - F.col("_xb"), F.lit(0.0))
        near_y = F.greatest(F.col("_ya") - y, y - F.col("_yb"), F.lit(0.0))
        far_x = F.greatest(F.abs(F.col("_xa") - x), F.abs(F.col("_xb") - x))
        far_y = F.greatest(F.abs(F.col("_ya") - y), F.abs(F.col("_yb") - y))
        scored = found.select(
            "_px", "_py", "_i", "_j",
            (near_x * near_x + near_y * near_y).alias("_near"),
            (far_x * far_x + far_y * far_y).alias("_far"),
        )
        reach = scored.groupBy("_px", "_py").agg(F.min("_far").alias("_reach"))
        front = scored.join(reach, ["_px", "_py"]).filter(
            F.col("_near") <= F.col("_reach") * (1 + 1e-12)
        ).select("_px", "_py", "_i", "_j")
        if level < levels:
            front = durable(front)
    leaves = unit.select("_cx", "_cy", "_cid", *tile(levels))
    dx, dy = F.col("_cx") - F.col("_px"), F.col("_cy") - F.col("_py")
    best = (
        front.join(leaves, ["_i", "_j"])
        .select("_px", "_py", (dx * dx + dy * dy).alias("_d2"), "_cid")
        .groupBy("_px", "_py")
        .agg(F.min(F.struct("_d2", "_cid")).alias("_best"))
        .select(
            F.col("_px").alias("_qx"), F.col("_py").alias("_qy"),
            F.col("_best._cid").alias(cell_id), F.sqrt("_best._d2").alias(out),
        )
    )
    match = (F.col(px).cast("double") == F.col("_qx")) & (F.col(py).cast("double") == F.col("_qy"))
    return points.join(best, match, "left").drop("_qx", "_qy")


def nearest_projected(
    points: DataFrame, cells: DataFrame, projection: PolarStereographic, cell_id: str = "cell_id",
    lon: str = "lon", lat: str = "lat",
) -> DataFrame:
    """Nearest cell by distance in projected metres; adds cell id and distance."""
    x, y = projection.forward(F.col(lon), F.col(lat))
    flat = lambda df: df.withColumns({"_mx": x, "_my": y})
    xy = ("_mx", "_my")
    return nearest(flat(points), flat(cells), xy, xy, cell_id).drop("_mx", "_my")


# -- regular grids --------------------------------------------------------------------------


def cell_extract(
    points: DataFrame, grid: DataFrame, lon: str, lat: str, west: float, south: float,
    dx: float, dy: float,
) -> DataFrame:
    """Rows of the regular grid (ix, iy) whose cell contains the point; null where none does.

    ``west``/``south`` are the centre of cell (0, 0).
    """
    ix = F.floor((F.col(lon) - F.lit(west)) / F.lit(dx) + 0.5).cast("int")
    iy = F.floor((F.col(lat) - F.lit(south)) / F.lit(dy) + 0.5).cast("int")
    return points.withColumns({"ix": ix, "iy": iy}).join(grid, ["ix", "iy"], "left")


def bin_rows(spark: SparkSession, rows: int) -> DataFrame:
    """Rows of the integerised sinusoidal grid: latitude, number of bins, first bin.

    Its size is the row count of the grid definition, not of the data.
    """
    lat = (F.col("id") + 0.5) * (180.0 / rows) - 90.0
    bins = F.floor(F.lit(2.0 * rows) * F.cos(F.radians(lat)) + 0.5)
    table = spark.range(0, rows, 1, 1).select(
        F.col("id").alias("row"), lat.alias("latitude"), bins.cast("bigint").alias("nbin")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("base", F.coalesce(F.sum("nbin").over(before), F.lit(0)) + 1)


def bin_lookup(bins: DataFrame, rows: int, bin_num: str = "bin_num") -> DataFrame:
    """Bin number to latitude and longitude: an equi-join on slices of the bin axis."""
    width = 2 * rows
    table = bin_rows(bins.sparkSession, rows)
    low, high = F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("nbin") - 1) / width)
    sliced = table.withColumn("_slice", F.explode(F.sequence(low, high)))
    joined = bins.withColumn("_slice", F.floor(F.col(bin_num) / width)).join(
        F.broadcast(sliced), "_slice"
    )
    inside = F.col(bin_num).between(F.col("base"), F.col("base") + F.col("nbin") - 1)
    lon = (F.col(bin_num) - F.col("base") + 0.5) * 360.0 / F.col("nbin") - 180.0
    return joined.filter(inside).withColumn("longitude", lon).drop("_slice", "row", "nbin", "base")


def reproject(
    grid: DataFrame, projection: PolarStereographic, resolution: float, west: float, south: float,
    dx: float, dy: float, low: float | None = None, high: float | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Regular lon/lat grid (ix, iy, lon, lat, value) to a grid in projected metres, bilinear.

    Cells with a missing neighbour are dropped; ``low``/``high`` clamp the result. ``by`` names the
    columns of several grids on the same cells, such as days.
    """
    x, y = projection.forward(F.col("lon"), F.col("lat"))
    corners = grid.select(x.alias("x"), y.alias("y")).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
    )
    along = lambda c: F.explode(
        F.sequence(F.floor(F.col(f"lo_{c}") / resolution), F.floor(F.col(f"hi_{c}") / resolution))
    )
    lines = corners.withColumn("px", along("x")).repartition("px")
    target = lines.withColumn("py", along("y")).select("px", "py")
    lon, lat = projection.inverse((F.col("px") + 0.5) * resolution, (F.col("py") + 0.5) * resolution)
    place = target.withColumns({"_fx": (lon - F.lit(west)) / F.lit(dx), "_fy": (lat - F.lit(south)) / F.lit(dy)})
    ix, iy = F.floor("_fx"), F.floor("_fy")
    wx, wy = F.col("_fx") - ix, F.col("_fy") - iy
    corner = lambda a, b: F.struct(
        (ix + a).cast("int").alias("ix"), (iy + b).cast("int").alias("iy"),
        ((wx if a else 1 - wx) * (wy if b else 1 - wy)).alias("w"),
    )
    near = place.select("px", "py", F.inline(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])))
    value = (
        near.join(grid.select(*by, "ix", "iy", "value"), ["ix", "iy"])
        .groupBy(*by, "px", "py")
        .agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count("value").alias("_n"))
        .filter(F.col("_n") == 4)
    )
    v = F.col("value")
    if low is not None:
        v = clamp(v, low, high)
    return value.select(
        *by, ((F.col("px") + 0.5) * resolution).alias("x"), ((F.col("py") + 0.5) * resolution).alias("y"),
        v.alias("value"),
    )


def squares(df: DataFrame, x: Column, y: Column, size: float, value: Column) -> DataFrame:
    """Points counted and averaged per projected square."""
    return df.groupBy(
        F.floor(x / size).alias("sx"), F.floor(y / size).alias("sy")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


# -- polygons -------------------------------------------------------------------------------


def box_rings(boxes: DataFrame, name: str, west: str, east: str, south: str, north: str) -> DataFrame:
    """Named boxes to closed rings of five vertices."""
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    vertex = [
        F.struct(F.lit(i).alias("seq"), F.col(a).alias("x"), F.col(b).alias("y"))
        for i, (a, b) in enumerate(corners)
    ]
    return boxes.select(F.col(name).alias("poly_id"), F.inline(F.array(*vertex)))


def ring_edges(vertices: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Vertices (keys, seq, x, y) to edges; an open ring is closed."""
    slim = vertices.select(*keys, "seq", "x", "y")
    steps = Ordered(slim, keys, ["seq"], **kw).frame(
        0, 1, lambda w: {"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}
    )
    inner = steps.filter(F.col("x2").isNotNull()).select(
        *keys, F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2"
    )
    ends = slim.groupBy(*keys).agg(
        F.max_by("x", "seq").alias("x1"), F.max_by("y", "seq").alias("y1"),
        F.min_by("x", "seq").alias("x2"), F.min_by("y", "seq").alias("y2"),
    )
    closing = ends.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    return inner.unionByName(closing)


def inside_polygons(
    points: DataFrame, point_id: str, x: str, y: str, edges: DataFrame, poly: str = "poly_id"
) -> DataFrame:
    """(point, polygon) for every point inside, holes counted out (crossing parity).

    A point id may come with several positions or several times; it is inside when one of its
    positions is. Polygons are sorted by size in powers of two. At each size the plane is cut in
    columns as wide as its polygons, which then touch two columns or so, and in bands as many
    per polygon as it has edges on average. A point looks, at each size, only at the edges of its
    column and band, and only edges that a ray to the east really crosses leave the join.
    """
    low = lambda c: F.min(F.least(f"{c}1", f"{c}2"))
    high = lambda c: F.max(F.greatest(f"{c}1", f"{c}2"))
    extent = edges.groupBy(poly).agg(
        low("x").alias("_west"), high("x").alias("_east"), low("y").alias("_south"),
        high("y").alias("_north"), F.count(F.lit(1)).alias("_n"),
    )
    wide, tall = F.col("_east") - F.col("_west"), F.col("_north") - F.col("_south")
    size = F.greatest(wide, tall)
    extent = extent.filter((wide > 0) & (tall > 0) & (size < float("inf"))).select(
        poly, "_west", "_east", "_n", F.ceil(F.log2(size)).cast("int").alias("_size")
    )
    per_size = extent.groupBy("_size").agg(F.ceil(F.avg("_n")).cast("bigint").alias("_bands"))
    # One row; it lists one entry for each exponent of a double at most.
    scales = per_size.agg(F.collect_list(F.struct("_size", "_bands")).alias("_scales"))
    extent = extent.join(F.broadcast(per_size), "_size")
    side, bands = F.pow(F.lit(2.0), F.col("_size")), F.col("_bands")
    column, band = (lambda c: F.floor(c / side)), (lambda c: F.floor(c * bands / side))
    sized = null_safe_join(edges.filter(F.col("y1") != F.col("y2")), extent, [poly])
    cut = sized.withColumn(
        "_column", F.explode(F.sequence(column(F.col("_west")), column(F.col("_east"))))
    ).withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    at = points.select(point_id, F.col(x).alias("_x"), F.col(y).alias("_y")).filter(
        known(F.col("_x")) & known(F.col("_y"))
    ).distinct()
    at = at.crossJoin(F.broadcast(scales)).select("*", F.inline("_scales")).drop("_scales")
    at = at.withColumn("_column", column(F.col("_x"))).withColumn("_band", band(F.col("_y")))
    spans = (F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))
    cross_x = F.col("x1") + (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (
        F.col("x2") - F.col("x1")
    )
    crossed = at.join(cut.drop("_bands"), ["_size", "_column", "_band"]).filter(spans & (F.col("_x") < cross_x))
    return (
        crossed.groupBy(point_id, "_x", "_y", poly)
        .agg((F.count(F.lit(1)) % 2).alias("_odd"))
        .filter(F.col("_odd") == 1)
        .select(point_id, poly)
        .distinct()
    )


def polygon_mask(
    cells: DataFrame, cell_id: str, x: str, y: str, edges: DataFrame, poly: str = "poly_id",
    crop: bool = True,
) -> DataFrame:
    """Cells outside every polygon, optionally only those within the polygons' extent."""
    kept = cells
    if crop:
        e = edges.agg(
            *[
                f(g(f"{c}1", f"{c}2")).alias(f"{n}_{c}")
                for c in ("x", "y")
                for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))
            ]
        )
        within = F.col(x).between(F.col("lo_x"), F.col("hi_x")) & F.col(y).between(F.col("lo_y"), F.col("hi_y"))
        kept = cells.crossJoin(F.broadcast(e)).filter(within).drop(*e.columns)  # one row
    inside = inside_polygons(kept, cell_id, x, y, edges, poly).select(cell_id).distinct()
    return null_safe_join(kept, inside, [cell_id], "left_anti")


def polygon_area(
    vertices: DataFrame, keys: Sequence[str], by: Sequence[str], hole: str, divisor: float = 1000.0, **kw
) -> DataFrame:
    """Sum of ring areas (holes negative) per ``by``, over ``divisor``. ``keys`` name a ring."""
    edges = ring_edges(vertices, [*keys, hole], **kw)
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    rings = edges.groupBy(*keys, hole).agg((F.abs(twice) / 2).alias("_area"))
    signed = F.when(F.col(hole), -F.col("_area")).otherwise(F.col("_area"))
    return rings.groupBy(*by).agg((F.sum(signed) / F.lit(divisor)).alias("area"))
