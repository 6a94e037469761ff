"""Nearest cells, polygons, grids, projections, distances and the field pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from polynya.functions import geodesy as geo
from polynya.operators import spatial as sp
from polynya.plans import fields, ice
from polynya.sources import grids
from registry import views as v
from registry.base import query
from registry.views import sql_with


def num(f: float) -> str:
    return f"CAST({f!r} AS DOUBLE)"


def forward_sql(p: geo.PolarStereographic, lon: str, lat: str) -> tuple[str, str]:
    s = f"({num(geo.E)} * sin(radians({lat})))"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {s}) / (1 + {s}), {num(geo.E / 2)}))"
    lam = f"radians({lon} - {num(p.lon_0)})"
    return f"({num(p.scale)} * {t} * sin({lam}))", f"(-{num(p.scale)} * {t} * cos({lam}))"


def inverse_sql(p: geo.PolarStereographic, x: str, y: str) -> tuple[str, str]:
    chi = f"(pi() / 2 - 2 * atan(sqrt({x} * {x} + {y} * {y}) / {num(p.scale)}))"
    terms = " + ".join(f"{num(c)} * sin({chi} * {2 * k})" for k, c in enumerate(geo.LATITUDE_SERIES, 1))
    return f"({num(p.lon_0)} + degrees(atan2({x}, -{y})))", f"degrees({chi} + {terms})"


def crossing_sql(points: str, pid: str, edges: str) -> str:
    """Pairs (point, polygon) inside, by crossing parity."""
    return f"""SELECT p.{pid}, e.poly_id FROM {points} p JOIN {edges} e ON (e.y1 > p.lat) != (e.y2 > p.lat)
        AND p.lon < e.x1 + (p.lat - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) GROUP BY 1, 2 HAVING count(*) % 2 = 1"""


_SX, _SY = forward_sql(geo.SEA_ICE, "lon", "lat")

_NEAR = f""", cx AS (SELECT cell_id, lon AS clon, lat AS clat, {_SX} AS mx, {_SY} AS my FROM cells WHERE lon BETWEEN -65 AND -50 AND lat BETWEEN 65 AND 72),
   sx AS (SELECT station, lon, lat, {_SX} AS x, {_SY} AS y FROM stations),
   near AS (SELECT * FROM (SELECT station, lon, lat, cell_id, clon, clat, sqrt((mx - x) * (mx - x) + (my - y) * (my - y)) AS distance,
     row_number() OVER (PARTITION BY station ORDER BY (mx - x) * (mx - x) + (my - y) * (my - y), cell_id) AS rn FROM sx, cx) WHERE rn = 1)"""


def near_table(t):
    area = v.cells(t).filter("lon BETWEEN -65 AND -50 AND lat BETWEEN 65 AND 72")
    found = sp.nearest_projected(v.stations(t), area, geo.SEA_ICE)
    places = area.select("cell_id", F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    return found.join(places, "cell_id")


@query(
    "nearest_cell",
    sql_with("stations cells", _NEAR + "SELECT station, cell_id, clon, clat, round(distance, 3) AS distance FROM near"),
)
def nearest_cell(t):
    return near_table(t).select("station", "cell_id", "clon", "clat", F.round("distance", 3).alias("distance"))


@query(
    "knn_degrees",
    sql_with(
        "stations cells",
        """SELECT station, cell_id, round(d, 9) AS distance FROM (SELECT station, cell_id, sqrt((c.lon - s.lon) * (c.lon - s.lon) + (c.lat - s.lat) * (c.lat - s.lat)) AS d,
           row_number() OVER (PARTITION BY station ORDER BY (c.lon - s.lon) * (c.lon - s.lon) + (c.lat - s.lat) * (c.lat - s.lat), cell_id) AS rn
           FROM stations s, cells c) WHERE rn = 1""",
    ),
)
def knn_degrees(t):
    found = sp.nearest(v.stations(t), v.cells(t), ("lon", "lat"), ("lon", "lat"), "cell_id")
    return found.select("station", "cell_id", F.round("distance", 9).alias("distance"))


v._view(
    "daily_grid",
    """SELECT l_partkey AS cell_id, CAST(l_shipdate AS DATE) AS ice_date, round(avg(l_quantity * 2), 6) AS sic FROM lineitem GROUP BY 1, 2""",
)


def daily_grid(t):
    return t.lineitem.groupBy(
        F.col("l_partkey").alias("cell_id"), F.to_date("l_shipdate").alias("ice_date")
    ).agg(F.round(F.avg(F.col("l_quantity") * 2), 6).alias("sic"))


@query(
    "sic_history",
    sql_with(
        "stations cells daily_grid",
        _NEAR
        + f"""SELECT station, -lon AS long_deg_w, lat AS lat_deg_n, ice_date, round(distance, 3) AS distance,
              round(sic * {num(ice.SIC_SCALE)}, 9) AS sic FROM near JOIN daily_grid USING (cell_id)""",
    ),
)
def sic_history(t):
    st = v.stations(t).select("station", (-F.col("lon")).alias("long_deg_w"), F.col("lat").alias("lat_deg_n"))
    out = ice.sic_history(st, v.cells(t), daily_grid(t))
    return out.withColumns({"distance": F.round("distance", 3), "sic": F.round("sic", 9)})


_CAMP = (-63.78953333333333, 67.47973333333333)


@query(
    "sic_point_history",
    sql_with(
        "cells daily_grid",
        f"""SELECT cell_id, ice_date, sic, {num(_CAMP[0])} AS lon, {num(_CAMP[1])} AS lat, CAST(year(ice_date) AS INTEGER) AS year
            FROM daily_grid WHERE cell_id = (SELECT cell_id FROM cells ORDER BY (lon - {num(_CAMP[0])}) * (lon - {num(_CAMP[0])})
              + (lat - {num(_CAMP[1])}) * (lat - {num(_CAMP[1])}), cell_id LIMIT 1)""",
    ),
)
def sic_point_history(t):
    point = t.spark.range(1).select(F.lit(_CAMP[0]).alias("lon"), F.lit(_CAMP[1]).alias("lat"))
    out = ice.sic_point_history(point, v.cells(t), daily_grid(t))
    return out.select("cell_id", "ice_date", "sic", "lon", "lat", "year")


@query(
    "sampling_day_value",
    sql_with("ice_sampled", "SELECT station, ice_date, sic FROM ice_sampled WHERE ice_date = sampling_date"),
)
def sampling_day_value(t):
    return ice.sampling_day_value(v.ice_sampled(t)).select("station", "ice_date", "sic")


@query(
    "sic_daily_summary",
    sql_with(
        "ice_daily",
        """SELECT ice_date, round(m, 6) AS mean_sic, round(s, 6) AS sd_sic, round(m - s, 6) AS low, round(m + s, 6) AS high FROM
           (SELECT ice_date, avg(sic * 100) AS m, stddev_samp(sic * 100) AS s FROM ice_daily GROUP BY 1)""",
    ),
)
def sic_daily_summary(t):
    out = ice.sic_daily_summary(v.ice_daily(t))
    return out.select("ice_date", *[F.round(c, 6).alias(c) for c in ("mean_sic", "sd_sic", "low", "high")])


# -- regular grids --------------------------------------------------------------------------

_IX = "CAST(floor((lon - -66) / 0.4::DOUBLE + 0.5::DOUBLE) AS INTEGER)"
_IY = "CAST(floor((lat - 64.5::DOUBLE) / 0.2::DOUBLE + 0.5::DOUBLE) AS INTEGER)"


@query(
    "cell_extract",
    sql_with(
        "stations grid",
        f"""SELECT station, s.ix, s.iy, value FROM (SELECT station, {_IX} AS ix, {_IY} AS iy FROM stations) s
            LEFT JOIN grid g ON g.ix = s.ix AND g.iy = s.iy""",
    ),
)
def cell_extract(t):
    g = v.grid(t).select("ix", "iy", "value")
    out = sp.cell_extract(v.stations(t), g, "lon", "lat", -66.0, 64.5, 0.4, 0.2)
    return out.select("station", "ix", "iy", "value")


_MONTHS = list(range(1, 13))
_BANDS = [f"X2016.{m:02d}.01.00.00.00" for m in _MONTHS]


def component(t, value):
    ix, iy = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    base = t.lineitem.select(
        ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), F.month("l_shipdate").alias("m"), value.alias("v")
    )
    wide = base.groupBy("ix", "iy").pivot("m", _MONTHS).agg(F.round(F.avg("v"), 9))
    return wide.toDF("ix", "iy", *_BANDS)


@query(
    "wind_speed",
    sql_with(
        "stations",
        f""", g AS (SELECT CAST(l_suppkey % 40 AS INTEGER) AS ix, CAST(l_partkey % 40 AS INTEGER) AS iy, month(l_shipdate) AS m,
             round(avg(l_quantity - 25), 9) AS u, round(avg(l_tax * 100), 9) AS w FROM lineitem GROUP BY 1, 2, 3),
           s AS (SELECT station, lat, lon, {_IX} AS ix, {_IY} AS iy, unnest(range(1, 13)) AS m FROM stations)
           SELECT station, lat, lon, CAST(make_timestamp(2016, s.m, 1, 0, 0, 0) AS TIMESTAMP) AS wind_date, u AS uwnd, w AS vwnd,
           round(sqrt(u * u + w * w), 9) AS speed FROM s LEFT JOIN g ON g.ix = s.ix AND g.iy = s.iy AND g.m = s.m""",
    ),
)
def wind_speed(t):
    out = fields.wind_speed(
        v.stations(t), component(t, F.col("l_quantity") - 25), component(t, F.col("l_tax") * 100),
        _BANDS, ["station", "lat", "lon"], -66.0, 64.5, 0.4, 0.2,
    )
    return out.withColumn("speed", F.round("speed", 9))


_ARR = "[" + ", ".join(f"CAST(e[{i}] AS DOUBLE)" for i in range(1, 65)) + "]"


def array_files(t):
    n = F.col("vec_id")
    name = F.format_string(
        "MOD08_D3.A%d%03d.hdf", (2000 + F.floor(n / 365)).cast("int"), (n % 365 + 1).cast("int")
    )
    return t.embeddings.select(
        "vec_id", name.alias("name"),
        F.expr("transform(sequence(0, 7), i -> 45.0D * i)").alias("lon"),
        F.expr("transform(sequence(0, 7), i -> 60 + 2.0D * i)").alias("lat"),
        "embedding", F.reverse("embedding").alias("second"),
    )


@query(
    "wind_speed_arrays",
    sql_with(
        "stations",
        """, px AS (SELECT vec_id, i % 8 AS c, i // 8 AS r, CAST(embedding[i + 1] AS DOUBLE) AS u, CAST(embedding[len(embedding) - i] AS DOUBLE) AS w
             FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)),
           cells AS (SELECT vec_id, u, w, (CASE WHEN 45 * c > 180 THEN 45 * c - 360 ELSE 45 * c END)::DOUBLE AS lon, 60 + 2.0::DOUBLE * r AS lat FROM px)
           SELECT station, s.lat, s.lon, CAST(TIMESTAMP '2016-05-01 00:00:00' + to_hours(vec_id) AS TIMESTAMP) AS wind_date,
           u AS uwnd, w AS vwnd, round(sqrt(u * u + w * w), 9) AS speed
           FROM stations s JOIN cells c ON c.lon BETWEEN -90 AND -40 AND c.lat BETWEEN 64 AND 90
           AND s.lon >= c.lon - 22.5::DOUBLE AND s.lon < c.lon + 22.5::DOUBLE AND s.lat >= c.lat - 1 AND s.lat < c.lat + 1""",
    ),
)
def wind_speed_arrays(t):
    hours = F.make_dt_interval(hours=F.col("vec_id"))
    records = array_files(t).select(
        (F.to_timestamp_ntz(F.lit("2016-05-01 00:00:00")) + hours).alias("wind_date"), "lon", "lat",
        F.col("embedding").alias("uwnd"), F.col("second").alias("vwnd"),
    )
    out = fields.wind_from_arrays(v.stations(t), records, "wind_date", (-90.0, -40.0, 64.0, 90.0), 45.0, 2.0, digits=9)
    return out.select("station", "lat", "lon", "wind_date", "uwnd", "vwnd", "speed")


_CELL = """CASE WHEN 45 * (i % 8) > 180 THEN 45.0::DOUBLE * (i % 8) - 360 ELSE 45.0::DOUBLE * (i % 8) END AS lon, 60 + 2.0::DOUBLE * (i // 8) AS lat"""


@query(
    "grid_to_cells",
    f"""SELECT vec_id, CAST(i AS INTEGER) AS cell_id, {_CELL}, CAST(embedding[i + 1] AS DOUBLE) * {num(ice.SIC_SCALE)} AS value,
        CAST(DATE '1978-01-01' + CAST(vec_id AS INTEGER) AS DATE) AS day FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def grid_to_cells(t):
    from polynya.functions.scalars import from_epoch_days

    cells = grids.grid_to_cells(array_files(t), ["vec_id"], "lon", "lat", "embedding", ice.SIC_SCALE)
    return cells.withColumn("day", from_epoch_days(F.col("vec_id"), "1978-01-01"))


@query(
    "bands_to_long",
    """SELECT vec_id, CAST(make_timestamp(2016, 1 + (b - 1) // 28, 1 + (b - 1) % 28, 6 * (b % 4), 0, 0) AS TIMESTAMP) AS time, CAST(embedding[b] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS b FROM embeddings)""",
)
def bands_to_long(t):
    names = [f"X2016.{1 + (b - 1) // 28:02d}.{1 + (b - 1) % 28:02d}.{6 * (b % 4):02d}.00.00" for b in range(1, 65)]
    wide = t.embeddings.select(
        "vec_id", *[F.get("embedding", F.lit(b)).cast("double").alias(n) for b, n in enumerate(names)]
    )
    return grids.bands_to_long(wide, ["vec_id"], names, "time", "value")


@query(
    "cloud_daily",
    f"""SELECT {_CELL}, CAST(make_date(2000 + CAST(vec_id // 365 AS INTEGER), 1, 1) + CAST(vec_id % 365 AS INTEGER) AS DATE) AS day,
        CAST(embedding[i + 1] AS DOUBLE) AS cot, CAST(embedding[len(embedding) - i] AS DOUBLE) AS cf
        FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def cloud_daily(t):
    return fields.cloud_daily(array_files(t), "embedding", "second")


_INV_LON, _INV_LAT = inverse_sql(geo.SEA_ICE, "((px + 0.5::DOUBLE) * 40000)", "((py + 0.5::DOUBLE) * 40000)")


@query(
    "grid_reproject",
    sql_with(
        "grid",
        f""", ext AS (SELECT floor(min({_SX}) / 40000) AS x1, floor(max({_SX}) / 40000) AS x2, floor(min({_SY}) / 40000) AS y1, floor(max({_SY}) / 40000) AS y2 FROM grid),
           tx AS (SELECT CAST(unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT) + 1)) AS DOUBLE) AS px FROM ext),
           ty AS (SELECT CAST(unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT) + 1)) AS DOUBLE) AS py FROM ext),
           pl AS (SELECT px, py, ({_INV_LON} + 66) / 0.4::DOUBLE AS fx, ({_INV_LAT} - 64.5::DOUBLE) / 0.2::DOUBLE AS fy FROM tx, ty),
           cn AS (SELECT px, py, fx, fy, floor(fx) AS ix, floor(fy) AS iy, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM pl),
           wt AS (SELECT px, py, CAST(ix + a AS INTEGER) AS ix, CAST(iy + b AS INTEGER) AS iy,
             CASE WHEN a = 1 THEN fx - ix ELSE 1 - (fx - ix) END * CASE WHEN b = 1 THEN fy - iy ELSE 1 - (fy - iy) END AS w FROM cn)
           SELECT (px + 0.5::DOUBLE) * 40000 AS x, (py + 0.5::DOUBLE) * 40000 AS y, round(least(greatest(sum(w * value), 35000), 60000), 3) AS value
           FROM wt JOIN grid USING (ix, iy) GROUP BY px, py HAVING count(value) = 4""",
    ),
)
def grid_reproject(t):
    out = sp.reproject(v.grid(t), geo.SEA_ICE, 40000.0, -66.0, 64.5, 0.4, 0.2, 35000.0, 60000.0)
    return out.withColumn("value", F.round("value", 3))


# Land with a hole in each polygon, and the grid of each day.
v._view(
    "land",
    """SELECT poly_id, 0 AS ring, seq, x, y FROM rings UNION ALL
       SELECT poly_id, 1, seq, (-66 + 4 * poly_id) + 0.4::DOUBLE * (x - (-66 + 4 * poly_id)), 68 + 0.4::DOUBLE * (y - 68) FROM rings""",
    "rings",
)
v._view(
    "day_grid",
    """SELECT CAST(l_linenumber AS INTEGER) AS day, CAST(l_suppkey % 40 AS INTEGER) AS ix, CAST(l_partkey % 40 AS INTEGER) AS iy,
       -66 + 0.4::DOUBLE * (l_suppkey % 40) AS lon, 64.5::DOUBLE + 0.2::DOUBLE * (l_partkey % 40) AS lat,
       round(avg(l_extendedprice), 6) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
)


def land(t):
    rings = v.rings(t)
    cx, cy = -66 + 4 * F.col("poly_id"), F.lit(68.0)
    hole = rings.select(
        "poly_id", F.lit(1).alias("ring"), "seq", (cx + F.lit(0.4) * (F.col("x") - cx)).alias("x"),
        (cy + F.lit(0.4) * (F.col("y") - cy)).alias("y"),
    )
    return rings.select("poly_id", F.lit(0).alias("ring"), "seq", "x", "y").unionByName(hole)


def day_grid(t):
    ix, iy = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    return t.lineitem.groupBy(
        F.col("l_linenumber").cast("int").alias("day"), ix.cast("int").alias("ix"), iy.cast("int").alias("iy"),
        (F.lit(-66) + F.lit(0.4) * ix).alias("lon"), (F.lit(64.5) + F.lit(0.2) * iy).alias("lat"),
    ).agg(F.round(F.avg("l_extendedprice"), 6).alias("value")).withColumn("cell_id", F.col("iy") * 40 + F.col("ix"))


@query(
    "grid_map",
    sql_with(
        "day_grid land",
        f""", ed AS (SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
             FROM land WINDOW w AS (PARTITION BY poly_id, ring ORDER BY seq)),
           spot AS (SELECT DISTINCT iy * 40 + ix AS cell_id, lon, lat FROM day_grid),
           grid AS (SELECT * FROM day_grid WHERE lon BETWEEN (SELECT min(x) FROM land) AND (SELECT max(x) FROM land)
             AND lat BETWEEN (SELECT min(y) FROM land) AND (SELECT max(y) FROM land)
             AND iy * 40 + ix NOT IN (SELECT cell_id FROM ({crossing_sql('spot', 'cell_id', 'ed')}))),
           ext AS (SELECT floor(min({_SX}) / 40000) AS x1, floor(max({_SX}) / 40000) AS x2, floor(min({_SY}) / 40000) AS y1, floor(max({_SY}) / 40000) AS y2 FROM grid),
           tx AS (SELECT CAST(unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT) + 1)) AS DOUBLE) AS px FROM ext),
           ty AS (SELECT CAST(unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT) + 1)) AS DOUBLE) AS py FROM ext),
           pl AS (SELECT px, py, ({_INV_LON} + 66) / 0.4::DOUBLE AS fx, ({_INV_LAT} - 64.5::DOUBLE) / 0.2::DOUBLE AS fy FROM tx, ty),
           cn AS (SELECT px, py, fx, fy, floor(fx) AS ix, floor(fy) AS iy, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM pl),
           wt AS (SELECT px, py, CAST(ix + a AS INTEGER) AS ix, CAST(iy + b AS INTEGER) AS iy,
             CASE WHEN a = 1 THEN fx - ix ELSE 1 - (fx - ix) END * CASE WHEN b = 1 THEN fy - iy ELSE 1 - (fy - iy) END AS w FROM cn)
           SELECT day, (px + 0.5::DOUBLE) * 40000 AS x, (py + 0.5::DOUBLE) * 40000 AS y, round(least(greatest(sum(w * value), 35000), 60000), 3) AS value
           FROM wt JOIN grid USING (ix, iy) GROUP BY day, px, py HAVING count(value) = 4""",
    ),
)
def grid_map(t):
    edges = sp.ring_edges(land(t), ["poly_id", "ring"], small=True)
    out = fields.grid_map(
        day_grid(t), edges, geo.SEA_ICE, 40000.0, (-66.0, 64.5), (0.4, 0.2), (35000.0, 60000.0), by=["day"]
    )
    return out.withColumn("value", F.round("value", 3))


_CX, _CY = forward_sql(geo.CAMERA, "lon", "lat")


@query(
    "project_points",
    sql_with(
        "cells",
        f"""SELECT 'sea_ice' AS projection, CAST(floor({_SX} / 25000) AS BIGINT) AS sx, CAST(floor({_SY} / 25000) AS BIGINT) AS sy, count(*) AS n, round(avg(value), 9) AS mean FROM cells GROUP BY 1, 2, 3
            UNION ALL SELECT 'camera', CAST(floor({_CX} / 25000) AS BIGINT), CAST(floor({_CY} / 25000) AS BIGINT), count(*), round(avg(value), 9) FROM cells GROUP BY 1, 2, 3""",
    ),
)
def project_points(t):
    cells = v.cells(t)
    parts = []
    for name, p in (("sea_ice", geo.SEA_ICE), ("camera", geo.CAMERA)):
        x, y = p.forward(F.col("lon"), F.col("lat"))
        parts.append(sp.squares(cells, x, y, 25000.0, F.col("value")).select(F.lit(name).alias("projection"), "sx", "sy", "n", F.round("mean", 9).alias("mean")))
    return parts[0].unionByName(parts[1])


_FL = num(geo.FLATTENING)


def sphere_sql(lam: str) -> str:
    return f"""su1, cu1, su2, cu2, l, {lam} AS lam, sqrt(pow(cu2 * sin({lam}), 2) + pow(cu1 * su2 - su1 * cu2 * cos({lam}), 2)) AS ss,
        su1 * su2 + cu1 * cu2 * cos({lam}) AS cs"""


_GEO = f""", start AS (SELECT station, cell_id, sin(atan((1 - {_FL}) * tan(radians(lat)))) AS su1, cos(atan((1 - {_FL}) * tan(radians(lat)))) AS cu1,
     sin(atan((1 - {_FL}) * tan(radians(clat)))) AS su2, cos(atan((1 - {_FL}) * tan(radians(clat)))) AS cu2, radians(clon - lon) AS l FROM near),
   it AS (SELECT station, cell_id, 0 AS i, su1, cu1, su2, cu2, l, l AS lam FROM start
     UNION ALL SELECT station, cell_id, i + 1, su1, cu1, su2, cu2, l,
       l + (1 - c) * {_FL} * sa * (sg + c * ss * (mid + c * cs * (2 * mid * mid - 1))) FROM
       (SELECT *, {_FL} / 16 * c2 * (4 + {_FL} * (4 - 3 * c2)) AS c FROM
        (SELECT *, 1 - sa * sa AS c2, coalesce(cs - 2 * su1 * su2 / nullif(1 - sa * sa, 0), 0) AS mid FROM
         (SELECT *, coalesce(cu1 * cu2 * sin(lam) / nullif(ss, 0), 0) AS sa, atan2(ss, cs) AS sg FROM
          (SELECT station, cell_id, i, {sphere_sql('lam')} FROM it WHERE i < 20))))),
   fin AS (SELECT station, cell_id, {num(geo.B)} * aa * (sg - bb * ss * (mid + bb / 4 * (cs * (2 * mid * mid - 1) - bb / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))) AS metres FROM
     (SELECT *, 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768)) AS aa, u / 1024 * (256 + u * (u * (74 - 47 * u) - 128)) AS bb FROM
      (SELECT *, c2 * {num((geo.A**2 - geo.B**2) / geo.B**2)} AS u FROM
       (SELECT *, 1 - sa * sa AS c2, coalesce(cs - 2 * su1 * su2 / nullif(1 - sa * sa, 0), 0) AS mid FROM
        (SELECT *, coalesce(cu1 * cu2 * sin(lam) / nullif(ss, 0), 0) AS sa, atan2(ss, cs) AS sg FROM
         (SELECT station, cell_id, {sphere_sql('lam')} FROM it WHERE i = 20))))))"""


@query(
    "geodesic_distance",
    sql_with(
        "stations cells",
        _NEAR + _GEO
        + """SELECT 'row' AS kind, station, round(metres, 3) AS metres FROM fin UNION ALL SELECT 'min', NULL, round(min(metres), 3) FROM fin
             UNION ALL SELECT 'mean', NULL, round(avg(metres), 3) FROM fin UNION ALL SELECT 'max', NULL, round(max(metres), 3) FROM fin""",
        recursive=True,
    ),
)
def geodesic_distance(t):
    near = near_table(t).select(
        "station",
        geo.geodesic_m(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")).alias("metres"),
    )
    stats = near.agg(F.min("metres").alias("min"), F.avg("metres").alias("mean"), F.max("metres").alias("max"))
    none = F.lit(None).cast("bigint").alias("station")
    summary = stats.unpivot([], ["min", "mean", "max"], "kind", "metres").select("kind", none, "metres")
    rows = near.select(F.lit("row").alias("kind"), "station", "metres")
    return rows.unionByName(summary).withColumn("metres", F.round("metres", 3))


@query(
    "bin_lookup",
    """WITH rw AS (SELECT r, (r + 0.5::DOUBLE) * (180.0::DOUBLE / 180) - 90 AS latitude, CAST(floor(2.0::DOUBLE * 180 * cos(radians((r + 0.5::DOUBLE) * (180.0::DOUBLE / 180) - 90)) + 0.5::DOUBLE) AS BIGINT) AS nbin
         FROM (SELECT unnest(range(180)) AS r)),
       tb AS (SELECT *, 1 + sum(nbin) OVER (ORDER BY r) - nbin AS base FROM rw),
       b AS (SELECT p_partkey, (p_partkey * 7919) % 41000 + 1 AS bin_num, p_retailprice AS total, 1 + p_size AS weights FROM part)
       SELECT p_partkey, bin_num, round(latitude, 6) AS latitude, round((bin_num - base + 0.5::DOUBLE) * 360.0::DOUBLE / nbin - 180, 6) AS longitude,
       round(total / weights, 6) AS chla FROM b JOIN tb ON bin_num BETWEEN base AND base + nbin - 1""",
)
def bin_lookup(t):
    k = F.col("p_partkey")
    bins = t.part.select(
        k, ((k * 7919) % 41000 + 1).alias("bin_num"), F.col("p_retailprice").alias("total"), (1 + F.col("p_size")).alias("weights")
    )
    out = sp.bin_lookup(bins, 180)
    return out.select(
        "p_partkey", "bin_num", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"),
        F.round(F.col("total") / F.col("weights"), 6).alias("chla"),
    )


# -- polygons -------------------------------------------------------------------------------


_EDGES = """, ed AS (SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
    FROM rings WINDOW w AS (PARTITION BY poly_id ORDER BY seq))"""


@query(
    "polygon_mask",
    sql_with(
        "cells rings",
        _EDGES
        + f"""SELECT cell_id, lon, lat, value FROM cells WHERE lon BETWEEN (SELECT min(x) FROM rings) AND (SELECT max(x) FROM rings)
              AND lat BETWEEN (SELECT min(y) FROM rings) AND (SELECT max(y) FROM rings)
              AND cell_id NOT IN (SELECT cell_id FROM ({crossing_sql('cells', 'cell_id', 'ed')}))""",
    ),
)
def polygon_mask(t):
    edges = sp.ring_edges(v.rings(t), ["poly_id"], small=True)
    return sp.polygon_mask(v.cells(t), "cell_id", "lon", "lat", edges).select("cell_id", "lon", "lat", "value")


@query(
    "area_polygon",
    sql_with(
        "cells",
        f""", box AS (SELECT CAST(n_nationkey AS BIGINT) AS poly_id, -66 + 0.7::DOUBLE * n_nationkey AS w, -66 + 0.7::DOUBLE * n_nationkey + 1.5::DOUBLE AS e,
             65 + 0.2::DOUBLE * n_nationkey AS s, 65 + 0.2::DOUBLE * n_nationkey + 1.1::DOUBLE AS n FROM nation)
           SELECT poly_id, count(*) AS n_cells FROM cells JOIN box ON lon >= w AND lon < e AND lat >= s AND lat < n GROUP BY 1""",
    ),
)
def area_polygon(t):
    k = F.col("n_nationkey")
    west, south = F.lit(-66) + F.lit(0.7) * k, F.lit(65) + F.lit(0.2) * k
    boxes = t.nation.select(
        k.cast("bigint").alias("poly_id"), west.alias("w"), (west + F.lit(1.5)).alias("e"), south.alias("s"), (south + F.lit(1.1)).alias("n")
    )
    edges = sp.ring_edges(sp.box_rings(boxes, "poly_id", "w", "e", "s", "n"), ["poly_id"], small=True)
    inside = sp.inside_polygons(v.cells(t), "cell_id", "lon", "lat", edges)
    return inside.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n_cells"))


_DAY_RINGS = """(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS hole, k AS seq,
    (o_custkey % 90) * 1000 + o_totalprice / 100 * cos(2 * pi() * k / 5) AS x, 5000 + o_totalprice / 100 * sin(2 * pi() * k / 5) AS y
    FROM (SELECT *, unnest(range(5)) AS k FROM orders))"""


@query(
    "polygon_area_daily",
    f"""SELECT day, round(sum(CASE WHEN hole THEN -area ELSE area END) / 1000, 4) AS area FROM
        (SELECT day, hole, o_orderkey, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM
         (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {_DAY_RINGS}
          WINDOW w AS (PARTITION BY o_orderkey ORDER BY seq)) GROUP BY 1, 2, 3) WHERE day != DATE '1996-07-13' GROUP BY 1""",
)
def polygon_area_daily(t):
    o = t.orders.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4))))
    angle = 2 * F.pi() * F.col("seq") / 5
    r = F.col("o_totalprice") / 100
    vertices = o.select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("hole"), "seq",
        ((F.col("o_custkey") % 90) * 1000 + r * F.cos(angle)).alias("x"), (F.lit(5000) + r * F.sin(angle)).alias("y"),
    )
    daily = sp.polygon_area(vertices, ["o_orderkey", "day"], ["day"], "hole")
    return daily.filter(F.col("day") != F.to_date(F.lit("1996-07-13"))).withColumn("area", F.round("area", 4))
