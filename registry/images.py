"""Image operators on the pixel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from polynya.operators import images as im
from registry import views as v
from registry.base import query
from registry.views import sql_with


@query(
    "image_crop_flip",
    sql_with(
        "pixels",
        """, f AS (SELECT image_id, max(row) OVER (PARTITION BY image_id) - row AS row, max(col) OVER (PARTITION BY image_id) - col AS col, v FROM pixels)
           SELECT image_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, v, row * 60 - 100.0::DOUBLE AS distance,
           -(row * 2.5::DOUBLE) AS x, -(col * 1.5::DOUBLE + row) AS y FROM f WHERE abs(row * 60 - 100.0::DOUBLE) <= 250""",
    ),
)
def image_crop_flip(t):
    p = v.pixels(t)
    camera = p.select("row", "col").distinct()
    distance = camera.select("row", (F.col("row") * 60 - F.lit(100.0)).alias("distance")).distinct()
    positions = camera.select(
        "row", "col", (F.col("row") * F.lit(2.5)).alias("x"), (F.col("col") * F.lit(1.5) + F.col("row")).alias("y")
    )
    return im.crop_flip(p, distance, positions)


@query(
    "image_threshold",
    sql_with("pixels", "SELECT image_id, round(avg(CASE WHEN v < 175 THEN 1 ELSE 0 END), 9) AS share, count(*) AS n FROM pixels GROUP BY 1"),
)
def image_threshold(t):
    return im.ice_share(im.threshold(v.pixels(t))).withColumn("share", F.round("share", 9))


def box_sql(source: str, f: str, r: int) -> str:
    return f"""(SELECT image_id, row, col, {f}(v) OVER (PARTITION BY image_id, col ORDER BY row RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM
      (SELECT image_id, row, col, {f}(v) OVER (PARTITION BY image_id, row ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM {source}))"""


v._view("flat", f"SELECT p.image_id, p.row, p.col, p.v - b.v AS v FROM pixels p JOIN {box_sql(box_sql('pixels', 'min', 2), 'max', 2)} b USING (image_id, row, col)", "pixels")


@query("image_background", sql_with("flat", "SELECT * FROM flat"))
def image_background(t):
    return im.remove_background(v.pixels(t), 2)


v._view(
    "stretched",
    """SELECT image_id, row, col, least(greatest((v - lo) / nullif(hi - lo, 0), 0), 1) AS v FROM pixels JOIN
       (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM pixels GROUP BY 1) USING (image_id)""",
    "pixels",
)


@query("image_stretch", sql_with("stretched", "SELECT image_id, row, col, round(v, 9) AS v FROM stretched"))
def image_stretch(t):
    return im.stretch(v.pixels(t)).withColumn("v", F.round("v", 9))


v._view(
    "binary_px",
    """SELECT image_id, row, col, CASE WHEN v > level THEN 1 ELSE 0 END AS bw, level FROM stretched JOIN
       (SELECT image_id, avg(k) / 255 AS level FROM (SELECT *, max(var) OVER (PARTITION BY image_id) AS top FROM
         (SELECT image_id, k, pow(s * w - m * n, 2) / nullif(w * (n - w), 0) AS var FROM
          (SELECT image_id, k, CAST(n AS DOUBLE) AS n, CAST(s AS DOUBLE) AS s, CAST(sum(coalesce(c, 0)) OVER o AS DOUBLE) AS w,
             CAST(sum(coalesce(c, 0) * k) OVER o AS DOUBLE) AS m FROM
           (SELECT image_id, sum(c) AS n, sum(c * k) AS s FROM bins GROUP BY 1) CROSS JOIN (SELECT unnest(range(256)) AS k)
           LEFT JOIN bins USING (image_id, k) WINDOW o AS (PARTITION BY image_id ORDER BY k ROWS UNBOUNDED PRECEDING))))
        WHERE var = top GROUP BY 1) USING (image_id)""",
    "bins_px",
)
v._view(
    "bins_px",
    "SELECT image_id, CAST(floor(v * 255 + 0.5::DOUBLE) AS BIGINT) AS k, count(*) AS c FROM stretched GROUP BY 1, 2",
    "stretched",
)
v.VIEWS["binary_px"] = v.VIEWS["binary_px"].replace(" bins ", " bins_px ")


@query("image_otsu", sql_with("binary_px", "SELECT image_id, row, col, bw, round(level, 9) AS level FROM binary_px"))
def image_otsu(t):
    out = im.binarise(im.stretch(v.pixels(t)))
    return out.select("image_id", "row", "col", "bw", F.round("level", 9).alias("level"))


@query(
    "image_remove_small",
    sql_with(
        "binary_px",
        """, px AS (SELECT image_id, row * 8 + col AS p, row, col FROM binary_px WHERE bw = 1),
           adj AS (SELECT a.image_id, a.p, b.p AS q FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
           reach AS (SELECT image_id, p, q FROM adj UNION SELECT r.image_id, r.p, a.q FROM reach r JOIN adj a ON a.image_id = r.image_id AND a.p = r.q),
           big AS (SELECT image_id, p FROM reach GROUP BY 1, 2 HAVING count(*) >= 5)
           SELECT x.image_id, row, col, CASE WHEN bw = 1 AND big.p IS NOT NULL THEN 1 ELSE 0 END AS bw FROM binary_px x
           LEFT JOIN big ON big.image_id = x.image_id AND big.p = x.row * 8 + x.col""",
        recursive=True,
    ),
)
def image_remove_small(t):
    out = im.remove_small(im.binarise(im.stretch(v.pixels(t))), 5)
    return out.select("image_id", "row", "col", "bw")
