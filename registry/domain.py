"""Splines, radiation, carbon and the organic-carbon overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from polynya.operators import fitting, spline
from polynya.plans import carbon, organic, par
from registry import views as v
from registry.absorption import shaded
from registry.base import query
from registry.fits import _GROUPS, fit_sql, lm_sql, rounded
from registry.views import sql_with


def spline_sql(source: str) -> str:
    """CTEs ending in ``fine`` (k, u, s): elimination and back substitution row by row.

    ``source`` has k, x, y with distinct x per k.
    """
    return f"""kn AS (SELECT k, x, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n, lead(x) OVER w - x AS h, x - lag(x) OVER w AS hp,
       (lead(y) OVER w - y) / (lead(x) OVER w - x) AS sl, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS slp FROM {source} WINDOW w AS (PARTITION BY k ORDER BY x)),
     e AS (SELECT k, max(x) FILTER (WHERE i = 1) AS x1, max(x) FILTER (WHERE i = 2) AS x2, max(x) FILTER (WHERE i = 3) AS x3, max(x) FILTER (WHERE i = 4) AS x4,
       max(sl) FILTER (WHERE i = 1) AS s1, max(sl) FILTER (WHERE i = 2) AS s2, max(sl) FILTER (WHERE i = 3) AS s3,
       max(x) FILTER (WHERE i = n) AS z4, max(x) FILTER (WHERE i = n - 1) AS z3, max(x) FILTER (WHERE i = n - 2) AS z2, max(x) FILTER (WHERE i = n - 3) AS z1,
       max(sl) FILTER (WHERE i = n - 1) AS q3, max(sl) FILTER (WHERE i = n - 2) AS q2, max(sl) FILTER (WHERE i = n - 3) AS q1 FROM kn GROUP BY k),
     sy AS (SELECT k, i, n, x, y, h, hp, sl, CASE WHEN i = 1 THEN -h WHEN i = n THEN -hp ELSE 2 * (h + hp) END AS dg,
       CASE WHEN i = 1 THEN ((s3 - s2) / (x4 - x2) - (s2 - s1) / (x3 - x1)) / (x4 - x1) * h * h
            WHEN i = n THEN -((q3 - q2) / (z4 - z2) - (q2 - q1) / (z3 - z1)) / (z4 - z1) * hp * hp ELSE sl - slp END AS r FROM kn JOIN e USING (k)),
     fw AS (SELECT k, i, n, dg AS b, r AS c, h FROM sy WHERE i = 1 UNION ALL
       SELECT s.k, s.i, s.n, s.dg - f.h / f.b * f.h, s.r - f.h / f.b * f.c, s.h FROM fw f JOIN sy s ON s.k = f.k AND s.i = f.i + 1),
     bw AS (SELECT k, i, c / b AS s FROM fw WHERE i = n UNION ALL
       SELECT f.k, f.i, (f.c - f.h * w.s) / f.b FROM bw w JOIN fw f ON f.k = w.k AND f.i = w.i - 1),
     sg AS (SELECT k, i, n, x, y, h, sl - h * (s2 + 2 * s) AS b, 3 * s AS c, (s2 - s) / h AS d FROM
       (SELECT sy.*, bw.s, lead(bw.s) OVER (PARTITION BY sy.k ORDER BY sy.i) AS s2 FROM sy JOIN bw ON bw.k = sy.k AND bw.i = sy.i) WHERE i < n),
     fine AS (SELECT k, u, y + (u - x) * (b + (u - x) * (c + (u - x) * d)) AS s FROM
       (SELECT *, CAST(unnest(range(400, 701)) AS DOUBLE) AS u FROM sg) WHERE (u >= x OR i = 1) AND (u < x + h OR i = n - 1))"""


v._view("knots", "SELECT sample AS k, wavelength AS x, round(avg(absorption), 12) AS y FROM spectra GROUP BY 1, 2", "spectra")


@query(
    "spline_resample",
    sql_with("knots", "," + spline_sql("knots") + "SELECT k AS sample, u AS wavelength, round(s, 10) AS absorption FROM fine", recursive=True),
)
def spline_resample(t):
    means = v.spectra(t).groupBy("sample", "wavelength").agg(F.round(F.avg("absorption"), 12).alias("absorption"))
    out = spline.spline_resample(means, ["sample"], "wavelength", "absorption", 400.0, 700.0, 1.0)
    return rounded(out, 10, "absorption")


v._view(
    "irradiance",
    """SELECT (l_suppkey % 20) * 10 + l_linenumber AS k, 343 + 7 * l_quantity AS x,
       round(avg(1000 * (2 + l_discount) * exp(-(0.1::DOUBLE + 0.02::DOUBLE * (l_suppkey % 5)) * l_linenumber)), 6) AS y FROM lineitem GROUP BY 1, 2""",
)


def irradiance(t):
    k, z = F.col("l_suppkey"), F.col("l_linenumber")
    light = 1000 * (2 + F.col("l_discount")) * F.exp(-(F.lit(0.1) + F.lit(0.02) * (k % 5)) * z)
    return t.lineitem.groupBy(
        (k % 20).alias("file"), z.cast("double").alias("depth"), (343 + 7 * F.col("l_quantity")).alias("wavelength")
    ).agg(F.round(F.avg(light), 6).alias("irradiance"))


_PAR = (
    ","
    + spline_sql("irradiance")
    + """, st AS (SELECT k, u, s, lead(u) OVER w AS u2, lead(s) OVER w AS s2 FROM fine WINDOW w AS (PARTITION BY k ORDER BY u)),
    par AS (SELECT k // 10 AS file, CAST(k % 10 AS DOUBLE) AS depth, round(sum((u2 - u) * (s + s2) / 2) * (0.045998::DOUBLE / 10000), 9) AS par FROM st GROUP BY k), """
    + fit_sql("par", "file", "depth", "par", [fitting.DECAY], "exp(-s0_ * (x - 10))", 2)
    + f", line AS (SELECT * FROM {lm_sql('(SELECT file, depth AS x, CASE WHEN par > 0 THEN ln(par) END AS y FROM par)', 'file')})"
)


@query(
    "par_profile",
    sql_with(
        "irradiance",
        _PAR
        + """SELECT 'par' AS kind, file, depth, round(par, 6) AS value, NULL AS rate FROM par
             UNION ALL SELECT 'nls', k, NULL, round(rss, 6), NULL FROM fit
             UNION ALL SELECT 'lm', file, NULL, round(intercept, 6), round(slope, 6) FROM line""",
        recursive=True,
    ),
)
def par_profile(t):
    depth_par = rounded(par.par_by_depth(irradiance(t)), 9, "par")
    nls, line = par.attenuation(depth_par)
    none = F.lit(None).cast("double")
    return (
        depth_par.select(F.lit("par").alias("kind"), "file", "depth", F.round("par", 6).alias("value"), none.alias("rate"))
        .unionByName(nls.select(F.lit("nls").alias("kind"), "file", none.alias("depth"), F.round("rss", 6).alias("value"), none.alias("rate")))
        .unionByName(line.select(F.lit("lm").alias("kind"), "file", none.alias("depth"), F.round("intercept", 6).alias("value"), F.round("slope", 6).alias("rate")))
    )


# -- inorganic carbon -----------------------------------------------------------------------

v._view(
    "ctd",
    """SELECT date, depth, first_value(sigt IGNORE NULLS) OVER up AS sigt, first_value(psal IGNORE NULLS) OVER up AS psal, n,
       first_value(sigt + 1000 IGNORE NULLS) OVER up AS water_density FROM
       (SELECT date, depth FROM cast_mean UNION SELECT DISTINCT date, unnest([0.5::DOUBLE, 1.5::DOUBLE]) FROM cast_mean) LEFT JOIN cast_mean USING (date, depth)
       WINDOW up AS (PARTITION BY date ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "cast_mean",
)
v._view(
    "cast_mean",
    """SELECT CAST(l_shipdate AS DATE) AS date, l_quantity AS depth, avg(CASE WHEN l_orderkey % 3 != 0 THEN 20 + 50 * l_tax END) AS sigt,
       avg(CASE WHEN l_orderkey % 5 != 0 THEN 30 + 40 * l_discount END) AS psal, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
v._view(
    "dic_obs",
    """SELECT date, CASE WHEN d = 0 THEN 0.5::DOUBLE ELSE d END AS depth, dic FROM (SELECT CAST(o_orderdate AS DATE) AS date, unnest([0.0::DOUBLE, 1.5::DOUBLE, 5, 20]) AS d,
       unnest([avg(o_totalprice) FILTER (WHERE o_custkey % 4 = 0), avg(o_totalprice) FILTER (WHERE o_custkey % 4 = 1),
         avg(o_totalprice) FILTER (WHERE o_custkey % 4 = 2), avg(o_totalprice) FILTER (WHERE o_custkey % 4 = 3)]) / 1000 + 2000 AS dic FROM orders GROUP BY 1) WHERE dic IS NOT NULL""",
)
v._view(
    "dic_place",
    """SELECT date, depth, psal, dic * (first_value(water_density IGNORE NULLS) OVER (PARTITION BY date ORDER BY depth
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 1e6::DOUBLE * 12 * 1000 AS dic FROM dic_obs LEFT JOIN ctd USING (date, depth)""",
    "dic_obs", "ctd",
)

v.SHARED |= {"ctd", "cast_mean", "dic_obs", "dic_place"}


def ctd_and_dic(t):
    nan = F.lit(float("nan"))
    casts = t.lineitem.select(
        F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("depth"),
        F.when(F.col("l_orderkey") % 3 != 0, 20 + 50 * F.col("l_tax")).otherwise(nan).alias("sigt"),
        F.when(F.col("l_orderkey") % 5 != 0, 30 + 40 * F.col("l_discount")).otherwise(nan).alias("psal"),
    )
    names = ["0 m", "1.5 m", "5 m", "20 m"]
    sheet = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        *[
            (F.avg(F.when(F.col("o_custkey") % 4 == i, F.col("o_totalprice"))) / 1000 + 2000).alias(c)
            for i, c in enumerate(names)
        ]
    )
    long = carbon.dic_long(sheet, names)
    return carbon.ctd_profile(casts), long


@query(
    "dic_insitu",
    sql_with("dic_place", "SELECT date, depth, round(psal, 6) AS psal, round(dic, 4) AS dic FROM dic_place"),
)
def dic_insitu(t):
    ctd, dic = ctd_and_dic(t)
    out = carbon.dic_insitu(dic, ctd)
    return out.select("date", "depth", F.round("psal", 6).alias("psal"), F.round("dic", 4).alias("dic"))


_X = "(SELECT psal AS x, dic AS y FROM dic_place)"
_HIGH = "(SELECT psal AS x, dic AS y FROM dic_place WHERE dic >= 25600 AND psal >= 32.3::DOUBLE)"


@query(
    "dic_model_compare",
    sql_with(
        "dic_place",
        f""", m1 AS (SELECT slope AS s1, intercept AS i1 FROM {lm_sql(_X)}), m2 AS (SELECT slope AS s2, intercept AS i2 FROM {lm_sql(_HIGH)}),
           w AS (SELECT c.date, c.depth, p.dic AS dic_insitu, i1 + s1 * c.psal AS a, i2 + s2 * c.psal AS b,
             CASE WHEN c.psal IS NULL THEN NULL WHEN c.psal >= 30 THEN 25900 ELSE 24000 END AS r
             FROM ctd c JOIN dic_place p ON p.date = c.date AND p.depth = c.depth, m1, m2 WHERE p.dic IS NOT NULL)
           SELECT date, depth, round(dic_insitu, 4) AS dic_insitu, unnest(['all', 'high', 'rule']) AS method,
           unnest([round(abs(dic_insitu - a), 4), round(abs(dic_insitu - b), 4), round(abs(dic_insitu - r), 4)]) AS residual FROM w""",
    ),
)
def dic_model_compare(t):
    ctd, dic = ctd_and_dic(t)
    out = carbon.compare_models(carbon.dic_insitu(dic, ctd), ctd)
    return rounded(out, 4, "dic_insitu", "residual")


# -- organic carbon -------------------------------------------------------------------------

_SRC = ["lab_a", "lab_b", "lab_c"]
v._view(
    "doc",
    """SELECT CAST(o_orderkey % 80 AS BIGINT) AS jday, CAST(o_custkey % 25 AS DOUBLE) AS depth, o_totalprice / 1000 AS doc,
       CASE o_orderstatus WHEN 'F' THEN 'lab_a' WHEN 'O' THEN 'lab_b' ELSE 'lab_c' END AS source FROM orders WHERE o_custkey % 50 != 7""",
)
v._view(
    "cdom",
    """SELECT CAST(sample AS BIGINT) AS jday, CAST(sample % 25 AS DOUBLE) AS depth, wavelength, avg(absorption) AS absorption FROM shaded WHERE sample_type = 's' GROUP BY 1, 2, 3""",
    "shaded",
)


def doc(t):
    source = F.when(F.col("o_orderstatus") == "F", "lab_a").when(F.col("o_orderstatus") == "O", "lab_b").otherwise("lab_c")
    value = F.when(F.col("o_custkey") % 50 != 7, F.col("o_totalprice") / 1000)
    return t.orders.select(
        (F.col("o_orderkey") % 80).alias("jday"), (F.col("o_custkey") % 25).cast("double").alias("depth"),
        value.alias("doc"), source.alias("source"),
    )


def cdom(t):
    n = F.col("sample")
    return shaded(t).filter("sample_type = 's'").groupBy(
        n.alias("jday"), (n % 25).cast("double").alias("depth"), "wavelength"
    ).agg(F.avg("absorption").alias("absorption"))


_DOC = (
    _GROUPS.replace("sources", "doc").replace("value", "doc")
    + """, wide AS (SELECT jday, depth, """
    + ", ".join(f"avg(doc) FILTER (WHERE source = '{s}') AS {s}" for s in _SRC)
    + f""" FROM doc GROUP BY 1, 2),
   mixed AS (SELECT depth FROM doc GROUP BY 1 HAVING count(DISTINCT source) > 1),
   rep AS (SELECT depth FROM doc GROUP BY 1 HAVING count(*) > 1),
   j AS (SELECT source, CAST(wavelength AS INTEGER) AS wl, absorption AS x, doc AS y FROM doc JOIN cdom USING (jday, depth) WHERE CAST(wavelength AS INTEGER) IN (350, 399, 448)),
   al AS (SELECT 'n' AS section, source AS name, CAST(count(*) AS DOUBLE) AS value FROM doc GROUP BY 2
     UNION ALL SELECT 'median', source, median(doc) FROM doc GROUP BY 2
     UNION ALL SELECT 'median_by_depth', source || '-' || CAST(depth AS INTEGER), median(doc) FROM doc JOIN mixed USING (depth) GROUP BY 2
     UNION ALL SELECT 'repeated_depths', source, count(*) FROM doc JOIN rep USING (depth) GROUP BY 2
     UNION ALL SELECT 'meansq', 'source', b / (k - 1) FROM a UNION ALL SELECT 'meansq', 'Residuals', w / (n - k) FROM a
     UNION ALL SELECT 'difference', y.source || '-' || x.source, y.m - x.m FROM g x JOIN g y ON x.source < y.source
     UNION ALL """
    + " UNION ALL ".join(
        f"SELECT 'correlation', '{p}-{q}', corr({p}, {q}) FROM wide" for i, p in enumerate(_SRC) for q in _SRC[i + 1 :]
    )
    + f""" UNION ALL SELECT 'slope', source || '-' || wl, slope FROM {lm_sql('j', 'source, wl')})"""
)


@query("doc_overview", sql_with("doc cdom", _DOC + "SELECT section, name, round(value, 6) AS value FROM al"))
def doc_overview(t):
    return rounded(organic.overview(doc(t), cdom(t), _SRC, [350, 399, 448]), 6, "value")
