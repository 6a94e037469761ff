"""Absorption spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from polynya.operators.relational import union_sources
from polynya.plans import absorption as ab
from registry import views as v
from registry.base import query
from registry.views import sql_with

_NAME = """CASE WHEN l_suppkey % 2 = 0 THEN 'data/X2016AM_stnG' || l_suppkey || '_c01_bottle00' || l_linenumber || '_045_' ELSE
   'data/X2016IC_2016_' || (100 + l_suppkey) || '_wat_xx_x_0005m_' END || CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_returnflag = 'A' THEN 's' ELSE 'm' END || '.TXT'"""


@query(
    "cdom_absorption",
    f"""SELECT file, l_orderkey, l_extendedprice, wavelength, replicate, round(2.303::DOUBLE * a / 2, 9) AS absorption, sample_type,
       CASE WHEN am THEN 'X2016AM' ELSE 'X2016IC' END AS mission,
       CASE WHEN am THEN 'stnG' || l_suppkey END AS station, CASE WHEN am THEN 'c01' END AS cast_no,
       CASE WHEN am THEN 'bottle00' || l_linenumber END AS bottle, CASE WHEN am THEN '045' END AS depth,
       CASE WHEN NOT am THEN '2016' END AS year, CASE WHEN NOT am THEN CAST(100 + l_suppkey AS VARCHAR) END AS jday,
       CASE WHEN NOT am THEN 'wat' END AS water_type, CASE WHEN NOT am THEN 'xx' END AS snow_type,
       CASE WHEN NOT am THEN 'x' END AS from_depth, CASE WHEN NOT am THEN '0005m' END AS to_depth FROM
       (SELECT {_NAME} AS file, *, l_suppkey % 2 = 0 AS am, 343 + 7 * l_quantity AS wavelength, unnest([1, 2]) AS replicate,
        unnest([l_discount, l_tax]) AS a, CASE WHEN l_returnflag = 'R' THEN 'r' ELSE 's' END AS sample_type
        FROM lineitem WHERE l_returnflag IN ('R', 'A'))""",
)
def cdom_absorption(t):
    readings = t.lineitem.select(
        F.expr(_NAME).alias("file"), "l_orderkey", "l_extendedprice",
        (343 + 7 * F.col("l_quantity")).alias("wavelength"),
        F.col("l_discount").alias("replicate_1"), F.col("l_tax").alias("replicate_2"),
    )
    out = ab.absorption_long(readings, "file", ["replicate_1", "replicate_2"])
    return out.withColumn("absorption", F.round("absorption", 9)).withColumnRenamed("cast", "cast_no")


v._view(
    "shaded",
    """SELECT sample, wavelength, sample_type, CASE WHEN sample_type = 'r' THEN absorption * (sample % 7) / 30
       ELSE absorption * (1 + sample % 5) + (sample % 3) * (700 - wavelength) * 0.004::DOUBLE END AS absorption FROM spectra""",
    "spectra",
)


def shaded(t):
    n, a, w = F.col("sample"), F.col("absorption"), F.col("wavelength")
    return v.spectra(t).select(
        "sample", "wavelength", "sample_type",
        F.when(F.col("sample_type") == "r", a * (n % 7) / 30)
        .otherwise(a * (1 + n % 5) + (n % 3) * (700 - w) * F.lit(0.004)).alias("absorption"),
    )


v._view(
    "wide_spectra",
    """SELECT sample, wavelength, avg(absorption) FILTER (WHERE sample_type = 'r') AS r,
       avg(absorption) FILTER (WHERE sample_type = 's') AS s,
       round(abs(100 * stddev_samp(absorption) FILTER (WHERE sample_type = 's')
         / nullif(avg(absorption) FILTER (WHERE sample_type = 's'), 0)), 9) AS cv FROM shaded GROUP BY 1, 2""",
    "shaded",
)
v._view(
    "corrected",
    """SELECT w.*, s - r - base AS absorption FROM wide_spectra w JOIN
       (SELECT sample, CASE WHEN count(*) FILTER (WHERE wavelength BETWEEN 683 AND 687 AND s - r IS NULL) = 0 THEN
          median(s - r) FILTER (WHERE wavelength BETWEEN 683 AND 687) END AS base FROM wide_spectra GROUP BY 1) USING (sample)""",
    "wide_spectra",
)


@query(
    "cdom_corrected",
    sql_with(
        "corrected",
        "SELECT sample, wavelength, round(r, 9) AS r, round(s, 9) AS s, round(absorption, 9) AS absorption FROM corrected",
    ),
)
def cdom_corrected(t):
    out = ab.corrected(shaded(t), ["sample"])
    return out.withColumns({c: F.round(c, 9) for c in ("r", "s", "absorption")})


_DIL = """, vol AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ICE' || CASE WHEN s_suppkey % 2 = 0 THEN 'HS' ELSE 'LS' END
       || CASE WHEN s_suppkey % 4 = 0 THEN '03cm' ELSE '310cm' END END AS label,
     400 + s_suppkey AS total, (s_suppkey * 7) % 300 AS added FROM supplier),
   dil AS (SELECT s_suppkey AS sample, label, CASE WHEN label IS NOT NULL THEN (total - added) / CAST(total AS DOUBLE) END AS f FROM vol),
   tagged AS (SELECT CAST(c.sample % 20 AS VARCHAR) AS jday, c.sample, c.sample // 20 AS to_depth, wavelength, absorption, f
     FROM corrected c LEFT JOIN dil USING (sample)),
   low AS (SELECT jday, min(to_depth) AS low FROM tagged WHERE f IS NULL GROUP BY 1),
   ref AS (SELECT jday, wavelength, absorption AS a_ref FROM tagged JOIN low USING (jday) WHERE f IS NULL AND to_depth = low)"""


def volumes(t):
    """Dilution records: one label per diluted sample, with its volumes."""
    k = F.col("s_suppkey")
    label = F.concat(
        F.lit("ICE"), F.when(k % 2 == 0, "HS").otherwise("LS"),
        F.when(k % 4 == 0, "03cm").otherwise("310cm"),
    )
    return t.supplier.filter(k % 3 == 0).select(
        k.alias("sample"), label.alias("cast"), (k % 20).alias("jday"),
        (400 + k).cast("double").alias("total_volumn_ml"), ((k * 7) % 300).cast("double").alias("added_fsw_ml"),
    )


@query(
    "cdom_dilution",
    sql_with(
        "corrected",
        _DIL
        + """SELECT jday, sample, wavelength, round(f, 9) AS f, round(coalesce((absorption - a_ref * (1 - f)) / nullif(f, 0), absorption), 9) AS absorption
             FROM tagged LEFT JOIN ref USING (jday, wavelength)""",
    ),
)
def cdom_dilution(t):
    records = volumes(t)
    f = ab.dilution_table(records.withColumn("jday", F.col("sample"))).select(
        F.col("jday").cast("bigint").alias("sample"), "f"
    )
    spectra = ab.corrected(shaded(t), ["sample"]).join(f, "sample", "left").select(
        (F.col("sample") % 20).cast("string").alias("jday"), "sample",
        F.floor(F.col("sample") / 20).alias("to_depth"), "wavelength", "absorption", "f",
    )
    out = ab.undiluted(spectra)
    return out.select("jday", "sample", "wavelength", F.round("f", 9).alias("f"), F.round("absorption", 9).alias("absorption"))


def _flags(table: str) -> str:
    return f""", facts AS (SELECT sample,
             CASE WHEN bool_or(cv > 5) FILTER (WHERE wavelength BETWEEN 350 AND 500) THEN true
               WHEN count(cv) FILTER (WHERE wavelength BETWEEN 350 AND 500) < count(*) FILTER (WHERE wavelength BETWEEN 350 AND 500) THEN NULL
               ELSE false END AS spread,
             CASE WHEN bool_or(absorption < 0) FILTER (WHERE wavelength BETWEEN 350 AND 500) THEN true
               WHEN count(absorption) FILTER (WHERE wavelength BETWEEN 350 AND 500) < count(*) FILTER (WHERE wavelength BETWEEN 350 AND 500) THEN NULL
               ELSE false END AS neg,
             max(absorption) FILTER (WHERE wavelength = 350) AS a350,
             CASE WHEN count(*) FILTER (WHERE wavelength BETWEEN 350 AND 500 AND r IS NULL) = 0 THEN
               median(abs(r)) FILTER (WHERE wavelength BETWEEN 350 AND 500) END AS noise FROM {table} GROUP BY 1),
           f1 AS (SELECT *, CASE WHEN spread THEN 7 ELSE 0 END AS q1 FROM facts),
           f2 AS (SELECT *, CASE WHEN noise IS NULL THEN NULL WHEN noise > 2.303::DOUBLE * 0.01::DOUBLE / 2 THEN 8
             WHEN noise >= 2.303::DOUBLE * 0.005::DOUBLE / 2 THEN 1 ELSE q1 END AS q2 FROM f1),
           f3 AS (SELECT *, CASE WHEN a350 IS NULL THEN NULL WHEN a350 > 1.8::DOUBLE THEN 6 ELSE q2 END AS q3 FROM f2),
           f4 AS (SELECT *, CASE WHEN neg IS NULL THEN NULL WHEN neg THEN 9 ELSE q3 END AS qf FROM f3)
           SELECT sample, wavelength, round(absorption, 9) AS absorption, qf FROM {table} JOIN f4 USING (sample)"""


@query("cdom_quality_flag", sql_with("corrected", _flags("corrected")))
def cdom_quality_flag(t):
    out = ab.flagged(shaded(t), ["sample"])
    return out.withColumn("absorption", F.round("absorption", 9))


_PLACE = """CAST({k} // 4 AS VARCHAR) AS jday, CASE WHEN {k} % 4 < 2 THEN 'HS' ELSE 'LS' END AS snow_type,
     CASE WHEN {k} % 2 = 0 THEN '0' ELSE '3' END AS from_depth, CASE WHEN {k} % 2 = 0 THEN '003cm' ELSE '010cm' END AS to_depth"""
_CAMP = f""", dil AS (SELECT {_PLACE.format(k="s_suppkey")}, true AS hit,
     (400 + s_suppkey - (s_suppkey * 7) % 300) / CAST(400 + s_suppkey AS DOUBLE) AS f FROM supplier WHERE s_suppkey % 3 = 0),
   camp AS (SELECT sample, {_PLACE.format(k="sample")}, wavelength, r, cv, absorption FROM corrected),
   tagged AS (SELECT *, CAST(left(to_depth, 3) AS INTEGER) AS cm FROM camp LEFT JOIN dil USING (jday, snow_type, from_depth, to_depth)),
   low AS (SELECT jday, min(cm) AS low FROM tagged WHERE hit IS NULL GROUP BY 1),
   ref AS (SELECT jday, wavelength, absorption AS a_ref FROM tagged JOIN low USING (jday) WHERE hit IS NULL AND cm = low),
   camped AS (SELECT DISTINCT sample, jday, snow_type, from_depth, to_depth, wavelength, r, cv,
     coalesce((absorption - a_ref * (1 - f)) / nullif(f, 0), absorption) AS absorption FROM tagged LEFT JOIN ref USING (jday, wavelength))"""


def camp_place(k):
    """Day, snow type and depths of a sample of the camp, four samples a day."""
    return {
        "jday": F.floor(k / 4).cast("string"),
        "snow_type": F.when(k % 4 < 2, "HS").otherwise("LS"),
        "from_depth": F.when(k % 2 == 0, "0").otherwise("3"),
        "to_depth": F.when(k % 2 == 0, "003cm").otherwise("010cm"),
    }


def camp_records(t):
    """Dilution records of every third sample, the place told by the label."""
    k = F.col("s_suppkey")
    label = F.concat(
        F.lit("ICE"), F.when(k % 4 < 2, "HS").otherwise("LS"),
        F.when(k % 2 == 0, "03cm").otherwise("310cm"),
    )
    return t.supplier.filter(k % 3 == 0).select(
        label.alias("cast"), F.floor(k / 4).alias("jday"),
        (400 + k).cast("double").alias("total_volumn_ml"), ((k * 7) % 300).cast("double").alias("added_fsw_ml"),
    )


@query(
    "cdom_quality_flag_camp",
    sql_with("corrected", _CAMP + _flags("camped").replace("round(absorption", "jday, to_depth, round(absorption")),
)
def cdom_quality_flag_camp(t):
    place = camp_place(F.col("sample"))
    spectra = shaded(t).withColumns(place)
    out = ab.flagged_camp(spectra, ab.dilution_table(camp_records(t)), ["sample", *place])
    return out.select("sample", "wavelength", "jday", "to_depth", F.round("absorption", 9).alias("absorption"), "qf")


@query(
    "corrected_vs_raw",
    sql_with(
        "corrected",
        """SELECT 'corrected' AS kind, sample, wavelength, round(absorption, 9) AS absorption FROM corrected WHERE wavelength IN (357, 350, 441)
           UNION ALL SELECT 'uncorrected', sample, wavelength, round(s - r, 9) FROM corrected WHERE wavelength IN (357, 350, 441)""",
    ),
)
def corrected_vs_raw(t):
    cdom = ab.corrected(shaded(t), ["sample"])
    both = union_sources(
        {
            "corrected": cdom.select("sample", "wavelength", "absorption"),
            "uncorrected": cdom.select("sample", "wavelength", (F.col("s") - F.col("r")).alias("absorption")),
        },
        "kind",
    )
    return both.filter(F.col("wavelength").cast("int").isin(357, 350, 441)).withColumn(
        "absorption", F.round("absorption", 9)
    )
