"""Projections of the driver tables that play the campaign's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.base import Tables

# SQL text of each view; ``sql_with`` puts the needed ones in front of a query.
VIEWS: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}
# Views that a query reads several times and that cost more than a scan.
SHARED: set[str] = set()


def _view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name], NEEDS[name] = sql, needs


def sql_with(names: str, body: str, recursive: bool = False) -> str:
    """``WITH view AS (...), ... body``; a body of further CTEs starts with a comma."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS[n]:
            visit(m)
        if n not in ordered:
            ordered.append(n)

    for n in names.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({VIEWS[n]})" for n in ordered)
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {ctes}\n{body}"


_view(
    "ice_daily",
    """SELECT user_id AS station, CAST(ts AS DATE) AS ice_date,
       least(round(avg(value) / 100, 9), CAST(1 AS DOUBLE)) AS sic
       FROM events GROUP BY 1, 2""",
)


def ice_daily(t: Tables) -> DataFrame:
    return (
        t.events.groupBy(F.col("user_id").alias("station"), F.to_date("ts").alias("ice_date"))
        .agg(F.least(F.round(F.avg("value") / 100, 9), F.lit(1.0)).alias("sic"))
    )


_view(
    "ice_sampled",
    """SELECT *, CAST(DATE '2024-01-12' + CAST(station % 15 AS INTEGER) AS DATE) AS sampling_date
       FROM ice_daily""",
    "ice_daily",
)


def ice_sampled(t: Tables) -> DataFrame:
    day = F.date_add(F.to_date(F.lit("2024-01-12")), (F.col("station") % 15).cast("int"))
    return ice_daily(t).withColumn("sampling_date", day)


_view(
    "stations",
    """SELECT s_suppkey AS station, 65 + ((s_suppkey * 37) % 700) / CAST(100 AS DOUBLE) AS lat,
       -65 + ((s_suppkey * 53) % 1500) / CAST(100 AS DOUBLE) AS lon FROM supplier""",
)


def stations(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("station"),
        (F.lit(65) + ((k * 37) % 700) / F.lit(100.0)).alias("lat"),
        (F.lit(-65) + ((k * 53) % 1500) / F.lit(100.0)).alias("lon"),
    )


_view(
    "cells",
    """SELECT p_partkey AS cell_id, 64.5::DOUBLE + ((p_partkey * 7919) % 8000) / CAST(1000 AS DOUBLE) AS lat,
       -66 + ((p_partkey * 104729) % 17000) / CAST(1000 AS DOUBLE) AS lon,
       p_retailprice / 1000 AS value FROM part""",
)


def cells(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("cell_id"),
        (F.lit(64.5) + ((k * 7919) % 8000) / F.lit(1000.0)).alias("lat"),
        (F.lit(-66) + ((k * 104729) % 17000) / F.lit(1000.0)).alias("lon"),
        (F.col("p_retailprice") / 1000).alias("value"),
    )


_view(
    "grid",
    """SELECT CAST(l_suppkey % 40 AS INTEGER) AS ix, CAST(l_partkey % 40 AS INTEGER) AS iy,
       -66 + 0.4::DOUBLE * (l_suppkey % 40) AS lon, 64.5::DOUBLE + 0.2::DOUBLE * (l_partkey % 40) AS lat,
       round(avg(l_extendedprice), 6) AS value FROM lineitem GROUP BY 1, 2, 3, 4""",
)


def grid(t: Tables) -> DataFrame:
    ix, iy = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    return t.lineitem.groupBy(
        ix.cast("int").alias("ix"),
        iy.cast("int").alias("iy"),
        (F.lit(-66) + F.lit(0.4) * ix).alias("lon"),
        (F.lit(64.5) + F.lit(0.2) * iy).alias("lat"),
    ).agg(F.round(F.avg("l_extendedprice"), 6).alias("value"))


_view(
    "spectra",
    """SELECT l_suppkey AS sample, 343 + 7 * l_quantity AS wavelength, l_linenumber AS replicate,
       CASE WHEN l_returnflag = 'R' THEN 'r' ELSE 's' END AS sample_type,
       2.303::DOUBLE * l_discount / 2 AS absorption FROM lineitem""",
)


def spectra(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("sample"),
        (F.lit(343) + 7 * F.col("l_quantity")).alias("wavelength"),
        F.col("l_linenumber").alias("replicate"),
        F.when(F.col("l_returnflag") == "R", "r").otherwise("s").alias("sample_type"),
        (F.lit(2.303) * F.col("l_discount") / 2).alias("absorption"),
    )


_view(
    "counts",
    """SELECT l_partkey AS curve, l_orderkey, l_linenumber,
       CASE l_linenumber WHEN 1 THEN 'TC1' WHEN 2 THEN 'Black2' ELSE 'P' || l_linenumber END AS id,
       l_extendedprice / 100 AS dpm, 16 * l_quantity AS light,
       CAST(28 + l_partkey % 8 AS DOUBLE) AS salinity, l_quantity, l_suppkey FROM lineitem""",
)


def counts(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.select(
        F.col("l_partkey").alias("curve"),
        "l_orderkey",
        "l_linenumber",
        F.when(n == 1, "TC1").when(n == 2, "Black2").otherwise(F.concat(F.lit("P"), n)).alias("id"),
        (F.col("l_extendedprice") / 100).alias("dpm"),
        (16 * F.col("l_quantity")).alias("light"),
        (28 + F.col("l_partkey") % 8).cast("double").alias("salinity"),
        "l_quantity",
        "l_suppkey",
    )


_view(
    "profiles",
    """SELECT CAST(l_shipdate AS DATE) AS day, l_quantity AS depth,
       30 + 40 * l_discount AS salinity, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice FROM lineitem""",
)

# Columns that together fix one order among the rows of a day.
PROFILE_ORDER = [
    "depth", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "salinity",
]
PROFILE_ORDER_SQL = "depth, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sal0"


def profiles(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").alias("depth"),
        (30 + 40 * F.col("l_discount")).alias("salinity"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


_view(
    "curve_raw",
    """SELECT l_partkey AS curve, 16 * l_quantity AS light, l_orderkey, l_linenumber,
       CAST(1 + l_partkey % 7 AS DOUBLE) AS ps0, 0.01::DOUBLE * (1 + l_partkey % 5) AS alpha0,
       (l_discount - 0.05::DOUBLE) * 0.2::DOUBLE AS noise FROM lineitem""",
)
_view(
    "curve_obs",
    """SELECT curve, light, l_orderkey, l_linenumber,
       round(ps0 * (1 - exp(-alpha0 * light / ps0)) + 0.1::DOUBLE + noise, 9) AS p FROM curve_raw""",
    "curve_raw",
)
_view(
    "curve_obs1",
    """SELECT curve, light, l_orderkey, l_linenumber,
       round(ps0 * (1 - exp(-alpha0 * light / ps0)) * exp(-0.002::DOUBLE * light / ps0) + 0.1::DOUBLE + noise, 9) AS p
       FROM curve_raw""",
    "curve_raw",
)


def curve_obs(t: Tables, inhibited: bool = False) -> DataFrame:
    ps0 = (1 + F.col("l_partkey") % 7).cast("double")
    alpha0 = F.lit(0.01) * (1 + F.col("l_partkey") % 5)
    light = 16 * F.col("l_quantity")
    noise = (F.col("l_discount") - F.lit(0.05)) * F.lit(0.2)
    p = ps0 * (1 - F.exp(-alpha0 * light / ps0))
    if inhibited:
        p = p * F.exp(F.lit(-0.002) * light / ps0)
    return t.lineitem.select(
        F.col("l_partkey").alias("curve"),
        light.alias("light"),
        "l_orderkey",
        "l_linenumber",
        F.round(p + F.lit(0.1) + noise, 9).alias("p"),
    )


_view(
    "rings",
    """SELECT CAST(n_regionkey AS BIGINT) AS poly_id, k AS seq,
       -66 + 4 * n_regionkey + 3 * cos(2 * pi() * k / 5) AS x, 68 + 2.5::DOUBLE * sin(2 * pi() * k / 5) AS y
       FROM (SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS k
             FROM nation)""",
)


def rings(t: Tables) -> DataFrame:
    from polynya.operators.ordered import Ordered

    ranked = Ordered(t.nation, ["n_regionkey"], ["n_nationkey"], small=True).cumulative(
        {"k": ("sum", F.lit(1))}
    )
    k = F.col("k").cast("int") - 1
    angle = 2 * F.pi() * k / 5
    return ranked.select(
        F.col("n_regionkey").cast("bigint").alias("poly_id"),
        k.alias("seq"),
        (-66 + 4 * F.col("n_regionkey") + 3 * F.cos(angle)).alias("x"),
        (68 + 2.5 * F.sin(angle)).alias("y"),
    )


_view(
    "pixels",
    """SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col,
       round(128 + 512 * CAST(embedding[i] AS DOUBLE), 0) AS v
       FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
)


def pixels(t: Tables) -> DataFrame:
    cells = t.embeddings.select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e")
    )
    return cells.select(
        "image_id",
        F.floor(F.col("i") / 8).cast("int").alias("row"),
        (F.col("i") % 8).cast("int").alias("col"),
        F.round(128 + 512 * F.col("e").cast("double"), 0).alias("v"),
    )


_view(
    "lines",
    r"""SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS parts FROM documents)""",
)


def lines(t: Tables) -> DataFrame:
    from polynya.sources.text import text_lines

    return text_lines(t.documents, "doc_id", "text")


_view(
    "sources",
    """SELECT event_type AS source, user_id, CAST(ts AS DATE) AS day, value FROM events""",
)


def sources(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("source"), "user_id", F.to_date("ts").alias("day"), "value"
    )
