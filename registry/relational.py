"""Projections, filters, gaps, joins, aggregates, ordered walks, reshape, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from polynya.functions import scalars as fn
from polynya.operators import aggregates as agg
from polynya.operators import gaps, joins, ordered
from polynya.operators import relational as rel
from polynya.plans import ice
from registry import views as v
from registry.base import query
from registry.views import sql_with

# -- projections ----------------------------------------------------------------------------


@query(
    "select_rename",
    """SELECT c_custkey AS station_id, c_name AS station_name, c_nationkey, c_mktsegment,
       c_acctbal AS bal FROM customer""",
)
def select_rename(t):
    df = t.customer
    picked = df.select(
        *rel.select_like(df, first_to_last=("c_custkey", "c_nationkey")),
        *rel.select_like(df, contains="segment"),
        *rel.select_like(df, starts="c_acct"),
    )
    return picked.withColumnsRenamed(
        {"c_custkey": "station_id", "c_name": "station_name", "c_acctbal": "bal"}
    )


@query(
    "mutate_across",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
       CAST(l_shipdate AS DATE) AS ship_day,
       round_even(l_quantity / 7, 2) AS l_quantity, round_even(l_extendedprice / 7, 2) AS l_extendedprice,
       round_even(l_discount / 7, 2) AS l_discount, round_even(l_tax / 7, 2) AS l_tax FROM lineitem""",
)
def mutate_across(t):
    df = t.lineitem.withColumn("ship_day", F.to_date("l_shipdate")).drop("l_shipdate")
    scaled = rel.mutate_across(df, rel.numeric_doubles(df), lambda c: c / 7)
    return rel.round_numeric(scaled, 2)


@query(
    "entry_template",
    """SELECT CAST(NULL AS VARCHAR) AS station, CAST(NULL AS BIGINT) AS cast_no, CAST(NULL AS BIGINT) AS niskin,
       CAST(NULL AS VARCHAR) AS curve_id, CAST(NULL AS VARCHAR) AS measurement_type, dpm1,
       CAST(NULL AS DOUBLE) AS light FROM (SELECT o_totalprice AS dpm1 FROM orders)""",
)
def entry_template(t):
    return rel.entry_template(
        t.orders.select(F.col("o_totalprice").alias("dpm1")),
        {
            "station": "string", "cast_no": "bigint", "niskin": "bigint", "curve_id": "string",
            "measurement_type": "string",
        },
        {"light": "double"},
    )


# -- filters --------------------------------------------------------------------------------


@query(
    "bbox_filter",
    sql_with(
        "stations cells",
        """SELECT 'closed' AS edges, station AS id, lat, lon FROM stations
           WHERE lon BETWEEN -65 AND -50 AND lat BETWEEN 65 AND 72
           UNION ALL SELECT 'open', cell_id, lat, lon FROM cells
           WHERE lon > -90 AND lon < -50 AND lat > 40 AND lat < 90""",
    ),
)
def bbox_filter(t):
    lon, lat = F.col("lon"), F.col("lat")
    closed = v.stations(t).filter(rel.in_box(lon, lat, -65, -50, 65, 72))
    opened = v.cells(t).filter(rel.in_box(lon, lat, -90, -50, 40, 90, closed=False))
    return closed.select(F.lit("closed").alias("edges"), F.col("station").alias("id"), lat, lon).union(
        opened.select(F.lit("open"), "cell_id", lat, lon)
    )


@query(
    "regex_filter",
    sql_with(
        "counts",
        """SELECT curve, l_orderkey, l_linenumber, id, dpm, regexp_matches(id, '^p', 'i') AS is_sample,
           regexp_matches(id, 'tc|t0', 'i') AS is_standard, regexp_matches(id, 'black|dark', 'i') AS is_blank,
           regexp_matches('S' || l_suppkey, '^s([3-9]|1[0-9]|20)', 'i') AS in_range
           FROM counts WHERE NOT regexp_matches(id, 'ice', 'i')
           AND (regexp_matches(id, '^p', 'i') OR regexp_matches(id, 'tc|t0', 'i'))""",
    ),
)
def regex_filter(t):
    id_ = F.col("id")
    kept = v.counts(t).filter(
        ~rel.matches(id_, "ice") & (rel.matches(id_, "^p") | rel.matches(id_, "tc|t0"))
    )
    return kept.select(
        "curve", "l_orderkey", "l_linenumber", "id", "dpm",
        rel.matches(id_, "^p").alias("is_sample"),
        rel.matches(id_, "tc|t0").alias("is_standard"),
        rel.matches(id_, "black|dark").alias("is_blank"),
        rel.matches(F.concat(F.lit("S"), "l_suppkey"), "^s([3-9]|1[0-9]|20)").alias("in_range"),
    )


@query(
    "membership_filter",
    sql_with(
        "spectra",
        "SELECT * FROM spectra WHERE CAST(wavelength AS INTEGER) IN (350, 399, 448, 686) AND sample_type IN ('r', 's')",
    ),
)
def membership_filter(t):
    return v.spectra(t).filter(
        F.col("wavelength").cast("int").isin(350, 399, 448, 686) & F.col("sample_type").isin("r", "s")
    )


@query(
    "season_filter",
    sql_with(
        "ice_daily",
        """SELECT * FROM ice_daily WHERE month(ice_date) >= 1 AND ice_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
           AND ice_date != DATE '2024-01-13'""",
    ),
)
def season_filter(t):
    day = F.col("ice_date")
    return v.ice_daily(t).filter(
        rel.in_season(day, first_month=1, start="2024-01-05", end="2024-01-25")
        & (day != F.to_date(F.lit("2024-01-13")))
    )


@query(
    "group_filter",
    sql_with(
        "sources",
        """, repeated AS (SELECT user_id, day FROM sources GROUP BY 1, 2 HAVING count(*) > 1),
           mixed AS (SELECT user_id, day FROM sources GROUP BY 1, 2 HAVING count(DISTINCT source) > 1)
           SELECT s.* FROM sources s JOIN repeated USING (user_id, day) JOIN mixed USING (user_id, day)""",
    ),
)
def group_filter(t):
    keys = ["user_id", "day"]
    return rel.keep_mixed(rel.keep_repeated(v.sources(t), keys), keys, "source")


_BLANKED = """, blanked AS (SELECT day, depth, CASE WHEN l_orderkey % 3 != 0 THEN salinity END AS salinity,
    salinity AS sal0, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM profiles)"""


def blanked(t):
    return v.profiles(t).withColumns(
        {
            "sal0": F.col("salinity"),
            "salinity": F.when(F.col("l_orderkey") % 3 != 0, F.col("salinity")),
        }
    )


_BLANK_ORDER = [c if c != "salinity" else "sal0" for c in v.PROFILE_ORDER]


@query(
    "drop_null_rows",
    sql_with("profiles", _BLANKED + "SELECT day, depth, salinity FROM blanked WHERE salinity IS NOT NULL"),
)
def drop_null_rows(t):
    return rel.drop_null_rows(blanked(t).select("day", "depth", "salinity"), ["salinity"])


@query(
    "distinct_rows",
    """SELECT * EXCLUDE (rn) FROM (
         SELECT o_custkey, o_orderpriority, o_orderkey AS first_order, o_totalprice, CAST(o_orderdate AS DATE) AS day,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       WHERE rn = 1""",
)
def distinct_rows(t):
    picked = t.orders.select(
        "o_custkey", "o_orderpriority", F.col("o_orderkey").alias("first_order"), "o_totalprice",
        F.to_date("o_orderdate").alias("day"),
    )
    return rel.distinct_first(picked, ["o_custkey", "o_orderpriority"], ["day", "first_order"])


# -- gaps -----------------------------------------------------------------------------------


@query(
    "fill_down_up",
    sql_with(
        "profiles",
        _BLANKED
        + f"""SELECT l_suppkey, day, depth, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        coalesce(last_value(salinity IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          first_value(salinity IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS salinity
        FROM blanked WINDOW w AS (PARTITION BY l_suppkey ORDER BY day, {v.PROFILE_ORDER_SQL})""",
    ),
)
def fill_down_up(t):
    filled = gaps.fill_down_up(blanked(t), ["l_suppkey"], ["day", *_BLANK_ORDER], ["salinity"])
    return filled.drop("sal0")


_DAY_DEPTH = _BLANKED + """, dd AS (SELECT day, depth, round(avg(salinity), 9) AS salinity FROM blanked GROUP BY 1, 2)"""


def day_depth(t):
    return blanked(t).groupBy("day", "depth").agg(F.round(F.avg("salinity"), 9).alias("salinity"))


@query(
    "fill_from_below",
    sql_with(
        "profiles",
        _DAY_DEPTH
        + """SELECT day, depth, first_value(salinity IGNORE NULLS) OVER (PARTITION BY day ORDER BY depth
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS salinity FROM dd""",
    ),
)
def fill_from_below(t):
    return gaps.fill_from_below(day_depth(t), ["day"], ["depth"], ["salinity"])


@query(
    "complete_grid",
    sql_with(
        "profiles",
        _DAY_DEPTH
        + """, want AS (SELECT day, depth FROM dd UNION SELECT DISTINCT day, unnest([0.5::DOUBLE, 1.5::DOUBLE]) FROM dd)
             SELECT day, depth, salinity FROM want LEFT JOIN dd USING (day, depth)""",
    ),
)
def complete_grid(t):
    return gaps.complete_grid(day_depth(t), "day", "depth", [0.5, 1.5])


@query(
    "fill_group_max",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice,
       coalesce(b, max(b) OVER (PARTITION BY l_suppkey)) AS bottle FROM
       (SELECT *, CASE WHEN l_suppkey % 10 != 0 AND l_linenumber % 2 = 0 THEN l_quantity END AS b FROM lineitem)""",
)
def fill_group_max(t):
    b = F.when((F.col("l_suppkey") % 10 != 0) & (F.col("l_linenumber") % 2 == 0), F.col("l_quantity"))
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", b.alias("bottle")
    )
    return gaps.fill_group_max(df, ["l_suppkey"], "bottle")


_TWO = """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN l_orderkey % 2 = 0 THEN l_quantity END AS a, CASE WHEN l_orderkey % 3 = 0 THEN l_tax * 100 END AS b
    FROM lineitem"""


def two_values(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax") * 100).alias("b"),
    )


@query(
    "fallback_salinity",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN coalesce(a, 0) + coalesce(b, 0) = 0 THEN CAST(31 AS DOUBLE)
        ELSE coalesce(a, 0) + coalesce(b, 0) END AS salinity FROM ({_TWO})""",
)
def fallback_salinity(t):
    return two_values(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        gaps.fallback_sum(F.col("a"), F.col("b"), 31.0).alias("salinity"),
    )


@query(
    "first_non_null",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce(a, b) AS chla FROM ({_TWO})",
)
def first_non_null(t):
    return two_values(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.coalesce("a", "b").alias("chla")
    )


@query(
    "nan_to_null",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       CASE WHEN l_discount != 0 THEN l_discount END AS x, CASE WHEN l_tax != 0 THEN l_tax END AS y FROM lineitem""",
)
def nan_to_null(t):
    nan = F.lit(float("nan"))
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).otherwise(nan).alias("x"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).otherwise(nan).alias("y"),
    )
    return gaps.nans_to_null(df)


# -- joins ----------------------------------------------------------------------------------

_WIND = """WITH u AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, round(avg(l_quantity), 9) AS uwnd
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
    w AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, round(avg(l_tax), 9) AS vwnd
    FROM lineitem WHERE l_returnflag != 'R' GROUP BY 1, 2)"""


@query("inner_keys", _WIND + "SELECT station, day, uwnd, vwnd FROM u JOIN w USING (station, day)")
def inner_keys(t):
    keys = [F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("day")]
    flag = F.col("l_returnflag") == "R"
    u = t.lineitem.filter(flag).groupBy(*keys).agg(F.round(F.avg("l_quantity"), 9).alias("uwnd"))
    w = t.lineitem.filter(~flag).groupBy(*keys).agg(F.round(F.avg("l_tax"), 9).alias("vwnd"))
    return joins.inner_keys(u, w, ["station", "day"])


@query(
    "natural_join",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 5 != 0 THEN c_nationkey END AS nation FROM customer),
       b AS (SELECT CASE WHEN n_nationkey != 7 THEN n_nationkey END AS nation, n_name, n_regionkey FROM nation)
       SELECT c_custkey, a.nation, n_name, n_regionkey FROM a JOIN b ON a.nation IS NOT DISTINCT FROM b.nation""",
)
def natural_join(t):
    a = t.customer.select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("nation")
    )
    b = t.nation.select(
        F.when(F.col("n_nationkey") != 7, F.col("n_nationkey")).alias("nation"), "n_name", "n_regionkey"
    )
    return joins.natural_join(a, b)


@query(
    "left_lookup",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, bottle_depth FROM lineitem
       LEFT JOIN (SELECT o_orderkey AS l_orderkey, o_totalprice AS bottle_depth FROM orders WHERE o_orderstatus = 'F'
                  UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT') USING (l_orderkey)""",
)
def left_lookup(t):
    o = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("bottle_depth"),
        "o_orderstatus", "o_orderpriority",
    )
    lookup = o.filter("o_orderstatus = 'F'").unionByName(
        o.filter("o_orderpriority = '1-URGENT'").withColumn("bottle_depth", -F.col("bottle_depth"))
    ).drop("o_orderstatus", "o_orderpriority")
    samples = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return joins.left_lookup(samples, lookup, ["l_orderkey"])


@query(
    "anti_check",
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS
       (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
)
def anti_check(t):
    bottles = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.without_partner(t.orders.select("o_orderkey", "o_custkey"), bottles, ["o_orderkey"])


@query(
    "cross_targets",
    sql_with(
        "ice_daily",
        "SELECT *, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS sic_target FROM ice_daily",
    ),
)
def cross_targets(t):
    return joins.cross_targets(v.ice_daily(t), "sic_target", [0.1, 0.5, 0.8])


# (station, target, day) corrections for the driver's stations.
OVERRIDES = [
    (1, 0.5, "2024-01-09"), (2, 0.5, "2024-01-11"), (3, 0.8, "2024-01-05"), (5, 0.8, "2024-01-18"),
    (8, 0.5, "2024-01-22"), (13, 0.8, "2024-01-03"), (21, 0.1, "2024-01-16"), (34, 0.8, "2024-01-27"),
]
_OVERRIDE_SQL = "(VALUES " + ", ".join(
    f"(CAST({s} AS BIGINT), CAST({g} AS DOUBLE), DATE '{d}')" for s, g, d in OVERRIDES
) + ") AS fix(station, sic_target, new_date)"


def overrides(spark):
    rows = ", ".join(f"(bigint({s}), double({g}), date'{d}')" for s, g, d in OVERRIDES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS fix(station, sic_target, new_date)")


_DOW = """, crossed AS (SELECT *, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS sic_target FROM ice_sampled
      WHERE ice_date >= DATE '2024-01-01'),
  led AS (SELECT *, CASE WHEN count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 THEN
      lead(sic, 1) OVER w < sic_target AND lead(sic, 2) OVER w < sic_target AND lead(sic, 3) OVER w < sic_target END AS next_below
    FROM crossed WINDOW w AS (PARTITION BY station, sic_target ORDER BY ice_date)),
  picked AS (SELECT station, sic_target, sampling_date, ice_date AS dow_date, sic AS dow_sic,
      CAST(sampling_date - ice_date AS INTEGER) AS dow_length FROM
    (SELECT *, row_number() OVER (PARTITION BY station, sic_target ORDER BY abs(sic - sic_target), ice_date) AS rn
     FROM led WHERE next_below) WHERE rn = 1)"""
_FIXED = f""", fix AS (SELECT * FROM {_OVERRIDE_SQL}),
  fixed AS (SELECT p.station, p.sic_target, p.sampling_date, coalesce(f.new_date, p.dow_date) AS dow_date,
      CASE WHEN f.new_date IS NOT NULL THEN i.sic ELSE p.dow_sic END AS dow_sic, p.dow_length AS old_length
    FROM picked p LEFT JOIN fix f USING (station, sic_target)
    LEFT JOIN ice_daily i ON i.station = f.station AND i.ice_date = f.new_date)"""


@query("next3_below", sql_with("ice_sampled", _DOW + "SELECT station, sic_target, ice_date, sic, next_below FROM led"))
def next3_below(t):
    return ordered.next_rows_below(
        v.ice_daily(t), ["station"], ["ice_date"], "sic", [0.1, 0.5, 0.8], "sic_target"
    )


@query(
    "closest_to_target",
    sql_with("ice_sampled", _DOW + "SELECT station, sic_target, sampling_date, dow_date, dow_sic FROM picked"),
)
def closest_to_target(t):
    return ice.open_water_days(v.ice_sampled(t), start="2024-01-01").select(
        "station", "sic_target", "sampling_date", "dow_date", "dow_sic"
    )


@query(
    "keyed_override",
    sql_with(
        "ice_sampled",
        _DOW + _FIXED + "SELECT station, sic_target, sampling_date, dow_date, dow_sic FROM fixed",
    ),
)
def keyed_override(t):
    series = v.ice_sampled(t)
    dow = ice.open_water_days(series, start="2024-01-01")
    fixed = ice.apply_corrections(dow, overrides(t.spark), series)
    return fixed.select("station", "sic_target", "sampling_date", "dow_date", "dow_sic")


@query(
    "days_open_water",
    sql_with(
        "ice_sampled",
        _DOW
        + _FIXED
        + """SELECT station, sic_target, sampling_date, dow_date, CAST(sampling_date - dow_date AS INTEGER) AS dow_length,
             dow_sic FROM fixed""",
    ),
)
def days_open_water(t):
    return ice.days_open_water(v.ice_sampled(t), overrides(t.spark), start="2024-01-01")


_REF = """, cv AS (SELECT sample, wavelength, sample_type, round(avg(absorption), 9) AS a FROM spectra GROUP BY 1, 2, 3),
   tagged AS (SELECT sample % 20 AS jday, sample, CAST(sample // 20 AS DOUBLE) AS to_depth, wavelength,
       sample % 3 = 0 AS has_record, a AS absorption FROM cv WHERE sample_type = 's'),
   free AS (SELECT *, min(to_depth) OVER (PARTITION BY jday) AS low FROM tagged WHERE NOT has_record),
   ref AS (SELECT jday, wavelength, absorption AS a_ref FROM free WHERE to_depth = low)"""


@query(
    "reference_row_join",
    sql_with("spectra", _REF + "SELECT t.*, a_ref FROM tagged t LEFT JOIN ref USING (jday, wavelength)"),
)
def reference_row_join(t):
    means = (
        v.spectra(t).filter("sample_type = 's'").groupBy("sample", "wavelength")
        .agg(F.round(F.avg("absorption"), 9).alias("absorption"))
    )
    tagged = means.select(
        (F.col("sample") % 20).alias("jday"),
        "sample",
        F.floor(F.col("sample") / 20).cast("double").alias("to_depth"),
        "wavelength",
        (F.col("sample") % 3 == 0).alias("has_record"),
        "absorption",
    )
    return joins.reference_rows(
        tagged, "jday", "to_depth", ~F.col("has_record"), ["wavelength"], {"a_ref": "absorption"}
    )


@query(
    "bind_by_position",
    """SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value, 60 + 0.5::DOUBLE * i AS lat
       FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def bind_by_position(t):
    from polynya.sources.grids import bind_by_position as bind

    values = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "e")).select(
        "vec_id", "pos", F.col("e").cast("double").alias("value")
    )
    places = t.embeddings.select(
        "vec_id",
        F.posexplode(F.transform("embedding", lambda e, i: F.lit(60.0) + F.lit(0.5) * i)).alias("pos", "lat"),
    )
    return bind(values, places, ["vec_id", "pos"])


# -- aggregates -----------------------------------------------------------------------------


@query(
    "mean_sd_n",
    sql_with(
        "ice_daily",
        """SELECT ice_date, round(avg(sic * 100), 6) AS mean, round(stddev_samp(sic * 100), 6) AS sd, count(sic) AS n
           FROM ice_daily GROUP BY 1""",
    ),
)
def mean_sd_n(t):
    out = agg.mean_sd_n(v.ice_daily(t), ["ice_date"], F.col("sic") * 100)
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(
    "mean_cv",
    sql_with(
        "spectra",
        """SELECT sample, wavelength, sample_type, round(avg(absorption), 9) AS mean_absorption,
           round(abs(100 * stddev_samp(absorption) / nullif(avg(absorption), 0)), 6) AS cv_absorption
           FROM spectra GROUP BY 1, 2, 3""",
    ),
)
def mean_cv(t):
    out = agg.mean_cv(v.spectra(t), ["sample", "wavelength", "sample_type"], "absorption")
    return out.withColumns(
        {"mean_absorption": F.round("mean_absorption", 9), "cv_absorption": F.round("cv_absorption", 6)}
    )


@query(
    "conditional_mean",
    sql_with(
        "counts",
        """SELECT curve, round(avg(dpm) FILTER (WHERE regexp_matches(id, 'tc|t0', 'i')), 6) AS standard,
           round(avg(dpm) FILTER (WHERE regexp_matches(id, 'black|dark', 'i')), 6) AS blank FROM counts GROUP BY 1""",
    ),
)
def conditional_mean(t):
    from polynya.plans.light_curves import curve_references

    out = curve_references(v.counts(t), ["curve"])
    return out.withColumns({c: F.round(c, 6) for c in ("standard", "blank")})


@query(
    "band_median",
    sql_with(
        "spectra",
        """SELECT sample, round(median(absorption) FILTER (WHERE wavelength BETWEEN 683 AND 687), 9) AS baseline
           FROM spectra GROUP BY 1""",
    ),
)
def band_median(t):
    out = agg.band_median(
        v.spectra(t), ["sample"], F.col("absorption"), "wavelength", 683, 687, "baseline"
    )
    return out.withColumn("baseline", F.round("baseline", 9))


@query(
    "any_in_band",
    sql_with(
        "spectra",
        """, c AS (SELECT sample, wavelength BETWEEN 350 AND 370 AS inside,
             CASE WHEN replicate != 2 THEN absorption END > 0.1::DOUBLE AS c FROM spectra)
           SELECT sample, CASE WHEN bool_or(c) FILTER (WHERE inside) THEN true
             WHEN count(c) FILTER (WHERE inside) < count(*) FILTER (WHERE inside) THEN NULL ELSE false END AS any_high
           FROM c GROUP BY 1""",
    ),
)
def any_in_band(t):
    high = F.when(F.col("replicate") != 2, F.col("absorption")) > F.lit(0.1)
    inside = F.col("wavelength").between(350, 370)
    return v.spectra(t).groupBy("sample").agg(agg.any_known(high, inside).alias("any_high"))


@query(
    "value_at_max",
    sql_with(
        "curve_obs",
        """SELECT curve, arg_max(p, (light, -l_orderkey, -l_linenumber, p)) AS p_at_max_light, max(p) AS max_p
           FROM curve_obs GROUP BY 1""",
    ),
)
def value_at_max(t):
    return agg.value_at_max(v.curve_obs(t), ["curve"], "light", "p", ["l_orderkey", "l_linenumber"])


@query(
    "group_validity",
    sql_with(
        "counts",
        """SELECT curve, bool_or(regexp_matches(id, '^p', 'i')) AND bool_or(regexp_matches(id, '^t', 'i'))
           AND bool_or(regexp_matches(id, '^b', 'i')) AS is_valid FROM counts GROUP BY 1""",
    ),
)
def group_validity(t):
    return agg.has_ids(v.counts(t), ["curve"], "id", ["^p", "^t", "^b"])


@query("count_sorted", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_sorted(t):
    return agg.count_sorted(t.events, "event_type")


@query("daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(t):
    return agg.daily_counts(t.events, "ts")


@query(
    "histogram",
    "SELECT CAST(floor(value / 1 + 0.5::DOUBLE) AS DOUBLE) AS bin, count(*) AS n FROM events WHERE value > 0 GROUP BY 1",
)
def histogram(t):
    return agg.histogram(t.events.filter("value > 0"), F.col("value"), 1.0)


_BOX = """, q AS (SELECT source, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM sources GROUP BY 1)
    SELECT source, count(value) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
    round(any_value(q3), 6) AS q3,
    min(value) FILTER (WHERE value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_low,
    max(value) FILTER (WHERE value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_high,
    count(*) FILTER (WHERE value NOT BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
    FROM sources JOIN q USING (source) GROUP BY 1"""


@query("box_stats", sql_with("sources", _BOX))
def box_stats(t):
    out = agg.box_stats(v.sources(t), ["source"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "group_size_check",
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) != 4",
)
def group_size_check(t):
    return agg.group_size_check(t.lineitem, ["l_orderkey"], 4)


@query(
    "signal_to_noise",
    sql_with(
        "spectra",
        """SELECT sample, wavelength, round(s, 9) AS signal, round(r, 9) AS noise, round(s / nullif(r, 0), 6) AS ratio FROM (
           SELECT sample, wavelength, avg(absorption) FILTER (WHERE sample_type = 's') AS s,
           avg(abs(absorption)) FILTER (WHERE sample_type = 'r') AS r FROM spectra GROUP BY 1, 2)""",
    ),
)
def signal_to_noise(t):
    out = agg.signal_to_noise(v.spectra(t), ["sample"], "wavelength", "sample_type", "absorption")
    return out.withColumns(
        {"signal": F.round("signal", 9), "noise": F.round("noise", 9), "ratio": F.round("ratio", 6)}
    )


# -- ordered walks --------------------------------------------------------------------------


@query(
    "track_segments",
    """SELECT event_id, user_id, ts, value, CAST(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS xend,
       lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS yend,
       CAST(lead(event_id) OVER (ORDER BY ts, event_id) AS BIGINT) AS xend_all,
       lead(value) OVER (ORDER BY ts, event_id) AS yend_all FROM events""",
)
def track_segments(t):
    events = t.events.select("event_id", "user_id", "ts", "value")
    one = ordered.track_segments(events, ["ts", "event_id"], "event_id", "value")
    named = one.withColumnsRenamed({"xend": "xend_all", "yend": "yend_all"})
    return ordered.track_segments(named, ["ts", "event_id"], "event_id", "value", keys=["user_id"])


@query(
    "run_lengths",
    """, runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_id FROM
         (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new
          FROM events))
       SELECT event_id, user_id, event_type, CAST(run_id AS BIGINT) AS run_id,
       count(*) OVER (PARTITION BY user_id, run_id) AS run_length FROM runs""".replace(", runs", "WITH runs", 1),
)
def run_lengths(t):
    events = t.events.select("event_id", "user_id", "event_type", "ts")
    return ordered.run_lengths(events, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query(
    "group_broadcast",
    sql_with(
        "spectra",
        """SELECT sample, wavelength, replicate, sample_type, round(absorption, 9) AS absorption,
           round(absorption - avg(absorption) OVER (PARTITION BY sample), 6) AS centred FROM spectra""",
    ),
)
def group_broadcast(t):
    from polynya.operators.scale import with_group

    out = with_group(v.spectra(t), ["sample"], {"m": F.avg("absorption")})
    return out.select(
        "sample", "wavelength", "replicate", "sample_type",
        F.round("absorption", 9).alias("absorption"), F.round(F.col("absorption") - F.col("m"), 6).alias("centred"),
    )


@query(
    "sorted_check",
    """SELECT user_id, NOT coalesce(bool_or(value < before), false) AS is_sorted FROM
       (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1""",
)
def sorted_check(t):
    events = t.events.select("event_id", "user_id", "ts", "value")
    return ordered.sorted_check(events, ["user_id"], ["ts", "event_id"], "value")


# -- sort, head, sets -----------------------------------------------------------------------


@query("sort_multi", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC")
def sort_multi(t):
    return rel.sort_multi(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "-s_acctbal")


@query(
    "head_n",
    """(SELECT 'top' AS part, o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6)
       UNION ALL SELECT 'first', o_orderkey, o_custkey, o_totalprice FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def head_n(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    top = rel.head_n(o, 6, "-o_totalprice", "o_orderkey")
    first = rel.head_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    pick = lambda df, tag: df.select(F.lit(tag).alias("part"), "o_orderkey", "o_custkey", "o_totalprice")
    return pick(top, "top").unionByName(pick(first, "first"))


@query(
    "union_all",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def union_all(t):
    a = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS bal", "c_mktsegment AS segment")
    b = t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS bal")
    return rel.union_all(a, b)


_DIFF_A = "SELECT CAST(o_custkey % 500 AS BIGINT) AS k, CASE WHEN o_custkey % 3 != 0 THEN o_orderstatus END AS s FROM orders"


@query(
    "table_diff",
    f"""SELECT a.k, a.s FROM ({_DIFF_A}) a WHERE NOT EXISTS (SELECT 1 FROM
        (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 != 0 THEN 'F' END AS s FROM customer) b
        WHERE a.k IS NOT DISTINCT FROM b.k AND a.s IS NOT DISTINCT FROM b.s)""",
)
def table_diff(t):
    a = t.orders.select(
        (F.col("o_custkey") % 500).alias("k"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("s")
    )
    b = t.customer.select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.lit("F")).alias("s")
    )
    return rel.table_diff(a, b)


# -- reshape --------------------------------------------------------------------------------


@query(
    "unpivot_cols",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(unnest([1, 2, 3]) AS DOUBLE) AS replicate,
       unnest([l_discount, CASE WHEN l_tax > 0 THEN l_tax END, l_quantity]) AS absorbance FROM lineitem""",
)
def unpivot_cols(t):
    wide = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("replicate_1"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("replicate_2"), F.col("l_quantity").alias("replicate_3"),
    )
    return rel.unpivot_numbered(
        wide, ["l_orderkey", "l_linenumber", "l_partkey"],
        ["replicate_1", "replicate_2", "replicate_3"], "replicate", "absorbance",
    )


@query(
    "pivot_cols",
    sql_with(
        "spectra",
        """SELECT sample, wavelength, round(avg(absorption) FILTER (WHERE sample_type = 'r'), 9) AS r,
           round(avg(absorption) FILTER (WHERE sample_type = 's'), 9) AS s FROM spectra GROUP BY 1, 2""",
    ),
)
def pivot_cols(t):
    out = rel.pivot_columns(
        v.spectra(t), ["sample", "wavelength"], "sample_type", ["r", "s"], F.avg("absorption")
    )
    return out.withColumns({c: F.round(c, 9) for c in ("r", "s")})


@query(
    "nest_unnest",
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place,
       count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""",
)
def nest_unnest(t):
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rel.map_groups(
        o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"place": ("sum", F.lit(1))}, {"n": F.count(F.lit(1))}
    ).select("o_custkey", "o_orderkey", "o_totalprice", F.col("place").cast("int").alias("place"), "n")


@query(
    "seq_grid",
    sql_with(
        "curve_obs",
        """SELECT curve, round(low + i * ((high - low) / 99), 6) AS light FROM
           (SELECT curve, min(light) AS low, max(light) AS high FROM curve_obs GROUP BY 1), (SELECT unnest(range(100)) AS i)""",
    ),
)
def seq_grid(t):
    spans = v.curve_obs(t).groupBy("curve").agg(F.min("light").alias("low"), F.max("light").alias("high"))
    return rel.even_grid(spans, "low", "high", 100, "light").select("curve", F.round("light", 6).alias("light"))


# -- scalar functions -----------------------------------------------------------------------


@query(
    "fn_string",
    r"""SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host,
        regexp_matches(url, 'page=') AS paged, substring(url, 8, 6) AS part, split_part(url, '/', -1) AS base,
        regexp_replace(split_part(url, '/', -1), '\.[A-Za-z0-9]+$', '') AS stem,
        regexp_split_to_array(html, ' +')[2] AS second_word, 'id-' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS tag,
        translate(html, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ',
          'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY') AS ascii,
        CASE regexp_extract(url, '/(en|fr|de)/', 1) WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE 'other' END AS language
        FROM pages""",
)
def fn_string(t):
    url, html = F.col("url"), F.col("html")
    code = fn.regex_or_null(url, "/(en|fr|de)/", 1)
    return t.pages.select(
        "page_id",
        fn.regex_or_null(url, "^https?://([^/]+)", 1).alias("host"),
        url.rlike("page=").alias("paged"),
        F.substring(url, 8, 6).alias("part"),
        fn.base_name(url).alias("base"),
        fn.strip_extension(fn.base_name(url)).alias("stem"),
        F.get(F.split(html, " +"), F.lit(1)).alias("second_word"),
        F.format_string("id-%06d", "page_id").alias("tag"),
        fn.to_ascii(html).alias("ascii"),
        F.when(code == "en", "english").when(code == "fr", "french").otherwise("other").alias("language"),
    )


@query(
    "fn_parse_number",
    r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '-?[0-9]+(\.[0-9]+)?'), '') AS DOUBLE) AS number
        FROM documents""",
)
def fn_parse_number(t):
    return t.documents.select("doc_id", fn.parse_number(F.col("text")).alias("number"))


@query(
    "fn_date",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
       strftime(o_orderdate, '%Y%j') AS year_day, CAST(o_orderdate AS DATE) AS back,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days_since,
       CAST(DATE '1978-01-01' + CAST(o_custkey AS INTEGER) AS DATE) AS from_epoch, CAST(o_orderdate AS DATE) AS parsed,
       CAST(o_orderdate AS TIMESTAMP) AS stamp FROM orders""",
)
def fn_date(t):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        day.alias("day"),
        F.dayofyear(day).alias("doy"),
        fn.year_day(day).alias("year_day"),
        fn.from_year_day(fn.year_day(day)).alias("back"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.date_diff(day, F.to_date(F.lit("1995-01-01"))).alias("days_since"),
        fn.from_epoch_days(F.col("o_custkey"), "1978-01-01").alias("from_epoch"),
        F.to_date(F.date_format(day, "dd-MMM-yyyy"), "dd-MMM-yyyy").alias("parsed"),
        F.to_timestamp_ntz(
            F.concat(F.date_format(day, "yyyy MMM dd"), F.lit(" 00:00:00")), F.lit("yyyy MMM dd HH:mm:ss")
        ).alias("stamp"),
    )


@query(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 9) AS speed,
       round(exp(-l_discount), 9) AS decay, round(ln(nullif(l_discount, 0)), 9) AS logged, round(pow(l_quantity, 1.5::DOUBLE), 6) AS power,
       abs(l_discount - l_tax) AS gap, round(l_extendedprice / 7, 3) AS rounded,
       CASE WHEN l_discount = 0 THEN 0 ELSE round_even(l_discount / 7 * pow(10, 2 - floor(log10(l_discount / 7))), 0)
         / pow(10, 2 - floor(log10(l_discount / 7))) END AS three_digits,
       least(greatest(l_quantity, 5), 40) AS clamped, CASE WHEN l_tax = 0 THEN 0.5::DOUBLE ELSE l_tax END AS depth,
       round(l_quantity / nullif(l_discount, 0), 6) AS ratio FROM lineitem""",
)
def fn_math(t):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.round(F.sqrt(q * q + x * x), 9).alias("speed"),
        F.round(F.exp(-d), 9).alias("decay"),
        F.round(fn.safe_log(d), 9).alias("logged"),
        F.round(F.pow(q, F.lit(1.5)), 6).alias("power"),
        F.abs(d - x).alias("gap"),
        F.round(F.col("l_extendedprice") / 7, 3).alias("rounded"),
        fn.signif(d / 7, 3).alias("three_digits"),
        fn.clamp(q, 5.0, 40.0).alias("clamped"),
        F.when(x == 0, F.lit(0.5)).otherwise(x).alias("depth"),
        F.round(fn.ratio(q, d), 6).alias("ratio"),
    )
