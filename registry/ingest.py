"""Text corpora, headers, file names, unions and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from polynya.operators import relational as rel
from polynya.operators.ordered import Ordered
from polynya.operators.scale import scratch_path
from polynya.plans import bottles
from polynya.sources import sinks
from polynya.sources import text as tx
from registry import views as v
from registry.base import query
from registry.views import sql_with


@query(
    "corpus_scan",
    r"""SELECT lang, count(*) AS n_lines, sum(length(line)) AS n_chars, true AS numbered FROM
        (SELECT lang, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents WHERE lang != 'de') GROUP BY 1""",
)
def corpus_scan(t):
    root = scratch_path(t.spark, "corpus")
    t.documents.select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(root)
    lines = tx.corpus(t.spark, root, include=r"lang=[a-z]+/part-.*\.txt$", exclude="lang=de/")
    n = F.count(F.lit(1))
    dense = (F.min("pos") == 0) & (F.max("pos") == n - 1) & (F.sum("pos") == n * (n - 1) / 2)
    files = lines.groupBy("file").agg(n.alias("n"), F.sum(F.length("line")).alias("c"), dense.alias("dense"))
    return files.groupBy(F.regexp_extract("file", "lang=([a-z]+)", 1).alias("lang")).agg(
        F.sum("n").alias("n_lines"), F.sum("c").alias("n_chars"), F.bool_and("dense").alias("numbered")
    )


_FIELDS = StructType([StructField(n, StringType()) for n in ("a", "b", "c")])


@query(
    "banner_csv",
    sql_with(
        "lines",
        """, f AS (SELECT doc_id, pos, regexp_split_to_array(line, ',') AS p FROM lines WHERE pos >= 2 AND line != '')
           SELECT doc_id, pos, nullif(nullif(p[1], ''), '*****') AS a, nullif(nullif(p[2], ''), '*****') AS b, nullif(nullif(p[3], ''), '*****') AS c,
           CASE WHEN len(p) > 3 THEN nullif(array_to_string(p[4:], ','), '') END AS rest FROM f""",
    ),
)
def banner_csv(t):
    kept = tx.skip_banner(v.lines(t), 2).filter("line != ''")
    return tx.parse_delimited(kept, _FIELDS, sep=",", na=("", "*****"), quote="", rest="rest")


@query(
    "marker_section",
    sql_with(
        "lines",
        """, m AS (SELECT doc_id, min(pos) AS m FROM lines WHERE regexp_matches(line, 'tion') GROUP BY 1),
           k AS (SELECT doc_id, pos - m - 1 AS pos, regexp_split_to_array(line, '[ ,.]+') AS p FROM lines JOIN m USING (doc_id) WHERE pos > m)
           SELECT doc_id, pos, TRY_CAST(p[1] AS DOUBLE) AS wavelength, TRY_CAST(p[2] AS DOUBLE) AS replicate_1, len(p) AS n_fields FROM k""",
    ),
)
def marker_section(t):
    section = tx.after_marker(v.lines(t), ["doc_id"], "tion")
    counted = section.withColumn("n_fields", F.size(F.split("line", "[ ,.]+")).cast("bigint"))
    return tx.numeric_fields(counted, ["wavelength", "replicate_1"], sep="[ ,.]+")


@query(
    "two_line_records",
    """WITH r AS (SELECT conv_id, turn // 2 AS record, max(text) FILTER (WHERE turn % 2 = 0) AS a, max(text) FILTER (WHERE turn % 2 = 1) AS b
         FROM conversations GROUP BY 1, 2),
       f AS (SELECT conv_id, record, list_concat(regexp_split_to_array(coalesce(a, ''), ' +'), CASE WHEN b IS NULL THEN [] ELSE regexp_split_to_array(b, ' +') END) AS p FROM r)
       SELECT conv_id, record, p[1] AS bottle, p[2] AS month, p[4] AS year, p[9] AS sva FROM f""",
)
def two_line_records(t):
    turns = t.conversations.select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("line"))
    names = ["bottle", "month", "temp1", "year", "temp2", "temp3", "temp4", "temp5", "sva"]
    return tx.two_line_records(turns, ["conv_id"], names)


# The labelled lines of an image header: column, label, unit, type.
HEADER = [
    ("cruise_number", "Cruise_Number", "", "string"),
    ("acquisition_number", "Acquisition_Number", "", "string"),
    ("original_filename", "Original_Filename", "", "string"),
    ("start_time", "Start_Date_Time", "utc", "timestamp_ntz"),
    ("latitude", "Initial_Latitude", "deg", "double"),
    ("longitude", "Initial_Longitude", "deg", "double"),
    ("altitude", "Altitude", "m", "double"),
    ("roll", "Roll", "deg", "double"),
    ("pitch", "Pitch", "deg", "double"),
    ("heading", "Heading", "deg", "double"),
    ("track", "Track", "deg", "double"),
    ("speed", "Speed", "kt", "double"),
    ("sun_azimut", "Sun azimut", "deg", "double"),
    ("sun_zenith", "Sun zenith", "deg", "double"),
]


@query(
    "labelled_header",
    """SELECT o_orderkey AS file, 'CR' || o_custkey AS cruise_number, CAST(o_orderkey AS VARCHAR) AS acquisition_number, 'cam_' || o_orderkey || '.jpg' AS original_filename,
       CAST(o_orderdate AS TIMESTAMP) AS start_time, CAST(60 + o_custkey % 10 AS DOUBLE) AS latitude, CAST(-60 - o_custkey % 7 AS DOUBLE) AS longitude, o_totalprice AS altitude,
       CAST(o_custkey % 3 AS DOUBLE) AS roll, CAST(o_custkey % 5 AS DOUBLE) AS pitch, CAST(o_custkey % 360 AS DOUBLE) AS heading, CAST(o_custkey % 180 AS DOUBLE) AS track,
       CASE WHEN o_custkey % 4 != 0 THEN CAST(o_custkey % 13 AS DOUBLE) END AS speed, CAST(o_custkey % 90 AS DOUBLE) AS sun_azimut, CAST(NULL AS DOUBLE) AS sun_zenith FROM orders""",
)
def labelled_header(t):
    k = F.col("o_custkey")
    values = {
        "cruise_number": F.concat(F.lit("CR"), k), "acquisition_number": F.col("o_orderkey"),
        "original_filename": F.concat(F.lit("cam_"), "o_orderkey", F.lit(".jpg")),
        "start_time": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        "latitude": 60 + k % 10, "longitude": -60 - k % 7, "altitude": F.col("o_totalprice").cast("decimal(18,2)"), "roll": k % 3,
        "pitch": k % 5, "heading": k % 360, "track": k % 180,
        "speed": F.when(k % 4 == 0, F.lit("n/a")).otherwise((k % 13).cast("string")),
        "sun_azimut": k % 90, "sun_zenith": F.lit("unknown"),
    }
    lines = [
        F.concat(F.lit(f"{label}{' ' + unit if unit else ''}: "), values[name].cast("string"))
        for name, label, unit, _ in HEADER
    ]
    text = t.orders.select(F.col("o_orderkey").alias("file"), F.posexplode(F.array(*lines)).alias("pos", "line"))
    return tx.labelled_header(text, ["file"], {n: (label, kind) for n, label, _, kind in HEADER})


@query(
    "number_per_line",
    sql_with(
        "lines",
        r"""SELECT doc_id, pos AS row_index, TRY_CAST(nullif(regexp_extract(regexp_replace(line, '([0-9]),([0-9])', '\1\2', 'g'), '-?[0-9]+(\.[0-9]+)?'), '') AS DOUBLE) AS distance FROM lines""",
    ),
)
def number_per_line(t):
    return tx.number_per_line(v.lines(t), ["doc_id"], "distance")


_FILES = """(SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'data/X2016AM_stn' || (o_custkey % 40) || '_c' || lpad(CAST(o_custkey % 99 AS VARCHAR), 3, '0') || '_b' || (o_custkey % 12) || '_045_s.TXT'
    ELSE 'data/X2016IC_2016_' || (o_custkey % 200) || '_wat_LS_0_3cm_r.TXT' END AS name,
    'A' || strftime(o_orderdate, '%Y%j') || '.L3b_DAY.nc' AS modis, 'Arc_' || strftime(o_orderdate, '%Y%m%d') || '_res3.125.nc' AS ice,
    '1601' || lpad(CAST(o_custkey % 999 AS VARCHAR), 3, '0') || '.btl' AS btl, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)"""


@query(
    "filename_meta",
    f"""SELECT o_orderkey, p[1] AS mission, CASE WHEN am THEN p[2] END AS station, CASE WHEN am THEN p[3] END AS cast_no, CASE WHEN am THEN p[4] END AS bottle,
        CASE WHEN am THEN p[5] END AS depth, CASE WHEN am THEN p[6] ELSE p[8] END AS sample_type, CASE WHEN NOT am THEN p[2] END AS year,
        CASE WHEN NOT am THEN p[3] END AS jday, CASE WHEN NOT am THEN p[4] END AS water_type, CASE WHEN NOT am THEN p[5] END AS snow_type,
        CASE WHEN NOT am THEN p[6] END AS from_depth, CASE WHEN NOT am THEN p[7] END AS to_depth, day AS modis_day, day AS ice_day, CAST(o_custkey % 999 AS DOUBLE) AS cast_number
        FROM (SELECT *, contains(name, 'AM') AS am, string_split(replace(split_part(name, '/', -1), '.TXT', ''), '_') AS p FROM {_FILES})""",
)
def filename_meta(t):
    k = F.col("o_custkey")
    name = F.when(
        k % 2 == 0,
        F.concat(F.lit("data/X2016AM_stn"), k % 40, F.format_string("_c%03d", k % 99), F.lit("_b"), k % 12, F.lit("_045_s.TXT")),
    ).otherwise(F.concat(F.lit("data/X2016IC_2016_"), k % 200, F.lit("_wat_LS_0_3cm_r.TXT")))
    files = t.orders.select(
        "o_orderkey",
        name.alias("name"),
        F.concat(F.lit("A"), F.date_format("o_orderdate", "yyyyDDD"), F.lit(".L3b_DAY.nc")).alias("modis"),
        F.concat(F.lit("Arc_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_res3.125.nc")).alias("ice"),
        F.concat(F.lit("1601"), F.format_string("%03d", k % 999), F.lit(".btl")).alias("btl"),
    )
    from polynya.plans.absorption import CAMP_FIELDS, SHIP_FIELDS

    meta = tx.name_layout(F.col("name"), "AM", list(SHIP_FIELDS), list(CAMP_FIELDS))
    named = {("cast_no" if c == "cast" else c): e for c, e in meta.items()}
    return files.select(
        "o_orderkey", *[e.alias(c) for c, e in named.items()],
        tx.date_in_name(F.col("modis")).alias("modis_day"), tx.date_in_name(F.col("ice")).alias("ice_day"),
        tx.cast_in_name(F.col("btl")).alias("cast_number"),
    )


@query(
    "union_sources",
    """SELECT 'lab_c' AS source, user_id AS jday, value AS doc, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS serial FROM events WHERE event_type = 'click'
       UNION ALL SELECT 'lab_b', user_id, value, props, NULL FROM events WHERE event_type = 'view' AND value != 139
       UNION ALL SELECT 'lab_a', user_id, value, NULL, event_id FROM events WHERE event_type NOT IN ('click', 'view')""",
)
def union_sources(t):
    e = t.events.select(
        F.col("user_id").alias("jday"), F.col("value").alias("doc"), F.col("props").alias("note"),
        F.col("event_id").alias("serial"), "event_type",
    )
    return rel.union_sources(
        {
            "lab_c": e.filter("event_type = 'click'").select("jday", "doc"),
            "lab_b": e.filter("event_type = 'view' AND doc != 139").select("jday", "doc", "note"),
            "lab_a": e.filter("event_type NOT IN ('click', 'view')").select("jday", "doc", "serial"),
        }
    )


@query(
    "tidy_names_drop_empty",
    """SELECT CASE WHEN c_custkey % 7 != 0 THEN c_custkey END AS cust_key, CASE WHEN c_custkey % 7 != 0 THEN c_name END AS name_of_station,
       CASE WHEN c_custkey % 7 != 0 THEN c_acctbal END AS acct_bal_usd FROM customer WHERE c_custkey % 7 != 0""",
)
def tidy_names_drop_empty(t):
    known = F.col("c_custkey") % 7 != 0
    messy = t.customer.select(
        F.when(known, F.col("c_custkey")).alias("CustKey"),
        F.when(known, F.col("c_name")).alias("Name of station"),
        F.when(known, F.col("c_acctbal")).alias("acct-bal [USD]"),
        F.lit(None).cast("string").alias("Remarks"),
    )
    return rel.drop_empty(rel.tidy_names(messy))


# -- sinks: write, read back ----------------------------------------------------------------


@query("csv_sink", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 9 != 0 THEN o_orderpriority END AS priority FROM orders")
def csv_sink(t):
    df = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(df, path)
    return sinks.read_csv(t.spark, path, df.schema)


@query("columnar_sink", sql_with("spectra", "SELECT sample, wavelength, replicate, sample_type, round(absorption, 9) AS absorption FROM spectra"))
def columnar_sink(t):
    path = scratch_path(t.spark, "columnar")
    sinks.write_columnar(v.spectra(t).withColumn("absorption", F.round("absorption", 9)), path)
    return t.spark.read.parquet(path)


@query("guarded_sink", "SELECT n_nationkey, n_name, n_regionkey, true AS was_refused FROM nation")
def guarded_sink(t):
    from pyspark.errors import AnalysisException

    path = scratch_path(t.spark, "guarded")
    sinks.write_columnar(t.region, path)
    try:
        sinks.write_columnar(t.nation, path)
        refused = False
    except AnalysisException:
        refused = True
    sinks.write_columnar(t.nation, path, overwrite=True)
    return t.spark.read.parquet(path).withColumn("was_refused", F.lit(refused))


@query("year_split_sink", "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def year_split_sink(t):
    path = scratch_path(t.spark, "years")
    sinks.write_by_year(t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year")), path)
    return t.spark.read.parquet(path)


# -- bottle files ---------------------------------------------------------------------------


@query(
    "bottle_table",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
       SELECT '1601' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '.btl' AS file_name, CAST(k AS DOUBLE) AS bottle,
       o_totalprice AS sva, CAST(o_custkey % 100 AS DOUBLE) AS depsm, CAST(30 + o_orderkey % 5 AS DOUBLE) AS sal00,
       CAST(o_orderdate + to_hours(o_orderkey % 24) AS TIMESTAMP) AS date, CAST(o_custkey % 1000 AS DOUBLE) AS cast_no FROM r""",
)
def bottle_table(t):
    ranked = Ordered(
        t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderkey"]
    ).cumulative({"k": ("sum", F.lit(1))})
    fill = F.lit(" 1.5")
    sensors = [fill] * 17
    sensors[0] = F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    sensors[6] = F.concat(F.lit(" "), (F.col("o_custkey") % 100).cast("string"))
    sensors[16] = F.concat(F.lit(" "), (30 + F.col("o_orderkey") % 5).cast("string"))
    first = F.concat(
        F.lit("   "), F.col("k").cast("string"), F.date_format("o_orderdate", " MMM dd yyyy"), *sensors, F.lit(" (avg)")
    )
    second = F.concat(
        F.lit("   "), F.format_string("%02d:00:00", F.col("o_orderkey") % 24), *[fill] * 13
    )
    name = F.concat(F.lit("1601"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(".btl")).alias("file_name")
    body = ranked.select(name, F.col("k"), F.posexplode(F.array(first, second)).alias("i", "line")).select(
        "file_name", (F.col("k") * 2 + F.col("i") + 1).cast("bigint").alias("pos"), "line"
    )
    head = ranked.select(name).distinct().select(
        "file_name",
        F.posexplode(F.array(F.lit("* banner"), F.lit("    Bottle    Date   Sva"), F.lit("  Position    Time"))).alias("p", "line"),
    ).select("file_name", F.col("p").cast("bigint").alias("pos"), "line")
    out = bottles.bottle_table(head.unionByName(body), ["file_name"])
    return out.select("file_name", "bottle", "sva", "depsm", "sal00", "date", F.col("cast").alias("cast_no"))
