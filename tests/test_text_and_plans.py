"""Text ingest, domain rules and guarded writes on small tables with known answers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from polynya.functions import scalars as fn
from polynya.operators import aggregates as agg
from polynya.operators import images as im
from polynya.operators import joins
from polynya.operators import relational as rel
from polynya.operators.gaps import fallback_sum
from polynya.operators.scale import scratch_path
from polynya.plans import absorption as ab
from polynya.plans import carbon, ice
from polynya.plans import light_curves as lc
from polynya.plans.bottles import bottle_table
from polynya.sources import sinks
from polynya.sources import text as tx
from tests.conftest import rows


def test_corpus_numbers_lines_across_splits(spark, tmp_path):
    want = {}
    for name, n in (("deep/stn1.TXT", 700), ("stn2.TXT", 3), ("stn3_ori.TXT", 5), ("note.md", 2)):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text("".join(f"line {i}\n" for i in range(n)))
        want[name] = n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = tx.corpus(spark, str(tmp_path), include=r"stn\d.*TXT$", exclude="ori").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 703
    assert all(r["line"] == f"line {r['pos']}" for r in got)
    assert {r["file"].rsplit("/", 1)[1] for r in got} == {"stn1.TXT", "stn2.TXT"}


def test_delimited(spark):
    df = spark.createDataFrame([(0, "banner"), (1, '1.5;"a;b";LOD'), (2, "x;;3")], "pos int, line string")
    schema = StructType([StructField("n", DoubleType()), StructField("t", StringType()), StructField("m", DoubleType())])
    got = tx.parse_delimited(tx.skip_banner(df, 1), schema, ";", ("", "LOD"))
    assert rows(got, "n", "t", "m") == [(None, None, 3.0), (1.5, "a;b", None)]


def test_bottles(spark):
    a = "     1  Jun 11 2016 " + " ".join(str(i + 0.5) for i in range(17)) + " (avg)"
    b = "           13:40:49 " + " ".join("0.1" for _ in range(13)) + " (sdev)"
    text = ["* x", "    Bottle   Date", "  Position  Time", a, b]
    df = spark.createDataFrame([("1601008.btl", i, l) for i, l in enumerate(text)], "file_name string, pos int, line string")
    got = bottle_table(df).first()
    assert (got["bottle"], got["sva"], got["sal00"], got["cast"]) == (1.0, 0.5, 16.5, 8.0)
    assert str(got["date"]) == "2016-06-11 13:40:49"


def test_scalars(spark):
    one = spark.createDataFrame([("a -1,234.5kg", "A2016180.L3", "Arc_20160711_res.nc", 0.00012345)], "t string, m string, i string, x double")
    got = one.select(
        fn.parse_number(F.col("t")), tx.date_in_name(F.col("m")).cast("string"), tx.date_in_name(F.col("i")).cast("string"),
        fn.signif(F.col("x"), 3), fn.regex_or_null(F.col("t"), "z(.)", 1), fn.to_ascii(F.lit("Été")),
        fn.clamp(F.lit(9.0), 0, 5), fn.clamp(F.lit(None).cast("double"), 0, 5),
    ).first()
    assert tuple(got) == (-1234.5, "2016-06-28", "2016-07-11", pytest.approx(0.000123), None, "Ete", 5.0, None)


def test_names_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, None)], "`Lat (deg N)` int, Empty int, `stationType` string")
    got = rel.drop_empty(rel.tidy_names(df))
    assert got.columns == ["lat_deg_n", "station_type"] and rows(got) == [(1, "x")]


def test_three_valued_any(spark):
    data = [("t", True), ("t", None), ("n", False), ("n", None), ("f", False)]
    df = spark.createDataFrame(data, "k string, c boolean").withColumn("inside", F.lit(True))
    df = df.unionByName(spark.createDataFrame([("e", True)], "k string, c boolean").withColumn("inside", F.lit(False)))
    got = dict(rows(df.groupBy("k").agg(agg.any_known(F.col("c"), F.col("inside")).alias("a"))))
    assert got == {"t": True, "n": None, "f": False, "e": False}


def spectrum(name, r, a, cv=1.0, a350=None):
    wl = [350.0, 400.0, 450.0, 500.0]
    return [(name, w, r, a350 if (w == 350 and a350 is not None) else a, cv) for w in wl]


def test_flags(spark):
    low, mid, high = 0.001, 0.008, 0.02
    data = (
        spectrum("clean", low, 0.1) + spectrum("spread", low, 0.1, cv=9.0) + spectrum("mid", mid, 0.1, cv=9.0)
        + spectrum("noisy", high, 0.1) + spectrum("strong", high, 0.1, a350=2.0) + spectrum("negative", high, -0.1)
        + spectrum("nocv", low, 0.1, cv=None) + spectrum("nor", None, 0.1) + [("no350", 400.0, low, 0.1, 1.0)]
    )
    df = spark.createDataFrame(data, "k string, wavelength double, r double, absorption double, cv_absorption double")
    for limit in (1, 2):
        got = dict(rows(ab.quality_flags(df, ["k"])))
        assert got == {
            "clean": 0, "spread": 7, "mid": 1, "noisy": 8, "strong": 6, "negative": 9, "nocv": 0, "nor": None, "no350": None,
        }


def test_undiluted(spark):
    data = [("d", 1.0, 350.0, 0.4, None), ("d", 2.0, 350.0, 0.9, 0.5), ("d", 3.0, 350.0, 0.8, None), ("e", 1.0, 350.0, 0.3, 0.5)]
    df = spark.createDataFrame(data, "jday string, to_depth double, wavelength double, absorption double, f double")
    got = rows(ab.undiluted(df), "jday", "to_depth", "absorption")
    assert got == [("d", 1.0, 0.4), ("d", 2.0, pytest.approx(1.4)), ("d", 3.0, 0.8), ("e", 1.0, 0.3)]


def test_open_water(spark):
    sic = [0.9, 0.85, 0.7, 0.4, 0.45, 0.3, 0.2, 0.05, 0.04, 0.03, 0.02]
    data = [("G1", f"2016-05-{i + 1:02d}", v, "2016-06-01") for i, v in enumerate(sic)]
    df = spark.createDataFrame(data, "station string, d string, sic double, s string").select(
        "station", F.to_date("d").alias("ice_date"), "sic", F.to_date("s").alias("sampling_date")
    )
    for limit in (1, 3):
        got = ice.days_open_water(df, first_month=5, blocks=limit)
        assert rows(got.select("sic_target", F.dayofmonth("dow_date"), "dow_length")) == [(0.1, 8, 24), (0.5, 5, 27), (0.8, 2, 30)]
    fixes = spark.createDataFrame([("G1", 0.5, "2016-05-10"), ("G9", 0.5, "2016-05-10")], "station string, sic_target double, d string").select(
        "station", "sic_target", F.to_date("d").alias("new_date")
    )
    fixed = ice.days_open_water(df, fixes, first_month=5).filter("sic_target = 0.5").first()
    assert (str(fixed["dow_date"]), fixed["dow_sic"], fixed["dow_length"]) == ("2016-05-10", 0.03, 22)


def test_production_and_choice(spark):
    data = [("c", "TC1", 1000.0, 0.0), ("c", "Dark", 10.0, 0.0), ("c", "P1", 110.0, 5.0), ("c", "p2", 60.0, 9.0)]
    df = spark.createDataFrame(data, "curve string, id string, dpm double, light double").withColumn("salinity", F.lit(31.0))
    out = lc.dpm_to_production(df, ["curve"], F.lit(120.0))
    want = [25900 * net / (1000 * 120 / 60) / (50 / 0.02) for net in (100.0, 50.0)]
    assert [r["p"] for r in out.orderBy("light").collect()] == pytest.approx(want)
    assert lc.model_choice(out, ["curve"], []).first()["model_type"] == "model1"
    dic = spark.range(1).select(*[lc.salinity_to_dic(F.lit(30.0), r) for r in ("linear", "step", "constant")]).first()
    assert tuple(dic) == (pytest.approx((30 * 0.067 - 0.05) * 0.96 * 12000), 25900.0, 25900.0)


def test_fallback_and_override(spark):
    one = spark.range(1)
    got = one.select(
        fallback_sum(F.lit(3.0), F.lit(4.0), 31.0), fallback_sum(F.lit(None).cast("double"), F.lit(4.0), 31.0),
        fallback_sum(F.lit(None).cast("double"), F.lit(None).cast("double"), 31.0),
    ).first()
    assert tuple(got) == (7.0, 4.0, 31.0)
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, s string")
    assert rel.table_diff(a, a).count() == 0
    assert rows(joins.natural_join(a, spark.createDataFrame([(None, 9)], "s string, z int"))) == [(1, None, 9)]
    with pytest.raises(ValueError):
        joins.assert_all_matched(a, a.filter("k = 1"), ["k"], "samples")
    joins.assert_all_matched(a, a, ["k"], "samples")


def test_ctd_profile(spark):
    data = [("2015-05-02", 2.0, 26.0, 32.0), ("2015-05-02", 2.0, 28.0, 32.0), ("2015-05-02", 5.0, float("nan"), 33.0), ("2015-05-02", 9.0, 29.0, None)]
    casts = spark.createDataFrame(data, "d string, depth double, sigt double, psal double").withColumn("date", F.to_date("d"))
    got = rows(carbon.ctd_profile(casts), "depth", "sigt", "psal", "water_density", "doy")
    assert got == [(0.5, 27.0, 32.0, 1027.0, 122), (1.5, 27.0, 32.0, 1027.0, 122), (2.0, 27.0, 32.0, 1027.0, 122), (5.0, 29.0, 33.0, 1029.0, 122), (9.0, 29.0, None, 1029.0, 122)]


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 2.5)], "i int, s string, d double")
    path = scratch_path(spark, "t")
    sinks.write_csv(df, path)
    assert rows(sinks.read_csv(spark, path, df.schema)) == rows(df)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_csv(df, path)
    sinks.write_csv(df.filter("i = 1"), path, overwrite=True)
    assert sinks.read_csv(spark, path, df.schema).count() == 1


def grid(spark, text):
    data = [(1, r, c, 1 if ch == "#" else 0) for r, line in enumerate(text) for c, ch in enumerate(line)]
    return spark.createDataFrame(data, "image_id int, row int, col int, bw int")


def test_small_components(spark):
    art = ["##....#.", "#....#..", "....#...", "...#....", "..#.....", "######..", "........", "#.#.#.#."]
    got = im.remove_small(grid(spark, art), 5)
    kept = {(r["row"], r["col"]) for r in got.collect() if r["bw"] == 1}
    want = {(r, c) for r, line in enumerate(art) for c, ch in enumerate(line) if ch == "#" and r < 7 and not (r <= 1 and c <= 1)}
    assert kept == want and got.count() == 64
    # Two components of four and one of five side by side.
    art = ["####.", ".....", "#####", ".....", "####."]
    kept = {(r["row"], r["col"]) for r in im.remove_small(grid(spark, art), 5).collect() if r["bw"] == 1}
    assert kept == {(2, c) for c in range(5)}


def test_opening_over_tile_edges(spark):
    n, spike = 3000, {1023, 1024, 2500}
    data = [(1, 0, c, 9.0 if c in spike or 100 <= c < 120 else 1.0) for c in range(n)]
    df = spark.createDataFrame(data, "image_id int, row int, col int, v double")
    got = {r["col"]: r["v"] for r in im.opening(df, 3).collect()}
    assert len(got) == n
    assert {c for c, v in got.items() if v == 9.0} == set(range(100, 120))


def test_otsu(spark):
    data = [(1, 0, i, 0.1 if i < 30 else 0.8) for i in range(50)]
    df = spark.createDataFrame(data, "image_id int, row int, col int, v double")
    got = im.binarise(df)
    assert got.filter("bw = 1").count() == 20


def test_components_over_tile_edges_equal_flood_fill(spark):
    import random

    rng = random.Random(3)
    on = {(r, c) for r in range(-30, 60) for c in range(70) if rng.random() < 0.3}
    data = [(1, r, c, 1 if (r, c) in on else None if (r + c) % 9 == 0 else 0, "x") for r in range(-30, 60) for c in range(70)]
    df = spark.createDataFrame(data, "image_id int, row int, col int, bw int, _tile string").repartition(3)
    for size in (1, 5, 9):
        got = {(r["row"], r["col"]) for r in im.remove_small(df, size, side=16).collect() if r["bw"] == 1}
        want, left = set(), set(on)
        while left:
            todo, part = [left.pop()], []
            while todo:
                r, c = todo.pop()
                part.append((r, c))
                near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            want |= set(part) if len(part) >= size else set()
        assert got == want


def test_sliding_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    px = {(r, c): float(rng.randint(0, 99)) for r in range(6) for c in range(90) if rng.random() < 0.8}
    df = spark.createDataFrame([(1, r, c, v) for (r, c), v in px.items()], "image_id int, row int, col int, v double")
    for radius in (2, 9, 14, 50):
        for f, pick in ((F.min, min), (F.max, max)):
            got = {(r["row"], r["col"]): r["v"] for r in im._sliding(df, "col", "row", radius, f).collect()}
            assert got == {
                (r, c): pick(px[r, k] for k in range(c - radius, c + radius + 1) if (r, k) in px) for r, c in px
            }


def test_rest_of_a_line_and_missing_order_values(spark):
    from polynya.operators.relational import distinct_first

    lines = [(0, 'a;"x;y";3;more;fields'), (1, "a;b;3"), (2, "a;b;3;"), (3, "")]
    df = spark.createDataFrame(lines, "pos int, line string")
    schema = StructType([StructField(n, StringType()) for n in "abc"])
    got = rows(tx.parse_delimited(df, schema, ";", rest="rest"), "pos", "b", "c", "rest")
    assert got[:3] == [(0, "x;y", "3", "more;fields"), (1, "b", "3", None), (2, "b", "3", None)]
    data = [("k", None, 1), ("k", 5, 2), ("k", 3, 3), ("only", None, 4)]
    picked = distinct_first(spark.createDataFrame(data, "k string, o int, v int"), ["k"], ["o"])
    assert rows(picked, "k", "v") == [("k", 3), ("only", 4)]
