"""Ordered walks: the split plan must give what a plain window gives, hot keys included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from polynya.functions.quantiles import group_quantiles
from polynya.operators import gaps, ordered
from polynya.operators.aggregates import box_stats
from polynya.operators.ordered import Ordered
from polynya.operators.scale import null_safe_join, with_group
from polynya.operators.statistics import trapezoid
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, a null key, blanks, repeated values."""
    rng = random.Random(5)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])
        value = None if rng.random() < 0.4 else float(rng.randint(0, 20))
        data.append((key, i * 7 % 901, value))
    return spark.createDataFrame(data, "k string, pos int, v double").cache()


@pytest.mark.parametrize("blocks", [1, 4, 23])
def test_cumulative_matches_window(skewed, blocks):
    w = Window.partitionBy("k").orderBy("pos")
    want = skewed.withColumns(
        {
            "s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "l": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "x": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            "r": F.sum("v").over(w.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    got = Ordered(skewed, ["k"], ["pos"], blocks=blocks).cumulative(
        {"s": ("sum", F.col("v")), "l": ("last", F.col("v")), "x": ("next", F.col("v")), "r": ("rest", F.col("v"))}
    )
    assert rows(got, *want.columns) == rows(want)


@pytest.mark.parametrize("blocks", [1, 5, 400])
def test_frame_matches_window(skewed, blocks):
    def build(w):
        return {
            "a": F.lead("v", 2).over(w),
            "b": F.lag("pos", 3).over(w),
            "n": F.count(F.lit(1)).over(w.rowsBetween(1, 3)),
        }

    want = skewed.withColumns(build(Window.partitionBy("k").orderBy("pos")))
    got = Ordered(skewed, ["k"], ["pos"], blocks=blocks).frame(3, 3, build)
    assert rows(got, *want.columns) == rows(want)


def test_one_sequence_without_keys(skewed):
    one = ordered.track_segments(skewed, ["pos"], "pos", "v", blocks=9)
    want = skewed.withColumn("xend", F.lead("pos").over(Window.orderBy("pos")))
    assert rows(one, "pos", "xend") == rows(want, "pos", "xend")


@pytest.mark.parametrize("blocks", [1, 7])
def test_runs_and_sorted(spark, blocks):
    data = [("a", i, v) for i, v in enumerate([1, 1, 2, 2, 2, None, None, 1] * 12)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    got = rows(ordered.run_lengths(df, ["k"], ["i"], "v", blocks=blocks), "i", "run_id", "run_length")
    assert got[:9] == [
        (0, 1, 2), (1, 1, 2), (2, 2, 3), (3, 2, 3), (4, 2, 3), (5, 3, 2), (6, 3, 2), (7, 4, 3), (8, 4, 3),
    ]
    assert rows(ordered.sorted_check(df, ["k"], ["i"], "v", blocks=blocks)) == [("a", False)]
    up = df.withColumn("v", F.col("i"))
    assert rows(ordered.sorted_check(up, ["k"], ["i"], "v", blocks=blocks)) == [("a", True)]


@pytest.mark.parametrize("blocks", [1, 11])
def test_quantiles(skewed, blocks):
    want = skewed.groupBy("k").agg(
        F.percentile("v", 0.25).alias("q"), F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.999).alias("z")
    )
    got = group_quantiles(skewed, ["k"], "v", {"q": 0.25, "m": 0.5, "z": 0.999}, blocks=blocks)
    for g, w in zip(rows(got, "k", "q", "m", "z"), rows(want)):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:])
    whole = group_quantiles(skewed, [], "v", {"m": 0.5}, blocks=blocks)
    assert whole.first()["m"] == skewed.agg(F.percentile("v", 0.5)).first()[0]


def test_quantiles_keep_empty_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 1.0), (None, 2.0)], "k string, v double")
    for blocks in (1, 5):
        assert rows(group_quantiles(df, ["k"], "v", {"m": 0.5}, blocks=blocks)) == [
            (None, 2.0), ("a", None), ("b", 1.0),
        ]


def test_fills(spark):
    data = [("g", 1, None), ("g", 2, 5.0), ("g", 3, None), ("g", 4, 7.0), ("h", 1, None)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    for blocks in (1, 3):
        got = rows(gaps.fill_down_up(df, ["k"], ["i"], ["v"], blocks=blocks), "k", "i", "v")
        assert got == [("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 5.0), ("g", 4, 7.0), ("h", 1, None)]
        got = rows(gaps.fill_from_below(df, ["k"], ["i"], ["v"], blocks=blocks), "k", "i", "v")
        assert got == [("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 7.0), ("g", 4, 7.0), ("h", 1, None)]


def test_trapezoid_split(spark):
    df = spark.range(0, 101).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"))
    df = df.withColumn("y", F.col("x") * 2)
    for blocks in (1, 9):
        assert trapezoid(df, ["k"], "x", "y", "area", blocks=blocks).first()["area"] == pytest.approx(10_000)


def test_with_group_and_null_keys(skewed):
    got = with_group(skewed, ["k"], {"n": F.count(F.lit(1))})
    assert got.count() == skewed.count()
    want = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert all(want[r["k"]] == r["n"] for r in got.collect())
    with pytest.raises(ValueError):
        null_safe_join(skewed, skewed, [])


def test_box_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "k string, v double")
    got = box_stats(df, ["k"], "v").first()
    assert (got["n"], got["outliers"], got["whisker_low"], got["whisker_high"]) == (6, 1, 1.0, 5.0)
    assert (got["q1"], got["median"], got["q3"]) == (2.25, 3.5, 4.75)


def test_a_hot_group_is_cut_and_the_others_are_not(spark, skewed):
    walk = Ordered(skewed, ["k"], ["pos"], blocks=9)
    blocks = dict(rows(walk.df.groupBy("k").agg(F.count_distinct("_walk_block").alias("n"))))
    assert blocks["hot"] == 3 and set(blocks) == {"hot", "a", "b", "c", None}
    assert all(n <= 2 for k, n in blocks.items() if k != "hot")
    assert Ordered(skewed, ["k"], ["pos"], small=True).cuts == []
    sizes = walk.df.filter("k = 'hot'").groupBy("_walk_block").count()
    assert max(r["count"] for r in sizes.collect()) < 150


def test_order_values_of_every_kind(spark):
    nan = float("nan")
    data = [(None, nan), (None, 1.0), ("", None), ("a", nan), ("a", 2.0), ("é", 1.0), ("b", None)] * 1
    df = spark.createDataFrame([(s, x, i) for i, (s, x) in enumerate(data)], "s string, x double, i int")
    w = Window.orderBy("s", "x", "i")
    want = df.withColumn("n", F.lead("i").over(w)).withColumn("t", F.sum("i").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    led = Ordered(df, [], ["s", "x", "i"], blocks=5).frame(0, 1, lambda v: {"n": F.lead("i").over(v)})
    got = Ordered(led, [], ["s", "x", "i"], blocks=5).cumulative({"t": ("sum", F.col("i"))})
    assert rows(got, "i", "n", "t") == rows(want, "i", "n", "t")
