"""Fits and splines: known curves, and the spread plans against the plain ones."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polynya.operators import fitting
from polynya.operators import statistics as st
from polynya.operators.spline import spline_resample
from polynya.plans import light_curves as lc
from tests.conftest import rows


def curve(ps, a, b, p0, lights):
    return [(x, ps * (1 - math.exp(-a * x / ps)) * math.exp(-b * x / ps) + p0) for x in lights]


@pytest.fixture(scope="module")
def curves(spark):
    lights = [i * 13.0 for i in range(40)]
    data = [("two", *r) for r in curve(3.0, 0.03, 0.0, 0.2, lights)]
    data += [("one", *r) for r in curve(4.0, 0.08, 0.01, 0.1, lights)]
    data += [(None, *r) for r in curve(2.0, 0.02, 0.0, 0.0, lights)]
    data += [("few", 1.0, 2.0), ("few", 2.0, 3.0), ("flat", 5.0, 1.0), ("flat", 5.0, 2.0), ("flat", 5.0, 3.0), ("flat", 5.0, 3.5)]
    return spark.createDataFrame(data, "k string, light double, p double").cache()


@pytest.mark.parametrize("limit", [10_000, 9])
def test_saturating_recovers(curves, limit):
    got = {r["k"]: r for r in fitting.pe_saturating(curves, ["k"], share_rows=limit, rounds=3).collect()}
    two = got["two"]
    assert two["ps"] == pytest.approx(3.0, rel=1e-2) and two["alpha"] == pytest.approx(0.03, rel=1e-2)
    assert two["p0"] == pytest.approx(0.2, abs=1e-2) and two["rss"] < 1e-4
    assert got[None]["ps"] == pytest.approx(2.0, rel=2e-2)
    assert got["few"]["ps"] is None and got["few"]["n"] == 2
    assert got["flat"]["ps"] is None and len(got) == 5


@pytest.mark.parametrize("limit", [10_000, 11])
def test_photoinhibition_recovers(curves, limit):
    got = {r["k"]: r for r in fitting.pe_photoinhibition(curves, ["k"], share_rows=limit).collect()}
    assert got["one"]["rss"] < 1e-2
    bounded = {r["k"]: r for r in fitting.pe_photoinhibition(curves, ["k"], ps_max=1.5, share_rows=limit).collect()}
    assert bounded["one"]["ps"] <= 1.5 and bounded["one"]["rss"] > got["one"]["rss"]


def test_whole_curves_are_one_shuffle_and_equal_cut_ones(spark):
    rng = np.random.default_rng(5)
    data = [(None if k == 7 else k, float("nan") if k == 3 else 1.0 * (k % 2), *r) for k in range(90) for r in
            curve(1.0 + k % 5, 0.02 + 0.01 * (k % 3), 0.004 * (k % 4), 0.1, rng.uniform(0, 700, int(rng.integers(1, 40))).tolist())]
    data += [(200, 0.0, 0.0, float(i)) for i in range(9)] + [(201, 0.0, 10.0 * i, 2.0) for i in range(9)]
    df = spark.createDataFrame(data, "a int, b double, light double, p double").repartition(5)
    # The rounds add no shuffle to the one that lays the rows out by key.
    plain = fitting.whole_curves(df.selectExpr("a", "b", "light AS _x", "p AS _y"), ["a", "b"], [fitting.SATURATION_2D, fitting.INHIBITION], fitting.RISE, fitting.FALL, 1e-6, 10.0, 3)
    assert plain._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    key = lambda r: (r["a"], str(r["b"]))
    got, cut = ({key(r): r for r in fitting.pe_photoinhibition(df, ["a", "b"], ps_max=10.0, share_rows=n).collect()} for n in (fitting.SHARE_ROWS, 6))
    assert got.keys() == cut.keys() and len(got) == 92
    for k, r in got.items():
        for c in ("n", "tss", "ps", "alpha", "beta", "p0", "rss", "at_edge"):
            assert (r[c] is None) == (cut[k][c] is None) and (r[c] is None or r[c] == pytest.approx(cut[k][c], rel=1e-6, abs=1e-9)), (k, c)
    assert got[(200, "0.0")]["ps"] is None and got[(200, "0.0")]["n"] == 9


def test_first_rows():
    table = pa.table({"k": ["a", "a", None, None, "b", "b"], "v": [1.0, 1.0, float("nan"), float("nan"), 2.0, 3.0]})
    assert fitting.first_rows(table, ["k"]).tolist() == [0, 2, 4] and fitting.first_rows(table, ["k", "v"]).tolist() == [0, 2, 4, 5]


def test_metrics(spark, curves):
    one = fitting.pe_photoinhibition(curves.filter("k = 'one'"), ["k"])
    two = fitting.pe_saturating(curves.filter("k = 'two'"), ["k"])
    got = {r["k"]: r for r in lc.metrics(one.unionByName(two).withColumn("chla", F.lit(2.0)), "chla").collect()}
    a, b, ps = (got["one"][c] for c in ("alpha", "beta", "ps"))
    assert got["one"]["pm"] == pytest.approx(ps * a / (a + b) * (b / (a + b)) ** (b / a))
    assert got["one"]["im"] == pytest.approx(ps / a * math.log((a + b) / b))
    assert all(got["two"][c] is None for c in ("pm", "ek", "im", "ib", "beta_b", "pb_max"))
    assert got["two"]["alpha_b"] == pytest.approx(got["two"]["alpha"] / 2)
    assert all(r["r2"] <= 1 for r in got.values())


def test_decay_and_prediction(spark, curves):
    data = [("f", float(z), 2 * math.exp(-0.15 * (z - 10)) + 0.4) for z in range(1, 40)]
    par = spark.createDataFrame(data, "file string, depth double, par double")
    fit = fitting.nls_decay(par, ["file"], "depth", "par", rounds=3).first()
    assert fit["kd"] == pytest.approx(0.15, rel=1e-2) and fit["k"] == pytest.approx(0.4, abs=2e-2)
    params = fitting.pe_saturating(curves, ["k"])
    at = fitting.predict_curve(params, ["k"], curves)
    assert {r["k"] for r in at.select("k").distinct().collect()} == {"two", "one", None}
    worst = at.filter("k = 'two'").agg(F.max(F.abs(F.col("fitted") - F.col("p")))).first()[0]
    assert worst < 0.02


def fmm(x, y, at):
    """Dense solve of the spline equations, for comparison."""
    n, h, sl = len(x), np.diff(x), np.diff(y) / np.diff(x)
    m, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = [h[i - 1], 2 * (h[i - 1] + h[i]), h[i]]
        r[i] = sl[i] - sl[i - 1]
    third = lambda i: np.polyfit(x[i : i + 4] - x[i], y[i : i + 4], 3)[0]
    m[0, :2], r[0] = [-h[0], h[0]], third(0) * h[0] ** 2
    m[-1, -2:], r[-1] = [h[-1], -h[-1]], -third(n - 4) * h[-1] ** 2
    s = np.linalg.solve(m, r)
    out = []
    for u in at:
        i = min(max(np.searchsorted(x, u, side="right") - 1, 0), n - 2)
        t = u - x[i]
        b = sl[i] - h[i] * (s[i + 1] + 2 * s[i])
        out.append(y[i] + t * (b + t * (3 * s[i] + t * (s[i + 1] - s[i]) / h[i])))
    return np.array(out)


@pytest.mark.parametrize("limit", [1, 8])
def test_spline(spark, limit):
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(395, 695, 37))
    y = np.sin(x / 30) + x / 100
    data = [("wave", float(a), float(b)) for a, b in zip(x, y)] + [("wave", float(x[5]), float(y[5]))]
    cubic = lambda v: 0.001 * (v - 500) ** 3 - 0.2 * v + 3
    data += [("cubic", v, cubic(v)) for v in (410.0, 450.0, 520.0, 600.0, 660.0)]
    data += [("line", 450.0, 1.0), ("line", 550.0, 3.0), ("dot", 500.0, 4.0)]
    data += [("three", 450.0, 1.0), ("three", 550.0, 3.0), ("three", 650.0, 2.0)]
    df = spark.createDataFrame(data, "k string, w double, e double")
    got = {}
    for r in spline_resample(df, ["k"], "w", "e", 400.0, 700.0, 1.0, blocks=limit).collect():
        got.setdefault(r["k"], {})[r["w"]] = r["e"]
    grid = np.arange(400.0, 701.0)
    assert all(len(v) == 301 for v in got.values()) and len(got) == 5
    values = lambda k: np.array([got[k][u] for u in grid])
    assert values("wave") == pytest.approx(fmm(x, y, grid), rel=1e-8, abs=1e-8)
    assert values("cubic") == pytest.approx(cubic(grid), rel=1e-7)
    assert values("line") == pytest.approx(1 + (grid - 450) / 50)
    assert values("dot") == pytest.approx(np.full(301, 4.0))
    assert got["three"][450.0] == pytest.approx(1.0) and got["three"][650.0] == pytest.approx(2.0)


def test_line_and_f_tail(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1 + (x % 2)) for x in range(10)], "x double, y double")
    fit = st.lm(df, [], F.col("x"), F.col("y")).first()
    slope, intercept = np.polyfit([r["x"] for r in df.collect()], [r["y"] for r in df.collect()], 1)
    assert (fit["slope"], fit["intercept"]) == pytest.approx((slope, intercept))
    same = spark.createDataFrame([(1.0, float(v)) for v in range(5)], "x double, y double")
    none = st.lm(same, [], F.col("x"), F.col("y")).first()
    assert none["slope"] is None and none["sigma"] is None
    tail = lambda f, a, b: spark.range(1).select(st.f_tail(F.lit(f), F.lit(a), F.lit(b))).first()[0]
    assert tail(4.0, 2, 10) == pytest.approx((1 + 2 * 4.0 / 10) ** (-5), rel=1e-6)
    assert tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)


def test_interp(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 1.0, 20.0), ("a", 2.0, 30.0), ("b", 3.0, 1.0)], "k string, d double, s double")
    got = st.interp_at(df, ["k"], "d", "s", [1.5])
    assert rows(got, "k", "s") == [("a", 22.5), ("b", None)]
    assert st.interp_at(df, ["k"], "d", "s", [2.0]).filter("k = 'a'").first()["s"] == 30.0


def test_tukey(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(m + e)) for g, m in (("a", 0), ("b", 1), ("c", 5)) for e in rng.normal(size=9)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r["group1"], r["group2"]): r for r in st.tukey_hsd(df, "g", "v").collect()}
    assert len(got) == 3 and got["a", "c"]["adj_p_value"] < 1e-6
    for r in got.values():
        # qtukey(0.95, 3, 24) from published tables.
        assert (r["conf_high"] - r["estimate"]) / r["std_error"] == pytest.approx(3.5317, abs=2e-3)
    table = st.anova_oneway(df, "g", "v", p_value=True).collect()
    assert table[0]["df"] == 2 and table[1]["df"] == 24 and table[0]["p_value"] < 1e-6


def test_anova_and_pairs_far_from_zero(spark):
    """Groups 1e-3 apart around 1e9: what is left of the spread after storage, not of a difference of squares."""
    import itertools

    values = {g: [1e9 + 1e-3 * g + 1e-3 * ((7 * i) % 11 - 5) for i in range(30)] for g in range(40)}
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs], "g int, x double").repartition(5)
    exact = {g: [Fraction(x) for x in xs] for g, xs in values.items()}
    mean = {g: sum(xs) / len(xs) for g, xs in exact.items()}
    grand = sum(map(sum, exact.values())) / sum(map(len, exact.values()))
    between = float(sum(30 * (m - grand) ** 2 for m in mean.values()))
    within = float(sum((x - mean[g]) ** 2 for g, xs in exact.items() for x in xs))
    got = {r["term"]: r for r in st.anova_oneway(df, "g", "x").collect()}
    assert got["g"]["sumsq"] == pytest.approx(between, rel=1e-3)
    assert got["Residuals"]["sumsq"] == pytest.approx(within, rel=1e-3)
    pairs = {(r["group1"], r["group2"]): r["estimate"] for r in st.tukey_pairs(df, "g", "x").collect()}
    assert set(pairs) == set(itertools.combinations(range(40), 2))
    assert pairs[3, 9] == pytest.approx(float(mean[9] - mean[3]), abs=3e-7)


def test_edge_of_the_grid_is_marked_and_decay_is_predicted(spark):
    lights = [0.0] + [float(x) for x in range(50, 1000, 50)]
    data = [("steep", x, p) for x, p in curve(2.0, 60.0, 0.0, 0.1, lights)]
    data += [("plain", x, p) for x, p in curve(2.0, 0.02, 0.0, 0.1, lights)]
    df = spark.createDataFrame(data, "k string, light double, p double")
    got = {r["k"]: r["at_edge"] for r in fitting.pe_saturating(df, ["k"]).collect()}
    assert got == {"steep": True, "plain": False}
    points = [("f", float(d), 3 * math.exp(-0.2 * (d - 10)) + 1) for d in range(0, 40, 2)] + [("short", 1.0, 2.0)]
    obs = spark.createDataFrame(points, "file string, depth double, par double")
    out = fitting.predict_decay(fitting.nls_decay(obs, ["file"], "depth", "par"), ["file"], obs).collect()
    assert {r["file"] for r in out} == {"f"}
    assert all(r["fitted"] == pytest.approx(r["par"], rel=1e-2) for r in out)


def test_spline_in_blocks_equals_one_system(spark):
    from polynya.operators.ordered import Ordered

    rng = np.random.default_rng(2)
    x = np.cumsum(rng.exponential(1.0, 4000) ** 3 + 1e-3)
    data = [("long", float(a), float(b)) for a, b in zip(x, rng.normal(size=4000))]
    data += [(k, float(i), float(i * i)) for k in ("short", None) for i in range(5)]
    df = spark.createDataFrame(data, "k string, w double, e double")
    assert len(Ordered(df, ["k"], ["w"], blocks=6).cuts[0][1]) >= 3
    args = (["k"], "w", "e", 0.0, float(x[-1]), float(x[-1]) / 5000)
    whole = rows(spline_resample(df, *args, small=True))
    cut = rows(spline_resample(df, *args, blocks=6))
    assert len(whole) == len(cut)
    for a, b in zip(whole, cut):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9)
