"""Statistics, curve fits and the light-response pipeline."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from polynya.operators import fitting, relational as rel
from polynya.operators import statistics as st
from polynya.plans import light_curves as lc
from registry import views as v
from registry.base import query
from registry.views import sql_with

# -- straight lines -------------------------------------------------------------------------

_LM = """count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(y) AS my"""


def lm_sql(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    by = f" GROUP BY {keys}" if keys else ""
    return f"""(SELECT {lead}n, mx, sxx, slope, my - slope * mx AS intercept, sigma,
      sigma / sqrt(sxx) AS se_slope, sigma * sqrt(1.0::DOUBLE / n + mx * mx / sxx) AS se_intercept, slope * sxy / nullif(syy, 0) AS r2
      FROM (SELECT *, CASE WHEN n >= 3 AND slope IS NOT NULL THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) END AS sigma FROM
      (SELECT *, CASE WHEN n >= 2 AND sxx > 0 THEN sxy / sxx END AS slope FROM
      (SELECT {lead}{_LM} FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL{by}))))"""


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


_LM_OUT = """n, round(slope, 9) AS slope, round(intercept, 6) AS intercept, round(se_slope, 9) AS se_slope,
    round(se_intercept, 6) AS se_intercept, round(slope / nullif(se_slope, 0), 6) AS t_slope, round(r2, 9) AS r2"""


def lm_out(df, *keys):
    return df.select(
        *keys, "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"),
        F.round("se_slope", 9).alias("se_slope"), F.round("se_intercept", 6).alias("se_intercept"),
        F.round("t_slope", 6).alias("t_slope"), F.round("r2", 9).alias("r2"),
    )


_LI = "(SELECT l_quantity AS x, l_extendedprice AS y, l_suppkey FROM lineitem)"


@query("lm_simple", f"SELECT {_LM_OUT} FROM {lm_sql(_LI)}")
def lm_simple(t):
    return lm_out(st.lm(t.lineitem, [], F.col("l_quantity"), F.col("l_extendedprice")))


@query(
    "lm_grouped",
    f"""SELECT l_suppkey, {_LM_OUT} FROM {lm_sql("(SELECT l_suppkey, l_quantity AS x, CASE WHEN l_discount > 0 THEN ln(l_discount) END AS y FROM lineitem)", "l_suppkey")}""",
)
def lm_grouped(t):
    from polynya.functions.scalars import safe_log

    fit = st.lm(t.lineitem, ["l_suppkey"], F.col("l_quantity"), safe_log(F.col("l_discount")))
    return lm_out(fit, "l_suppkey")


@query(
    "lm_predict",
    f"""WITH f AS (SELECT * FROM {lm_sql("(SELECT o_custkey % 10 AS g, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders)", "g")}),
        w AS (SELECT * FROM {lm_sql("(SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders)")})
        SELECT c_custkey, round(f.intercept + f.slope * c_custkey, 4) AS fitted,
        round(f.sigma * sqrt(1.0::DOUBLE / f.n + (c_custkey - f.mx) * (c_custkey - f.mx) / f.sxx), 4) AS se,
        round(w.intercept + w.slope * c_custkey, 4) AS fitted_all
        FROM customer LEFT JOIN f ON f.g = c_custkey % 10, w""",
)
def lm_predict(t):
    o = t.orders.withColumn("g", F.col("o_custkey") % 10)
    x, y = F.col("o_custkey"), F.col("o_totalprice")
    c = t.customer.select("c_custkey", (F.col("c_custkey") % 10).alias("g"))
    one = st.lm_predict(c, st.lm(o, ["g"], x, y), "c_custkey", "fitted", ["g"], se="se")
    both = st.lm_predict(one, st.lm(o, [], x, y), "c_custkey", "fitted_all")
    return rounded(both, 4, "fitted", "se", "fitted_all").drop("g")


@query(
    "residual_compare",
    """SELECT o_orderkey, o_totalprice, method, round(residual, 4) AS residual FROM (
       SELECT o_orderkey, o_totalprice, unnest(['half', 'linear', 'flat']) AS method,
       unnest([abs(o_totalprice - o_totalprice / 2), abs(o_totalprice - (1000 + 10 * o_custkey)), abs(o_totalprice - 150000)]) AS residual
       FROM orders WHERE o_totalprice IS NOT NULL)""",
)
def residual_compare(t):
    df = t.orders.select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") / 2).alias("a"),
        (1000 + 10 * F.col("o_custkey")).cast("double").alias("b"), F.lit(150000.0).alias("c"),
    )
    out = st.residual_compare(df, ["o_orderkey"], "o_totalprice", {"half": "a", "linear": "b", "flat": "c"})
    return rounded(out, 4, "residual")


# -- analysis of variance, pairs, correlations ----------------------------------------------

_GROUPS = """, g AS (SELECT source, count(value) AS n, avg(value) AS m, regr_sxx(value, value) AS ss FROM sources GROUP BY 1),
   c AS (SELECT avg(m) AS c FROM g),
   a AS (SELECT sum(n) AS n, count(*) AS k, sum(n * (m - c) * (m - c)) - sum(n * (m - c)) * sum(n * (m - c)) / sum(n) AS b, sum(ss) AS w FROM g, c)"""


@query(
    "anova_oneway",
    sql_with(
        "sources",
        _GROUPS
        + """SELECT 'source' AS term, CAST(k - 1 AS BIGINT) AS df, round(b, 4) AS sumsq, round(b / (k - 1), 4) AS meansq,
             round((b / (k - 1)) / (w / (n - k)), 6) AS statistic,
             round(list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
               * pow(sin(cut / 2000 * i), n - k - 1) * pow(cos(cut / 2000 * i), k - 2))) * cut / 6000
               / (list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
               * pow(sin(pi() / 4000 * i), n - k - 1) * pow(cos(pi() / 4000 * i), k - 2))) * pi() / 12000), 6) AS p_value
             FROM (SELECT *, asin(sqrt((n - k)::DOUBLE / ((n - k) + (k - 1) * (b / (k - 1)) / (w / (n - k))))) AS cut FROM a)
             UNION ALL SELECT 'Residuals', CAST(n - k AS BIGINT), round(w, 4), round(w / (n - k), 4), NULL, NULL FROM a""",
    ),
)
def anova_oneway(t):
    out = st.anova_oneway(v.sources(t), "source", "value", p_value=True)
    return rounded(rounded(out, 4, "sumsq", "meansq"), 6, "statistic", "p_value")


@query(
    "tukey_pairs",
    sql_with(
        "sources",
        _GROUPS
        + """SELECT x.source AS group1, y.source AS group2, round(y.m - x.m, 6) AS estimate,
             round(sqrt(w / (a.n - k) / 2 * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)), 6) AS std_error,
             round(abs(y.m - x.m) / sqrt(w / (a.n - k) / 2 * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)), 6) AS q,
             CAST(a.n - k AS BIGINT) AS df FROM g x JOIN g y ON x.source < y.source, a""",
    ),
)
def tukey_pairs(t):
    return rounded(st.tukey_pairs(v.sources(t), "source", "value"), 6, "estimate", "std_error", "q")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "corr_matrix",
    sql_with(
        "sources",
        ", wide AS (SELECT user_id, day, "
        + ", ".join(f"avg(value) FILTER (WHERE source = '{s}') AS {s}" for s in _TYPES)
        + " FROM sources GROUP BY 1, 2) "
        + " UNION ALL ".join(
            f"""SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
            CASE WHEN count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) >= 2 THEN round(corr({a}, {b}), 9) END AS r FROM wide"""
            for i, a in enumerate(_TYPES) for b in _TYPES[i + 1 :]
        ),
    ),
)
def corr_matrix(t):
    return rounded(st.corr_matrix(v.sources(t), ["user_id", "day"], "source", "value", _TYPES), 9, "r")


# -- interpolation and integration ----------------------------------------------------------


@query(
    "interp_at",
    sql_with(
        "profiles",
        """, prof AS (SELECT day, depth, avg(salinity) AS s FROM profiles GROUP BY 1, 2),
           tt AS (SELECT *, unnest([1.5::DOUBLE, 20]) AS tgt FROM prof),
           br AS (SELECT day, tgt, max(depth) FILTER (WHERE depth <= tgt) AS x1, min(depth) FILTER (WHERE depth >= tgt) AS x2,
             arg_max(s, depth) FILTER (WHERE depth <= tgt) AS y1, arg_min(s, depth) FILTER (WHERE depth >= tgt) AS y2 FROM tt GROUP BY 1, 2)
           SELECT day, depth, round(s, 6) AS salinity FROM prof UNION ALL
           SELECT day, tgt, round(CASE WHEN x1 = x2 THEN y1 ELSE y1 + (tgt - x1) / nullif(x2 - x1, 0) * (y2 - y1) END, 6) FROM br""",
    ),
)
def interp_at(t):
    p = v.profiles(t).select("day", "depth", "salinity")
    return rounded(st.interp_at(p, ["day"], "depth", "salinity", [1.5, 20.0], add=True), 6, "salinity")


@query(
    "trapezoid",
    sql_with(
        "spectra",
        """, m AS (SELECT sample, wavelength, avg(absorption) AS a FROM spectra GROUP BY 1, 2),
           s AS (SELECT *, lead(wavelength) OVER w AS x2, lead(a) OVER w AS y2 FROM m WINDOW w AS (PARTITION BY sample ORDER BY wavelength))
           SELECT sample, round(sum((x2 - wavelength) * (a + y2) / 2) * (0.045998::DOUBLE / 10000), 12) AS par FROM s GROUP BY 1""",
    ),
)
def trapezoid(t):
    m = v.spectra(t).groupBy("sample", "wavelength").agg(F.avg("absorption").alias("a"))
    return rounded(st.trapezoid(m, ["sample"], "wavelength", "a", "par", 0.045998 / 10000), 12, "par")


# -- curve fits -----------------------------------------------------------------------------


def fit_sql(source: str, key: str, x: str, y: str, shapes, basis: str, rounds: int, low=None, high=None) -> str:
    """The grid search as CTEs ending in ``fit``; ``basis`` uses x and s0_, s1_ (shape values)."""
    names = [f"s{i}" for i in range(len(shapes))]
    value = lambda sh, col: sh.value.format(s=col).replace("_span", "span")
    num = lambda f: f"CAST({f!r} AS DOUBLE)"
    amp = "sgy / sxx"
    if low:
        amp = f"greatest({amp}, greatest(ymin, {num(fitting.SMALLEST_PS)}))"
    if high is not None:
        amp = f"least({amp}, {num(high)})"
    g = basis
    for i, sh in enumerate(shapes):
        g = g.replace(f"s{i}_", f"({value(sh, f's{i}')})")
    ctes = [
        f"pts AS (SELECT {key} AS k, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source})",
        """sizes AS (SELECT k, count(*) AS n, avg(y) AS my, regr_sxx(y, y) AS syy, min(y) AS ymin,
            max(x) - least(min(x), 0) AS span FROM pts GROUP BY 1)""",
        "base AS (SELECT * FROM pts JOIN sizes USING (k))",
    ]
    for r in range(rounds + 1):
        if r == 0:
            grids = "".join(
                f", (SELECT unnest([{', '.join(num(s) for s in sh.first())}]) AS {n})" for sh, n in zip(shapes, names)
            )
            laid = f"SELECT base.*, {', '.join(names)} FROM base{grids}"
        else:
            offs = "".join(
                f", (SELECT unnest([{', '.join(num(s) for s in sh.offsets(r))}]) AS o{i})" for i, sh in enumerate(shapes)
            )
            moved = ", ".join(
                f"greatest(b.{n} + o{i}, {num(sh.floor) if math.isfinite(sh.floor) else '-1e300::DOUBLE'}) AS {n}"
                for i, (sh, n) in enumerate(zip(shapes, names))
            )
            laid = f"SELECT base.*, {moved} FROM base JOIN best{r - 1} b USING (k){offs}"
        ctes.append(f"g{r} AS (SELECT *, {g} AS g FROM ({laid}))")
        ctes.append(
            f"""score{r} AS (SELECT *, syy - 2 * a * sgy + a * a * sxx AS rss FROM (SELECT *, {amp} AS a FROM
            (SELECT k, n, my, syy, ymin, span, {', '.join(names)}, sum(g) AS sg, sum(g * g) AS sgg, sum(g * (y - my)) AS sgy,
             sum(g * g) - sum(g) * sum(g) / n AS sxx FROM g{r} GROUP BY k, n, my, syy, ymin, span, {', '.join(names)})
            WHERE sxx > sgg * 1e-6::DOUBLE AND n >= {len(shapes) + 2}))"""
        )
        ctes.append(
            f"""best{r} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(rss / nullif(syy, 0), 8) NULLS FIRST, {', '.join(names)}) AS rn
            FROM score{r}) WHERE rn = 1)"""
        )
    shape_cols = ", ".join(f"{value(sh, n)} AS {sh.name}" for sh, n in zip(shapes, names))
    ctes.append(
        f"""fit AS (SELECT sizes.k, sizes.n, sizes.syy AS tss, a AS amplitude, my2 - a * sg / bn AS off, {shape_cols.replace('span', 'bspan')}, CASE WHEN rss IS NOT NULL THEN greatest(rss, 0) END AS rss
        FROM sizes LEFT JOIN (SELECT k, n AS bn, my AS my2, span AS bspan, a, sg, {', '.join(names)}, rss FROM best{rounds}) USING (k))"""
    )
    return ",\n".join(ctes)


def tagged(sql: str, tag: str) -> str:
    """The fit with its CTEs renamed, so that one query can hold several."""
    return re.sub(r"\b(pts|sizes|base|g\d|score\d|best\d|fit)\b", rf"{tag}\1", sql)


_SAT = fit_sql("curve_obs", "curve", "light", "p", [fitting.SATURATION], "1 - exp(-s0_ * x)", 2, low=True)
_INH = fit_sql(
    "curve_obs1", "curve", "light", "p", [fitting.SATURATION_2D, fitting.INHIBITION],
    "(1 - exp(-s0_ * x)) * exp(-s1_ * x)", 3, low=True, high=10.0,
)


@query(
    "pe_saturating",
    sql_with(
        "curve_obs",
        "," + _SAT + """ SELECT k AS curve, n, round(amplitude, 4) AS ps, round(kappa * amplitude, 6) AS alpha, round(off, 5) AS p0,
             round(rss, 6) AS rss FROM fit""",
    ),
)
def pe_saturating(t):
    out = fitting.pe_saturating(v.curve_obs(t), ["curve"])
    return out.select(
        "curve", "n", F.round("ps", 4).alias("ps"), F.round("alpha", 6).alias("alpha"),
        F.round("p0", 5).alias("p0"), F.round("rss", 6).alias("rss"),
    )


@query(
    "pe_photoinhibition",
    sql_with(
        "curve_obs1",
        "," + _INH + """ SELECT k AS curve, n, round(amplitude, 4) AS ps, round(kappa * amplitude, 6) AS alpha,
             round(mu * amplitude, 6) AS beta, round(off, 5) AS p0, round(rss, 6) AS rss FROM fit""",
    ),
)
def pe_photoinhibition(t):
    out = fitting.pe_photoinhibition(v.curve_obs(t, inhibited=True), ["curve"], ps_max=10.0)
    return out.select(
        "curve", "n", F.round("ps", 4).alias("ps"), F.round("alpha", 6).alias("alpha"),
        F.round("beta", 6).alias("beta"), F.round("p0", 5).alias("p0"), F.round("rss", 6).alias("rss"),
    )


v._view(
    "decay_obs",
    """SELECT l_suppkey AS file, l_quantity AS depth,
       round(avg((1 + l_suppkey % 4) * exp(-(0.03::DOUBLE + 0.01::DOUBLE * (l_suppkey % 6)) * (l_quantity - 10)) + 0.2::DOUBLE + l_discount), 9) AS par
       FROM lineitem GROUP BY 1, 2""",
)


def decay_obs(t):
    k, d = F.col("l_suppkey"), F.col("l_quantity")
    par = (1 + k % 4) * F.exp(-(F.lit(0.03) + F.lit(0.01) * (k % 6)) * (d - 10)) + F.lit(0.2) + F.col("l_discount")
    return t.lineitem.groupBy(k.alias("file"), d.alias("depth")).agg(F.round(F.avg(par), 9).alias("par"))


_DECAY = fit_sql("decay_obs", "file", "depth", "par", [fitting.DECAY], "exp(-s0_ * (x - 10))", 2)


@query(
    "nls_decay",
    sql_with(
        "decay_obs",
        "," + _DECAY + "SELECT k AS file, n, round(amplitude, 4) AS a0, round(kd, 6) AS kd, round(off, 4) AS k, round(rss, 6) AS rss FROM fit",
    ),
)
def nls_decay(t):
    out = fitting.nls_decay(decay_obs(t), ["file"], "depth", "par")
    return out.select(
        "file", "n", F.round("a0", 4).alias("a0"), F.round("kd", 6).alias("kd"), F.round("k", 4).alias("k"),
        F.round("rss", 6).alias("rss"),
    )


@query(
    "nls_decay_fitted",
    sql_with(
        "decay_obs",
        "," + _DECAY + """ SELECT file, depth, par, round(amplitude * exp(-kd * (depth - 10)) + off, 5) AS fitted
           FROM decay_obs JOIN fit ON k = file WHERE amplitude IS NOT NULL""",
    ),
)
def nls_decay_fitted(t):
    obs = decay_obs(t)
    out = fitting.predict_decay(fitting.nls_decay(obs, ["file"], "depth", "par"), ["file"], obs)
    return rounded(out, 5, "fitted")


# Curves of three different lengths: some too short to fit.
v._view(
    "short_obs",
    """SELECT o_custkey AS curve, o_orderkey AS l_orderkey, 0 AS l_linenumber, CAST(o_orderkey % 700 AS DOUBLE) AS light,
       round(o_totalprice / 100000, 8) AS p FROM orders""",
)


def short_obs(t):
    return t.orders.select(
        F.col("o_custkey").alias("curve"), F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"),
        (F.col("o_orderkey") % 700).cast("double").alias("light"), F.round(F.col("o_totalprice") / 100000, 8).alias("p"),
    )


_SHORT = fit_sql("short_obs", "curve", "light", "p", [fitting.SATURATION], "1 - exp(-s0_ * x)", 0, low=True)


@query(
    "fit_failures_isolated",
    sql_with(
        "short_obs",
        "," + _SHORT + "SELECT k AS curve, n, amplitude IS NOT NULL AS is_fitted, round(rss, 6) AS rss FROM fit",
    ),
)
def fit_failures_isolated(t):
    out = fitting.pe_saturating(short_obs(t), ["curve"], rounds=0)
    return out.select("curve", "n", F.col("ps").isNotNull().alias("is_fitted"), F.round("rss", 6).alias("rss"))


@query(
    "predict_curve",
    sql_with(
        "curve_obs",
        "," + _SAT + """, span AS (SELECT curve, min(light) AS lo, max(light) AS hi FROM curve_obs GROUP BY 1),
           spots AS (SELECT 'data' AS kind, curve, light FROM curve_obs UNION ALL
             SELECT 'even', curve, lo + i * ((hi - lo) / 99) FROM span, (SELECT unnest(range(100)) AS i))
           SELECT kind, curve, round(light, 4) AS light, round(amplitude * (1 - exp(-(kappa * amplitude) * light / amplitude)) + off, 5) AS fitted
           FROM spots JOIN fit ON k = curve WHERE amplitude IS NOT NULL""",
    ),
)
def predict_curve(t):
    obs = v.curve_obs(t)
    params = fitting.pe_saturating(obs, ["curve"])
    spans = obs.groupBy("curve").agg(F.min("light").alias("lo"), F.max("light").alias("hi"))
    even = rel.even_grid(spans, "lo", "hi", 100, "light").select("curve", "light")
    at = rel.union_sources({"data": obs.select("curve", "light"), "even": even}, "kind")
    out = fitting.predict_curve(params, ["curve"], at)
    return out.select("kind", "curve", F.round("light", 4).alias("light"), F.round("fitted", 5).alias("fitted"))


@query(
    "predict_curve_inhibited",
    sql_with(
        "curve_obs1",
        "," + _INH + """ SELECT curve, round(light, 4) AS light,
           round(amplitude * (1 - exp(-kappa * light)) * exp(-mu * light) + off, 5) AS fitted
           FROM curve_obs1 JOIN fit ON k = curve WHERE amplitude IS NOT NULL""",
    ),
)
def predict_curve_inhibited(t):
    obs = v.curve_obs(t, inhibited=True)
    params = fitting.pe_photoinhibition(obs, ["curve"], ps_max=10.0)
    out = fitting.predict_curve(params, ["curve"], obs.select("curve", "light"))
    return out.select("curve", F.round("light", 4).alias("light"), F.round("fitted", 5).alias("fitted"))


# -- light-response pipeline ----------------------------------------------------------------

v._view(
    "refs",
    """SELECT curve, avg(dpm) FILTER (WHERE regexp_matches(id, 'tc|t0', 'i')) AS standard,
       avg(dpm) FILTER (WHERE regexp_matches(id, 'black|dark', 'i')) AS blank FROM counts GROUP BY 1""",
    "counts",
)
v._view(
    "production",
    """SELECT curve, l_orderkey, l_linenumber, l_suppkey, id, light, dpm - blank AS net,
       round(CASE WHEN salinity >= 30 THEN 25900 ELSE 24000 END * (dpm - blank) / nullif(standard * (100 + l_quantity) / 60, 0) / (50 / 0.02::DOUBLE), 9) AS p
       FROM counts JOIN refs USING (curve) WHERE regexp_matches(id, '^p', 'i')""",
    "refs",
)


def production(t):
    out = lc.dpm_to_production(v.counts(t), ["curve"], 100 + F.col("l_quantity"))
    return out.withColumn("p", F.round("p", 9))


@query(
    "dpm_to_production",
    sql_with("production", "SELECT curve, l_orderkey, l_linenumber, l_suppkey, id, light, round(net, 9) AS dpm, round(p, 6) AS p FROM production"),
)
def dpm_to_production(t):
    return production(t).select(
        "curve", "l_orderkey", "l_linenumber", "l_suppkey", "id", "light", F.round("dpm", 9).alias("dpm"), F.round("p", 6).alias("p")
    )


@query(
    "salinity_to_dic",
    sql_with(
        "profiles",
        """SELECT day, depth, l_orderkey, l_linenumber, l_partkey, round(((salinity * 0.067::DOUBLE) - 0.05::DOUBLE) * 0.96::DOUBLE * 12000, 6) AS linear,
           CASE WHEN salinity >= 32 THEN CAST(25900 AS DOUBLE) WHEN salinity >= 30 THEN CAST(25900 AS DOUBLE) ELSE CAST(24000 AS DOUBLE) END AS step,
           CAST(25900 AS DOUBLE) AS constant FROM profiles""",
    ),
)
def salinity_to_dic(t):
    s = F.col("salinity")
    return v.profiles(t).select(
        "day", "depth", "l_orderkey", "l_linenumber", "l_partkey",
        F.round(lc.salinity_to_dic(s, "linear"), 6).alias("linear"),
        lc.salinity_to_dic(s, "step").alias("step"),
        lc.salinity_to_dic(s, "constant").alias("constant"),
    )


_CHOICE = """, peaks AS (SELECT curve, arg_max(p, (light, -l_orderkey, -l_linenumber, p)) AS at_top, max(p) AS top FROM production
     WHERE p IS NOT NULL GROUP BY 1),
   choice AS (SELECT curve, CASE WHEN at_top < top THEN 'model1' ELSE 'model2' END AS model_type FROM peaks)"""


@query("pe_model_choice", sql_with("production", _CHOICE + "SELECT curve, model_type FROM choice"))
def pe_model_choice(t):
    usable = production(t).filter(F.col("p").isNotNull())
    return lc.model_choice(usable, ["curve"], ["l_orderkey", "l_linenumber"])


_METRICS = """, par AS (SELECT k, n, tss, amplitude AS ps, kappa * amplitude AS alpha, mu * amplitude AS beta, off AS p0, rss FROM fit),
   met AS (SELECT *, ps * (alpha / nullif(alpha + beta, 0)) * pow(beta / nullif(alpha + beta, 0), beta / nullif(alpha, 0)) AS pm,
     ps / nullif(alpha, 0) * CASE WHEN (alpha + beta) / nullif(beta, 0) > 0 THEN ln((alpha + beta) / nullif(beta, 0)) END AS im,
     ps / nullif(beta, 0) AS ib, 1 - rss / nullif(n * (tss / nullif(n - 1, 0)), 0) AS r2, 0.5::DOUBLE + k % 4 AS chla FROM par)"""


@query(
    "pe_metrics",
    sql_with(
        "curve_obs1",
        "," + _INH + _METRICS
        + """SELECT k AS curve, round(pm, 4) AS pm, round(pm / nullif(alpha, 0), 2) AS ek, round(im, 2) AS im, round(ib, 1) AS ib, round(r2, 6) AS r2,
             round(alpha / chla, 6) AS alpha_b, round(beta / chla, 6) AS beta_b, round(pm / chla, 4) AS pb_max FROM met""",
    ),
)
def pe_metrics(t):
    params = fitting.pe_photoinhibition(v.curve_obs(t, inhibited=True), ["curve"], ps_max=10.0)
    out = lc.metrics(params.withColumn("chla", F.lit(0.5) + F.col("curve") % 4), "chla")
    digits = {"pm": 4, "ek": 2, "im": 2, "ib": 1, "r2": 6, "alpha_b": 6, "beta_b": 6, "pb_max": 4}
    return out.select("curve", *[F.round(c, d).alias(c) for c, d in digits.items()])


_CHOSEN = "(SELECT p.* FROM production p JOIN choice USING (curve) WHERE p IS NOT NULL AND model_type = '{}')"
_MODELS = (
    tagged(
        fit_sql(
            _CHOSEN.format("model1"), "curve", "light", "p", [fitting.SATURATION_2D, fitting.INHIBITION],
            "(1 - exp(-s0_ * x)) * exp(-s1_ * x)", 3, low=True,
        ),
        "one_",
    )
    + ","
    + tagged(fit_sql(_CHOSEN.format("model2"), "curve", "light", "p", [fitting.SATURATION], "1 - exp(-s0_ * x)", 2, low=True), "two_")
)


@query(
    "pe_chosen_metrics",
    sql_with(
        "production",
        _CHOICE + "," + _MODELS
        + """ SELECT 'model1' AS model_type, k AS curve, n, round(1 - rss / nullif(n * (tss / nullif(n - 1, 0)), 0), 5) AS r2,
             amplitude IS NOT NULL AS is_fitted, mu * amplitude IS NOT NULL AS has_beta FROM one_fit
             UNION ALL SELECT 'model2', k, n, round(1 - rss / nullif(n * (tss / nullif(n - 1, 0)), 0), 5), amplitude IS NOT NULL, false FROM two_fit""",
    ),
)
def pe_chosen_metrics(t):
    usable = production(t).filter(F.col("p").isNotNull())
    chosen = lc.model_choice(usable, ["curve"], ["l_orderkey", "l_linenumber"])
    out = lc.metrics(lc.fit_curves(usable.join(chosen, "curve"), ["curve"]))
    return out.select(
        "model_type", "curve", "n", F.round("r2", 5).alias("r2"), F.col("ps").isNotNull().alias("is_fitted"),
        F.col("beta").isNotNull().alias("has_beta"),
    )


@query(
    "pe_normalised",
    sql_with(
        "curve_obs",
        """, par AS (SELECT curve % 50 AS depth, avg(p) AS alpha, max(p) AS pm, min(p) AS beta FROM curve_obs GROUP BY curve % 50),
           pig AS (SELECT CAST(s_suppkey % 50 AS BIGINT) AS depth, 1 + s_suppkey / CAST(7 AS DOUBLE) AS tchla, 'hplc' AS origin FROM supplier WHERE s_suppkey % 3 = 0
             UNION ALL SELECT n_nationkey, 2 + n_nationkey / CAST(9 AS DOUBLE), NULL FROM nation)
           SELECT depth, origin, round_even(tchla, 2) AS tchla, round_even(alpha, 2) AS alpha, round_even(beta, 2) AS beta, round_even(pm, 2) AS pm,
           round_even(alpha / tchla, 2) AS alpha_star, round_even(beta / tchla, 2) AS beta_star, round_even(pm / tchla, 2) AS pm_star
           FROM par LEFT JOIN pig USING (depth)""",
    ),
)
def pe_normalised(t):
    params = v.curve_obs(t).groupBy((F.col("curve") % 50).alias("depth")).agg(
        F.avg("p").alias("alpha"), F.max("p").alias("pm"), F.min("p").alias("beta")
    )
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    hplc = t.supplier.filter(k % 3 == 0).select(
        (k % 50).alias("depth"), (1 + k / 7).alias("tchla"), F.lit("hplc").alias("origin")
    )
    other = t.nation.select(n.cast("bigint").alias("depth"), (2 + n / 9).alias("tchla"))
    return lc.normalised(params, rel.union_all(hplc, other), ["depth"])


v._view(
    "sheet",
    """SELECT 'G' || (o_custkey % 40) AS station, CASE WHEN o_orderkey % 11 = 0 THEN 'ice' ELSE 'c' END || (o_custkey % 6) AS curve_id, o_orderkey AS pid,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 40 AS INTEGER) END AS cast_no,
       CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 6 != 1 THEN CAST(o_custkey % 6 AS INTEGER) END AS bottle, o_totalprice AS dpm FROM orders""",
)


@query(
    "pe_sample_assembly",
    sql_with(
        "sheet",
        """, a AS (SELECT station, curve_id, pid, dpm,
             coalesce(last_value(cast_no IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               first_value(cast_no IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cast_no,
             coalesce(last_value(bottle IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               first_value(bottle IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bottle
             FROM sheet WINDOW w AS (PARTITION BY station, curve_id ORDER BY pid)),
           b AS (SELECT station, curve_id, pid, dpm, coalesce(bottle, max(bottle) OVER (PARTITION BY station)) AS bottle,
             coalesce(last_value(cast_no IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               first_value(cast_no IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cast_no
             FROM a WINDOW w AS (PARTITION BY station ORDER BY pid)),
           bot AS (SELECT DISTINCT CAST(s_suppkey % 40 AS INTEGER) AS cast_no, CAST((s_suppkey * 7) % 6 AS INTEGER) AS bottle FROM supplier)
           SELECT b.station, b.curve_id, b.pid, b.cast_no, b.bottle, dpm, CASE WHEN bot.bottle IS NOT NULL THEN b.bottle * 10 + 0.5::DOUBLE END AS depth,
           1 + pig.bottle / CAST(3 AS DOUBLE) AS chla, bot.bottle IS NULL AS orphan
           FROM b LEFT JOIN bot ON bot.cast_no = b.cast_no AND bot.bottle = b.bottle
           JOIN (SELECT DISTINCT 'G' || (s_suppkey % 40) AS station, CAST((s_suppkey // 40) AS INTEGER) AS bottle FROM supplier) pig
             ON pig.station = b.station AND pig.bottle = b.bottle
           WHERE NOT contains(curve_id, 'ice')""",
    ),
)
def pe_sample_assembly(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sheets = t.orders.select(
        F.concat(F.lit("G"), c % 40).alias("station"),
        F.concat(F.when(k % 11 == 0, "ice").otherwise("c"), c % 6).alias("curve_id"),
        k.alias("pid"),
        F.when(k % 4 == 0, c % 40).cast("int").alias("cast"),
        F.when((k % 4 == 0) & (c % 6 != 1), c % 6).cast("int").alias("bottle"),
        F.col("o_totalprice").alias("dpm"),
    )
    s = F.col("s_suppkey")
    bottles = t.supplier.select((s % 40).cast("int").alias("cast"), ((s * 7) % 6).cast("int").alias("bottle")).distinct()
    bottles = bottles.withColumn("depth", F.col("bottle") * 10 + F.lit(0.5))
    pigments = t.supplier.select(
        F.concat(F.lit("G"), s % 40).alias("station"), F.floor(s / 40).cast("int").alias("bottle")
    ).distinct().withColumn("chla", 1 + F.col("bottle") / 3)
    samples, _ = lc.assemble_samples(sheets, bottles, pigments, ["pid"])
    return samples.select(
        "station", "curve_id", "pid", F.col("cast").alias("cast_no"), "bottle", "dpm", "depth", "chla",
        F.col("depth").isNull().alias("orphan"),
    )
