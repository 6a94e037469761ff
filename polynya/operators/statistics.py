"""Straight-line fits, analysis of variance, correlations, interpolation, integration.

Every statistic comes from sums that combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.functions.scalars import known
from polynya.operators.ordered import Ordered
from polynya.operators.relational import unpivot_columns


def lm(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """y ~ x per group: coefficients, standard errors, t values, R², residual error.

    Rows with a null or NaN on either side are left out. Coefficients need two distinct x, errors
    three rows.
    """
    both = known(x) & known(y)
    pairs = df.select(
        *keys, F.when(both, x.cast("double")).alias("_x"), F.when(both, y.cast("double")).alias("_y")
    )
    sums = pairs.groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.avg("_x").alias("mean_x"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
        F.avg("_y").alias("_my"),
    )
    slope = F.when((F.col("n") >= 2) & (F.col("sxx") > 0), F.col("_sxy") / F.col("sxx"))
    with_slope = sums.withColumn("slope", slope)
    rss = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    errors = with_slope.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("mean_x")).withColumn(
        "sigma", F.when((F.col("n") >= 3) & F.col("slope").isNotNull(), F.sqrt(rss / (F.col("n") - 2)))
    )
    se_slope = F.when(F.col("sxx") > 0, F.col("sigma") / F.sqrt("sxx"))
    se_intercept = F.when(
        F.col("sxx") > 0,
        F.col("sigma") * F.sqrt(1 / F.col("n") + F.col("mean_x") * F.col("mean_x") / F.col("sxx")),
    )
    return errors.select(
        *keys,
        "n",
        "slope",
        "intercept",
        se_slope.alias("se_slope"),
        se_intercept.alias("se_intercept"),
        F.try_divide(F.col("slope"), se_slope).alias("t_slope"),
        F.try_divide(F.col("intercept"), se_intercept).alias("t_intercept"),
        F.try_divide(F.col("slope") * F.col("_sxy"), F.col("_syy")).alias("r2"),
        "sigma",
        "mean_x",
        "sxx",
    )


def lm_predict(
    df: DataFrame, fit: DataFrame, x: str, out: str, keys: Sequence[str] = (), se: str | None = None
) -> DataFrame:
    """Add the fitted value (and the standard error of the fit) of one line per group.

    Without keys the fit is a single row, read as a scalar subquery.
    """
    cols = ["slope", "intercept"] + (["sigma", "mean_x", "sxx", "n"] if se else [])
    if keys:
        line = fit.select(*keys, F.struct(*cols).alias("_line"))
        joined = df.join(line, list(keys), "left")
    else:
        joined = df.withColumn("_line", fit.select(F.struct(*cols)).scalar())
    part = lambda c: F.col("_line")[c]
    new = {out: part("intercept") + part("slope") * F.col(x)}
    if se:
        away = F.col(x) - part("mean_x")
        new[se] = part("sigma") * F.sqrt(1 / part("n") + away * away / part("sxx"))
    return joined.withColumns(new).drop("_line")


def residual_compare(
    df: DataFrame, ids: Sequence[str], observed: str, predicted: Mapping[str, str]
) -> DataFrame:
    """|observed − predicted| for several methods, one row per method."""
    known = df.filter(F.col(observed).isNotNull())
    wide = known.select(
        *ids, observed, *[F.abs(F.col(observed) - F.col(c)).alias(m) for m, c in predicted.items()]
    )
    return unpivot_columns(wide, [*ids, observed], list(predicted), "method", "residual")


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, mean m and the sum of squares ss around the mean (mergeable moments)."""
    return df.filter(known(F.col(value))).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.regr_sxx(F.col(value), F.col(value)).alias("ss")
    )


def variance_parts(moments: DataFrame) -> DataFrame:
    """One row: n, number of groups k, sums of squares between and within groups.

    Means are taken from a centre among them before they are squared, so that a spread far
    below the level of the values is not lost.
    """
    centred = moments.crossJoin(F.broadcast(moments.agg(F.avg("m").alias("_c"))))  # one row
    d = F.col("m") - F.col("_c")
    shift = F.sum(F.col("n") * d)
    return centred.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * d * d) - shift * shift / F.sum("n")).alias("between"),
        F.sum("ss").alias("within"),
    )


def anova_oneway(df: DataFrame, group: str, value: str, p_value: bool = False) -> DataFrame:
    """value ~ group: the two rows (group, residuals) of the table."""
    return anova_table(group_moments(df, group, value), group, p_value)


def anova_table(moments: DataFrame, group: str, p_value: bool = False) -> DataFrame:
    """The table of ``anova_oneway`` from ``group_moments``."""
    all_ = variance_parts(moments)
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    ms1, ms2 = F.try_divide("between", df1), F.try_divide("within", df2)
    stat = F.try_divide(ms1, ms2)
    none = F.lit(None).cast("double")
    p = f_tail(stat, df1, df2) if p_value else none
    row = lambda term, d, ss, ms, f, pv: F.struct(
        F.lit(term).alias("term"), d.alias("df"), ss.alias("sumsq"), ms.alias("meansq"),
        f.alias("statistic"), pv.alias("p_value"),
    )
    rows = F.array(
        row(group, df1, F.col("between"), ms1, stat, p),
        row("Residuals", df2, F.col("within"), ms2, none, none),
    )
    out = all_.select(F.inline(rows))
    return out if p_value else out.drop("p_value")


def f_tail(stat: Column, df1: Column, df2: Column) -> Column:
    """P(F > stat): the incomplete beta integral by Simpson's rule on 2,000 steps.

    The substitution x = sin²θ removes the end singularities of the integrand.
    """
    a, b = df2 / 2.0, df1 / 2.0
    cut = F.asin(F.sqrt(F.try_divide(df2.cast("double"), df2 + df1 * stat)))
    steps = 2000

    def integral(top: Column) -> Column:
        h = top / steps

        def term(i: Column) -> Column:
            th = h * i
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return weight * F.pow(F.sin(th), 2 * a - 1) * F.pow(F.cos(th), 2 * b - 1)

        total = F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + term(i)
        )
        return total * h / 3

    return F.try_divide(integral(cut), integral(F.lit(math.pi / 2)))


PAIR_BLOCKS = 16


def tukey_pairs(df: DataFrame, group: str, value: str, with_k: bool = False) -> DataFrame:
    """Differences of all pairs of group means with standard error and studentised range.

    Groups are dealt to blocks, and every pair of blocks is one key of an equi-join: no row holds
    all means, and no task more than two blocks of them.
    """
    return pairs_of_means(group_moments(df, group, value), group, with_k)


def pairs_of_means(means: DataFrame, group: str, with_k: bool = False) -> DataFrame:
    """The pairs of ``tukey_pairs`` from ``group_moments``."""
    pooled = variance_parts(means).select(
        (F.col("within") / (F.col("n") - F.col("k"))).alias("ms"), (F.col("n") - F.col("k")).alias("df"), "k"
    )
    block = F.pmod(F.xxhash64(group), F.lit(PAIR_BLOCKS)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1))).alias("_other")
    dealt = means.select(F.col(group).alias("g"), "n", "m", block.alias("_block"), other).withColumn(
        "_pair", F.struct(F.least("_block", "_other").alias("a"), F.greatest("_block", "_other").alias("b"))
    )
    lo, hi = dealt.alias("lo"), dealt.alias("hi")
    # A pair of groups meets at the pair of their blocks alone.
    met = lo.join(
        hi,
        (F.col("lo._pair") == F.col("hi._pair"))
        & (F.col("lo._other") == F.col("hi._block"))
        & (F.col("hi._other") == F.col("lo._block"))
        & (F.col("lo.g") < F.col("hi.g")),
    )
    pairs = met.crossJoin(F.broadcast(pooled))  # one row
    se = F.sqrt(F.col("ms") / 2 * (1 / F.col("lo.n") + 1 / F.col("hi.n")))
    diff = F.col("hi.m") - F.col("lo.m")
    return pairs.select(
        F.col("lo.g").alias("group1"),
        F.col("hi.g").alias("group2"),
        diff.alias("estimate"),
        se.alias("std_error"),
        F.try_divide(F.abs(diff), se).alias("q"),
        "df",
        *([F.col("k")] if with_k else []),
    )


def tukey_hsd(df: DataFrame, group: str, value: str, level: float = 0.95) -> DataFrame:
    """Tukey's honest differences: ``tukey_pairs`` with adjusted p values and intervals.

    The tail of the studentised range is a numeric double integral, evaluated for the few rows
    of the pair table.
    """
    def tails(batches):
        import numpy as np
        import pandas as pd

        z, wz = np.polynomial.legendre.leggauss(160)
        z, wz = 8.5 * z, 8.5 * wz
        u, wu = np.polynomial.legendre.leggauss(120)
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        normal = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
        at_z = normal(z)

        def tail(q, k, nu):
            # Scale s = sqrt(chi2 / nu): integrate over the range where its density matters.
            spread = 8 / math.sqrt(2 * nu)
            lo, hi = max(1e-9, 1 - spread), 1 + spread
            s, ws = (hi - lo) / 2 * u + (hi + lo) / 2, (hi - lo) / 2 * wu
            log_f = (
                math.log(2) + nu / 2 * math.log(nu / 2) - math.lgamma(nu / 2)
                + (nu - 1) * np.log(s) - nu * s * s / 2
            )
            inner = np.array(
                [k * np.sum(wz * density * (at_z - normal(z - q * si)) ** (k - 1)) for si in s]
            )
            return float(min(1.0, max(0.0, 1 - np.sum(ws * np.exp(log_f) * inner))))

        def quantile(k, nu):
            lo, hi = 0.0, 200.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if tail(mid, k, nu) > 1 - level else (lo, mid)
            return (lo + hi) / 2

        known = {}
        for pdf in batches:
            p, low, high = [], [], []
            for q, k, nu, d, se in zip(pdf["q"], pdf["k"], pdf["df"], pdf["estimate"], pdf["std_error"]):
                if pd.isna(q) or nu < 1:
                    p.append(None), low.append(None), high.append(None)
                    continue
                if (k, nu) not in known:
                    known[k, nu] = quantile(k, nu)
                reach = known[k, nu] * se
                p.append(tail(q, k, nu)), low.append(d - reach), high.append(d + reach)
            yield pdf.assign(adj_p_value=p, conf_low=low, conf_high=high)

    pairs = tukey_pairs(df, group, value, with_k=True)
    fields = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInPandas(
        tails, f"{fields}, adj_p_value double, conf_low double, conf_high double"
    )


def corr_matrix(
    df: DataFrame, ids: Sequence[str], key: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Pairwise correlations between sources matched on ``ids`` (complete pairs)."""
    wide = df.groupBy(*ids).pivot(key, list(names)).agg(F.avg(value))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    stats = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        stats += [F.count_if(both).alias(f"n{i}"), F.corr(a, b).alias(f"r{i}")]
    one = wide.agg(*stats)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"),
                F.when(F.col(f"n{i}") >= 2, F.col(f"r{i}")).alias("r"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(rows))


def interp_at(
    df: DataFrame, keys: Sequence[str], x: str, y: str, at: Sequence[float], add: bool = False
) -> DataFrame:
    """Linear interpolation per group; null outside its range; duplicate x averaged first.

    ``add``: return the averaged profile with the new points in it.
    """
    profile = df.filter(known(F.col(x)) & known(F.col(y))).groupBy(*keys, x).agg(F.avg(y).alias(y))
    targets = profile.withColumn("_t", F.explode(F.array(*[F.lit(float(a)) for a in at])))
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    brackets = targets.groupBy(*keys, "_t").agg(
        F.max(F.when(F.col(x) <= F.col("_t"), point)).alias("lo"),
        F.min(F.when(F.col(x) >= F.col("_t"), point)).alias("hi"),
    )
    share = F.try_divide(F.col("_t") - F.col("lo.x"), F.col("hi.x") - F.col("lo.x"))
    value = F.when(F.col("lo.x") == F.col("hi.x"), F.col("lo.y")).otherwise(
        F.col("lo.y") + share * (F.col("hi.y") - F.col("lo.y"))
    )
    points = brackets.select(*keys, F.col("_t").alias(x), value.alias(y))
    return profile.select(*keys, x, y).unionByName(points) if add else points


def trapezoid(
    df: DataFrame, keys: Sequence[str], x: str, y: str, out: str, factor: float = 1.0, **kw
) -> DataFrame:
    """Trapezoidal integral of y over x per group."""
    steps = Ordered(df, keys, [x], **kw).frame(
        0, 1, lambda w: {"_x2": F.lead(x).over(w), "_y2": F.lead(y).over(w)}
    )
    area = (F.col("_x2") - F.col(x)) * (F.col(y) + F.col("_y2")) / 2
    return steps.groupBy(*keys).agg((F.sum(area) * F.lit(factor)).alias(out))
