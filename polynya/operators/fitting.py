"""Curve fits as distributed aggregates: separable least squares.

Each model is linear in an amplitude A and an offset C once its shape is fixed:
``y = A * g(x; shape) + C``. A grid of shapes is laid over each curve, the best A and C of
every shape follow from sums, and the grid is narrowed around the winner. The rows of a curve
are laid side by side once, sorted by key, and a task reads them as a stream and goes through all
rounds curve by curve: what it holds is a few thousand rows or one curve, however large the table.
A curve of more than ``SHARE_ROWS`` rows is cut in shares, whose sums meet after each round; there
the grid multiplies rows only inside a task, never across the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polynya.functions.scalars import known
from polynya.operators.scale import null_safe_join

# Grid points summed side by side in one row; keeps the stage within code generation.
CHUNK = 7
# Rows of a curve that are summed in one place.
SHARE_ROWS = 250_000
# Rows of whole curves that a task works on at once.
BLOCK_ROWS = 16_384

Curve = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Shape:
    """One shape parameter: its even first grid in ``s`` and, as SQL text and as ``at`` of arrays,
    how ``s`` and the span of x (``_span``) give the parameter."""

    name: str
    low: float
    high: float
    steps: int
    value: str
    at: Curve
    floor: float = -math.inf
    zoom_points: int = 21
    zoom_by: float = 8.0

    @property
    def step(self) -> float:
        return (self.high - self.low) / (self.steps - 1)

    def first(self) -> list[float]:
        return [self.low + i * self.step for i in range(self.steps)]

    def offsets(self, round_: int) -> list[float]:
        half = self.zoom_points // 2
        fine = self.step / self.zoom_by**round_
        return [(i - half) * fine for i in range(self.zoom_points)]

    def on_edge(self, s: str) -> str:
        """Did the winner end at the edge of the first grid? A floor is a value, not an edge."""
        above = f"{s} > {number(self.high - self.step / 2)}"
        return above if math.isfinite(self.floor) else f"({s} < {number(self.low + self.step / 2)} OR {above})"

    def parameter(self, s: str) -> str:
        return f"({self.value.format(s=s)})"


def number(v: float) -> str:
    """A double literal in Spark SQL."""
    return f"{v!r}D" if math.isfinite(v) else f"double('{'-' if v < 0 else ''}infinity')"


def fit_separable(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    shapes: Sequence[Shape],
    basis: tuple[str, Curve],
    weight: tuple[str, Curve] | None = None,
    low: float | None = None,
    high: float | None = None,
    rounds: int = 2,
    share_rows: int = SHARE_ROWS,
) -> DataFrame:
    """One row per group: n, amplitude, offset, the shape values, rss, total sum of squares, at_edge.

    g is ``basis * weight``, both given as SQL text over ``_x`` and as a function of arrays (x,
    shape value): the basis uses the first shape's value ``{0}``, the weight that of the second
    ``{1}``. The first shape is a LOG_SCALE one, so its grid values are multiples of each other.
    ``low`` bounds the amplitude below by the smallest y, as far as that is above ``low``. A group
    with fewer rows than parameters, or that no shape fits, or all of whose x are 0, keeps its row
    with null parameters. ``at_edge`` marks a curve whose best shape lies at the edge of the grid:
    the data hardly tell it from shapes beyond.
    """
    keys = list(keys)
    given = df.filter(known(F.col(x)) & known(F.col(y))).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    # A table has few curves of many rows each, at most one per ``share_rows`` of its rows.
    counts = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(f"_n > {share_rows}")
    large = F.broadcast(counts.select(*keys))
    search = shapes, basis, weight, low, high, rounds
    whole = whole_curves(null_safe_join(given, large, keys, "left_anti"), keys, *search)
    cut = cut_curves(null_safe_join(given, large, keys, "left_semi"), keys, *search, share_rows)
    names = [f"_s{i}" for i in range(len(shapes))]
    return whole.unionByName(cut).selectExpr(
        *[f"`{k}`" for k in keys],
        "_n AS n",
        "_syy AS tss",
        "_a AS amplitude",
        "_my - _a * _sg / _n AS offset",
        *[f"{s.parameter(n)} AS {s.name}" for s, n in zip(shapes, names)],
        "CASE WHEN _rss IS NOT NULL THEN greatest(_rss, 0D) END AS rss",
        " OR ".join(s.on_edge(n) for s, n in zip(shapes, names)) + " AS at_edge",
    )


def grid_search(
    x: np.ndarray, y: np.ndarray, n: np.ndarray, shapes: Sequence[Shape], basis: Curve,
    weight: Curve | None, low: float | None, high: float | None, rounds: int,
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """All rounds for curves that lie one after the other, ``n`` rows each: who has a fit, and the fits."""
    start = np.concatenate(([0], np.cumsum(n)[:-1]))
    total = lambda v: np.add.reduceat(v, start)
    wide = lambda v: np.repeat(v, n)
    my = total(y) / n
    dy = y - wide(my)
    syy = total(dy * dy)
    span = np.maximum.reduceat(x, start) - np.minimum(np.minimum.reduceat(x, start), 0.0)
    least = None if low is None else np.maximum(np.minimum.reduceat(y, start), low)
    fitted = (n >= len(shapes) + 2) & (span != 0)
    room = [np.empty(len(x)) for _ in range(2)]
    best: list[np.ndarray] = []
    for r in range(rounds + 1):
        # Per shape its grid points, each one value for every curve.
        if r == 0:
            points = [[np.full(len(n), v) for v in s.first()] for s in shapes]
        else:
            points = [[np.maximum(b + o, s.floor) for o in s.offsets(r)] for s, b in zip(shapes, best)]
        weights = [[weight(x, wide(s.at(p, span))) for p in ps] for s, ps in zip(shapes[1:], points[1:])]
        # Points that meet on a floor are one point, which counts a row once for each of them.
        times = [[sum((p == q).astype(float) for q in ps) for p in ps] for ps in points[1:]]
        best = [np.zeros(len(n)) for _ in shapes]
        order, found = np.full(len(n), np.inf), np.zeros(len(n), bool)
        sg, a, rss = (np.zeros(len(n)) for _ in range(3))
        for p in points[0]:
            g0 = basis(x, wide(shapes[0].at(p, span)))
            for js in product(*map(range, map(len, points[1:]))):
                g = g0
                for j, w in zip(js, weights):
                    g = np.multiply(g, w[j], out=room[0])
                _sg, often = total(g), math.prod(t[j] for j, t in zip(js, times))
                _sgg, _sgy = (total(np.multiply(g, other, out=room[1])) * often for other in (g, dy))
                _sg = _sg * often
                sxx = _sgg - _sg * _sg / n
                # As in SQL, a sum that is no number is above every number.
                usable = (sxx > _sgg * 1e-6) | (np.isnan(sxx) & ~np.isnan(_sgg))
                _a = _sgy / sxx
                if least is not None:
                    _a = np.maximum(_a, least)
                if high is not None:
                    _a = np.fmin(_a, high)
                _rss = syy - 2 * _a * _sgy + _a * _a * sxx
                share = _rss / syy
                _order = np.where(np.isnan(share), np.inf, np.floor(share * 1e8 + 0.5) / 1e8)
                _order = np.where(syy == 0, -np.inf, _order)
                better = usable & (~found | (_order < order))
                found |= usable
                for held, new in ((order, _order), (sg, _sg), (a, _a), (rss, _rss), (best[0], p)):
                    np.copyto(held, new, where=better)
                for held, ps, j in zip(best[1:], points[1:], js):
                    np.copyto(held, ps[j], where=better)
        fitted &= found
    fits = {"_syy": syy, "_my": my, "_span": span, **{f"_s{i}": b for i, b in enumerate(best)}, "_sg": sg, "_a": a, "_rss": rss}
    return fitted, fits


def first_rows(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places where a curve begins, in rows that are sorted by key; null and NaN equal themselves."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        codes = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def whole_curves(
    rows: DataFrame, keys: Sequence[str], shapes: Sequence[Shape], basis: tuple[str, Curve],
    weight: tuple[str, Curve] | None, low: float | None, high: float | None, rounds: int,
) -> DataFrame:
    """Best grid point of curves whose rows one task can hold: all rounds in one pass."""
    parameters = (shapes, basis[1], weight and weight[1], low, high, rounds)
    names = ["_syy", "_my", "_span", *[f"_s{i}" for i in range(len(shapes))], "_sg", "_a", "_rss"]
    fields = [T.StructField("_n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    schema = T.StructType([*[rows.schema[k] for k in keys], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, need = 0, BLOCK_ROWS
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                count += batch.num_rows
                if count < need:
                    continue
            if not count:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # More rows of the last curve may follow.
            start = np.append(first_rows(table, keys), [] if batch is not None else [count]).astype(np.int64)
            start, at, n = start[:-1], int(start[-1]), np.diff(start)
            held, count = table.slice(at).to_batches(), count - at
            need = max(BLOCK_ROWS, 2 * count)
            if len(n):
                x, y = (table[c].to_numpy()[:at] for c in ("_x", "_y"))
                with np.errstate(all="ignore"):
                    fitted, fits = grid_search(x, y, n, *parameters)
                own = table.select(list(keys)).take(pa.array(start)).append_column("_n", pa.array(n))
                for c in names:
                    own = own.append_column(c, pa.array(fits[c], mask=None if c == "_syy" else ~fitted))
                yield from own.combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def cut_curves(
    rows: DataFrame, keys: Sequence[str], shapes: Sequence[Shape], basis: tuple[str, Curve],
    weight: tuple[str, Curve] | None, low: float | None, high: float | None, rounds: int, share_rows: int,
) -> DataFrame:
    """Best grid point of curves that lie in several shares; their sums meet after each round."""
    # A struct compares null fields as equal, so plain equi-joins keep every group.
    ks = ["_k"]
    basis_sql, weight_sql = basis[0], weight[0] if weight else "1D"
    given = rows.select(F.struct(*keys).alias("_k"), "_x", "_y")
    sizes = given.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_y").alias("_my"),
        F.regr_sxx("_y", "_y").alias("_syy"),
        F.min("_y").alias("_ymin"),
        (F.max("_x") - F.least(F.min("_x"), F.lit(0.0))).alias("_span"),
    )
    parts = [*ks, "_salt"]
    shares = f"ceil(_n / {share_rows})"
    rows = given.join(sizes.filter("_span != 0"), ks).withColumn("_y", F.col("_y") - F.col("_my"))
    rows = rows.withColumn("_salt", F.expr(f"pmod(xxhash64(_x, _y), {shares})")).repartition(*parts)

    names = [f"_s{i}" for i in range(len(shapes))]
    per_curve = ["_n", "_my", "_syy", "_ymin", "_span"]
    best = None
    for r in range(rounds + 1):
        # The first shape runs over columns (sums side by side), in slices of at most CHUNK
        # points; the slices and the other shapes multiply the rows.
        first, others = shapes[0], list(zip(shapes[1:], names[1:]))
        if best is None:
            grid, steps = rows, first.first()
            across, fine = min(CHUNK, len(steps)), first.step
            axes = {"_from": ", ".join(map(number, steps[::CHUNK]))}
            axes |= {n: ", ".join(map(number, s.first())) for s, n in others}
        else:
            centre = best.selectExpr(*ks, "_n", *[f"{n} AS _b{n}" for n in names])
            centre = centre.withColumn("_salt", F.expr(f"explode(sequence(0L, {shares} - 1))"))
            grid = rows.join(centre.drop("_n"), parts)
            offsets = first.offsets(r)
            across, fine = min(CHUNK, len(offsets)), first.step / first.zoom_by**r
            axes = {"_from": ", ".join(f"_b{names[0]} + {number(o)}" for o in offsets[::CHUNK])}
            axes |= {
                n: ", ".join(f"greatest(_b{n} + {number(o)}, {number(s.floor)})" for o in s.offsets(r))
                for s, n in others
            }
        for name, points in axes.items():
            grid = grid.selectExpr("*", f"explode(array({points})) AS {name}")
        at = [f"(_from + {number(j * fine)})" for j in range(across)]
        rest = [s.parameter(n) for s, n in others]
        node = list(axes)
        shaped = grid.selectExpr(
            *parts, *node, *per_curve, "_x", "_y",
            f"{first.parameter('_from')} AS _p", f"{weight_sql.format(None, *rest)} AS _w",
        )
        multiples = [number(math.exp(j * fine)) for j in range(across)]
        laid = shaped.selectExpr(
            *parts, *node, *per_curve, "_y",
            *[f"({basis_sql.format(f'(_p * {m})')}) * _w AS _g{j}" for j, m in enumerate(multiples)],
        )
        sums = {}
        for j in range(across):
            sums |= {f"_sg{j}": f"_g{j}", f"_sgg{j}": f"_g{j} * _g{j}", f"_sgy{j}": f"_g{j} * _y"}
        once = [F.expr(f"first({c}) AS {c}") for c in per_curve]
        partial = laid.groupBy(*parts, *node).agg(
            *once, *[F.expr(f"sum({e}) AS {n}") for n, e in sums.items()]
        )
        partial = partial.groupBy(*ks, *node).agg(*once, *[F.expr(f"sum({n}) AS {n}") for n in sums])
        # One row per grid point again, now per curve and not per observation.
        points = ", ".join(
            f"struct({s} AS _s0, _sg{j} AS _sg, _sgg{j} AS _sgg, _sgy{j} AS _sgy)"
            for j, s in enumerate(at)
        )
        amplitude = "_sgy / _sxx"
        if low is not None:
            amplitude = f"greatest({amplitude}, greatest(_ymin, {number(low)}))"
        if high is not None:
            amplitude = f"least({amplitude}, {number(high)})"
        scored = (
            partial.selectExpr(*ks, *per_curve, *names[1:], f"inline(array({points}))")
            .selectExpr("*", "_sgg - _sg * _sg / _n AS _sxx")
            .filter(f"_sxx > _sgg * 1e-6D AND _n >= {len(shapes) + 2}")
            .selectExpr("*", f"{amplitude} AS _a")
            .selectExpr("*", "_syy - 2 * _a * _sgy + _a * _a * _sxx AS _rss")
        )
        picked = ["_n", "_span", "_my", "_sg", "_a", "_rss"]
        best = (
            scored.groupBy(*ks)
            .agg(F.expr(f"min(struct(round(try_divide(_rss, _syy), 8) AS _order, {', '.join([*names, *picked])})) AS _b"))
            .selectExpr(*ks, *[f"_b.{c}" for c in (*names, *picked)])
        )
    fits = best.select(*ks, "_my", "_span", *names, "_sg", "_a", "_rss")
    out = sizes.select(*ks, "_n", "_syy").join(fits, ks, "left")
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], *[c for c in out.columns if c not in ks])


# Positive shapes are exp(s) per span of x; a shape that may be zero is (exp(s) − 1) / 100.
LOG_SCALE = "exp({s}) / _span"
ZERO_SCALE = "(exp({s}) - 1) / 100 / _span"


def log_scale(s: np.ndarray, span: np.ndarray) -> np.ndarray:
    return np.exp(s) / span


def zero_scale(s: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (np.exp(s) - 1) / 100 / span


SATURATION = Shape("kappa", math.log(0.01), math.log(200.0), 42, LOG_SCALE, log_scale)
SATURATION_2D = Shape("kappa", math.log(0.01), math.log(200.0), 14, LOG_SCALE, log_scale, zoom_points=7, zoom_by=3.0)
INHIBITION = Shape("mu", 0.0, math.log(2001.0), 7, ZERO_SCALE, zero_scale, floor=0.0, zoom_points=7, zoom_by=3.0)
DECAY = Shape("kd", math.log(0.01), math.log(200.0), 42, LOG_SCALE, log_scale)

# The smallest production bounds ps from below, as far as it is positive.
SMALLEST_PS = 1e-6

RISE: tuple[str, Curve] = ("1 - exp(-{0} * _x)", lambda x, k: 1 - np.exp(-k * x))
FALL: tuple[str, Curve] = ("exp(-{1} * _x)", lambda x, k: np.exp(-k * x))


def pe_saturating(df: DataFrame, keys: Sequence[str], light: str = "light", p: str = "p", **kw) -> DataFrame:
    """p = ps·(1 − e^(−α·light/ps)) + p0."""
    fit = fit_separable(df, keys, light, p, [SATURATION], RISE, low=SMALLEST_PS, **kw)
    return fit.selectExpr(
        *keys, "n", "tss", "amplitude AS ps", "kappa * amplitude AS alpha",
        "CAST(NULL AS DOUBLE) AS beta", "offset AS p0", "rss", "at_edge",
    )


def pe_photoinhibition(
    df: DataFrame, keys: Sequence[str], light: str = "light", p: str = "p",
    ps_max: float | None = None, **kw,
) -> DataFrame:
    """p = ps·(1 − e^(−α·light/ps))·e^(−β·light/ps) + p0; ``ps_max`` bounds ps above."""
    kw.setdefault("rounds", 3)
    fit = fit_separable(
        df, keys, light, p, [SATURATION_2D, INHIBITION], RISE, FALL, low=SMALLEST_PS, high=ps_max, **kw,
    )
    return fit.selectExpr(
        *keys, "n", "tss", "amplitude AS ps", "kappa * amplitude AS alpha",
        "mu * amplitude AS beta", "offset AS p0", "rss", "at_edge",
    )


def nls_decay(
    df: DataFrame, keys: Sequence[str], depth: str, par: str, reference: float = 10.0, **kw
) -> DataFrame:
    """par = a0·exp(−kd·(depth − reference)) + k."""
    fall = f"exp(-{{0}} * (_x - {number(reference)}))", lambda x, k: np.exp(-k * (x - reference))
    fit = fit_separable(df, keys, depth, par, [DECAY], fall, **kw)
    return fit.selectExpr(*keys, "n", "amplitude AS a0", "kd", "offset AS k", "rss", "at_edge")


def saturating_curve(light: Column) -> Column:
    ps, alpha, beta = F.col("ps"), F.col("alpha"), F.coalesce("beta", F.lit(0.0))
    return ps * (1 - F.exp(-alpha * light / ps)) * F.exp(-beta * light / ps) + F.col("p0")


def predict_curve(params: DataFrame, keys: Sequence[str], at: DataFrame, light: str = "light") -> DataFrame:
    """Fitted value at every row of ``at``; rows of unfitted curves are dropped."""
    fitted = params.filter(F.col("ps").isNotNull()).select(*keys, "ps", "alpha", "beta", "p0")
    joined = null_safe_join(at, fitted, keys)
    return joined.withColumn("fitted", saturating_curve(F.col(light))).drop("ps", "alpha", "beta", "p0")


def predict_decay(
    params: DataFrame, keys: Sequence[str], at: DataFrame, depth: str = "depth", reference: float = 10.0
) -> DataFrame:
    """Fitted decay at every row of ``at``; rows of unfitted groups are dropped."""
    fitted = params.filter(F.col("a0").isNotNull()).select(*keys, "a0", "kd", "k")
    joined = null_safe_join(at, fitted, keys)
    value = F.col("a0") * F.exp(-F.col("kd") * (F.col(depth) - F.lit(reference))) + F.col("k")
    return joined.withColumn("fitted", value).drop("a0", "kd", "k")
