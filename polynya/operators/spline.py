"""Cubic splines through the points of each group, sampled on an even grid.

End conditions take the cubics through the four first and the four last points. The tridiagonal
system of the second-derivative coefficients is solved by cyclic reduction within a task (one
vectorised pass per doubling). Long groups are cut into blocks that overlap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from polynya.functions.scalars import known
from polynya.operators.ordered import SIDE, Ordered

MARGIN = 60
COEFFICIENTS = ("x", "y", "b", "c", "d", "x_next")


def spline_resample(
    df: DataFrame, keys: Sequence[str], x: str, y: str, start: float, stop: float, by: float,
    small: bool = False, **kw,
) -> DataFrame:
    """(keys, x, y) on the grid start…stop; equal x are averaged first.

    ``small`` and ``kw`` are those of ``Ordered``, which cuts long groups into blocks."""
    keys = list(keys)
    knots = (
        df.filter(known(F.col(x)) & known(F.col(y)))
        .groupBy(*keys, F.col(x).cast("double").alias("x"))
        .agg(F.avg(y).alias("y"))
    )
    segments = segments_in_blocks(knots, keys, small=small, **kw)
    return evaluate(segments, keys, start, stop, by).withColumnsRenamed({"x": x, "y": y})


def evaluate(segments: DataFrame, keys: Sequence[str], start: float, stop: float, by: float) -> DataFrame:
    """Each segment lists the grid points it covers; the outer segments reach to infinity."""
    last = math.floor((stop - start) / by + 1e-9)
    place = lambda c: F.ceil((c - F.lit(start)) / F.lit(by)).cast("bigint")
    low = F.when(F.col("is_first"), F.lit(0)).otherwise(F.greatest(place(F.col("x")), F.lit(0)))
    high = F.when(F.col("x_next").isNull(), F.lit(last)).otherwise(
        F.least(place(F.col("x_next")) - 1, F.lit(last))
    )
    steps = F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint")))
    at = segments.withColumn("_j", F.explode(steps)).withColumn("_u", F.lit(start) + F.col("_j") * F.lit(by))
    t = F.col("_u") - F.col("x")
    value = F.col("y") + t * (F.col("b") + t * (F.col("c") + t * F.col("d")))
    return at.select(*keys, F.col("_u").alias("x"), value.alias("y"))


def segments_in_blocks(knots: DataFrame, keys: list[str], **kw) -> DataFrame:
    """One row per segment with its cubic.

    A long group is solved block by block, each with ``MARGIN`` knots of its neighbours: every row
    of the system weighs its own unknown at least twice as much as the two beside it together, so
    what happens at a block's outer ends is halved at each knot and gone, in doubles, at its own.
    """
    walk = Ordered(knots, keys, ["x"], **kw)
    rows = walk.df.withColumn(SIDE, F.lit(0))
    if walk.cuts:
        for side in (1, -1):
            rows = rows.unionByName(walk._neighbours(MARGIN, side))
    solved = segments_in_task(rows, walk.parts)
    return solved.filter(F.col(SIDE) == 0).drop(SIDE, *[c for c in walk.parts if c not in keys])


def segments_in_task(knots: DataFrame, keys: list[str]) -> DataFrame:
    """One row per segment with its cubic; all groups of a batch are solved in one go.

    Rows arrive sorted by (keys, x) with their place in the group. The systems of different
    groups do not touch (their coupling is zero), so one reduction over the batch solves all.
    """
    place = Window.partitionBy(*keys).orderBy("x")
    numbered = (
        knots.repartition(*keys)
        .withColumn("_i", F.row_number().over(place))
        .sortWithinPartitions(*keys, "x")
    )
    fields = [StructField(c, DoubleType()) for c in COEFFICIENTS]
    schema = StructType(
        [knots.schema[k] for k in keys] + fields
        + [StructField("is_first", BooleanType()), StructField(SIDE, IntegerType())]
    )

    def solve(batches):
        import numpy as np
        import pandas as pd

        def shifted(v, k, fill):
            out = np.full(len(v), fill)
            if k > 0:
                out[k:] = v[:-k]
            else:
                out[:k] = v[-k:]
            return out

        def segments(pdf):
            x, y, i = (pdf[c].to_numpy() for c in ("x", "y", "_i"))
            m = len(x)
            first = i == 1
            start = np.flatnonzero(first)
            end = np.append(start[1:], m) - 1
            size = np.repeat(end - start + 1, end - start + 1)
            last = np.zeros(m, bool)
            last[end] = True
            h = np.where(last, 0.0, shifted(x, -1, np.nan) - x)
            hp = np.where(first, 0.0, shifted(h, 1, 0.0))
            with np.errstate(all="ignore"):
                sl = np.where(last, 0.0, (shifted(y, -1, np.nan) - y) / h)
            diag = np.where(first, -h, np.where(last, -hp, 2 * (h + hp)))
            rhs = np.where(first | last, 0.0, sl - shifted(sl, 1, 0.0))
            long = end - start > 2
            for at, sign, edge in ((start[long], 1, start[long]), (end[long] - 3, -1, end[long])):
                second = [
                    (sl[at + k + 1] - sl[at + k]) / (x[at + k + 2] - x[at + k]) for k in (0, 1)
                ]
                width = h[at] if sign > 0 else h[edge - 1]
                rhs[edge] = sign * (second[1] - second[0]) / (x[at + 3] - x[at]) * width**2
            tiny = size < 3
            low, up = np.where(tiny, 0.0, hp), np.where(tiny, 0.0, h)
            diag[tiny], rhs[tiny] = 1.0, 0.0
            stride = 1
            while stride < min(size.max(), m):
                p = -low / shifted(diag, stride, 1.0)
                q = -up / shifted(diag, -stride, 1.0)
                diag = diag + p * shifted(up, stride, 0.0) + q * shifted(low, -stride, 0.0)
                rhs = rhs + p * shifted(rhs, stride, 0.0) + q * shifted(rhs, -stride, 0.0)
                low, up = p * shifted(low, stride, 0.0), q * shifted(up, -stride, 0.0)
                stride *= 2
            s = rhs / diag
            after = shifted(s, -1, 0.0)
            inner = ~last & ~shifted(last, -1, True).astype(bool)
            out = pdf[keys].assign(
                x=x, y=y, b=sl - h * (after + 2 * s), c=3 * s,
                d=np.divide(after - s, h, out=np.zeros(m), where=h > 0),
                x_next=np.where(inner, shifted(x, -1, np.nan), np.nan), is_first=first, **{SIDE: pdf[SIDE]},
            )
            one = size == 1
            out.loc[one, ["b", "c", "d"]] = 0.0
            return out[~last | one]

        waiting = []
        for pdf in batches:
            starts = np.flatnonzero(pdf["_i"].to_numpy() == 1)
            if len(starts) and (waiting or starts[-1] > 0):
                done = pd.concat([*waiting, pdf.iloc[: starts[-1]]], ignore_index=True)
                waiting = [pdf.iloc[starts[-1] :]]
                if len(done):
                    yield segments(done)
            elif len(pdf):
                waiting.append(pdf)
        if waiting:
            yield segments(pd.concat(waiting, ignore_index=True))

    solved = numbered.select(*keys, "x", "y", "_i", SIDE).mapInPandas(solve, schema)
    return solved.withColumn("x_next", F.when(~F.isnan("x_next"), F.col("x_next")))
