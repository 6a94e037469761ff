"""Walks over rows in order, per group, without a task that holds a large group.

One pass over keys and order takes a fixed number of rows by hash. A key with a large share of
them is cut at sampled places of its order into blocks of about equal size; where it is cut
changes the work of a task, never a result. Windows run per key and block. What must cross a block
edge is brought in: the first or last few rows of a block for bounded frames, one total a block for
running columns. Keys that are not cut, mostly all of them, take a plain window.

A row's block is a function of its own order values and the cuts, so every part of a plan and
every repeated task agrees on it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

from polynya.operators.scale import null_safe_join, with_group

BLOCK, SIDE, RANK, ALL, CUTS = "_walk_block", "_walk_side", "_walk_rank", "_walk_all", "_walk_cuts"
SAMPLE, THIN = 4096, 16  # rows of the sample at most, and one in so many looked at
STRIDE = 32  # cuts are searched in two steps of about so many


def sort_key(values: Sequence) -> list:
    """Python order of order values as Spark sorts them: null first, NaN last."""
    return [(v is not None, v != v, 0 if v is None or v != v else v) for v in values]


class Ordered:
    """``df`` with groups ``keys`` walked by ``order`` (ascending columns that fix a total order).

    ``small``: no group is large by construction (a fixed grid, a list of levels). ``blocks``: into
    how many parts all rows are thought cut; a key is cut when two or more of them are its own.
    ``like``: a walk of the same rows, whose cuts are taken.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[Column | str],
        small: bool = False,
        blocks: int | None = None,
        like: Ordered | None = None,
    ):
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.columns = df.columns
        self.keys = list(keys) or [ALL]
        self.df = df if keys else df.withColumn(ALL, F.lit(0))
        self.place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.order)])
        blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.cuts = like.cuts if like else [] if small and keys else self._sampled(blocks)
        if self.cuts:
            self.df = self._in_blocks()
        self.parts = self.keys + ([BLOCK] if self.cuts else [])

    def _sampled(self, blocks: int) -> list[tuple[tuple, list[list]]]:
        """(key, cuts) of each key that is cut."""
        along = self.df.select(F.struct(*self.keys).alias("k"), self.place.alias("o"))
        thin = along.filter(F.pmod(F.xxhash64(F.lit(0), "k", "o"), F.lit(THIN)) == 0)
        slot = F.pmod(F.xxhash64("k", "o"), F.lit(SAMPLE))
        picked = F.min(F.struct(F.xxhash64(F.lit(1), "k", "o").alias("h"), "k", "o")).alias("row")
        rows = [r.row for r in thin.groupBy(slot.alias("slot")).agg(picked).collect()]
        found = defaultdict(list)
        for r in rows:
            found[tuple(r.k)].append(list(r.o))
        cuts = []
        for key, places in found.items():
            own = min(math.floor(blocks * len(places) / len(rows)), len(places))
            if own >= 2:
                places.sort(key=sort_key)
                cuts.append((key, [places[i * len(places) // own] for i in range(1, own)]))
        return cuts

    def _in_blocks(self) -> DataFrame:
        """Rows with the number of cuts at or before them; null for keys that are not cut."""
        kinds = self.df.select(*self.keys, self.place.alias("_o")).schema
        schema = T.StructType(
            [T.StructField(f"_k{i}", kinds[k].dataType) for i, k in enumerate(self.keys)]
            + [T.StructField(CUTS, T.ArrayType(T.ArrayType(kinds["_o"].dataType)))]
        )
        rows = [
            (*key, [[tuple(c) for c in cuts[i : i + STRIDE]] for i in range(0, len(cuts), STRIDE)])
            for key, cuts in self.cuts
        ]
        table = self.df.sparkSession.createDataFrame(rows, schema)
        met = F.lit(True)
        for i, k in enumerate(self.keys):
            met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        # At most as many rows as the sample has.
        joined = self.df.join(F.broadcast(table), met, "left").withColumn("_o", self.place)
        reached = lambda c: c <= F.col("_o")
        coarse = F.size(F.filter(CUTS, lambda g: reached(F.get(g, F.lit(0)))))
        fine = F.size(F.filter(F.get(CUTS, coarse - 1), reached))
        block = F.when(coarse == 0, 0).otherwise((coarse - 1) * STRIDE + fine)
        return joined.withColumn(BLOCK, F.when(F.col(CUTS).isNotNull(), block)).drop(
            "_o", CUTS, *[f"_k{i}" for i in range(len(self.keys))]
        )

    def _window(self, *leading: str) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*leading, *self.order)

    def frame(
        self, before: int, after: int, build: Callable[[WindowSpec], Mapping[str, Column]]
    ) -> DataFrame:
        """Add window columns whose frames reach at most ``before``/``after`` rows away."""
        if not self.cuts:
            return self.df.withColumns(dict(build(self._window()))).drop(ALL)
        whole = self.df.withColumn(SIDE, F.lit(0))
        if after:
            whole = whole.unionByName(self._neighbours(after, 1))
        if before:
            whole = whole.unionByName(self._neighbours(before, -1))
        built = whole.withColumns(dict(build(self._window(SIDE))))
        return built.filter(F.col(SIDE) == 0).drop(SIDE, BLOCK, ALL)

    def _neighbours(self, n: int, side: int) -> DataFrame:
        """For each block the ``n`` rows after it (side 1) or before it (side -1).

        Only the first (last) ``n`` rows of each block are looked at, and Spark keeps no more of
        them before the shuffle.
        """
        along = self.order if side > 0 else [o.desc() for o in self.order]
        edge = F.row_number().over(Window.partitionBy(*self.parts).orderBy(*along))
        edges = self.df.filter(F.col(BLOCK).isNotNull()).withColumn(RANK, edge).filter(F.col(RANK) <= n)
        ahead = Window.partitionBy(*self.keys).orderBy(F.col(BLOCK) * side, RANK)
        last = F.max(RANK).over(Window.partitionBy(*self.parts)) == F.col(RANK)
        cell = F.struct(*dict.fromkeys([*self.columns, *self.keys]))
        near = edges.withColumns({"_near": F.collect_list(cell).over(ahead.rowsBetween(1, n)), "_last": last})
        found = near.filter("_last").select(BLOCK, F.explode("_near").alias("_row"))
        return found.select("_row.*", BLOCK, F.lit(side).alias(SIDE))

    def cumulative(self, specs: Mapping[str, tuple[str, Column]]) -> DataFrame:
        """Add running columns: ``name -> (kind, expression)``.

        kinds: ``sum`` (running total, this row included), ``rest`` (total from this row on),
        ``last`` (last non-null so far), ``next`` (first non-null from here on).
        """
        down = self._window().rowsBetween(Window.unboundedPreceding, 0)
        # Backward kinds walk the reversed order: a frame open to the end would rescan it for
        # each row.
        back = Window.partitionBy(*self.parts).orderBy(*[o.desc() for o in self.order])
        up = back.rowsBetween(Window.unboundedPreceding, 0)
        run = {
            "sum": lambda c: F.sum(c).over(down),
            "rest": lambda c: F.sum(c).over(up),
            "last": lambda c: F.last(c, ignorenulls=True).over(down),
            "next": lambda c: F.last(c, ignorenulls=True).over(up),
        }
        local = self.df.withColumns({n: run[kind](c) for n, (kind, c) in specs.items()})
        if not self.cuts:
            return local.drop(ALL)
        known = lambda c: F.when(c.isNotNull(), self.place)
        total = {
            "sum": F.sum,
            "rest": F.sum,
            "last": lambda c: F.max_by(c, known(c)),
            "next": lambda c: F.min_by(c, known(c)),
        }
        edges = self.df.filter(F.col(BLOCK).isNotNull()).groupBy(*self.parts).agg(
            *[total[kind](c).alias(f"_in_{n}") for n, (kind, c) in specs.items()]
        )
        blocks = Window.partitionBy(*self.keys)
        earlier = blocks.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        later = blocks.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        carry = {
            "sum": lambda n: F.sum(n).over(earlier),
            "rest": lambda n: F.sum(n).over(later),
            "last": lambda n: F.last(n, ignorenulls=True).over(earlier),
            "next": lambda n: F.last(n, ignorenulls=True).over(later),
        }
        carried = edges.select(
            *self.parts, *[carry[kind](F.col(f"_in_{n}")).alias(f"_in_{n}") for n, (kind, _) in specs.items()]
        )
        joined = null_safe_join(local, F.broadcast(carried), self.parts, "left")  # a row a block
        merged = {
            n: F.coalesce(F.col(n) + F.col(f"_in_{n}"), F.col(n), F.col(f"_in_{n}"))
            if kind in ("sum", "rest")
            else F.coalesce(F.col(n), F.col(f"_in_{n}"))
            for n, (kind, _) in specs.items()
        }
        return joined.withColumns(merged).drop(BLOCK, ALL, *[f"_in_{n}" for n in specs])


def next_rows_below(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    targets: Sequence[float],
    target: str = "target",
    out: str = "next_below",
    n: int = 3,
    **kw,
) -> DataFrame:
    """Every row once per target: are the next ``n`` rows (this one excluded) all below it?

    Null for the last rows, which do not have ``n`` after them. The walk does not depend on
    the target, so rows are sorted once and multiplied afterwards.
    """
    def build(w: WindowSpec) -> dict[str, Column]:
        ahead = {f"_next{k}": F.lead(value, k).over(w) for k in range(1, n + 1)}
        return ahead | {"_ahead": F.count(F.lit(1)).over(w.rowsBetween(1, n))}

    walked = Ordered(df, keys, order, **kw).frame(0, n, build)
    crossed = walked.withColumn(target, F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    verdict = F.lit(True)
    for k in range(1, n + 1):
        verdict = verdict & (F.col(f"_next{k}") < F.col(target))
    judged = crossed.withColumn(out, F.when(F.col("_ahead") == n, verdict))
    return judged.drop("_ahead", *[f"_next{k}" for k in range(1, n + 1)])


def closest_to_target(
    df: DataFrame, keys: Sequence[str], flag: str, value: str, target: str, tie: str
) -> DataFrame:
    """Of the flagged rows of a group, the one nearest the target, earliest first."""
    gap = F.abs(F.col(value) - F.col(target))
    rest = [c for c in df.columns if c not in keys]
    best = (
        df.filter(F.col(flag) & F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(gap, F.col(tie))).alias("_row"))
    )
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def track_segments(
    df: DataFrame,
    order: Sequence[Column | str],
    x: str,
    y: str,
    keys: Sequence[str] = (),
    **kw,
) -> DataFrame:
    """Each point with the position of the next one. Without keys all tracks form one sequence."""
    return Ordered(df, keys, order, **kw).frame(
        0, 1, lambda w: {"xend": F.lead(x).over(w), "yend": F.lead(y).over(w)}
    )


def run_lengths(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, **kw
) -> DataFrame:
    """Number the runs of equal values and put run number and length on every row."""
    walk = Ordered(df, keys, order, **kw)
    changed = walk.frame(
        1,
        0,
        lambda w: {
            "_new": F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1),
            "_at": F.lag(F.lit(1)).over(w),
        },
    )
    starts = changed.withColumn("_new", F.when(F.col("_at").isNull(), 1).otherwise(F.col("_new")))
    numbered = Ordered(starts.drop("_at"), keys, order, like=walk).cumulative(
        {"run_id": ("sum", F.col("_new"))}
    )
    return with_group(
        numbered.drop("_new"), [*keys, "run_id"], {"run_length": F.count(F.lit(1))}
    )


def sorted_check(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, **kw
) -> DataFrame:
    """Per group: is ``value`` non-decreasing along ``order``? Nulls are passed over."""
    known = df.filter(F.col(value).isNotNull())
    steps = Ordered(known, keys, order, **kw).frame(
        1, 0, lambda w: {"_down": F.col(value) < F.lag(value).over(w)}
    )
    return steps.groupBy(*keys).agg(
        (~F.coalesce(F.bool_or("_down"), F.lit(False))).alias("is_sorted")
    )
