"""Equi-joins and the checks around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.operators.scale import null_safe_join


def inner_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys))


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner", nulls_match: bool = True) -> DataFrame:
    """Join on every shared column name; null keys meet null keys unless told otherwise."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("no shared column names")
    return null_safe_join(a, b, shared, how) if nulls_match else a.join(b, shared, how)


def left_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a lookup table; duplicate lookup keys multiply rows."""
    return df.join(lookup, list(keys), "left")


def without_partner(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def assert_all_matched(df: DataFrame, other: DataFrame, keys: Sequence[str], what: str) -> None:
    """Stop the job when a row has no partner (looks for one row only)."""
    if without_partner(df, other, keys).head(1):
        raise ValueError(f"{what}: rows without a partner on {', '.join(keys)}")


def cross_targets(df: DataFrame, name: str, targets: Sequence[float]) -> DataFrame:
    """Every row once per target; an explode of a literal array, no join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(t)) for t in targets])))


def keyed_override(
    df: DataFrame,
    corrections: DataFrame,
    keys: Sequence[str],
    replace: Mapping[str, str],
    series: DataFrame | None = None,
    series_on: Mapping[str, str] | None = None,
    take: Mapping[str, str] | None = None,
) -> DataFrame:
    """Manual corrections: change existing rows only.

    ``replace`` maps a column to the corrections column with its new content. ``take`` maps a
    column to a value column of ``series``, looked up by ``series_on`` (df/corrections column to
    series column) at the corrected place.
    """
    fixes = corrections
    take, series_on = dict(take or {}), dict(series_on or {})
    if series is not None:
        looked = series.select(
            *[F.col(s).alias(c) for c, s in series_on.items()],
            *[F.col(s).alias(f"_new_{c}") for c, s in take.items()],
        )
        fixes = fixes.join(looked, list(series_on), "left")
    fixes = fixes.select(
        *keys,
        *[F.col(src).alias(f"_fix_{c}") for c, src in replace.items()],
        *[F.col(f"_new_{c}") for c in take],
        F.lit(True).alias("_hit"),
    )
    joined = df.join(fixes, list(keys), "left")
    new = {c: F.coalesce(f"_fix_{c}", c) for c in replace}
    new |= {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in take}
    return joined.withColumns(new).select(*df.columns)


def reference_rows(
    df: DataFrame,
    group: str,
    order: str,
    unmatched: Column,
    on: Sequence[str],
    columns: Mapping[str, str],
) -> DataFrame:
    """Left self-join to the row(s) at the group's smallest ``order`` among ``unmatched`` rows."""
    candidates = df.filter(unmatched)
    lowest = candidates.groupBy(group).agg(F.min(order).alias("_low"))
    picked = candidates.join(lowest, group).filter(F.col(order) == F.col("_low"))
    reference = picked.select(group, *on, *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(reference, [group, *on], "left")


def block_counts(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int = 512, most: int = 256) -> DataFrame:
    """Blocks of each shared key on both sides, ``_nl`` and ``_nr``.

    A block has about ``rows`` rows; where that would give a key more than ``most`` pairs of blocks, as
    many as leave it ``most``, on both sides alike, as this takes the fewest copies. A key of l and r
    rows thus has l + r + 2 sqrt(l r most) copies at most, which grow as its rows, not as their product.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(name))

    block = F.greatest(F.lit(float(rows)), F.sqrt(F.col("_nl") * F.col("_nr") / most))
    both = sizes(left, "_nl").join(sizes(right, "_nr"), list(on))
    return both.select(*on, *[F.ceil(F.col(n) / block).cast("int").alias(n) for n in ("_nl", "_nr")])


def blocked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], rows: int = 512, most: int = 256, run: int = 256
) -> DataFrame:
    """Inner equi-join for keys that have many rows on both sides.

    The output of such a key is the product of its rows, far more than either side. Each side's rows
    of a key are dealt by a hash into blocks (``block_counts``); every pair of blocks is a join key of
    its own, so the work of one key spreads over tasks. A row is copied once per block of the other
    side; the left ones travel and come out in lists of ``run``, the same list for one right row
    after another, so that files hold the columns of the right as runs and those of the left as
    repeats that compress. Rows with a null key have no partner.
    """
    on = list(on)
    counts = block_counts(left, right, on, rows, most)

    def dealt(df: DataFrame, own: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*df.columns), F.col(f"_n{own}")).cast("int").alias(f"_{own}")
        return df.join(counts, on).select(*df.columns, place, "_nl", "_nr")

    def copied(df: DataFrame, other: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)).alias(f"_{other}")
        return df.select("*", each).drop("_nl", "_nr")

    mine, others = [c for c in left.columns if c not in on], [c for c in right.columns if c not in on]
    held = {f"_v{i}": c for i, c in enumerate(mine or on)}
    apart = dealt(left, "l").repartition(*on, "_l")  # else all blocks of a key would be gathered by one task
    block = apart.groupBy(*on, "_l", "_nl", "_nr").agg(F.collect_list(F.struct(*held.values())).alias("_all"))
    start = F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(run))).alias("_at")
    # A list of plain values for each column: taking them apart again makes no object for a row.
    lists = {v: F.slice(F.col("_all")[c], F.col("_at"), run) for v, c in held.items()}
    lists = block.select("*", start).withColumns(lists).drop("_all", "_at")
    # Both sides are shuffled: a broadcast would leave the pairs in the few tasks of the other side. The
    # number is given, as tasks would else be merged by what they read, which is little beside their output.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each, every = (
        copied(df, other).repartition(tasks, *on, "_l", "_r") for df, other in ((lists, "r"), (dealt(right, "r"), "l"))
    )
    pairs = each.join(every.hint("shuffle_hash"), [*on, "_l", "_r"])
    made = pairs.select("*", F.posexplode("_v0").alias("_i", "_x"))
    return made.select(*on, *[F.get(v, F.col("_i")).alias(c) for v, c in held.items() if mine], *others)
