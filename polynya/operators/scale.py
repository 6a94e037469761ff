"""Shared scratch space, null-safe joins and totals of groups of any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the session's checkpoint folder, else (local runs) a new one."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="polynya-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable copy, so ids taken from the physical layout stay fixed."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on shared names where null keys meet null keys; keys come from the left."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = {k: f"_right_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for k, r in renamed.items():
        condition = condition & F.col(k).eqNullSafe(F.col(r))
    joined = left.join(other, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


def with_group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Put group aggregates on every row: partial aggregation, then a join back.

    A window over the keys would bring each whole group into one task; here only partial
    aggregates do, and the join back is broadcast or skew-split by adaptive execution.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return null_safe_join(df, totals, keys)
