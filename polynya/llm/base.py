"""What the operators of this folder share: reading, scratch tables, fold rules, packed arrays."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polynya.operators.scale import scratch_path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: later steps start from files that
    outlive any executor. The shuffle files of the write are not needed again, so Spark may
    delete them when it ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table once everything made from it is written itself."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def pieces(total: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` a total needs; grows with the data."""
    return max(least, math.ceil((total or 0) / each))


def text_size(docs: DataFrame, column: str = "text") -> int:
    """Characters of a text column over all rows: one number, by which work is cut in parts."""
    return docs.agg(F.sum(F.length(column))).first()[0] or 0


def crc_mod(key: Column, n: int) -> Column:
    """Remainder of the crc32 of a key written as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def frames(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[list[dict]]:
    """Arrow batches as lists of at most ``rows`` row dicts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).to_pylist()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of plain numbers in one binary value."""
    return b"".join(
        np.array([ord(a.dtype.char), a.dtype.itemsize, a.size], np.int64).tobytes() + a.tobytes()
        for a in arrays
    )


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        char, width, n = np.frombuffer(body, np.int64, 3, at)
        at += 24
        out.append(np.frombuffer(body, np.dtype(chr(char)), n, at))
        at += int(width * n)
    return out


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int
) -> list[tuple[str, int]]:
    """Bounded training sample as (whole text, label), brought to the driver.

    At most ``per_class`` labelled ids of each class for which ``learn`` (a rule on doc_id)
    holds, picked by a hash of the id. Only the number of rows of a fit is bounded; scores read
    all rows. Null ids, texts and labels are left out; of several labels of one id the largest
    counts, of several texts the smallest. The order of the sample is that of the ids' checksums.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(
        F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & learn
    )
    known = known.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    place = F.xxhash64(F.lit(label), F.col("doc_id"))
    picked = [known.where(F.col("_y") == y).orderBy(place, "doc_id").limit(per_class) for y in (0, 1)]
    few = picked[0].unionByName(picked[1])
    found = docs.where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    rows = found.groupBy("doc_id", "_y").agg(F.min(F.col("text").cast("string")).alias("_text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id)))
    return [(r._text, r._y) for r in rows]


def scored(docs: DataFrame, score) -> DataFrame:
    """``doc_id, score`` of every row; ``score(texts)`` gives a float per text, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = score([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
