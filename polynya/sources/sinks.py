"""Writers and their read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CSV = {"header": "true", "nullValue": "NA", "timestampNTZFormat": STAMP}


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.options(**CSV).mode("overwrite" if overwrite else "errorifexists").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**CSV).option("enforceSchema", "false").schema(schema).csv(path)


def write_columnar(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; refuses an existing target unless told to overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_by_year(df: DataFrame, path: str, year: str = "year", overwrite: bool = False) -> None:
    """One folder per year. Rows of one year may fill many files; no year is held by one task."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(year).parquet(path)
