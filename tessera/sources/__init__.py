"""Arrays from and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Headerless numbers as c0, c1, ...; an empty cell is null and shifts nothing, bad cells raise."""
    schema = ", ".join(f"c{k} double" for k in range(columns))
    return spark.read.csv(path, schema=schema, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")


def write_csv(a: DataFrame, path: str, columns: int) -> None:
    """A matrix (i, j, v) as headerless rows, in order; a vector (idx, v) is the matrix of one row.  Cells that are left out are empty."""
    if "idx" in a.columns:
        a = a.select(F.lit(0).cast("long").alias("i"), F.col("idx").alias("j"), "v")
    wide = a.groupBy("i").pivot("j", list(range(columns))).agg(F.first("v")).orderBy("i")
    wide.select(*(F.col(str(k)) for k in range(columns))).write.csv(path, header=False)


def save(a: DataFrame, path: str, shape: tuple[int, ...]) -> None:
    """An array as Parquet; its shape goes with the schema, so an array without cells has one too."""
    a.select(*(c for c in a.columns if c != "v"), F.col("v").alias("v", metadata={"shape": list(shape)})).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...]]:
    a = spark.read.parquet(path)
    return a, tuple(a.schema["v"].metadata["shape"])
