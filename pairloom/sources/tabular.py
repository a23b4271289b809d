"""CSV tables with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def read_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every value as text; columns are found by header name, absent ones are NULL.

    A missing path gives no rows.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path)
    if not found:
        return spark.createDataFrame([], schema)
    seen = spark.read.option("header", True).csv(path)
    present = set(seen.columns)
    return seen.selectExpr(*[f"`{c}`" if c in present else f"CAST(NULL AS STRING) AS `{c}`" for c in columns])


def write_rows(rows: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Only the named columns, in that order; the files share the header."""
    rows.select(*columns).write.mode(mode).option("header", True).csv(path)
