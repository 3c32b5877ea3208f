"""CSV and Parquet scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens that mean "missing" in the raw files, besides the empty field.
NULL_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";",
             encoding: str = "ISO-8859-1") -> DataFrame:
    """Scan a headed CSV file with a declared schema.

    Columns are read as text first, so that a missing-value token in a number column becomes null
    instead of failing the row.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema])
    raw = (
        spark.read.schema(as_text)
        .option("header", True).option("sep", sep).option("encoding", encoding)
        .option("nullValue", "").csv(path)
    )
    return raw.select(*[
        F.when(~F.col(f.name).isin(NULL_TOKENS), F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8",
              gzip: bool = False, mode: str = "overwrite") -> str:
    """Write a headed CSV folder, one file per task, gzipped on request."""
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", encoding)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)
    return path


def recompress_csv(spark: SparkSession, source: str, target: str, schema: T.StructType,
                   sep: str = ",", encoding: str = "UTF-8") -> str:
    """Copy a CSV folder into a gzipped one."""
    return write_csv(read_csv(spark, source, schema, sep, encoding), target, sep, encoding, gzip=True)


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan; the columns named are the only ones read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet sink, the default between pipeline stages because it keeps the types."""
    df.write.mode(mode).parquet(path)
    return path
