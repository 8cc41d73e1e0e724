"""Signal tables from CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.subjects import require_columns


def read_signals(spark: SparkSession, path: str, schema=None, file_format: str | None = None,
                 row_id: str | None = None) -> DataFrame:
    """Read a signal table; CSV has a header and commas.

    With a ``schema`` nothing is inferred. Without one a CSV is scanned once for its types.
    ``row_id`` names the unique key column; it must exist.
    """
    file_format = file_format or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if file_format == "csv":
        df = reader.option("header", True).option("inferSchema", schema is None).csv(path)
    elif file_format == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unknown format {file_format!r}; valid: csv, parquet")
    if row_id is not None:
        require_columns(df, [row_id])
    return df


def with_row_id(df: DataFrame, columns, name: str = "row_id") -> DataFrame:
    """Add a key made from columns that identify a row together: 128 bits as text.

    Each part carries its length, so that neither nulls nor separators make different rows equal.
    """
    require_columns(df, columns)
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return df.withColumn(name, F.md5(F.concat(*parts)))
