"""Reading tables, with the columns an operator needs in fixed types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder, one file or a directory of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable(c: Column | str) -> Column:
    """True where a double is neither NULL nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def micros(c: Column | str) -> Column:
    """Epoch microseconds of a timestamp, with or without zone (without: read as UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))
