"""Archives of trade tapes, sinks and identities of files."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.amm import wide_text
from tidemark.operators.ordered import keep_one
from tidemark.sources.tables import usable


def read_parts(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A directory of ``part-*.parquet`` files beside other files; columns of all parts are united."""
    r = spark.read.option("pathGlobFilter", "part-*.parquet").option("mergeSchema", "true")
    return (r.schema(schema) if schema else r).parquet(path)


def read_gzip_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """Headed CSV files, gzipped or not. A gzip file can't be split, so rows are spread over the cores after reading."""
    header = spark.read.option("header", True).csv(path).columns
    if lost := set(required) - set(header):
        raise ValueError(f"columns are missing: {sorted(lost)}")
    kinds = dict(x.strip().split(" ", 1) for x in schema.split(","))
    df = spark.read.option("header", True).csv(path)
    df = df.select(*[(F.col(c).try_cast(t) if c in header else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])
    return df.repartition(spark.sparkContext.defaultParallelism)


def read_zip_csv(spark: SparkSession, path: str, names: Sequence[str], chunk_rows: int = 50_000) -> DataFrame:
    """CSV files without header in zip archives, all columns as text: one task per archive, read member by member in chunks.

    Members are those named .csv or .txt, in upper or lower case; others, as checksums, are left alone, and an archive
    without any is refused. Empty fields are NULL, shorter rows are filled up with NULL, and empty lines are no rows. A row with more fields
    than ``names`` is refused.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return zip_rows(files, names, chunk_rows)


def zip_rows(files: DataFrame, names: Sequence[str], chunk_rows: int = 50_000) -> DataFrame:
    """The rows of archives given as (path, content); see :func:`read_zip_csv`."""
    schema = ", ".join(f"`{n}` string" for n in names)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [m for m in z.namelist() if m.lower().endswith((".csv", ".txt"))]
                    if not members:
                        raise ValueError(f"no table in the archive {path}")
                    for member in members:
                        with z.open(member) as f:
                            rows: list[list[str | None]] = []
                            for row in csv.reader(io.TextIOWrapper(f, "utf-8", newline="")):
                                if len(row) > len(names):
                                    raise ValueError(f"{len(row)} fields instead of {len(names)} in {member} of {path}")
                                if row:
                                    rows.append([*(x or None for x in row), *[None] * (len(names) - len(row))])
                                if len(rows) == chunk_rows:
                                    yield pd.DataFrame(rows, columns=list(names))
                                    rows = []
                            yield pd.DataFrame(rows, columns=list(names))

    return files.select("path", "content").mapInPandas(read, schema)


def epoch_time(c: Column) -> Column:
    """Timestamp of an epoch number: microseconds from 10^14 on, else milliseconds; row by row."""
    n = c.cast("bigint")
    return F.when(n >= 100_000_000_000_000, F.timestamp_micros(n)).otherwise(F.timestamp_millis(n))


def write_table(df: DataFrame, path: str, wide: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """Parquet with the ``wide`` integer columns as canonical decimal text; only the partitions written are replaced."""
    df = df.withColumns({c: wide_text(c) for c in wide})
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the files under a path, hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def directory_digest(spark: SparkSession, path: str) -> DataFrame:
    """(files, length, sha256) of a directory: the digest of its files' names and digests in the order of names."""
    f = file_identities(spark, path).groupBy().agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.sort_array(F.collect_list(F.struct("name", "sha256"))).alias("each"))
    lines = F.array_join(F.transform("each", lambda x: F.concat_ws(" ", x["name"], x["sha256"])), "\n")
    return f.select("files", "length", F.sha2(lines, 256).alias("sha256"))


def resume_parts(df: DataFrame, path: str, part: str) -> None:
    """Writes those rows whose ``part`` isn't in the dataset yet, a directory per part, so that a run that broke off goes on.

    A part is there as soon as its directory is; Spark's commit moves whole directories of finished jobs into place.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = spark.read.parquet(path).select(F.col(part).cast(df.schema[part].dataType).alias("_there")).distinct()
        df = df.join(there, F.col(part).eqNullSafe(F.col("_there")), "left_anti")
    df.write.mode("append").partitionBy(part).parquet(path)


def keep_last_by_time(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of the rows of ``keys`` with one ``timestamp`` the one with the last ``order``; rows without time are one time."""
    return keep_one(df, [*keys, "timestamp"], order, last=True)


def fresh_or_inexact(df: DataFrame, tolerance_seconds: float) -> DataFrame:
    """Rows that aren't for alignment (``alignment_eligible`` false or NULL), and of the others those at most so old as noted."""
    exact = F.coalesce("alignment_eligible", F.lit(False))
    fresh = usable("age_seconds") & (F.col("age_seconds") <= tolerance_seconds)
    return df.where(~exact | fresh)


def window_ends(start: str, end: str) -> tuple[Column, Column]:
    """The closed window of two UTC texts; an end that is a date only counts to its last microsecond. Ends in wrong order are refused."""
    first, last = (datetime.fromisoformat(x).replace(tzinfo=datetime.fromisoformat(x).tzinfo or UTC) for x in (start, end))
    if "T" not in end and " " not in end:
        last += timedelta(days=1) - timedelta(microseconds=1)
    if last <= first:
        raise ValueError("the window ends before it starts")
    return F.lit(first), F.lit(last)


def in_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows whose timestamp lies in the closed window; the filter is on the column itself, so it reaches the scan."""
    first, last = window_ends(start, end)
    return df.where((F.col(column) >= first) & (F.col(column) <= last))


def klines_reference(klines: DataFrame, source: str, time: str = "close_time", price: str = "close") -> DataFrame:
    """Bars of an archive, all columns as text, as reference rows (timestamp, mid, source, alignment_eligible, regime_eligible).

    The time of closing is an epoch number in milli- or microseconds, told row by row. Bars without readable time or
    price are left out. Bars are for regimes, not for alignment.
    """
    p = F.col(price).try_cast("double")
    k = klines.select(epoch_time(F.trim(time).try_cast("bigint")).alias("timestamp"), p.alias("mid")).where(F.col("timestamp").isNotNull() & usable("mid"))
    return k.select("timestamp", "mid", F.lit(source).alias("source"), F.lit(False).alias("alignment_eligible"), F.lit(True).alias("regime_eligible"))


def seeded_rates(seed: DataFrame, updates: DataFrame, keys: Sequence[str], us: str, rate: str) -> DataFrame:
    """The changes of a rate from a known opening state on: (keys, us, rate); an update at the time of the seed replaces it."""
    rows = lambda d, first: d.select(*keys, us, rate, F.lit(first).alias("_rank"))
    return keep_one(rows(seed, 0).unionByName(rows(updates, 1)), [*keys, us], "_rank", last=True).drop("_rank")


def normalise_reference(df: DataFrame, source: str = "unknown") -> DataFrame:
    """(timestamp, mid, source): mid from ``mid``, ``price``, ``last_trade`` or the middle of ``bid`` and ``ask``, whichever is there first."""
    has = lambda c: c in df.columns
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    tries = [number(c) for c in ("mid", "price", "last_trade") if has(c)]
    if has("bid") and has("ask"):
        tries.append((number("bid") + number("ask")) / 2)
    if not tries:
        raise ValueError("no price column")
    at = F.coalesce(F.col("source"), F.lit(source)) if has("source") else F.lit(source)
    return df.select(F.col("timestamp").cast("timestamp").alias("timestamp"), F.coalesce(*tries).alias("mid"), at.alias("source"))
