"""Ordered work on keys that may hold a large share of all rows: chunks, previous rows and one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

CHUNK = "_chunk"


#: Rows of a chunk that a task takes at once, about.
ROWS_PER_CHUNK = 500_000


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``df`` with ``_chunk``: numbers that rise with keys and order, so that the rows of a long key are in many chunks.

    A chunk is a range partition. There are as many as the rows need, and at least ``spark.sql.shuffle.partitions``.
    Rows alike in keys and order are in one chunk. The result is a written table: a recomputation could draw other
    borders. ``df`` is written first, so that what it comes from is computed once and not again for the number of rows
    and the sample of the borders; that isn't needed where the caller knows about how many ``rows`` there are, of a
    ``df`` that is cheap to compute.
    """
    d = written(df, f"{name}-rows") if rows is None else df
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(d.count() if rows is None else rows) // rows_per_chunk))
    return written(d.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id()), name)


def time_chunks(df: DataFrame, us: str, width_us: int) -> DataFrame:
    """``df`` with ``_chunk``: the span of ``width_us`` microseconds that holds the row's time."""
    return df.withColumn(CHUNK, F.floor(F.col(us) / F.lit(width_us)).cast("bigint"))


def attach(df: DataFrame, per_chunk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``per_chunk``, which has one row for each of its keys (NULL too) and chunks."""
    on = [*keys, CHUNK]
    small = per_chunk.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in per_chunk.columns if c not in on])
    same: Column = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return df.join(small, same).drop(*[f"_on{i}" for i in range(len(on))])


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: dict[str, str], required: bool = False) -> DataFrame:
    """``df`` with ``columns`` (result name: name in ``table``) of the row of ``table`` with the same keys, of which there is one at most.

    Rows without counterpart, as all with a NULL key, have NULL; with ``required`` the query fails at the first of them instead.
    """
    found = table.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns.values())], F.lit(True).alias("_found"))
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_on{i}"))
    j = df.join(found, same, "left")
    miss = F.raise_error(F.concat_ws(" ", F.lit("no row for"), *[F.col(k).cast("string") for k in keys]))
    got = lambda i: F.when(F.col("_found"), F.col(f"_c{i}")).otherwise(miss) if required else F.col(f"_c{i}")
    return j.select(*[F.col(f"`{c}`") for c in df.columns], *[got(i).alias(name) for i, name in enumerate(columns)])


def chunk_line(keys: Sequence[str]) -> Window:
    """The chunks of a key in order: one row per chunk, not per row of the tape."""
    return Window.partitionBy(*keys).orderBy(CHUNK)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str = "_prev") -> DataFrame:
    """``df``, which has a ``_chunk`` that rises with ``order``, with the struct ``name``: ``columns`` of the row before.

    The first row of a key has NULL. ``order`` must be without ties within a key. NULL keys form a key of their own. A
    window covers one chunk; the last rows of the chunks bridge the borders.
    """
    row = F.struct(*columns)
    ends = df.groupBy(*keys, CHUNK).agg(F.max_by(row, F.struct(*order)).alias("_end"))
    ends = ends.select(*keys, CHUNK, F.lag("_end").over(chunk_line(keys)).alias("_before"))
    within = F.lag(row).over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
    return attach(df, ends, keys).withColumn(name, F.coalesce(within, "_before")).drop("_before")


def keep_one(df: DataFrame, keys: Sequence[str], by: str, last: bool = False, unique: bool = False) -> DataFrame:
    """The row of each key with the smallest ``by`` (with ``last`` the largest), all columns.

    Copies are reduced before the shuffle, so a message delivered very often makes no large group. NULL keys are a
    key like any other; rows with NULL ``by`` are left out; of rows with equal ``by`` any one stays. Where ``by`` is
    ``unique`` in the table, only keys and ``by`` are aggregated, by hash, and the rows that have it are kept.
    """
    d = df.where(F.col(by).isNotNull())
    if unique:
        best = d.groupBy(*keys).agg((F.max if last else F.min)(by).alias("_by")).select("_by")
        return d.join(best, F.col(by) == F.col("_by"), "left_semi")
    first = F.col(by).desc() if last else F.col(by).asc()
    # a rank of one is cut off in each partition before the shuffle
    return d.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(first))).where("_rank = 1").drop("_rank")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df``, which has a ``_chunk`` that rises with ``order``, with ``name``: the sum of ``value`` over the key's rows so far.

    NULL values add nothing; a key starts at 0. Rows with equal ``order`` all count for each of them. Sums run within a
    chunk and go on from the sums of the chunks before.
    """
    v = F.coalesce(F.col(value), F.lit(0))
    past = chunk_line(keys).rowsBetween(Window.unboundedPreceding, -1)
    c = df.groupBy(*keys, CHUNK).agg(F.sum(v).alias("_sum")).select(*keys, CHUNK, F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, CHUNK).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return attach(df, c, keys).withColumn(name, F.col("_base") + F.sum(v).over(within)).drop("_base")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order`` over the whole table, numbered chunk by chunk, never in one task."""
    d = ordered_chunks(df, [], order, "numbered")
    c = d.groupBy(CHUNK).agg(F.count("*").alias("_n"))
    past = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    c = c.select(CHUNK, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    return attach(d, c, []).withColumn(name, F.col("_base") + within - 1).drop("_base", CHUNK)
