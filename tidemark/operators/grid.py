"""Irregular readings onto a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written
from tidemark.sources.tables import micros, usable


def regular_grid(
    readings: DataFrame,
    keys: Sequence[str],
    timestamp: str = "timestamp",
    value: str = "mid",
    period_seconds: int = 300,
    max_interpolated_seconds: float = 900.0,
    start_epoch: int | None = None,
    end_epoch: int | None = None,
    chunk_periods: int = 4096,
) -> DataFrame:
    """One row per series and period from the period of the first reading to that of the last.

    Columns: ``keys``, ``slot_epoch`` (start of the period), ``status``, ``n_readings``, ``value``. ``status`` is
    ``observed`` (``value``: the last reading of the period), ``interpolated`` (linear at the period's start between
    the readings around the gap, when these are at most ``max_interpolated_seconds`` apart), ``missing`` (longer
    gaps), and with explicit boundaries ``leading`` or ``trailing`` (periods before the first or after the last
    reading, from ``start_epoch``'s period to ``end_epoch``'s). Boundaries only extend, they never cut a series.

    Rows whose timestamp is NULL or whose value is NULL or NaN are no readings. NULL keys form series of their own.
    Of readings at the same instant the largest value counts. An empty table gives an empty result; other columns
    don't matter.

    Readings are first aggregated per period (partial aggregation before the shuffle), so a series that holds most
    rows shrinks to its periods, which are written; ``lead`` then runs within chunks of ``chunk_periods`` periods, and the heads of the
    following chunks bridge the borders, so no series has to fit into one task.
    """
    keys, p = list(keys), int(period_seconds)
    us = micros(timestamp)
    r = readings.where(usable(value) & F.col(timestamp).isNotNull()).select(
        *keys, us.alias("_us"), F.col(value).cast("double").alias("_v")
    )
    us_in = F.lit(p * 1_000_000)
    slot = ((F.col("_us") - F.pmod(F.col("_us"), us_in)) / us_in).cast("bigint") * p
    per = (
        r.groupBy(*keys, slot.alias("slot"))
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("_us", "_v")).alias("first"),
            F.max(F.struct("_us", "_v")).alias("last"),
        )
        .withColumn("chunk", F.floor(F.col("slot") / F.lit(p * chunk_periods)).cast("bigint"))
    )
    per = written(per, "periods")  # read twice below, and far fewer than the readings
    head = F.struct(F.col("slot"), F.col("first._us").alias("us"), F.col("first._v").alias("v"))
    heads = per.groupBy(*keys, "chunk").agg(F.min(head).alias("head"))
    after = heads.select(
        *keys,
        F.col("chunk").alias("chunk"),
        F.lead("head").over(Window.partitionBy(*keys).orderBy("chunk")).alias("after"),
        (F.row_number().over(Window.partitionBy(*keys).orderBy("chunk")) == 1).alias("first_chunk"),
    )
    within = Window.partitionBy(*keys, "chunk").orderBy("slot")
    per = per.withColumn("next", F.lead(head).over(within)).withColumn("rn", F.row_number().over(within))
    a, b = per.alias("a"), after.alias("b")
    cond = F.col("a.chunk") == F.col("b.chunk")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = a.join(b, cond, "left").select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        "slot",
        "n",
        "last",
        F.coalesce("next", "after").alias("next"),
        ((F.col("rn") == 1) & F.col("first_chunk")).alias("is_first"),
    )
    lo, hi = F.col("slot"), F.coalesce(F.col("next.slot") - p, F.col("slot"))
    if start_epoch is not None:
        lo = F.when(F.col("is_first"), F.least(F.lit(start_epoch // p * p).cast("bigint"), lo)).otherwise(lo)
    if end_epoch is not None:
        hi = F.when(F.col("next").isNull(), F.greatest(F.lit(end_epoch // p * p).cast("bigint"), hi)).otherwise(hi)
    j = j.withColumn("slot_epoch", F.explode(F.sequence(lo, hi, F.lit(p).cast("bigint"))))
    gap = F.col("next.us") - F.col("last._us")
    t = F.col("slot_epoch") * 1_000_000
    status = (
        F.when(F.col("slot_epoch") == F.col("slot"), "observed")
        .when(F.col("slot_epoch") < F.col("slot"), "leading")
        .when(F.col("next").isNull(), "trailing")
        .when(gap <= int(max_interpolated_seconds * 1_000_000), "interpolated")
        .otherwise("missing")
    )
    v0, v1 = F.col("last._v"), F.col("next.v")
    line = v0 + (v1 - v0) * ((t - F.col("last._us")) / gap)
    return (
        j.withColumn("status", status)
        .select(
            *keys,
            "slot_epoch",
            "status",
            F.when(F.col("status") == "observed", F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n_readings"),
            F.when(F.col("status") == "observed", v0).when(F.col("status") == "interpolated", line).alias("value"),
        )
    )
