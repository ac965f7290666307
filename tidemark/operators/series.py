"""Resampling, gaps, variances and rates of time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import CHUNK, running_sums
from tidemark.session import written
from tidemark.sources.tables import usable

DAY_US = 86_400_000_000


def day_of(us: str) -> Column:
    return ((F.col(us) - F.pmod(F.col(us), F.lit(DAY_US))) / F.lit(DAY_US)).cast("bigint")


def last_per_period(df: DataFrame, keys: Sequence[str], us: str, value: str, tie: str, period_us: int) -> DataFrame:
    """The last usable value of each period: (keys, slot_us, value); at one time that with the largest ``tie``."""
    slot = F.col(us) - F.pmod(F.col(us), F.lit(period_us))
    return (
        df.where(usable(value) & F.col(us).isNotNull())
        .groupBy(*keys, slot.alias("slot_us"))
        .agg(F.max_by(value, F.struct(us, tie)).alias("value"))
    )


def daily_sums(df: DataFrame, keys: Sequence[str], us: str, value: str, fill: bool = False) -> DataFrame:
    """(keys, day, total): sums per UTC day (days since 1970) that has rows, or with ``fill`` of all days in between, 0 where empty."""
    d = df.where(F.col(us).isNotNull()).groupBy(*keys, day_of(us).alias("day")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    if not fill:
        return d
    nxt = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    d = d.withColumn("until", F.coalesce(nxt - 1, F.col("day")))
    d = d.withColumn("each", F.explode(F.sequence("day", "until")))
    return d.select(*keys, F.col("each").alias("day"), F.when(F.col("each") == F.col("day"), F.col("total")).otherwise(0.0).alias("total"))


def realised_variance(df: DataFrame, keys: Sequence[str], us: str, value: str, tie: str, period_us: int = 300_000_000, least: int = 2) -> DataFrame:
    """(keys, day, variance, n): yearly variance from squared log returns between the last values of successive periods.

    Returns run across midnight and over empty periods and count for the day of their later period; days with fewer
    than ``least`` returns are left out. Values that aren't positive are no prices.
    """
    p = last_per_period(df.where(F.col(value) > 0), keys, us, value, tie, period_us)
    step = F.log("value") - F.log(F.lag("value").over(Window.partitionBy(*keys).orderBy("slot_us")))
    r = p.withColumn("r", step).where("r is not null")
    return (
        r.groupBy(*keys, day_of("slot_us").alias("day"))
        .agg((F.sum(F.col("r") * F.col("r")) * 365.0).alias("variance"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, n, one column per quantile): exact quantiles of the usable values, linear between neighbours.

    Equal values are counted first; their ranks are running sums within chunks of values, a hundredth of the value
    wide, bridged by the chunks' sums, so no key's values go through one task. A key without usable values has no row.
    """
    keys, v = list(keys), F.col(value).cast("double")
    g = df.where(F.col(value).isNotNull() & ~F.isnan(v)).groupBy(*keys, (v + 0.0).alias("_v")).agg(F.count("*").alias("_n"))
    # rises with the value; values beyond 2^-1000 count as 0 here, and share a chunk
    size = F.greatest(F.log2(F.abs("_v")) + 1000, F.lit(0.0)) * 64
    g = g.withColumn(CHUNK, F.when(F.col("_v") == 0, 0).otherwise(F.floor(F.signum("_v") * F.coalesce(size, F.lit(0.0)))).cast("bigint"))
    g = running_sums(written(g, "counted"), keys, ["_v"], "_n", "_upto")
    total = g.groupBy(*keys).agg(F.max("_upto").alias("n"))
    j = attach_all(g, total, keys)
    picks, outs = [], []
    for name, q in wanted.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
        part = F.pmod(at, F.lit(1.0))
        outs.append((F.col(f"_{name}_lo") * (1 - part) + F.col(f"_{name}_hi") * part).alias(name))
    return j.groupBy(*keys, "n").agg(*picks).select(*keys, "n", *outs)


def attach_all(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``per_key``, one row per key (NULL too); without keys its only row is attached to all."""
    if not keys:
        return df.crossJoin(F.broadcast(per_key))  # one row by construction
    small = per_key.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)], *[c for c in per_key.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return df.join(small, same).drop(*[f"_on{i}" for i in range(len(keys))])


def tail_days(reference: DataFrame, candidate: DataFrame, value: str, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of ``reference`` (exact, linearly interpolated) and how many days of ``candidate`` lie beyond them: a row per ``by``."""
    q = reference.agg(
        F.count(value).alias("n_reference"),
        F.percentile(value, F.lit(low)).alias("low"),
        F.percentile(value, F.lit(high)).alias("high"),
    )
    j = candidate.crossJoin(F.broadcast(q))  # one row by construction
    inside = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return j.groupBy(*by).agg(
        F.max("n_reference").alias("n_reference"), F.count(value).alias("n_candidate"), F.max("low").alias("low"), F.max("high").alias("high"),
        inside(F.col(value) <= F.col("low")).alias("n_low"), inside(F.col(value) >= F.col("high")).alias("n_high"),
    )


def largest_gaps(df: DataFrame, keys: Sequence[str], us: str, chunk_us: int = 3_600_000_000) -> DataFrame:
    """(keys, n, first_us, last_us, max_gap_us): the longest time between successive rows of a series; 0 for a single row.

    Gaps within chunks of time and gaps between the chunks' ends are taken apart, so a series is never in one task.
    """
    chunk = F.col(us) - F.pmod(F.col(us), F.lit(chunk_us))
    d = df.where(F.col(us).isNotNull()).select(*keys, F.col(us).alias("t"), chunk.alias("chunk"))
    d = d.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*keys, "chunk").orderBy("t")))
    c = d.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z"), F.max("gap").alias("gap"))
    c = c.withColumn("gap", F.greatest("gap", F.col("a") - F.lag("z").over(Window.partitionBy(*keys).orderBy("chunk"))))
    return c.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("a").alias("first_us"), F.max("z").alias("last_us"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_us")
    )


def gaps_in_window(df: DataFrame, keys: Sequence[str], us: str, start_us: int | Column, end_us: int | Column, chunk_us: int = 3_600_000_000) -> DataFrame:
    """(keys, n, max_gap_us) within the closed window [start, end]: the longest time without a row, to both ends of the window too.

    The ends are numbers, or columns of ``df`` that are constant per key. A key without rows in the window has the
    whole window as gap; one without any row has no row here.
    """
    ends = [(F.lit(x) if isinstance(x, int) else x).cast("bigint") for x in (start_us, end_us)]
    d = df.withColumns({"_from": ends[0], "_to": ends[1]})
    seen = d.groupBy(*keys).agg(F.max("_from").alias("_from"), F.max("_to").alias("_to"))
    g = largest_gaps(d.where((F.col(us) >= F.col("_from")) & (F.col(us) <= F.col("_to"))), keys, us, chunk_us)
    g = g.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("n").alias("_n"), "first_us", "last_us", "max_gap_us")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    j = seen.join(g, same, "left")
    gap = F.coalesce(F.greatest("max_gap_us", F.col("first_us") - F.col("_from"), F.col("_to") - F.col("last_us")), F.col("_to") - F.col("_from"))
    return j.select(*keys, F.coalesce("_n", F.lit(0)).alias("n"), gap.alias("max_gap_us"))


def yield_over(rates: DataFrame, keys: Sequence[str], us: str, rate: str, start_us: int | Column, end_us: int | Column) -> DataFrame:
    """(keys, total, covered): return of a piecewise constant yearly rate over [start, end], compounded.

    The rate at the start is the last one at or before it; without such a row ``covered`` is false and the time before
    the first row earns nothing. ``rates`` is the series of rate changes, not a tape; of changes at one time the largest counts.
    The ends are numbers, or columns of ``rates`` that are constant per key.
    """
    year = 365 * 86400 * 1e6
    ends = [(F.lit(x) if isinstance(x, int) else x).cast("bigint") for x in (start_us, end_us)]
    r = rates.where(F.col(us).isNotNull() & usable(rate)).withColumns({"_start": ends[0], "_end": ends[1]}).where(F.col(us) < F.col("_end"))
    r = r.groupBy(*keys, F.greatest(F.col(us), F.col("_start")).alias("from_us")).agg(
        F.max(F.struct(F.col(us).alias("u"), F.col(rate).alias("r"))).alias("x"), F.min(us).alias("seen"), F.max("_start").alias("_start"), F.max("_end").alias("_end")
    )
    to = F.coalesce(F.lead("from_us").over(Window.partitionBy(*keys).orderBy("from_us")), F.col("_end"))
    r = r.withColumn("g", F.log1p("x.r") * ((to - F.col("from_us")) / year))
    return r.groupBy(*keys).agg(F.expm1(F.sum("g")).alias("total"), (F.min("seen") <= F.max("_start")).alias("covered"))


def time_weighted_mean(df: DataFrame, keys: Sequence[str], us: str, value: str, tie: str, chunk_us: int = 3_600_000_000) -> DataFrame:
    """(keys, mean, seconds): mean of the usable values, each weighed by the time to the next; the last one weighs nothing.

    At one time the value with the largest ``tie`` counts. A series without any such time has the plain mean of its
    values. Sums within chunks of time are bridged by the chunks' ends, so a series is never in one task.
    """
    d = df.where(usable(value) & F.col(us).isNotNull()).groupBy(*keys, F.col(us).alias("t")).agg(F.max_by(value, tie).alias("v"))
    d = d.withColumn("chunk", F.col("t") - F.pmod(F.col("t"), F.lit(chunk_us)))
    d = d.withColumn("gap", F.lead("t").over(Window.partitionBy(*keys, "chunk").orderBy("t")) - F.col("t"))
    c = d.groupBy(*keys, "chunk").agg(
        F.sum(F.col("v") * F.col("gap")).alias("s"), F.sum("gap").alias("g"), F.min("t").alias("a"), F.max(F.struct("t", "v")).alias("z"),
        F.sum("v").alias("all"), F.count("*").alias("n"),
    )
    over = F.lead("a").over(Window.partitionBy(*keys).orderBy("chunk")) - F.col("z.t")
    c = c.withColumn("over", F.coalesce(over, F.lit(0)))
    t = c.groupBy(*keys).agg(
        F.sum(F.coalesce("s", F.lit(0.0)) + F.col("z.v") * F.col("over")).alias("s"), F.sum(F.coalesce("g", F.lit(0)) + F.col("over")).alias("g"),
        (F.sum("all") / F.sum("n")).alias("plain"),
    )
    return t.select(*keys, F.when(F.col("g") > 0, F.col("s") / F.nullif("g", F.lit(0))).otherwise(F.col("plain")).alias("mean"), (F.col("g") / 1e6).alias("seconds"))


def ratio_of_mean(daily: DataFrame, keys: Sequence[str], value: str, periods: float = 365.0) -> DataFrame:
    """(keys, n, ratio): yearly mean over standard deviation of zero-filled periods; NULL for fewer than two or without spread."""
    sd = F.stddev_samp(value)
    return daily.groupBy(*keys).agg(F.count(value).alias("n"), F.when(sd > 0, F.avg(value) / sd * (periods**0.5)).alias("ratio"))
