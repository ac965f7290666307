"""Resampling inference: stationary bootstrap, block length, power, permutation null, markouts, sensitivity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import CHUNK, numbered, running_sums, time_chunks
from tidemark.operators.series import quantiles
from tidemark.session import written
from tidemark.sources.tables import usable

#: Running sums of so many points at most are sent to the draws; of more, both are sorted.
SENT_POINTS = 500_000


def uniform(seed: int, rep: int, number: np.ndarray, which: int) -> np.ndarray:
    """Numbers in [0, 1): the published 64-bit mixing function of a counter made of repetition, number and draw, for each seed another."""
    mask = (1 << 64) - 1
    start = (seed * 0xD1342543DE82EF95 + (rep << 33) + which) & mask
    with np.errstate(over="ignore"):
        z = (np.uint64(start) + np.uint64(2) * number.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def resample_blocks(spark: SparkSession, reps: int, size: int, length: int, mean_block: float, seed: int) -> DataFrame:
    """(rep, at, start, n): the blocks of stationary bootstrap resamples of ``length`` points of a series of ``size``.

    Blocks have geometric lengths and random starts and run round the end; a resample's blocks follow one another from
    ``at`` = 0. The draws are hashes of seed, repetition and number of the block, so a task that runs again draws the same.
    """
    leave = np.log1p(-min(1.0 / max(mean_block, 1.0), 1 - 1e-16))

    def one(rep: int) -> Iterator[tuple[np.ndarray, ...]]:
        at = k = 0
        while at < length:
            number = np.arange(k, k + max(16, min(100_000, int((length - at) / max(mean_block, 1.0)))))
            n = np.floor(np.log1p(-uniform(seed, rep, number, 0)) / leave).astype(np.int64) + 1
            end = at + np.cumsum(n)
            keep = int(np.searchsorted(end, length)) + 1
            begin, end, number = (end - n)[:keep], np.minimum(end[:keep], length), number[:keep]
            yield np.full(len(begin), rep), begin, (uniform(seed, rep, number, 1) * size).astype(np.int64), end - begin
            at, k = int(end[-1]), k + len(number)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = lambda parts: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["rep", "at", "start", "n"])
        parts, rows = [], 0
        for b in batches:
            for rep in b.column(0).to_pylist():
                for part in one(rep):
                    parts.append(part)
                    rows += len(part[0])
                    if rows > 50_000:
                        yield send(parts)
                        parts, rows = [], 0
        if parts:
            yield send(parts)

    return spark.range(reps if size else 0).mapInArrow(draw, "rep bigint, at bigint, start bigint, n bigint")


def _upto(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, s): the sum of ``v`` up to position ``i`` of a ``series`` (keys, i, v), written."""
    return written(running_sums(time_chunks(series, "i", 100_000), keys, ["i"], "v", "s").select(*keys, "i", "s"), "upto")


def _block_sums(blocks: DataFrame, upto: DataFrame, points: int, size: int, keys: Sequence[str]) -> DataFrame:
    """(keys, rep, total): a block's sum is a difference of sums up to its ends, and those of all points for each time it runs round.

    Spark takes the draws for as few rows as there are repetitions and would send them through the driver, so which
    side is sent goes by the ``points`` of ``upto``, never by Spark's guess.
    """
    last = F.col("start") + F.col("n")
    end = lambda i, w: F.struct(i.cast("bigint").alias("i"), w.cast("bigint").alias("w"))
    ends = F.array(end(F.lit(size - 1), F.floor(last / size)), end(F.pmod(last, F.lit(size)) - 1, F.lit(1)), end(F.col("start") - 1, F.lit(-1)))
    e = blocks.select(*keys, "rep", F.explode(ends).alias("e")).select(*keys, "rep", "e.i", "e.w").where("i >= 0 and w != 0")
    upto = upto.hint("broadcast" if points <= SENT_POINTS else "merge")
    return e.join(upto, [*keys, "i"]).groupBy(*keys, "rep").agg(F.sum(F.col("w") * F.col("s")).alias("total"))


def _numbered_series(df: DataFrame, order: str, value: str) -> tuple[DataFrame, int]:
    """(i, v) of the finite values in order, written, and their number."""
    v = F.col(value).cast("double")
    s = numbered(df.select(order, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))), [order], "i")
    s = written(s.select("i", "v"), "series")
    return s, s.count()


def bootstrap_sums(df: DataFrame, order: str, value: str, reps: int = 2000, mean_block: float = 100.0, seed: int = 11) -> DataFrame:
    """(rep, total): sums of stationary bootstrap resamples, each as long as the series, whose values stay where they are.

    Only block ends are drawn and joined with the running sums of the series, so the work grows with the blocks. NULL, NaN
    and infinite values are no points; a series without points gives no rows.
    """
    s, size = _numbered_series(df, order, value)
    blocks = resample_blocks(df.sparkSession, reps, size, size, mean_block, seed)
    return _block_sums(blocks, _upto(s, []), size, max(size, 1), [])


def interval(draws: DataFrame, value: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, n, low, high): the two-sided interval that holds ``level`` of the values."""
    a = (1 - level) / 2
    return quantiles(draws, by, value, {"low": a, "high": 1 - a})


def _deviations(df: DataFrame, order: str, value: str) -> DataFrame:
    """(i, d, n): positions, deviations from the mean and the number of points."""
    s = numbered(df.where(F.col(value).isNotNull()).select(order, F.col(value).cast("double").alias("v")), [order], "i").select("i", "v")
    mean = s.agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(mean)).select("i", (F.col("v") - F.col("m")).alias("d"), "n")


def _correlations(s: DataFrame, max_lag: int) -> DataFrame:
    a = s.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("j", F.col("i") + F.col("lag"))
    p = a.join(s.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    g = p.groupBy("lag").agg((F.sum(F.col("d") * F.col("e")) / F.count("*")).alias("c"))
    zero = g.where("lag = 0").select(F.col("c").alias("c0"))
    return g.crossJoin(F.broadcast(zero)).select("lag", (F.col("c") / F.nullif("c0", F.lit(0.0))).alias("rho"))


def autocorrelation(df: DataFrame, order: str, value: str, max_lag: int) -> DataFrame:
    """(lag, rho) of an aggregated series, with unbiased denominators, by self-joins on the position less the lag."""
    return _correlations(_deviations(df, order, value), max_lag)


def mean_block_length(df: DataFrame, order: str, value: str, max_lag: int, least: int = 1, most: int = 1000) -> DataFrame:
    """(tau, blocks): 1 + 2 times the autocorrelations summed over the initial pairs with positive sums, and its ceiling in bounds.

    ``max_lag`` is where the search starts: while all pairs are positive it is doubled, up to the last lag of the series
    or ten times ``most``; there a single lag without partner counts as a pair does.
    """
    d = written(_deviations(df, order, value), "deviations")
    end = min((d.agg(F.max("n")).first()[0] or 1) - 1, 10 * most)
    lag = min(max(max_lag + max_lag % 2, 2), end)
    while True:
        r = _correlations(d, lag).where("lag > 0")
        pairs = r.groupBy(((F.col("lag") - 1) / 2).cast("int").alias("pair")).agg(F.sum("rho").alias("s"))
        pairs = pairs.withColumn("positive", usable("s") & (F.col("s") > 0))
        if lag >= end or pairs.where("not positive").limit(1).count():
            break
        lag = min(lag * 2, end)
    good = F.min(F.col("positive").cast("int")).over(Window.orderBy("pair"))
    total = pairs.withColumn("good", good).where("good = 1").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    tau = F.greatest(F.lit(1.0), 1 + 2 * F.col("s"))
    return total.select(tau.alias("tau"), F.least(F.greatest(F.ceil(tau), F.lit(least)), F.lit(most)).cast("int").alias("blocks"))


def power(
    df: DataFrame, order: str, value: str, n: int, effects: Sequence[float], outer: int = 500, inner: int = 500, mean_block: float = 10.0,
    hurdle: float = 0.0, level: float = 0.95, seed: int = 17,
) -> DataFrame:
    """(effect, reps, power): the share of ``outer`` resamples of ``n`` points, mean removed and effect added, that pass.

    A resample passes if the lower end of the interval of its mean, from ``inner`` resamples of it, lies above
    ``hurdle``. An effect shifts all means alike, so both levels are drawn once for all effects. The outer resamples are
    rows (rep, position, value), the inner ones blocks of these, all in tasks; a series without points gives no rows.
    """
    s, size = _numbered_series(df, order, value)
    mean = s.agg(F.avg("v").alias("mean"))
    base = s.crossJoin(F.broadcast(mean)).select("i", (F.col("v") - F.col("mean")).alias("v"))
    blocks = resample_blocks(df.sparkSession, outer, size, n, mean_block, seed)
    points = blocks.select(F.col("rep").alias("outer"), "at", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    points = points.select("outer", (F.col("at") + F.col("k")).alias("t"), F.pmod(F.col("start") + F.col("k"), F.lit(max(size, 1))).alias("i"))
    points = written(points.join(base, "i").select("outer", F.col("t").alias("i"), "v"), "outer")
    again = resample_blocks(df.sparkSession, outer * inner, n if size else 0, n, mean_block, seed + 1)
    again = again.withColumn("outer", F.floor(F.col("rep") / inner))
    sums = _block_sums(again, _upto(points, ["outer"]), outer * n, n, ["outer"])
    low = sums.groupBy("outer").agg(F.percentile(F.col("total") / n, F.lit((1 - level) / 2)).alias("low"))  # of ``inner`` values
    each = low.select("low", F.explode(F.array(*[F.lit(float(e)) for e in effects])).alias("effect"))
    passes = (F.col("low") + F.col("effect") > hurdle).cast("double")
    return each.groupBy("effect").agg(F.count("*").alias("reps"), F.avg(passes).alias("power"))


def shuffled_sign_null(
    df: DataFrame, sign: str, value: str, reps: int = 1000, seed: int = 7, rows_per_block: int = 100_000, by: str | None = None
) -> DataFrame:
    """(rep, mean), with ``by`` (group, rep, mean): the mean of sign times value when the signs are permuted over all rows.

    Equal values are counted first. How many positive signs each block of values gets in a repetition is drawn exactly
    (hypergeometric, block after block), then how many each value of the block gets: together a uniform permutation of
    the signs of the group's rows, in one pass and without a large group. Rows without value take part in the
    permutation but not in the mean; rows with other signs don't count. The draws, one row per block, meet their
    block's values by a cogroup. They take up to 10^9 rows a group; more are refused. Groups are few: horizons.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    v = F.col(value).cast("double")
    d = df.where(F.col(sign).isin(1, -1)).select(group.alias("grp"), F.when(~F.isnan(v), v).alias("v"), F.col(sign).alias("s"))
    d = d.groupBy("grp", "v").agg(F.count("*").alias("n"), F.sum((F.col("s") > 0).cast("bigint")).alias("up"))
    d = written(d, "values")
    whole = {r["grp"]: r for r in d.groupBy("grp").agg(F.count("v").alias("k"), F.sum("n").alias("n"), F.sum("up").alias("up")).collect()}
    if any(r["n"] >= 1_000_000_000 for r in whole.values()):
        raise ValueError("more than 10^9 rows: aggregate the values first")
    blocks = max([8, *[-(-r["k"] // rows_per_block) for r in whole.values()]])
    # block 0 is that of the rows without value
    d = d.withColumn("block", F.when(F.col("v").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(blocks)) + 1).cast("int"))
    rng, drawn = np.random.default_rng(seed), []
    left = {g: r["n"] for g, r in whole.items()}
    good = {g: np.full(reps, r["up"], np.int64) for g, r in whole.items()}
    for r in sorted(d.groupBy("grp", "block").agg(F.sum("n").alias("n")).collect()):
        ups = rng.hypergeometric(good[r["grp"]], left[r["grp"]] - good[r["grp"]], r["n"])
        good[r["grp"]], left[r["grp"]] = good[r["grp"]] - ups, left[r["grp"]] - r["n"]
        if r["block"]:
            drawn.append((r["grp"], r["block"], ups.tolist()))
    draws = df.sparkSession.createDataFrame(drawn, "grp string, block int, ups array<bigint>")

    def run(key: tuple, rows: pd.DataFrame, ups: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")
        v, n = rows["v"].to_numpy(), rows["n"].to_numpy(np.int64)
        start = np.random.default_rng([seed, key[1], zlib.crc32(key[0].encode())])
        out = np.array([2 * float(v @ start.multivariate_hypergeometric(n, up, method="marginals")) for up in ups["ups"].iloc[0]]) - float(v @ n)
        return pd.DataFrame({"grp": key[0], "rep": np.arange(reps), "part": out, "n": n.sum()})

    values = d.where("v is not null").select("grp", "block", "v", "n")
    # few bytes but much work: as many tasks as cores, which adaptive execution leaves apart
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values, draws = (x.repartition(tasks, "grp", "block") for x in (values, draws))
    parts = values.groupBy("grp", "block").cogroup(draws.groupBy("grp", "block")).applyInPandas(run, "grp string, rep bigint, part double, n bigint")
    mean = (F.sum("part") / F.sum("n")).alias("mean")
    if by is None:
        return parts.groupBy("rep").agg(mean)
    return parts.groupBy(F.col("grp").cast(df.schema[by].dataType).alias(by), "rep").agg(mean)


def null_summary(null: DataFrame, by: str, value: str = "mean", tail: float = 0.025) -> DataFrame:
    """(``by``, null_mean, null_low, null_high): mean and two-sided quantiles of the repetitions of each group."""
    q = lambda p: F.percentile(value, F.lit(p))  # noqa: E731  over as many rows as repetitions
    return null.groupBy(by).agg(F.avg(value).alias("null_mean"), q(tail).alias("null_low"), q(1 - tail).alias("null_high"))


def swap_markouts(
    swaps: DataFrame, reference: DataFrame, key: str, row_id: str, us: str, ref_us: str, ref_id: str, mid: str, at_mid: str, amount0: str, amount1: str,
    horizons: Sequence[int], tolerance_us: int,
) -> DataFrame:
    """(row_id, horizon_seconds, direction, exec_price, edge_bps, future_mid, info_bps, exec_bps) of swaps with a price ``at_mid``.

    ``direction`` is 1 where the trader takes the first token out of the pool (``amount0`` below 0), else -1; the
    price paid is the ratio of both amounts; the edge is how much better it is than ``at_mid``. Both markouts are the signed moves to
    the first reading at or after the horizon, from ``at_mid`` and from the price paid. Amounts that are NULL, NaN or 0
    give no price paid; swaps without ``amount0`` have no direction and NULL throughout.
    """
    a0, a1 = (F.when(usable(c), F.col(c)) for c in (amount0, amount1))
    paid = F.nullif(F.abs(F.try_divide(a1, a0)), F.lit(0.0))
    s = swaps.where(F.col(at_mid).isNotNull()).select(
        row_id, key, us, F.col(at_mid).alias("_mid"), F.when(a0 < 0, 1).when(a0 >= 0, -1).alias("direction"), paid.alias("exec_price"),
        F.explode(F.array(*[F.lit(int(x)) for x in horizons])).alias("horizon_seconds"),
    )
    s = s.withColumn("_due", F.col(us) + F.col("horizon_seconds").cast("bigint") * 1_000_000)
    j = asof_join(s, reference, [key], "_due", ref_us, ref_id, [mid], tolerance_us, "forward", prefix="_future_")
    f, d = F.col(f"_future_{mid}"), F.col("direction")
    bps = lambda now, base: d * (now / F.nullif(base, F.lit(0.0)) - 1) * 1e4
    edge = d * (F.col("_mid") / F.col("exec_price") - 1) * 1e4
    return j.select(
        row_id, "horizon_seconds", "direction", "exec_price", edge.alias("edge_bps"), f.alias("future_mid"),
        bps(f, F.col("_mid")).alias("info_bps"), bps(f, F.col("exec_price")).alias("exec_bps"),
    )


def markouts(aligned: DataFrame, reference: DataFrame, key: str, row_id: str, us: str, ref_us: str, ref_id: str, mid: str, at_mid: str, sign: str, horizons: Sequence[int], tolerance_us: int) -> DataFrame:
    """(row_id, horizon_seconds, future_mid, markout_bps): the signed move to the first reading at or after each horizon.

    All horizons go through one as-of join: a row enters once per horizon.
    """
    h = aligned.select(row_id, key, us, at_mid, sign, F.explode(F.array(*[F.lit(int(x)) for x in horizons])).alias("horizon_seconds"))
    h = h.withColumn("due_us", F.col(us) + F.col("horizon_seconds").cast("bigint") * 1_000_000)
    j = asof_join(h, reference, [key], "due_us", ref_us, ref_id, [mid], tolerance_us, "forward", prefix="future_")
    f = F.col(f"future_{mid}")
    move = F.col(sign) * (f / F.nullif(F.col(at_mid), F.lit(0.0)) - 1) * 1e4
    return j.select(row_id, "horizon_seconds", f.alias("future_mid"), move.alias("markout_bps"))


def shift_sensitivity(left: DataFrame, reference: DataFrame, key: str, us: str, ref_us: str, ref_id: str, mid: str, shifts_us: Sequence[int], tolerance_us: int) -> DataFrame:
    """(shift_us, n, matched, median_age_us, mean_age_us, mean_mid): how the match changes when reference times are shifted.

    One join for all shifts. Ages are whole microseconds within the tolerance, so their exact median counts no more
    different values than the tolerance has.
    """
    s = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in shifts_us]))
    l = left.select(key, us).withColumn("shift_us", s)
    r = reference.select(key, ref_us, ref_id, mid).withColumn("shift_us", s).withColumn("_at", F.col(ref_us) + F.col("shift_us"))
    j = asof_join(l, r, [key, "shift_us"], us, "_at", ref_id, [mid], tolerance_us)
    return j.groupBy("shift_us").agg(
        F.count("*").alias("n"), F.count(f"ref_{mid}").alias("matched"), F.percentile(F.col(us) - F.col("ref_us"), F.lit(0.5)).alias("median_age_us"),
        F.avg(F.col(us) - F.col("ref_us")).alias("mean_age_us"), F.avg(f"ref_{mid}").alias("mean_mid"),
    )
