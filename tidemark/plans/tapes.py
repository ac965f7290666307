"""Queries over event tapes: alignment, ordered state, lots, resampling, position arithmetic and inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import amm
from tidemark.operators import asof, fold, inference, lots, ordered, series
from tidemark.operators.dedup import hash_number
from tidemark.operators.pointintime import as_known
from tidemark.session import scratch_path, written
from tidemark.sources.archives import epoch_time, normalise_reference, read_gzip_csv, read_parts, write_table
from tidemark.sources.tables import micros, table, usable

PRIMARY, FALLBACK, METRIC, OTHER_METRIC = "kestrel_spot_trade", "oriole_spot_trade", "oriole_5m_close", "kestrel_5m_close"
TOLERANCE = 3_000_000
AGES = (250_000, 500_000, 1_000_000, 2_000_000, 3_000_000)
HORIZONS = (30, 60, 300)
SHIFTS = (-10_000_000, -5_000_000, -2_000_000, 0, 2_000_000, 5_000_000, 10_000_000)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "swap_targets").select("target_id", "symbol", "swap_count", micros("target_timestamp").alias("us"))


def _trades(spark: SparkSession, d: str, source: str | None = None) -> DataFrame:
    r = table(spark, d, "reference").where(F.coalesce("alignment_eligible", F.lit(True)) & usable("mid"))
    r = r.where(F.col("source") == source) if source else r
    return r.select("symbol", "ref_id", "mid", micros("timestamp").alias("at"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where(F.coalesce("regime_eligible", F.lit(True)) & usable("mid"))
    return r.select("source", "symbol", "ref_id", "mid", micros("timestamp").alias("at"))


MESSAGE = ("block_number", "log_index")


def _tape(spark: SparkSession, d: str, *columns: str, last: bool = False) -> DataFrame:
    """``columns`` of the pool messages, the first (or last) delivery of each."""
    wanted = dict.fromkeys(["delivery_id", *MESSAGE, "event", *columns])
    return ordered.keep_one(table(spark, d, "pool_events").select(*wanted), MESSAGE, "delivery_id", last, unique=True)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, start_us, end_us) between successive target times of a symbol."""
    t = ordered.time_chunks(_targets(spark, d).select("symbol", "us").where("us is not null").distinct(), "us", 3_600_000_000)
    t = ordered.with_previous(t, ["symbol"], ["us"], ["us"])
    t = t.where("_prev is not null").select("symbol", F.col("_prev.us").alias("start_us"), F.col("us").alias("end_us"))
    return written(t, "steps")


def _aligned(spark: SparkSession, d: str, source: str | None = None) -> DataFrame:
    return asof.asof_join(_targets(spark, d), _trades(spark, d, source), ["symbol"], "us", "at", "ref_id", ["ref_id", "mid"], TOLERANCE)


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select("target_id", F.col("ref_ref_id").alias("ref_id"), (F.col("us") - F.col("ref_us")).alias("age_us"))


def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last reading of each metric source at or before each target."""
    t = _targets(spark, d).withColumn("source", F.explode(F.array(F.lit(METRIC), F.lit(OTHER_METRIC))))
    series_of = lambda x: x.withColumn("series", F.struct("source", "symbol"))
    k = asof.latest_before(series_of(t), series_of(_metrics(spark, d)), "series", "us", "at", ["ref_id"])
    return k.select("target_id", "source", "ref_ref_id")


def markouts(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d).where("ref_mid is not null").withColumn("sign", F.when(F.col("target_id") % 4 == 1, 1).otherwise(-1))
    m = inference.markouts(a, _trades(spark, d), "symbol", "target_id", "us", "at", "ref_id", "mid", "ref_mid", "sign", HORIZONS, TOLERANCE)
    return m.select("target_id", "horizon_seconds", "future_mid", (F.round("markout_bps", 6) + 0.0).alias("markout_bps"))


def priority_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _fallback(spark, d).select("target_id", "ref_mid", F.when(F.col("chosen") == PRIMARY, "primary").when(F.col("chosen") == FALLBACK, "fallback").alias("chosen"))


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where(F.coalesce("alignment_eligible", F.lit(True)) & usable("mid"))
    r = r.select("symbol", "source", "ref_id", "mid", micros("timestamp").alias("at"))
    return asof.prefer_source(_targets(spark, d), r, ["symbol"], "target_id", "us", "at", "ref_id", ["mid"], "source", (PRIMARY, FALLBACK), TOLERANCE)


def coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d).withColumn("age", F.col("us") - F.col("ref_us"))
    return asof.coverage_by_age(a, "age", "swap_count", AGES, 0.6).withColumn("coverage", F.round("coverage", 9))


def venue_overlap(spark: SparkSession, d: str) -> DataFrame:
    mid = lambda s: F.try_element_at("by_source", F.lit(s)).getField("ref_mid")
    bps = F.abs(mid(PRIMARY) / F.nullif(mid(FALLBACK), F.lit(0.0)) - 1) * 1e4
    q = series.quantiles(_fallback(spark, d).select(bps.alias("bps")), [], "bps", {"median_bps": 0.5, "p99_bps": 0.99})
    return q.select("n", F.round("median_bps", 6).alias("median_bps"), F.round("p99_bps", 6).alias("p99_bps"))


def worst_symbols(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.count("ref_mid").alias("matched"))
    return a.withColumn("missing", F.round(1 - F.col("matched") / F.col("n"), 9)).orderBy(F.desc("missing"), "symbol").limit(5)


def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    found = _aligned(spark, d).where("ref_mid is not null").select("target_id")
    return _targets(spark, d).join(found, "target_id", "left_anti").select("target_id", "symbol")


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    s = inference.shift_sensitivity(_targets(spark, d), _trades(spark, d), "symbol", "us", "at", "ref_id", "mid", SHIFTS, TOLERANCE)
    return s.withColumns({"mean_age_us": F.round("mean_age_us", 3), "mean_mid": F.round("mean_mid", 6)})


def target_counts(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).groupBy("symbol", "us").agg(F.count("*").alias("n"), F.coalesce(F.sum("swap_count"), F.lit(0)).alias("swaps"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return _tape(spark, d).select("delivery_id", "event")


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return _tape(spark, d, last=True).select("delivery_id", "event")


def fee_state(spark: SparkSession, d: str) -> DataFrame:
    t = written(_tape(spark, d, "pool", "fee_protocol0_new", "fee_protocol1_new"), "tape")
    packed = amm.pack_nibbles(F.col("fee_protocol0_new"), F.col("fee_protocol1_new"))
    c = t.where("event = 'SetFeeProtocol'").select("pool", "block_number", "log_index", packed.alias("packed")).where("packed is not null")
    e = t.where("event = 'Swap'").select("pool", "block_number", "log_index")
    k = as_known(e, c, "pool", ("block_number", "log_index"), ("block_number", "log_index"), "block_number", ["packed"])
    return k.select("block_number", "log_index", F.coalesce("known_packed", F.lit(0)).alias("packed"))


def interval_sums(spark: SparkSession, d: str) -> DataFrame:
    e = _trades(spark, d).select("symbol", "at", F.floor(F.col("mid") * 100).cast("double").alias("v"))
    return lots.sums_over_intervals(_steps(spark, d), e, "symbol", "start_us", "end_us", "at", "v", 3_600_000_000)


def last_5min(spark: SparkSession, d: str) -> DataFrame:
    return series.last_per_period(_metrics(spark, d), ["source", "symbol"], "at", "mid", "ref_id", 300_000_000)


def _order_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderpriority", micros("o_orderdate").alias("us"), F.col("o_totalprice").alias("v"))


def daily_sum(spark: SparkSession, d: str) -> DataFrame:
    return series.daily_sums(_order_days(spark, d), ["o_orderpriority"], "us", "v").withColumn("total", F.round("total", 2))


def daily_sum_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return series.daily_sums(_order_days(spark, d), ["o_orderpriority"], "us", "v", fill=True).withColumn("total", F.round("total", 2))


def realized_variance(spark: SparkSession, d: str) -> DataFrame:
    return series.realised_variance(_metrics(spark, d), ["source", "symbol"], "at", "mid", "ref_id").withColumn("variance", F.round("variance", 9))


def regime_tails(spark: SparkSession, d: str) -> DataFrame:
    """How many days of each source lie beyond the tails of METRIC's days."""
    v = series.realised_variance(_metrics(spark, d), ["source", "symbol"], "at", "mid", "ref_id")
    v = written(v, "variances")
    t = series.tail_days(v.where(F.col("source") == METRIC), v, "variance", 0.1, 0.9, ["source"])
    return t.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


def max_gap(spark: SparkSession, d: str) -> DataFrame:
    return series.largest_gaps(_metrics(spark, d), ["source", "symbol"], "at")


HOUR_US = 3_600_000_000


def _hourly_rates(spark: SparkSession, d: str) -> DataFrame:
    hourly = series.last_per_period(_metrics(spark, d), ["source", "symbol"], "at", "mid", "ref_id", HOUR_US)
    return hourly.withColumn("rate", F.least(F.col("value") * 1e-3, F.lit(0.5)))


def rate_integral(spark: SparkSession, d: str) -> DataFrame:
    """The return of each series from its own first hour to the end of its last one."""
    r = _hourly_rates(spark, d)
    own = Window.partitionBy("source", "symbol")  # one row per hour, not per reading
    r = r.withColumns({"first_us": F.min("slot_us").over(own), "until_us": F.max("slot_us").over(own) + HOUR_US})
    return series.yield_over(r, ["source", "symbol"], "slot_us", "rate", F.col("first_us"), F.col("until_us")).withColumn("total", F.round("total", 12))


def rate_integral_whole(spark: SparkSession, d: str) -> DataFrame:
    """The return from the first hour of the table that has a reading to the end of the last one."""
    r = written(_hourly_rates(spark, d), "rates")
    span = r.agg(F.min("slot_us").alias("first_us"), (F.max("slot_us") + HOUR_US).alias("until_us"))
    r = r.crossJoin(F.broadcast(span))  # one row by construction
    return series.yield_over(r, ["source", "symbol"], "slot_us", "rate", F.col("first_us"), F.col("until_us")).withColumn("total", F.round("total", 12))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pools").select("pool", "token0_decimals", "token1_decimals")
    t = _tape(spark, d, "pool", "tick", "sqrt_price_x96", "timestamp", "amount0", "amount1").where("event = 'Swap'").withColumn("sqrt", amm.number("sqrt_price_x96"))
    return t.join(p, "pool").withColumn("price", amm.price_of_sqrt(F.col("sqrt"), F.col("token0_decimals"), F.col("token1_decimals")))


def position_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d).where("price is not null and tick is not null")
    at = amm.price_of_tick(F.col("tick"), F.col("token0_decimals"), F.col("token1_decimals"))
    lo, hi = F.col("price") * 0.9, F.col("price") * 1.25
    l = amm.liquidity_for_value(F.lit(10000.0), F.col("price"), lo, hi)
    a0, a1 = amm.position_amounts(l, F.col("price"), lo, hi)
    return p.select(
        "delivery_id",
        F.round(F.log("price"), 9).alias("log_price"),
        F.round(at / F.col("price"), 9).alias("tick_ratio"),
        F.round(a0 * F.col("price"), 6).alias("value0"),
        F.round(a1, 6).alias("value1"),
    )


def swap_decode(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pool_events").where("event = 'Swap'")
    clean = lambda c: F.when(usable(c), F.col(c))
    a0, a1 = clean("amount0"), clean("amount1")
    return t.select(
        "delivery_id",
        F.when(a0 < 0, 1).when(a0 >= 0, -1).alias("direction"),
        F.round(F.abs(F.try_divide(a1, a0)), 9).alias("exec_price"),
        amm.wide_text("sqrt_price_x96").alias("sqrt_text"),
    )


def block_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "pool_events").select("delivery_id", "block_number", micros("timestamp").alias("us"))
    known = e.where("us is not null").groupBy("block_number").agg(F.min("us").alias("block_us"))
    return ordered.lookup(e, known, ["block_number"], {"block_us": "block_us"}).select("delivery_id", F.coalesce("us", "block_us").alias("us"))


def reference_union(spark: SparkSession, d: str) -> DataFrame:
    r = normalise_reference(table(spark, d, "reference").drop("target_timestamp"), "unknown")
    t = normalise_reference(table(spark, d, "venue_trades").select("timestamp", "price", F.col("venue").alias("source")))
    u = r.unionByName(t)
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count("mid").alias("n_mid"), F.max(micros("timestamp")).alias("last_us"))


def running_total(spark: SparkSession, d: str) -> DataFrame:
    """What has been counted for a symbol up to each of its target times."""
    t = target_counts(spark, d).where("us is not null")
    t = ordered.running_sums(ordered.time_chunks(t, "us", 3_600_000_000), ["symbol"], ["us"], "swaps", "so_far")
    return t.select("symbol", "us", "so_far")


def epoch_units(spark: SparkSession, d: str) -> DataFrame:
    """Epoch numbers among the raw times of the archives, their unit told by size."""
    t = table(spark, d, "venue_trades").where(F.trim("timestamp_raw").rlike("^([0-9]{13}|[0-9]{16})$"))
    return t.select("record_id", micros(epoch_time(F.trim("timestamp_raw"))).alias("us"))


def hash_spelling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pool_events").select("delivery_id", hash_number("tx_hash").alias("hash"))


def fee_income(spark: SparkSession, d: str) -> DataFrame:
    """Per pool the value that swaps paid in, in units of the second token, and the pool's fee on it."""
    tier = table(spark, d, "pools").select("pool", "fee_tier_pips")
    paid = lambda c: usable(c) & (F.col(c) > 0)
    value = F.when(paid("amount0"), F.col("amount0") * F.col("price")).when(paid("amount1"), F.col("amount1"))
    p = _prices(spark, d).where("price is not null").withColumn("value", value).where("value is not null")
    g = p.groupBy("pool").agg(F.count("*").alias("n"), F.sum("value").alias("paid")).join(tier, "pool")
    return g.select("pool", "n", F.round("paid", 2).alias("paid"), F.round(F.col("paid") * F.col("fee_tier_pips") / 1e6, 3).alias("fee"))


def parts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pool messages written in partitions by kind, wide integers as text, and read back from the parts."""
    at = scratch_path(spark, "parts")
    write_table(table(spark, d, "pool_events").select("event", "delivery_id", "liquidity", "amount1_raw"), at, ["liquidity", "amount1_raw"], ["event"])
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c)
    return read_parts(spark, at).groupBy("event").agg(F.count("*").alias("n"), F.max("delivery_id").alias("last_id"), size("liquidity"), size("amount1_raw"))


def gzip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Observations written as gzipped text with a header and read back with types."""
    at = scratch_path(spark, "gzip")
    r = table(spark, d, "reference").select("symbol", "ref_id", "mid", micros("timestamp").alias("us"))
    r.where(usable("mid")).write.option("header", True).option("compression", "gzip").csv(at)
    back = read_gzip_csv(spark, at, "symbol string, ref_id bigint, mid double, us bigint", ["symbol", "us"])
    return back.groupBy("symbol").agg(F.count("*").alias("n"), F.max("us").alias("last_us"), F.max_by("mid", F.struct("us", "ref_id")).alias("last_mid"))


BAND = 0.02


def _band_tape(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d).where("price is not null")
    return p.select("pool", "block_number", "log_index", "price", (100.0 / F.sqrt("price")).alias("target"), (F.sqrt("price") * 100 * BAND).alias("band"))


def band_path(spark: SparkSession, d: str) -> DataFrame:
    t = fold.band_path(_band_tape(spark, d), "pool", ["block_number", "log_index"], "target", "price", "band")
    return t.select("pool", "block_number", "log_index", F.round("held", 9).alias("held"))


def band_edge_path(spark: SparkSession, d: str) -> DataFrame:
    t = fold.band_path(_band_tape(spark, d), "pool", ["block_number", "log_index"], "target", "price", "band", edge=True)
    return t.select("pool", "block_number", "log_index", F.round("held", 9).alias("held"))


def _lp_fraction(t: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Swaps of the tape ``t`` with ``fraction``: what the protocol's share at their position leaves of the fee to liquidity.

    Shares change by messages of the tape and by recorded states, the last record of a position being the right one.
    Where no state is known, the swap's own ``lp_fee_fraction`` counts, else 1.
    """
    at = ["pool", *MESSAGE]
    t = written(t, "tape")
    e = t.where("event = 'SetFeeProtocol'").select(*at, F.lit(-1).cast("bigint").alias("rank"), amm.pack_nibbles(F.col("fee_protocol0_new"), F.col("fee_protocol1_new")).alias("packed"))
    s = table(spark, d, "fee_states").select(F.lower(F.trim("pool")).alias("pool"), *MESSAGE, F.coalesce("recorded_block", F.lit(0)).alias("rank"), F.col("fee_protocol_packed").alias("packed"), "state_id")
    c = e.withColumn("state_id", F.lit(-1).cast("bigint")).unionByName(s).where("packed is not null")
    c = c.groupBy(*at).agg(F.max_by("packed", F.struct("rank", "state_id")).alias("packed"))
    k = as_known(t.where("event = 'Swap'"), c, "pool", MESSAGE, MESSAGE, "block_number", ["packed"])
    low, high = amm.unpack_nibbles(F.col("known_packed"))
    part = F.when(_paid("amount0"), low).when(_paid("amount1"), high).otherwise(0)
    known = F.when(F.col("known_packed").isNotNull(), F.when(part == 0, 1.0).otherwise(1 - F.lit(1.0) / F.nullif(part, F.lit(0))))
    return k.withColumn("fraction", F.coalesce(known, F.when(usable("lp_fee_fraction"), F.col("lp_fee_fraction")), F.lit(1.0)))


def _paid(c: str) -> Column:
    return usable(c) & (F.col(c) > 0)


def _replay_tape(spark: SparkSession, d: str) -> DataFrame:
    """Swaps with a reference price: pool, position, us, price, ref, fee, active liquidity and funding since the swap before.

    ``fee`` is what the swap pays to all liquidity: its input value, times the pool's tier, times the fraction left by the
    protocol. As in the reference, swaps without an observation within the tolerance are left out. The tables have no
    funding payments: hourly ones of the rate that ``cash_increments`` takes from the metric stand for them.
    """
    wanted = ("pool", "sqrt_price_x96", "timestamp", "amount0", "amount1", "liquidity", "lp_fee_fraction", "fee_protocol0_new", "fee_protocol1_new")
    t = _lp_fraction(_tape(spark, d, *wanted).withColumn("pool", F.lower(F.trim("pool"))), spark, d)
    t = t.join(table(spark, d, "pools").withColumn("pool", F.lower(F.trim("pool"))), "pool")
    known = table(spark, d, "pool_events").groupBy("block_number").agg(F.min(micros("timestamp")).alias("block_us"))
    t = t.join(known, "block_number", "left").withColumn("us", F.coalesce(micros("timestamp"), "block_us"))
    t = asof.asof_join(t, _trades(spark, d), ["symbol"], "us", "at", "ref_id", ["mid"], TOLERANCE).where("ref_mid > 0")
    price = amm.price_of_sqrt(amm.number("sqrt_price_x96"), F.col("token0_decimals"), F.col("token1_decimals"))
    value = F.when(_paid("amount0"), F.col("amount0") * F.col("ref_mid")).when(_paid("amount1"), F.col("amount1")).otherwise(0.0)
    unit = F.pow(F.lit(10.0), (F.col("token0_decimals") + F.col("token1_decimals")) / 2)
    t = t.select(
        "pool", "symbol", *MESSAGE, "us", F.coalesce(price, "ref_mid").alias("price"), F.col("ref_mid").alias("ref"),
        (value * F.col("fee_tier_pips") / 1e6 * F.col("fraction")).alias("fee"), (amm.number("liquidity") / unit).alias("active"),
    )
    t = ordered.time_chunks(written(t, "swaps"), "block_number", 4096)
    t = ordered.with_previous(t, ["pool"], MESSAGE, ["us"]).drop(ordered.CHUNK)
    t = t.withColumn("since", F.least("_prev.us", "us")).withColumn("since", F.when(F.col("_prev").isNotNull(), F.col("since"))).drop("_prev")
    f = _hourly_rates(spark, d).where(F.col("source") == METRIC)
    f = f.select("symbol", (F.col("slot_us") + HOUR_US).alias("at"), (F.col("value") * F.col("rate") / (365 * 24)).alias("v"))
    t = lots.sums_over_intervals(t, f, "symbol", "since", "us", "at", "v", HOUR_US)
    return written(t.withColumnRenamed("total", "funding").drop("n_events", "since", "symbol"), "replay")


def replay_daily(spark: SparkSession, d: str) -> DataFrame:
    t = _replay_tape(spark, d).withColumn("day", series.day_of("us"))
    r = fold.replay(t, "pool", MESSAGE, "day", "price", "ref", 10_000.0, 0.8, 1.25, "fee", 50.0, 2.0, "active", "funding")
    return r.groupBy("pool", "day").agg(*[F.sum(c).alias(c) for c in ("lp_inc", "fee_inc", "hedge_inc", "funding_inc", "cost_inc", "net_inc")])


OWNED, RANGES, OWNER_RANGES = ["pool", "owner"], ["pool", "tick_lower", "tick_upper"], ["pool", "owner", "tick_lower", "tick_upper"]


def _lots(spark: SparkSession, d: str, keys: list[str], max_blocks: int | None = None) -> DataFrame:
    t = _tape(spark, d, "pool", "owner", "tick_lower", "tick_upper", "liquidity_delta").where("event in ('Mint', 'Burn') and owner is not null and tick_lower is not null and tick_upper is not null")
    t = t.withColumn("owner", F.lower("owner")).withColumn("signed", amm.signed_delta("liquidity_delta", "event"))
    return lots.fifo_lots(t, keys, ["block_number", "log_index"], "signed", "block_number", max_blocks)


def fifo_lots(spark: SparkSession, d: str) -> DataFrame:
    return _lots(spark, d, OWNED).withColumn("amount", F.col("amount").cast("string"))


def _overlap(spark: SparkSession, d: str, keys: list[str], max_blocks: int) -> DataFrame:
    """First deliveries of swaps with the liquidity ``active`` of lots that lived ``max_blocks`` blocks at most."""
    p = _tape(spark, d, "pool", "symbol", "tick", "liquidity", "timestamp", "amount0", "amount1").where("event = 'Swap' and tick is not null")
    p = written(p.select("pool", "symbol", *MESSAGE, "tick", "liquidity", micros("timestamp").alias("us"), "amount0", "amount1"), "swaps")
    return lots.active_amounts(p, _lots(spark, d, keys, max_blocks), "pool", "block_number", "tick", max_blocks)


def lot_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d, RANGES, 200).select("block_number", "log_index", F.round(F.col("active") / 1e15, 4).alias("active"))


def overlap_summary(spark: SparkSession, d: str) -> DataFrame:
    """How much of the liquidity that a pool's swaps meet is short-lived: counts, mean share and share weighed by the value paid in."""
    return _dilution(_overlap(spark, d, RANGES, 200), spark, d)


def _dilution(overlap: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    e = overlap.withColumn("share", amm.clipped_share(F.col("active"), amm.number("liquidity")))
    a = asof.asof_join(e, _trades(spark, d), ["symbol"], "us", "at", "ref_id", ["mid"], TOLERANCE)
    value = amm.input_value(F.col("amount0"), F.col("amount1"), F.col("ref_mid"))
    a = a.select("pool", "active", "share", F.when(value > 0, value).alias("value"))
    return a.groupBy("pool").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("active") > 0, 1)).alias("n_met"), F.round(F.avg("share"), 9).alias("mean_share"),
        F.round(F.sum(F.col("share") * F.col("value")) / F.nullif(F.sum("value"), F.lit(0.0)), 9).alias("weighted_share"),
    )


def owner_lots(spark: SparkSession, d: str) -> DataFrame:
    """Lots by owner and range that lived three blocks at most."""
    return _lots(spark, d, OWNER_RANGES, 3).withColumn("amount", F.col("amount").cast("string"))


def owner_dilution(spark: SparkSession, d: str) -> DataFrame:
    return _dilution(_overlap(spark, d, OWNER_RANGES, 3), spark, d)


def percent_change(spark: SparkSession, d: str) -> DataFrame:
    """The relative change of each reading of a metric to the one before, in the order of time and arrival."""
    m = ordered.time_chunks(_metrics(spark, d).where("at is not null"), "at", 3_600_000_000)
    m = ordered.with_previous(m, ["source", "symbol"], ["at", "ref_id"], ["mid"])
    return m.select("ref_id", F.round(F.col("mid") / F.nullif(F.col("_prev.mid"), F.lit(0.0)) - 1, 9).alias("change"))


def batch_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per delivered batch, how many swaps find an observation of their symbol in time; the ten worst first."""
    e = table(spark, d, "pool_events").where("event = 'Swap'").select("batch_no", "delivery_id", "symbol", micros("timestamp").alias("us"))
    a = asof.asof_join(e, _trades(spark, d), ["symbol"], "us", "at", "ref_id", ["ref_id"], TOLERANCE)
    g = a.groupBy("batch_no").agg(F.count("*").alias("n"), F.count("ref_ref_id").alias("matched"))
    return g.withColumn("missing", F.round(1 - F.col("matched") / F.col("n"), 9)).orderBy(F.desc("missing"), "batch_no").limit(10)


def fee_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """The packed fee state taken apart and put together again, and the share of a swap's second amount in both."""
    clean = lambda c: F.when(usable(c), F.abs(c))
    low, high = amm.unpack_nibbles(F.col("fee_protocol_packed"))
    e = table(spark, d, "pool_events").where("event = 'Swap'")
    both = clean("amount0") + clean("amount1")
    return e.select("delivery_id", low.alias("low"), high.alias("high"), amm.pack_nibbles(low, high).alias("packed"), F.round(amm.clipped_share(clean("amount1"), both), 9).alias("share"))


def rate_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Yearly yields of rates in fixed point, and what a return over 30 days is in a year."""
    rate = F.least(F.col("mid") * 1e-3, F.lit(0.5))
    m = _metrics(spark, d)
    return m.select("ref_id", F.round(amm.compounded(rate * 1e27), 8).alias("yearly"), F.round(amm.annualised(rate - 0.25, F.lit(30.0)), 9).alias("annual"))


def curvature(spark: SparkSession, d: str) -> DataFrame:
    """A position's second derivative times the squared price at each swap."""
    p = _prices(spark, d).where("price is not null and tick is not null")
    price = F.col("price")
    bend = amm.gamma(F.lit(1.0), price, price * 0.9, price * (1.2 + F.pmod("tick", F.lit(7)) * 0.01))
    return p.select("delivery_id", F.round(bend * price * price / F.sqrt(price), 6).alias("bend"))


def _days(spark: SparkSession, d: str) -> DataFrame:
    o = _order_days(spark, d).withColumn("all", F.lit(1))
    return series.daily_sums(o, ["all"], "us", "v", fill=True)


def block_length(spark: SparkSession, d: str) -> DataFrame:
    return inference.mean_block_length(_days(spark, d), "day", "total", 20).withColumn("tau", F.round("tau", 6))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Sums of 2,000 resamples of the daily totals, in blocks of the length that their autocorrelation asks for."""
    days = written(_days(spark, d), "days")
    blocks = inference.mean_block_length(days, "day", "total", 20).first()["blocks"]
    b = inference.bootstrap_sums(days, "day", "total", 2000, float(blocks))
    return b.select("rep", F.round(F.col("total") / 1e6, 4).alias("millions"))


def power(spark: SparkSession, d: str) -> DataFrame:
    """How often 243 days would show two effects, by 500 times 500 resamples of the daily totals."""
    return inference.power(_days(spark, d), "day", "total", 243, (1e5, 1e6), 500, 500, 5.0)


def sign_null(spark: SparkSession, d: str) -> DataFrame:
    """Mean and quantiles of the markout at each horizon when the directions of the swaps are permuted."""
    m = _swap_markouts(spark, d).withColumn("move", F.col("info_bps") * F.col("direction"))
    return inference.null_summary(inference.shuffled_sign_null(m, "direction", "move", 1000, by="horizon_seconds"), "horizon_seconds")


def _swap_markouts(spark: SparkSession, d: str) -> DataFrame:
    t = _tape(spark, d, "symbol", "timestamp", "amount0", "amount1").where("event = 'Swap'")
    t = t.select("delivery_id", "symbol", micros("timestamp").alias("us"), "amount0", "amount1")
    a = asof.asof_join(t, _trades(spark, d), ["symbol"], "us", "at", "ref_id", ["mid"], TOLERANCE)
    return inference.swap_markouts(a, _trades(spark, d), "symbol", "delivery_id", "us", "at", "ref_id", "mid", "ref_mid", "amount0", "amount1", HORIZONS, TOLERANCE)


def swap_markouts(spark: SparkSession, d: str) -> DataFrame:
    """Direction, price paid, edge and both markouts of the first delivery of each swap that has an observation in time."""
    r = lambda c, n: (F.round(c, n) + 0.0).alias(c)
    return _swap_markouts(spark, d).select(
        "delivery_id", "horizon_seconds", "direction", r("exec_price", 9), r("edge_bps", 5), "future_mid", r("info_bps", 6), r("exec_bps", 5)
    )


def gap_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    m = series.time_weighted_mean(_metrics(spark, d), ["source", "symbol"], "at", "mid", "ref_id")
    return m.withColumns({"mean": F.round("mean", 6), "seconds": F.round("seconds", 6)})


def cash_increments(spark: SparkSession, d: str) -> DataFrame:
    """What the rate of each metric source at the start of a step makes of cash by its end."""
    s = _steps(spark, d).withColumn("source", F.explode(F.array(F.lit(METRIC), F.lit(OTHER_METRIC))))
    series_of = lambda x: x.withColumn("series", F.struct("source", "symbol"))
    k = asof.latest_before(series_of(s), series_of(_metrics(spark, d)), "series", "start_us", "at", ["ref_id", "mid"])
    rate = F.when(F.col("ref_mid").isNotNull(), F.least(F.col("ref_mid") * 1e-3, F.lit(0.5)))
    grown = F.expm1(F.log1p(rate) * ((F.col("end_us") - F.col("start_us")) / (365 * 86400 * 1e6)))
    return k.select("source", "symbol", "end_us", F.round(grown, 12).alias("increment"))


def markout_summary(spark: SparkSession, d: str) -> DataFrame:
    m = written(markouts(spark, d).select("horizon_seconds", "markout_bps"), "markouts")
    mean = m.groupBy("horizon_seconds").agg(F.count("markout_bps").alias("n"), F.round(F.avg("markout_bps"), 6).alias("mean_bps"))
    q = series.quantiles(m, ["horizon_seconds"], "markout_bps", {"median_bps": 0.5}).drop("n")
    return mean.join(q, "horizon_seconds", "left").withColumn("median_bps", F.round("median_bps", 6))


def mean_to_spread(spark: SparkSession, d: str) -> DataFrame:
    daily = series.daily_sums(_order_days(spark, d), ["o_orderpriority"], "us", "v", fill=True)
    return series.ratio_of_mean(daily, ["o_orderpriority"], "total").withColumn("ratio", F.round("ratio", 6))


def block_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The first block at or after and the last at or before each full hour."""
    hour = 3_600_000_000
    b = table(spark, d, "pool_events").select("block_number", micros("timestamp").alias("us")).where("us is not null")
    b = b.groupBy("block_number").agg(F.min("us").alias("us"))
    h = b.withColumn("hour_us", F.col("us") - F.pmod("us", F.lit(hour)))
    return h.groupBy("hour_us").agg(F.min_by("block_number", F.struct("us", "block_number")).alias("first_block"), F.max_by("block_number", F.struct("us", "block_number")).alias("last_block"))


def capital_replay(spark: SparkSession, d: str, capitals: tuple[float, ...]) -> DataFrame:
    """(capital, net, trades): the position of every pool replayed with each capital, all in one job."""
    t = _replay_tape(spark, d).withColumn("capital", F.explode(F.array(*[F.lit(float(x)) for x in capitals])))
    t = t.withColumns({"run": F.concat_ws("|", "pool", F.col("capital").cast("string")), "day": F.lit(0)})
    r = fold.replay(t, "run", MESSAGE, "day", "price", "ref", "capital", 0.8, 1.25, "fee", 50.0, 2.0, "active", "funding")
    r = r.withColumn("capital", F.split_part("run", F.lit("|"), F.lit(2)).cast("double"))
    return r.groupBy("capital").agg(F.sum("net_inc").alias("net"), F.sum("trades").alias("trades"))


def capacity_sweep(spark: SparkSession, d: str) -> DataFrame:
    return capital_replay(spark, d, (1e3, 1e4, 1e5))


QUERIES = {
    f.__name__: f
    for f in (
        asof_backward, asof_latest, markouts, priority_fallback, coverage_grid, venue_overlap, worst_symbols, anti_missing, sensitivity,
        target_counts, dedupe_first, dedupe_last, fee_state, interval_sums, last_5min, daily_sum, daily_sum_zero_fill, realized_variance, regime_tails,
        max_gap, rate_integral, rate_integral_whole, position_arithmetic, swap_decode, block_times, reference_union, band_path, replay_daily, fifo_lots,
        gap_weighted_mean, cash_increments, markout_summary, mean_to_spread, block_bounds, capacity_sweep, lot_overlap, overlap_summary,
        percent_change, batch_coverage, fee_arithmetic, rate_arithmetic, curvature,
        band_edge_path, owner_lots, owner_dilution, swap_markouts, running_total, epoch_units, hash_spelling, fee_income, parts_round_trip, gzip_round_trip, block_length, bootstrap, power, sign_null,
    )
}

_T = "t AS (SELECT target_id, symbol, swap_count, epoch_us(target_timestamp) AS us FROM swap_targets)"


def _ref(where: str = "TRUE", name: str = "r") -> str:
    return f"""{name} AS (SELECT symbol, epoch_us(timestamp) AS tm, min(ref_id) AS ref_id, arg_min(mid, ref_id) AS mid FROM reference
  WHERE COALESCE(alignment_eligible, TRUE) AND mid IS NOT NULL AND NOT isnan(mid) AND {where} GROUP BY ALL)"""


def _align(ref: str = "r", name: str = "a") -> str:
    return f"""{name} AS (SELECT t.*, CASE WHEN t.us - {ref}.tm <= {TOLERANCE} THEN {ref}.ref_id END AS ref_id,
    CASE WHEN t.us - {ref}.tm <= {TOLERANCE} THEN {ref}.mid END AS mid, CASE WHEN t.us - {ref}.tm <= {TOLERANCE} THEN t.us - {ref}.tm END AS age_us
  FROM t ASOF LEFT JOIN {ref} ON t.symbol = {ref}.symbol AND t.us >= {ref}.tm)"""


_M = """m AS (SELECT source, symbol, ref_id, mid, epoch_us(timestamp) AS tm FROM reference
  WHERE COALESCE(regime_eligible, TRUE) AND mid IS NOT NULL AND NOT isnan(mid) AND timestamp IS NOT NULL)"""
_TAPE = "tape AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_number, log_index ORDER BY delivery_id) AS rn FROM pool_events) WHERE rn = 1)"
_BOTH = f"{_T}, {_ref(f"source = '{PRIMARY}'", 'r1')}, {_ref(f"source = '{FALLBACK}'", 'r2')}, {_align('r1', 'a1')}, {_align('r2', 'a2')}"
_VAR = f"""{_M}, p AS (SELECT source, symbol, tm - tm % 300000000 AS slot, arg_max(mid, ROW(tm, ref_id)) AS v FROM m WHERE mid > 0 GROUP BY ALL),
r AS (SELECT source, symbol, slot // 86400000000 AS day, ln(v) - ln(lag(v) OVER (PARTITION BY source, symbol ORDER BY slot)) AS r FROM p),
v AS (SELECT source, symbol, day, sum(r * r) * 365 AS variance, count(r) AS n FROM r GROUP BY ALL HAVING count(r) >= 2)"""
_DAYS = "d AS (SELECT o_orderpriority, epoch_us(o_orderdate) // 86400000000 AS day, sum(o_totalprice) AS total FROM orders GROUP BY ALL)"
_PRICE = f"""{_TAPE}, s AS (SELECT tape.*, p.token0_decimals AS d0, p.token1_decimals AS d1, TRY_CAST(sqrt_price_x96 AS DOUBLE) / pow(2.0::DOUBLE, 96) AS root
  FROM tape JOIN pools p ON tape.pool = p.pool WHERE event = 'Swap' AND TRY_CAST(sqrt_price_x96 AS DOUBLE) > 0),
x AS (SELECT *, root * root * pow(10.0::DOUBLE, d0 - d1) AS price FROM s)"""


def _pieces(keys: list[str]) -> str:
    k, same = ", ".join(keys), " AND ".join(f"m.{x} = b.{x}" for x in keys)
    over = f"(PARTITION BY {k} ORDER BY block_number, log_index)"
    return f"""{_TAPE}, e AS (SELECT pool, lower(owner) AS owner, tick_lower, tick_upper, block_number, log_index,
    CAST(ltrim(trim(liquidity_delta), '-') AS HUGEINT) * CASE event WHEN 'Burn' THEN -1 ELSE 1 END AS a
  FROM tape WHERE event IN ('Mint', 'Burn') AND owner IS NOT NULL AND tick_lower IS NOT NULL AND tick_upper IS NOT NULL
    AND regexp_full_match(trim(liquidity_delta), '-?[0-9]+') AND ltrim(trim(liquidity_delta), '-0') <> ''),
s AS (SELECT *, sum(a) OVER {over} AS s, sum(CASE WHEN a > 0 THEN a ELSE 0 END) OVER {over} AS i FROM e),
v AS (SELECT *, i - s - greatest(0, -min(s) OVER {over}) AS o FROM s),
x AS (SELECT *, COALESCE(lag(o) OVER {over}, 0) AS o0 FROM v),
l AS (SELECT {", ".join(f"m.{x}" for x in keys)}, m.block_number AS in_block, b.block_number AS out_block,
    least(m.i, b.o) - greatest(m.i - m.a, b.o0) AS amount, b.block_number - m.block_number AS lifetime
  FROM x m JOIN x b ON {same} WHERE m.a > 0 AND b.a < 0 AND least(m.i, b.o) > greatest(m.i - m.a, b.o0))"""


def _diluted(keys: list[str], lifetime: int) -> str:
    return f"""WITH {_pieces(keys)}, {_ref()}, t AS (SELECT pool, symbol, block_number, log_index, tick, TRY_CAST(liquidity AS DOUBLE) AS whole, amount0, amount1, epoch_us(timestamp) AS us
  FROM tape WHERE event = 'Swap' AND tick IS NOT NULL), {_align()},
o AS (SELECT p.pool, p.block_number, p.log_index, COALESCE(sum(l.amount::DOUBLE), 0) AS active, any_value(whole) AS whole,
    any_value(CASE WHEN amount0 > 0 AND NOT isnan(amount0) THEN amount0 * p.mid WHEN amount1 > 0 AND NOT isnan(amount1) THEN amount1 END) AS v
  FROM a p LEFT JOIN l ON l.pool = p.pool AND p.block_number BETWEEN in_block AND out_block AND tick_lower <= tick AND tick < tick_upper AND lifetime <= {lifetime}
  GROUP BY p.pool, p.block_number, p.log_index),
h AS (SELECT *, CASE WHEN whole > 0 THEN least(active / whole, 1) ELSE 0 END AS share, CASE WHEN v > 0 THEN v END AS value FROM o)
SELECT pool, count(*) AS n, count(*) FILTER (active > 0) AS n_met, round(avg(share), 9) AS mean_share, round(sum(share * value) / nullif(sum(value), 0), 9) AS weighted_share FROM h GROUP BY pool"""


ORACLES = {
    "asof_backward": f"WITH {_T}, {_ref()}, {_align()} SELECT target_id, ref_id, age_us FROM a",
    "asof_latest": f"""WITH {_T}, {_M}, u AS (SELECT t.*, s AS source FROM t, (SELECT unnest(['{METRIC}', '{OTHER_METRIC}']) AS s)),
r AS (SELECT source, symbol, tm, max(ref_id) AS ref_id FROM m GROUP BY ALL)
SELECT t.target_id, t.source, r.ref_id AS ref_ref_id FROM u t ASOF LEFT JOIN r ON t.source = r.source AND t.symbol = r.symbol AND t.us >= r.tm""",
    "markouts": f"""WITH {_T}, {_ref()}, {_align()},
h AS (SELECT a.target_id, a.symbol, a.mid, CASE WHEN a.target_id % 4 = 1 THEN 1 ELSE -1 END AS sign, h AS horizon_seconds, a.us + h * 1000000 AS due
  FROM a, (SELECT unnest({list(HORIZONS)}) AS h) WHERE mid IS NOT NULL),
j AS (SELECT h.*, CASE WHEN r.tm - h.due <= {TOLERANCE} THEN r.mid END AS f FROM h ASOF LEFT JOIN r ON h.symbol = r.symbol AND h.due <= r.tm)
SELECT target_id, horizon_seconds, f AS future_mid, round(sign * (f / mid - 1) * 1e4, 6) + 0.0 AS markout_bps FROM j""",
    "priority_fallback": f"""WITH {_BOTH} SELECT a1.target_id, COALESCE(a1.mid, a2.mid) AS ref_mid,
  CASE WHEN a1.mid IS NOT NULL THEN 'primary' WHEN a2.mid IS NOT NULL THEN 'fallback' END AS chosen FROM a1 JOIN a2 USING (target_id)""",
    "coverage_grid": f"""WITH {_T}, {_ref()}, {_align()}, g AS (SELECT unnest({list(AGES)})::BIGINT AS max_age_us),
c AS (SELECT max_age_us, CAST(sum(COALESCE(swap_count, 0)) AS BIGINT) AS total,
  CAST(sum(CASE WHEN age_us <= max_age_us THEN COALESCE(swap_count, 0) ELSE 0 END) AS BIGINT) AS matched FROM a, g GROUP BY 1)
SELECT max_age_us, total, matched, total - matched AS missing, round(matched / greatest(total, 1), 9) AS coverage, matched / greatest(total, 1) >= 0.6 AS passes FROM c""",
    "venue_overlap": f"""WITH {_BOTH}, o AS (SELECT abs(a1.mid / a2.mid - 1) * 1e4 AS x FROM a1 JOIN a2 USING (target_id) WHERE a1.mid IS NOT NULL AND a2.mid IS NOT NULL)
SELECT count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median_bps, round(quantile_cont(x, 0.99), 6) AS p99_bps FROM o""",
    "worst_symbols": f"""WITH {_T}, {_ref()}, {_align()} SELECT symbol, count(*) AS n, count(mid) AS matched, round(1 - count(mid) / count(*), 9) AS missing
FROM a GROUP BY symbol ORDER BY missing DESC, symbol LIMIT 5""",
    "anti_missing": f"WITH {_T}, {_ref()}, {_align()} SELECT target_id, symbol FROM a WHERE mid IS NULL",
    "sensitivity": f"""WITH {_T}, {_ref()}, g AS (SELECT unnest({list(SHIFTS)})::BIGINT AS shift_us),
ts AS (SELECT * FROM t, g), rs AS (SELECT symbol, shift_us, tm + shift_us AS tm, mid FROM r, g),
j AS (SELECT ts.shift_us, CASE WHEN ts.us - rs.tm <= {TOLERANCE} THEN ts.us - rs.tm END AS age, CASE WHEN ts.us - rs.tm <= {TOLERANCE} THEN rs.mid END AS mid
  FROM ts ASOF LEFT JOIN rs ON ts.symbol = rs.symbol AND ts.shift_us = rs.shift_us AND ts.us >= rs.tm)
SELECT shift_us, count(*) AS n, count(age) AS matched, quantile_cont(age::DOUBLE, 0.5) AS median_age_us,
  round(avg(age), 3) AS mean_age_us, round(avg(mid), 6) AS mean_mid FROM j GROUP BY 1""",
    "target_counts": f"WITH {_T} SELECT symbol, us, count(*) AS n, CAST(COALESCE(sum(swap_count), 0) AS BIGINT) AS swaps FROM t GROUP BY symbol, us",
    "dedupe_first": f"WITH {_TAPE} SELECT delivery_id, event FROM tape",
    "dedupe_last": f"WITH {_TAPE.replace('ORDER BY delivery_id', 'ORDER BY delivery_id DESC')} SELECT delivery_id, event FROM tape",
    "percent_change": f"WITH {_M} SELECT ref_id, round(mid / lag(mid) OVER (PARTITION BY source, symbol ORDER BY tm, ref_id) - 1, 9) AS change FROM m",
    "batch_coverage": f"""WITH t AS (SELECT batch_no, symbol, epoch_us(timestamp) AS us FROM pool_events WHERE event = 'Swap'), {_ref()}, {_align()}
SELECT batch_no, count(*) AS n, count(ref_id) AS matched, round(1 - count(ref_id) / count(*), 9) AS missing FROM a GROUP BY batch_no ORDER BY missing DESC, batch_no LIMIT 10""",
    "fee_arithmetic": """WITH c AS (SELECT delivery_id, fee_protocol_packed AS p, CASE WHEN NOT isnan(amount0) THEN abs(amount0) END AS a0, CASE WHEN NOT isnan(amount1) THEN abs(amount1) END AS a1
  FROM pool_events WHERE event = 'Swap')
SELECT delivery_id, p & 15 AS low, p >> 4 & 15 AS high, (p & 15) | ((p >> 4 & 15) << 4) AS packed, round(CASE WHEN a0 + a1 > 0 THEN a1 / (a0 + a1) ELSE 0 END, 9) AS share FROM c""",
    "rate_arithmetic": f"""WITH {_M}, r AS (SELECT ref_id, least(mid * 1e-3, 0.5::DOUBLE) AS r, r / 31536000 AS x FROM m)
SELECT ref_id, round(exp(31536000 * (x - x * x / 2 + x * x * x / 3)) - 1, 8) AS yearly, round(pow(0.75::DOUBLE + r, 365 / 30.0::DOUBLE) - 1, 9) AS annual FROM r""",
    "fee_state": f"""WITH {_TAPE}, s AS (SELECT event, block_number, log_index, last_value(CASE WHEN event = 'SetFeeProtocol' THEN fee_protocol0_new | (fee_protocol1_new << 4) END IGNORE NULLS)
  OVER (PARTITION BY pool ORDER BY block_number, log_index) AS packed FROM tape)
SELECT block_number, log_index, COALESCE(packed, 0)::INTEGER AS packed FROM s WHERE event = 'Swap'""",
    "interval_sums": f"""WITH {_T}, u AS (SELECT DISTINCT symbol, us FROM t),
i AS (SELECT symbol, lag(us) OVER (PARTITION BY symbol ORDER BY us) AS start_us, us AS end_us FROM u),
e AS (SELECT symbol, epoch_us(timestamp) AS tm, floor(mid * 100) AS v FROM reference WHERE COALESCE(alignment_eligible, TRUE) AND mid IS NOT NULL AND NOT isnan(mid))
SELECT i.symbol, start_us, end_us, COALESCE(sum(v), 0)::DOUBLE AS total, count(v) AS n_events FROM i LEFT JOIN e ON e.symbol = i.symbol AND e.tm > start_us AND e.tm <= end_us
WHERE start_us IS NOT NULL GROUP BY i.symbol, start_us, end_us""",
    "last_5min": f"WITH {_M} SELECT source, symbol, tm - tm % 300000000 AS slot_us, arg_max(mid, ROW(tm, ref_id)) AS value FROM m GROUP BY ALL",
    "daily_sum": f"WITH {_DAYS} SELECT o_orderpriority, day, round(total, 2) AS total FROM d",
    "daily_sum_zero_fill": f"""WITH {_DAYS}, g AS (SELECT o_orderpriority, unnest(generate_series(min(day), max(day))) AS day FROM d GROUP BY 1)
SELECT o_orderpriority, g.day, round(COALESCE(total, 0), 2) AS total FROM g LEFT JOIN d USING (o_orderpriority, day)""",
    "realized_variance": f"WITH {_VAR} SELECT source, symbol, day, round(variance, 9) AS variance, n FROM v",
    "regime_tails": f"""WITH {_VAR}, q AS (SELECT count(variance) AS n_reference, quantile_cont(variance, 0.1) AS low, quantile_cont(variance, 0.9) AS high
  FROM v WHERE source = '{METRIC}'), c AS (SELECT source, variance FROM v)
SELECT source, max(n_reference) AS n_reference, count(variance) AS n_candidate, round(max(low), 9) AS low, round(max(high), 9) AS high,
  CAST(COALESCE(sum((variance <= low)::INT), 0) AS BIGINT) AS n_low, CAST(COALESCE(sum((variance >= high)::INT), 0) AS BIGINT) AS n_high FROM c, q GROUP BY source""",
    "max_gap": f"""WITH {_M}, g AS (SELECT source, symbol, tm, tm - lag(tm) OVER (PARTITION BY source, symbol ORDER BY tm) AS gap FROM m)
SELECT source, symbol, count(*) AS n, min(tm) AS first_us, max(tm) AS last_us, COALESCE(max(gap), 0) AS max_gap_us FROM g GROUP BY source, symbol""",
    "rate_integral": f"""WITH {_M}, h AS (SELECT source, symbol, tm - tm % 3600000000 AS slot, least(arg_max(mid, ROW(tm, ref_id)) * 1e-3, 0.5) AS rate FROM m GROUP BY ALL),
g AS (SELECT source, symbol, slot, rate, COALESCE(lead(slot) OVER (PARTITION BY source, symbol ORDER BY slot), slot + 3600000000) AS z FROM h)
SELECT source, symbol, round(exp(sum(ln(1 + rate) * ((z - slot) / (365 * 86400 * 1e6)))) - 1, 12) AS total, TRUE AS covered FROM g GROUP BY source, symbol""",
    "rate_integral_whole": f"""WITH {_M}, h AS (SELECT source, symbol, tm - tm % 3600000000 AS slot, least(arg_max(mid, ROW(tm, ref_id)) * 1e-3, 0.5) AS rate FROM m GROUP BY ALL),
b AS (SELECT min(slot) AS a, max(slot) + 3600000000 AS z FROM h),
g AS (SELECT source, symbol, slot, rate, COALESCE(lead(slot) OVER (PARTITION BY source, symbol ORDER BY slot), b.z) AS z, b.a FROM h, b)
SELECT source, symbol, round(exp(sum(ln(1 + rate) * ((z - slot) / (365 * 86400 * 1e6)))) - 1, 12) AS total, min(slot) <= min(a) AS covered FROM g GROUP BY source, symbol""",
    "position_arithmetic": f"""WITH {_PRICE}, y AS (SELECT delivery_id, price, pow(1.0001::DOUBLE, tick) * pow(10.0::DOUBLE, d0 - d1) AS tm,
  sqrt(price) AS sp, sqrt(price * 0.9) AS sa, sqrt(price * 1.25) AS sb FROM x WHERE tick IS NOT NULL),
z AS (SELECT *, (sb - sp) / (sp * sb) AS u0, sp - sa AS u1 FROM y)
SELECT delivery_id, round(ln(price), 9) AS log_price, round(tm / price, 9) AS tick_ratio, round(10000 / (u0 * price + u1) * u0 * price, 6) AS value0,
  round(10000 / (u0 * price + u1) * u1, 6) AS value1 FROM z""",
    "swap_decode": """WITH c AS (SELECT delivery_id, CASE WHEN NOT isnan(amount0) THEN amount0 END AS a0, CASE WHEN NOT isnan(amount1) THEN amount1 END AS a1, trim(sqrt_price_x96) AS s
  FROM pool_events WHERE event = 'Swap')
SELECT delivery_id, CASE WHEN a0 < 0 THEN 1 WHEN a0 >= 0 THEN -1 END AS direction, CASE WHEN a0 <> 0 THEN round(abs(a1 / a0), 9) END AS exec_price,
  CASE WHEN regexp_full_match(s, '[0-9]+') THEN COALESCE(NULLIF(ltrim(s, '0'), ''), '0') END AS sqrt_text FROM c""",
    "block_times": """WITH k AS (SELECT block_number, min(epoch_us(timestamp)) AS block_us FROM pool_events GROUP BY 1)
SELECT delivery_id, COALESCE(epoch_us(timestamp), block_us) AS us FROM pool_events JOIN k USING (block_number)""",
    "reference_union": """WITH n AS (SELECT source, timestamp, COALESCE(CASE WHEN NOT isnan(mid) THEN mid END, CASE WHEN NOT isnan(last_trade) THEN last_trade END,
    CASE WHEN NOT isnan(bid) THEN bid END / 2 + CASE WHEN NOT isnan(ask) THEN ask END / 2) AS mid FROM reference
  UNION ALL SELECT venue, timestamp, CASE WHEN NOT isnan(price) THEN price END FROM venue_trades)
SELECT COALESCE(source, 'unknown') AS source, count(*) AS n, count(mid) AS n_mid, max(epoch_us(timestamp)) AS last_us FROM n GROUP BY 1""",
    "band_path": f"""WITH RECURSIVE {_PRICE}, n AS (SELECT pool, block_number, log_index, price, 100 / sqrt(price) AS target, sqrt(price) * 100 * {BAND} AS band,
  row_number() OVER (PARTITION BY pool ORDER BY block_number, log_index) AS k FROM x),
r AS (SELECT pool, k, block_number, log_index, target AS held FROM n WHERE k = 1
  UNION ALL SELECT n.pool, n.k, n.block_number, n.log_index, CASE WHEN abs(n.target - r.held) * n.price > n.band THEN n.target ELSE r.held END
  FROM r JOIN n ON n.pool = r.pool AND n.k = r.k + 1)
SELECT pool, block_number, log_index, round(held, 9) AS held FROM r""",
    "band_edge_path": f"""WITH RECURSIVE {_PRICE}, n AS (SELECT pool, block_number, log_index, 100 / sqrt(price) AS target, sqrt(price) * 100 * {BAND} / price AS far,
  row_number() OVER (PARTITION BY pool ORDER BY block_number, log_index) AS k FROM x),
r AS (SELECT pool, k, block_number, log_index, target AS held FROM n WHERE k = 1
  UNION ALL SELECT n.pool, n.k, n.block_number, n.log_index, least(greatest(r.held, n.target - far), n.target + far) FROM r JOIN n ON n.pool = r.pool AND n.k = r.k + 1)
SELECT pool, block_number, log_index, round(held, 9) AS held FROM r""",
    "fifo_lots": f"WITH {_pieces(OWNED)} SELECT pool, owner, in_block, out_block, CAST(amount AS VARCHAR) AS amount, lifetime FROM l",
    "lot_overlap": f"""WITH {_pieces(RANGES)}, p AS (SELECT pool, block_number, log_index, tick FROM tape WHERE event = 'Swap' AND tick IS NOT NULL)
SELECT p.block_number, p.log_index, round(COALESCE(sum(l.amount::DOUBLE), 0) / 1e15, 4) AS active FROM p LEFT JOIN l ON l.pool = p.pool AND p.block_number BETWEEN in_block AND out_block
  AND tick_lower <= tick AND tick < tick_upper AND lifetime <= 200 GROUP BY p.block_number, p.log_index""",
    "overlap_summary": _diluted(RANGES, 200),
    "owner_dilution": _diluted(OWNER_RANGES, 3),
    "owner_lots": f"WITH {_pieces(OWNER_RANGES)} SELECT pool, owner, tick_lower, tick_upper, in_block, out_block, CAST(amount AS VARCHAR) AS amount, lifetime FROM l WHERE lifetime <= 3",
    "swap_markouts": f"""WITH {_TAPE}, {_ref()}, t AS (SELECT delivery_id, symbol, epoch_us(timestamp) AS us, CASE WHEN NOT isnan(amount0) THEN amount0 END AS a0,
    CASE WHEN NOT isnan(amount1) THEN amount1 END AS a1 FROM tape WHERE event = 'Swap'), {_align()},
h AS (SELECT a.*, CASE WHEN a0 < 0 THEN 1 WHEN a0 >= 0 THEN -1 END AS d, CASE WHEN a0 <> 0 THEN nullif(abs(a1 / a0), 0) END AS paid, h AS horizon_seconds, a.us + h * 1000000 AS due
  FROM a, (SELECT unnest({list(HORIZONS)}) AS h) WHERE mid IS NOT NULL),
j AS (SELECT h.*, CASE WHEN r.tm - h.due <= {TOLERANCE} THEN r.mid END AS f FROM h ASOF LEFT JOIN r ON h.symbol = r.symbol AND h.due <= r.tm)
SELECT delivery_id, horizon_seconds, d AS direction, round(paid, 9) + 0.0 AS exec_price, round(d * (mid / paid - 1) * 1e4, 5) + 0.0 AS edge_bps, f AS future_mid,
  round(d * (f / mid - 1) * 1e4, 6) + 0.0 AS info_bps, round(d * (f / paid - 1) * 1e4, 5) + 0.0 AS exec_bps FROM j""",
    "running_total": f"""WITH {_T}, c AS (SELECT symbol, us, CAST(COALESCE(sum(swap_count), 0) AS BIGINT) AS swaps FROM t WHERE us IS NOT NULL GROUP BY symbol, us)
SELECT symbol, us, CAST(sum(swaps) OVER (PARTITION BY symbol ORDER BY us) AS BIGINT) AS so_far FROM c""",
    "epoch_units": """SELECT record_id, CASE WHEN length(trim(timestamp_raw)) = 13 THEN 1000 ELSE 1 END * CAST(timestamp_raw AS BIGINT) AS us FROM venue_trades
WHERE regexp_full_match(trim(timestamp_raw), '[0-9]{13}|[0-9]{16}')""",
    "hash_spelling": r"""WITH h AS (SELECT delivery_id, ltrim(regexp_extract(lower(tx_hash), '^\s*(?:0x)?([0-9a-f]+)\s*$', 1), '0') AS x,
  regexp_full_match(lower(tx_hash), '\s*(?:0x)?[0-9a-f]+\s*') AS ok FROM pool_events)
SELECT delivery_id, CASE WHEN ok AND length(x) <= 64 THEN lpad(x, 64, '0') END AS hash FROM h""",
    "fee_income": f"""WITH {_PRICE}, v AS (SELECT pool, CASE WHEN amount0 > 0 AND NOT isnan(amount0) THEN amount0 * price WHEN amount1 > 0 AND NOT isnan(amount1) THEN amount1 END AS v FROM x)
SELECT pool, count(*) AS n, round(sum(v), 2) AS paid, round(sum(v) * max(fee_tier_pips) / 1e6, 3) AS fee FROM v JOIN pools USING (pool) WHERE v IS NOT NULL GROUP BY pool""",
    "parts_round_trip": """WITH w AS (SELECT event, delivery_id, trim(liquidity) AS a, trim(amount1_raw) AS b FROM pool_events),
c AS (SELECT event, delivery_id, CASE WHEN regexp_full_match(a, '[+-]?[0-9]+') THEN CAST(a AS HUGEINT)::VARCHAR END AS a,
  CASE WHEN regexp_full_match(b, '[+-]?[0-9]+') THEN CAST(b AS HUGEINT)::VARCHAR END AS b FROM w)
SELECT event, count(*) AS n, max(delivery_id) AS last_id, CAST(COALESCE(sum(length(a)), 0) AS BIGINT) AS liquidity, CAST(COALESCE(sum(length(b)), 0) AS BIGINT) AS amount1_raw FROM c GROUP BY event""",
    "gzip_round_trip": """SELECT symbol, count(*) AS n, max(epoch_us(timestamp)) AS last_us, arg_max(mid, ROW(epoch_us(timestamp), ref_id)) AS last_mid
FROM reference WHERE mid IS NOT NULL AND NOT isnan(mid) GROUP BY symbol""",
    "curvature": f"""WITH {_PRICE}, c AS (SELECT delivery_id, price, sqrt(price * 0.9::DOUBLE) AS sa, sqrt(price * (1.2::DOUBLE + ((tick % 7 + 7) % 7) * 0.01::DOUBLE)) AS sb,
  greatest(price * 1e-4, 1e-6) AS h FROM x WHERE tick IS NOT NULL),
v AS (SELECT *, list_transform([price + h, price, price - h], lambda p: (sb - sqrt(p)) / (sqrt(p) * sb) * p + (sqrt(p) - sa)) AS v FROM c)
SELECT delivery_id, round((v[1] - 2 * v[2] + v[3]) / (h * h) * price * price / sqrt(price), 6) AS bend FROM v""",
    "block_length": f"""WITH {_DAYS}, a AS (SELECT day, sum(total) AS total FROM d GROUP BY 1), g AS (SELECT unnest(generate_series(min(day), max(day))) AS day FROM a),
s AS (SELECT day, COALESCE(total, 0) AS v FROM g LEFT JOIN a USING (day)), c AS (SELECT day, v - avg(v) OVER () AS x FROM s),
l AS (SELECT unnest(generate_series(0, 20)) AS lag), k AS (SELECT lag, avg(p.x * q.x) AS c FROM l, c p JOIN c q ON q.day = p.day + lag GROUP BY lag),
r AS (SELECT lag, c / (SELECT c FROM k WHERE lag = 0) AS rho FROM k WHERE lag > 0),
b AS (SELECT (lag - 1) // 2 AS pair, sum(rho) AS s FROM r GROUP BY 1 HAVING count(*) = 2), o AS (SELECT s, min((s > 0)::INT) OVER (ORDER BY pair) AS good FROM b),
t AS (SELECT greatest(1, 1 + 2 * COALESCE(sum(s), 0)) AS tau FROM o WHERE good = 1)
SELECT round(tau, 6) AS tau, least(greatest(ceil(tau), 1), 1000)::INTEGER AS blocks FROM t""",
    "gap_weighted_mean": f"""WITH {_M}, u AS (SELECT source, symbol, tm, arg_max(mid, ref_id) AS v FROM m GROUP BY ALL),
g AS (SELECT *, lead(tm) OVER (PARTITION BY source, symbol ORDER BY tm) - tm AS gap FROM u)
SELECT source, symbol, round(CASE WHEN sum(gap) > 0 THEN sum(v * gap) / sum(gap) ELSE avg(v) END, 6) AS mean, round(COALESCE(sum(gap), 0) / 1e6, 6) AS seconds
FROM g GROUP BY source, symbol""",
    "cash_increments": f"""WITH {_T}, {_M}, u AS (SELECT DISTINCT symbol, us FROM t),
i AS (SELECT symbol, lag(us) OVER (PARTITION BY symbol ORDER BY us) AS start_us, us AS end_us FROM u),
r AS (SELECT source, symbol, tm, least(arg_max(mid, ref_id) * 1e-3, 0.5) AS rate FROM m GROUP BY ALL),
s AS (SELECT i.*, s AS source FROM i, (SELECT unnest(['{METRIC}', '{OTHER_METRIC}']) AS s) WHERE start_us IS NOT NULL),
j AS (SELECT s.*, r.rate FROM s ASOF LEFT JOIN r ON s.source = r.source AND s.symbol = r.symbol AND s.start_us >= r.tm)
SELECT source, symbol, end_us, round(exp(ln(1 + rate) * ((end_us - start_us) / (365 * 86400 * 1e6))) - 1, 12) AS increment FROM j""",
    "mean_to_spread": f"""WITH {_DAYS}, g AS (SELECT o_orderpriority, unnest(generate_series(min(day), max(day))) AS day FROM d GROUP BY 1),
f AS (SELECT o_orderpriority, COALESCE(total, 0) AS v FROM g LEFT JOIN d USING (o_orderpriority, day))
SELECT o_orderpriority, count(*) AS n, round(avg(v) / stddev_samp(v) * sqrt(365), 6) AS ratio FROM f GROUP BY 1""",
    "block_bounds": """WITH b AS (SELECT block_number, min(epoch_us(timestamp)) AS us FROM pool_events WHERE timestamp IS NOT NULL GROUP BY 1)
SELECT us - us % 3600000000 AS hour_us, arg_min(block_number, ROW(us, block_number)) AS first_block, arg_max(block_number, ROW(us, block_number)) AS last_block FROM b GROUP BY 1""",
}
ORACLES["bootstrap"] = f"""WITH l AS ({ORACLES["block_length"]}), {_DAYS}, a AS (SELECT day, sum(total) AS total FROM d GROUP BY 1), g AS (SELECT unnest(generate_series(min(day), max(day))) AS day FROM a),
s AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, COALESCE(total, 0) AS v FROM g LEFT JOIN a USING (day)),
c AS (SELECT i, sum(v) OVER (ORDER BY i) AS upto FROM s), n AS (SELECT count(*) AS n FROM s),
k AS (SELECT rep, number, which, (((11::UHUGEINT * 15074714826142052245::UHUGEINT + rep::UHUGEINT * 8589934592::UHUGEINT + which::UHUGEINT + 2::UHUGEINT * number::UHUGEINT) & m) * 11400714819323198485::UHUGEINT) & m AS z, m
  FROM (SELECT 18446744073709551615::UHUGEINT AS m), (SELECT unnest(range(2000)) AS rep), (SELECT unnest(range(0, (SELECT n.n // blocks * 5 // 4 + 100 FROM n, l)::BIGINT)) AS number), (SELECT unnest([0, 1]) AS which)),
k2 AS (SELECT *, (xor(z, z >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) & m AS z2 FROM k), k3 AS (SELECT *, (xor(z2, z2 >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) & m AS z3 FROM k2),
u AS (SELECT rep, number, max(CASE which WHEN 0 THEN {{u}} END) AS u0, max(CASE which WHEN 1 THEN {{u}} END) AS u1 FROM k3 GROUP BY ALL),
b AS (SELECT rep, number, CAST(floor(u1 * n) AS BIGINT) AS start, CASE WHEN blocks <= 1 THEN 1 ELSE CAST(floor(ln(1 - u0) / ln(1 - 1.0::DOUBLE / blocks)) AS BIGINT) + 1 END AS len, n FROM u, n, l),
e AS (SELECT *, CAST(sum(len) OVER (PARTITION BY rep ORDER BY number) AS BIGINT) - len AS began FROM b),
f AS (SELECT rep, start, start + least(len, n - began) AS stop, n FROM e WHERE began < n)
SELECT rep, round(sum((stop // n) * t.upto + COALESCE(p.upto, 0) - COALESCE(q.upto, 0)) / 1e6, 4) AS millions FROM f JOIN c t ON t.i = f.n - 1 LEFT JOIN c p ON p.i = f.stop % f.n - 1 LEFT JOIN c q ON q.i = f.start - 1
GROUP BY rep""".replace("{u}", "(xor(z3, z3 >> 31::UHUGEINT) >> 11::UHUGEINT)::DOUBLE / 9007199254740992")
ORACLES["markout_summary"] = f"""WITH k AS ({ORACLES["markouts"]}) SELECT horizon_seconds, count(markout_bps) AS n, round(avg(markout_bps), 6) AS mean_bps,
  round(quantile_cont(markout_bps, 0.5), 6) AS median_bps FROM k GROUP BY 1"""
