"""Queries over trade archives, decoding of pool messages, windows and the rebuild of a reference from several sources."""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import amm
from tidemark.operators import asof, inference, ordered, series
from tidemark.operators.pointintime import as_known
from tidemark.operators.timeparse import normalise_timestamps
from tidemark.plans import tapes
from tidemark.plans.problems import TIMES
from tidemark.session import scratch_path, written
from tidemark.sources import archives
from tidemark.sources.tables import micros, table, usable

#: Venues by priority, and how old a trade of an archive may be.
VENUES, TRADE_AGE = ("kestrel", "oriole"), 7 * 86_400_000_000
#: Ages of which the smallest is wanted that gives this coverage.
FRESH, COVERAGE = (250_000, 500_000, 1_000_000, 2_000_000, 3_000_000), 0.5


def _venue_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades of the archives with a readable time and a price, the time read from the raw text."""
    t = table(spark, d, "venue_trades").select("record_id", "venue", "symbol", "price", "timestamp_raw")
    t = normalise_timestamps(t, table(spark, d, "venues")).where((F.col("time_status") == "ok") & usable("price"))
    # of trades at one time the last one delivered counts
    return written(t.select("record_id", "venue", "symbol", "price", F.col("utc_micros").alias("at"), (-F.col("record_id")).alias("turn")), "trades")


def trade_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each trade with the last one of the first venue by then, at most a week old; none may come from later."""
    t = _venue_trades(spark, d)
    first = t.where(F.col("venue") == VENUES[0])
    a = asof.asof_join(t, first, ["symbol"], "at", "at", "turn", ["record_id", "price"], TRADE_AGE)
    age = F.col("at") - F.col("ref_us")
    return a.select("record_id", F.col("ref_record_id").alias("ref_id"), F.col("ref_price").alias("mid"), age.alias("age_us"), (age >= 0).alias("no_lookahead"))


def trade_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Each trade of the other venues with the last one of the first venue that has one by then, at most a week old."""
    t = _venue_trades(spark, d)
    left = t.where(~F.col("venue").isin(*VENUES)).drop("venue", "price")
    p = asof.prefer_source(left, t, ["symbol"], "record_id", "at", "at", "turn", ["record_id", "price"], "venue", VENUES, TRADE_AGE)
    return p.select("record_id", "chosen", F.col("ref_record_id").alias("ref_id"), F.col("ref_price").alias("mid"))


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct targets with the number of their swaps and, of both trade sources, the latest observation within the largest age."""
    t = tapes.target_counts(spark, d).where("symbol is not null and us is not null").withColumn("target", F.struct("symbol", "us"))
    r = table(spark, d, "reference").where(F.coalesce("alignment_eligible", F.lit(True)) & usable("mid"))
    r = r.select("symbol", "source", "ref_id", "mid", micros("timestamp").alias("at"))
    p = asof.prefer_source(t, r, ["symbol"], "target", "us", "at", "ref_id", ["ref_id", "mid"], "source", (tapes.PRIMARY, tapes.FALLBACK), max(FRESH))
    return written(t.select("target", "swaps").join(p.select("target", "by_source"), "target").select("target.symbol", "target.us", "swaps", "by_source"), "offers")


def _youngest(o: DataFrame) -> DataFrame:
    ages = [F.col("us") - F.try_element_at("by_source", F.lit(s)).getField("ref_us") for s in (tapes.PRIMARY, tapes.FALLBACK)]
    return o.withColumn("age", F.least(*ages))


def smallest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The smallest age at which both sources together cover enough swaps."""
    return asof.smallest_passing(asof.coverage_by_age(_youngest(_offers(spark, d)), "age", "swaps", FRESH, COVERAGE))


def rebuilt_reference(spark: SparkSession, d: str) -> DataFrame:
    """The whole rebuild: targets, both sources, the smallest age that covers enough, the choice by priority at that
    age, and the sources' own five-minute rows beside the rows for alignment."""
    o = _offers(spark, d)
    t = asof.smallest_passing(asof.coverage_by_age(_youngest(o), "age", "swaps", FRESH, COVERAGE))
    o = o.crossJoin(F.broadcast(t))  # one row by construction
    fresh = [F.try_element_at("by_source", F.lit(s)) for s in (tapes.PRIMARY, tapes.FALLBACK)]
    fit = [F.col("us") - x.getField("ref_us") <= F.col("max_age_us") for x in fresh]
    best = F.when(fit[0], fresh[0]).when(fit[1], fresh[1])
    chosen = F.when(fit[0], tapes.PRIMARY).when(fit[1], tapes.FALLBACK)
    a = o.select("symbol", F.col("us").alias("target_us"), chosen.alias("source"), best["ref_us"].alias("us"), best["ref_mid"].alias("mid"), F.lit(True).alias("aligns"))
    five = tapes.last_5min(spark, d).select("symbol", F.lit(None).cast("bigint").alias("target_us"), "source", F.col("slot_us").alias("us"), F.col("value").alias("mid"), F.lit(False).alias("aligns"))
    return a.where("source is not null").unionByName(five)


def repair_merge(spark: SparkSession, d: str) -> DataFrame:
    """Targets without an observation of the first source are looked up in the second; per target the first source's row stays."""
    first = tapes._aligned(spark, d, tapes.PRIMARY).where("ref_mid is not null").select("target_id", "ref_ref_id", F.lit(0).alias("rank"))
    first = written(first, "first")
    missing = tapes._targets(spark, d).join(first.select("target_id"), "target_id", "left_anti")
    second = asof.asof_join(missing, tapes._trades(spark, d, tapes.FALLBACK), ["symbol"], "us", "at", "ref_id", ["ref_id"], tapes.TOLERANCE)
    second = second.where("ref_ref_id is not null").select("target_id", "ref_ref_id", F.lit(1).alias("rank"))
    return ordered.keep_one(first.unionByName(second), ["target_id"], "rank").select("target_id", F.col("ref_ref_id").alias("ref_id"), "rank")


def klines(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute bars of the archives' trades, as an archive writes them, read as reference rows."""
    t = _venue_trades(spark, d)
    slot = F.col("at") - F.pmod("at", F.lit(300_000_000)) + 299_999_999
    bars = t.groupBy("venue", "symbol", slot.alias("end")).agg(F.max_by("price", F.struct("at", "record_id")).cast("string").alias("close"))
    # one venue writes milliseconds, the others microseconds
    bars = bars.withColumn("close_time", F.when(F.col("venue") == VENUES[0], F.floor(F.col("end") / 1000)).otherwise(F.col("end")).cast("string"))
    k = archives.klines_reference(bars.withColumn("close", F.concat(F.lit(" "), "close")), "archive_5m")
    return k.select(micros("timestamp").alias("us"), "mid", "source", "alignment_eligible", "regime_eligible")


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Messages per kind from the first to the last day of the tape, both given as dates."""
    e = table(spark, d, "pool_events").select("event", "timestamp")
    span = e.agg(F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("z")).first()
    if span["a"] is None:
        return e.limit(0).groupBy("event").agg(F.count("*").alias("n"))
    return archives.in_window(e, "timestamp", span["a"], span["z"]).groupBy("event").agg(F.count("*").alias("n"))


def reference_last(spark: SparkSession, d: str) -> DataFrame:
    """Of the rows of a source and symbol at one time the last that arrived."""
    r = table(spark, d, "reference").select("source", "symbol", "timestamp", "ref_id")
    return archives.keep_last_by_time(r, ["source", "symbol"], "ref_id").select("ref_id", "source", "symbol")


def fresh_reference(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select("ref_id", "alignment_eligible", "age_seconds")
    return archives.fresh_or_inexact(r, 1.0).select("ref_id")


def direct_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct targets the rows for alignment note as met within a second, and how many there are."""
    r = table(spark, d, "reference").where(F.coalesce("alignment_eligible", F.lit(False)) & usable("age_seconds") & (F.col("age_seconds") <= 1.0))
    n = r.agg(F.count_distinct("symbol", "target_timestamp").alias("covered"))
    return n.crossJoin(F.broadcast(table(spark, d, "swap_targets").agg(F.count_distinct("symbol", "target_timestamp").alias("targets"))))


def distinct_days(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select("source", micros("timestamp").alias("us"))
    return r.where("us is not null").groupBy("source").agg(F.count_distinct(series.day_of("us")).alias("days"))


def window_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per series of a metric the longest time without a reading between the first and the last reading of any."""
    m = written(tapes._metrics(spark, d).select("source", "symbol", "at"), "metrics")
    span = m.agg(F.min("at").alias("first_us"), F.max("at").alias("last_us"))
    m = m.crossJoin(F.broadcast(span))  # one row by construction
    return series.gaps_in_window(m, ["source", "symbol"], "at", F.col("first_us"), F.col("last_us"))


def largest_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Per source the largest price among the rows for alignment, minus infinity where there is none."""
    fit = F.coalesce("alignment_eligible", F.lit(False)) & usable("mid")
    return table(spark, d, "reference").groupBy("source").agg(F.coalesce(F.max(F.when(fit, F.col("mid"))), F.lit(float("-inf"))).alias("largest"))


def attach_first(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery with the batch and the price root of the first delivery of its message, by block and number in it."""
    e = table(spark, d, "pool_events").select("delivery_id", *tapes.MESSAGE)
    first = tapes._tape(spark, d, "batch_no", "sqrt_price_x96")
    j = ordered.lookup(e, first, tapes.MESSAGE, {"first_batch": "batch_no", "root": "sqrt_price_x96"}, required=True)
    return j.select("delivery_id", "first_batch", amm.wide_text("root").alias("root"))


def decoded(spark: SparkSession, d: str) -> DataFrame:
    """Raw amounts in whole tokens, the change of liquidity with its sign, and wide hexadecimal numbers as decimal text."""
    p = table(spark, d, "pools").select("pool", "token0_decimals", "token1_decimals")
    e = table(spark, d, "pool_events").select("delivery_id", "pool", "event", "amount0_raw", "amount1_raw", "liquidity_delta", "tx_hash")
    e = ordered.lookup(e, p, ["pool"], {"d0": "token0_decimals", "d1": "token1_decimals"})
    digits = F.regexp_extract(F.lower("tx_hash"), r"^\s*(?:0x)?([0-9a-f]+)\s*$", 1)
    return e.select(
        "delivery_id", F.round(amm.scaled("amount0_raw", F.col("d0")), 6).alias("amount0"), F.round(amm.scaled("amount1_raw", F.col("d1")), 6).alias("amount1"),
        amm.signed_delta("liquidity_delta", "event").alias("delta"), amm.hex_integer(F.substring(digits, 1, 30)).alias("hash_head"),
    )


def pro_rata_fees(spark: SparkSession, d: str) -> DataFrame:
    """Per swap the price, else that of the reference, and the part of its fee of a position of 10,000 around that price."""
    t = tapes._tape(spark, d, "pool", "symbol", "timestamp", "sqrt_price_x96", "liquidity", "amount0", "amount1").where("event = 'Swap'")
    t = t.join(table(spark, d, "pools").drop("symbol"), "pool").withColumn("us", micros("timestamp"))
    a = asof.asof_join(t, tapes._trades(spark, d), ["symbol"], "us", "at", "ref_id", ["mid"], tapes.TOLERANCE)
    dec = F.col("token0_decimals"), F.col("token1_decimals")
    a = a.withColumn("price", amm.price_or_reference(amm.number("sqrt_price_x96"), F.col("ref_mid"), *dec))
    own = amm.raw_liquidity(amm.liquidity_for_value(F.lit(10_000.0), F.col("price"), F.col("price") * 0.8, F.col("price") * 1.25), *dec)
    fee = amm.input_value(F.col("amount0"), F.col("amount1"), F.col("price")) * F.col("fee_tier_pips") / 1e6
    part = amm.pro_rata_fee(fee, own, amm.number("liquidity"))
    return a.select("delivery_id", F.round(F.log("price"), 9).alias("log_price"), F.round(F.log(amm.raw_price(F.col("price"), *dec)), 9).alias("log_raw"), F.round(part, 7).alias("part"))


def price_ticks(spark: SparkSession, d: str) -> DataFrame:
    """The tick of a price half a tick above each swap's own, which is that tick again."""
    p = table(spark, d, "pools").select("pool", "token0_decimals", "token1_decimals")
    e = table(spark, d, "pool_events").where("event = 'Swap'").select("delivery_id", "pool", "tick").join(p, "pool")
    dec = F.col("token0_decimals"), F.col("token1_decimals")
    return e.select("delivery_id", amm.tick_of_price(amm.price_of_tick(F.col("tick"), *dec) * 1.00005, *dec).alias("tick"))


def fee_and_curvature(spark: SparkSession, d: str) -> DataFrame:
    """Per pool the yearly yield of fees of a hypothetical position and its predictable loss, from the whole tape.

    The position has 10,000 in [0.8, 1.25] of the pool's first reference price. Fees are its part of those of swaps
    within the range; the loss is that of its curvature at a variance of 0.5 a year, weighed by the time to the next swap.
    """
    wanted = ("pool", "symbol", "timestamp", "liquidity", "amount0", "amount1", "lp_fee_fraction")
    t = tapes._tape(spark, d, *wanted).where("event = 'Swap'").join(table(spark, d, "pools").drop("symbol"), "pool").withColumn("us", micros("timestamp"))
    a = asof.asof_join(t, tapes._trades(spark, d), ["symbol"], "us", "at", "ref_id", ["mid"], tapes.TOLERANCE)
    active = amm.number("liquidity")
    a = a.where((F.col("ref_mid") > 0) & active.isNotNull()).select(
        "pool", *tapes.MESSAGE, "us", "ref_mid", "amount0", "amount1", active.alias("active"), F.col("fee_tier_pips").alias("tier"),
        F.when(usable("lp_fee_fraction"), F.col("lp_fee_fraction")).otherwise(1.0).alias("fraction"), "token0_decimals", "token1_decimals",
    )
    a = written(a, "tape")
    start = a.groupBy("pool").agg(F.min(F.struct(*tapes.MESSAGE, "ref_mid")).alias("s")).select("pool", F.col("s.ref_mid").alias("p0"))
    a = a.join(start, "pool")
    price, lo, hi = F.col("ref_mid"), F.col("p0") * 0.8, F.col("p0") * 1.25
    own = amm.liquidity_for_value(F.lit(10_000.0), F.col("p0"), lo, hi)
    value = amm.input_value(F.col("amount0"), F.col("amount1"), price)
    counts = (price > lo) & (price < hi) & value.isNotNull()
    fee = amm.pro_rata_fee(value * F.col("tier") / 1e6 * F.col("fraction"), amm.raw_liquidity(own, F.col("token0_decimals"), F.col("token1_decimals")), F.col("active"))
    loss = F.greatest(F.lit(0.0), -0.5 * amm.gamma(own, price, lo, hi) * price * price * 0.5)
    a = a.select("pool", *tapes.MESSAGE, "us", F.when(counts, fee).alias("fee"), F.when(counts, loss).alias("loss"))
    a = ordered.with_previous(ordered.time_chunks(a, "block_number", 4096), ["pool"], tapes.MESSAGE, ["us", "loss"])
    gap = F.when(F.col("_prev.loss").isNotNull(), F.greatest(F.col("us") - F.col("_prev.us"), F.lit(0)))
    g = a.groupBy("pool").agg(
        F.count("*").alias("n"), F.sum("fee").alias("fee"), F.sum(F.col("_prev.loss") * gap).alias("weighed"), F.sum(gap).alias("gap"), F.avg("loss").alias("plain"),
        F.greatest((F.max("us") - F.min("us")) / 1e6, F.lit(1.0)).alias("seconds"),
    ).where("n >= 2")
    fees = F.coalesce("fee", F.lit(0.0)) / 10_000.0 * (365.0 * 86_400.0 / F.col("seconds"))
    lost = F.coalesce(F.when(F.col("gap") > 0, F.col("weighed") / F.col("gap")), "plain", F.lit(0.0)) / 10_000.0
    return g.select("pool", "n", F.round(fees, 6).alias("fee_yield"), F.round(lost, 6).alias("loss_yield"))


def value_increments(spark: SparkSession, d: str) -> DataFrame:
    """Per swap the change of the logarithm of its pool's price, and whether it and the swap before lie within 2 % of the pool's first price."""
    p = written(tapes._prices(spark, d).where("price is not null").select("pool", *tapes.MESSAGE, "price"), "prices")
    start = p.groupBy("pool").agg(F.min(F.struct(*tapes.MESSAGE, "price")).alias("s")).select("pool", F.col("s.price").alias("p0"))
    p = p.join(start, "pool").withColumn("inside", F.abs(F.col("price") / F.col("p0") - 1) < 0.02)
    p = ordered.with_previous(ordered.time_chunks(p, "block_number", 4096), ["pool"], tapes.MESSAGE, ["price", "inside"])
    change = F.coalesce(F.log(F.col("price") / F.col("_prev.price")), F.lit(0.0))
    return p.select("block_number", "log_index", (F.round(change, 9) + 0.0).alias("change"), "inside", F.coalesce("_prev.inside", F.lit(False)).alias("was_inside"))


def seeded_rates(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rates from an opening state on: each series starts at the table's first hour with the rate of its own first one."""
    h = written(tapes._hourly_rates(spark, d).select("source", "symbol", "slot_us", "rate"), "rates")
    first = h.groupBy("source", "symbol").agg(F.min_by("rate", "slot_us").alias("rate"))
    seed = first.crossJoin(F.broadcast(h.agg(F.min("slot_us").alias("slot_us"))))  # one row by construction
    r = archives.seeded_rates(seed, h, ["source", "symbol"], "slot_us", "rate")
    return r.select("source", "symbol", "slot_us", F.round(amm.compounded(F.col("rate") * 1e27), 8).alias("yearly"))


def blocks_around(spark: SparkSession, d: str) -> DataFrame:
    """The last block by each target time and the first one from it on."""
    b = table(spark, d, "pool_events").select("block_number", micros("timestamp").alias("us")).where("us is not null")
    b = b.groupBy("block_number").agg(F.min("us").alias("block_us"))
    return asof.bounds_of(tapes._targets(spark, d), "us", b, "block_number", "block_us").select("target_id", "last_before", "first_after")


CHUNK_BLOCKS = 500


def chunk_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The fee state of each pool just before each chunk of blocks in which it has messages, so that chunks can be replayed apart."""
    t = tapes._tape(spark, d, "pool", "fee_protocol0_new", "fee_protocol1_new")
    t = written(t.withColumn("pool", F.lower(F.trim("pool"))), "tape")
    packed = amm.pack_nibbles(F.col("fee_protocol0_new"), F.col("fee_protocol1_new"))
    c = t.where("event = 'SetFeeProtocol'").select("pool", *tapes.MESSAGE, packed.alias("packed")).where("packed is not null")
    first = (F.col("block_number") - F.pmod("block_number", F.lit(CHUNK_BLOCKS))).alias("first_block")
    e = t.select("pool", first).distinct().withColumns({"before": F.col("first_block") - 1, "end": F.lit(1 << 31)})
    k = as_known(e, c, "pool", ("before", "end"), tapes.MESSAGE, "block_number", ["packed"])
    return k.select("pool", "first_block", F.coalesce("known_packed", F.lit(0)).alias("packed"))


def seeded_fee_state(spark: SparkSession, d: str) -> DataFrame:
    """The packed fee state at each swap: what the tape last set, and before that what the pool's opening record says."""
    t = tapes._tape(spark, d, "pool", "fee_protocol0_new", "fee_protocol1_new")
    t = written(t.withColumn("pool", F.lower(F.trim("pool"))), "tape")
    packed = amm.pack_nibbles(F.col("fee_protocol0_new"), F.col("fee_protocol1_new"))
    c = t.where("event = 'SetFeeProtocol'").select("pool", *tapes.MESSAGE, packed.alias("packed")).where("packed is not null")
    s = table(spark, d, "fee_states").where("fee_protocol_packed is not null").withColumn("pool", F.lower(F.trim("pool")))
    s = s.groupBy("pool").agg(F.min_by("fee_protocol_packed", F.struct(*tapes.MESSAGE, "state_id")).alias("packed"))
    opening = s.select("pool", F.lit(-1).cast("bigint").alias("block_number"), F.lit(-1).alias("log_index"), "packed")
    k = as_known(t.where("event = 'Swap'"), c.unionByName(opening), "pool", tapes.MESSAGE, tapes.MESSAGE, "block_number", ["packed"])
    return k.select("block_number", "log_index", F.col("known_packed").alias("packed"))


def resumed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Messages written by kind in two runs, of which the first broke off after swaps, and read back."""
    at = scratch_path(spark, "resumed")
    e = table(spark, d, "pool_events").select("event", "delivery_id")
    archives.resume_parts(e.where("event = 'Swap'"), at, "event")
    archives.resume_parts(e, at, "event")
    return archives.read_parts(spark, at).groupBy("event").agg(F.count("*").alias("n"), F.max("delivery_id").alias("last_id"))


def zip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Trades packed into zip archives of about 10,000 rows a venue, each with a checksum beside its table, and read back."""
    t = table(spark, d, "venue_trades").select("venue", "record_id", F.col("price").cast("string").alias("price"), (F.col("record_id") / 10_000).cast("bigint").alias("part"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        text, out = io.StringIO(), io.BytesIO()
        csv.writer(text).writerows(zip(*(rows[c].to_pylist() for c in ("venue", "record_id", "price")), strict=True))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("trades.csv", text.getvalue())
            z.writestr("trades.csv.CHECKSUM", hashlib.sha256(text.getvalue().encode()).hexdigest())
        return pa.table({"path": [f"{key[0].as_py()}-{key[1].as_py()}.zip"], "content": [out.getvalue()]})

    files = t.groupBy("venue", "part").applyInArrow(pack, "path string, content binary")
    back = archives.zip_rows(files, ["venue", "record_id", "price"])
    price = F.col("price").try_cast("double")
    return back.groupBy("venue").agg(F.count("*").alias("n"), F.max(F.col("record_id").cast("bigint")).alias("last_id"), F.max(F.when(~F.isnan(price), price)).alias("largest"))


def percentile_interval(spark: SparkSession, d: str) -> DataFrame:
    """Per series of a metric the interval that holds 95 % of its readings."""
    i = inference.interval(tapes._metrics(spark, d), "mid", 0.95, ["source", "symbol"])
    return i.select("source", "symbol", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


QUERIES = {
    f.__name__: f
    for f in (
        trade_asof, trade_fallback, smallest_tolerance, rebuilt_reference, repair_merge, klines, window_counts, reference_last, fresh_reference,
        direct_coverage, distinct_days, window_gaps, largest_eligible, attach_first, decoded, pro_rata_fees, price_ticks, fee_and_curvature,
        value_increments, seeded_rates, blocks_around, chunk_seeds, seeded_fee_state, resumed_parts, zip_round_trip, percentile_interval,
    )
}

_V = f"""WITH {TIMES}, v AS (SELECT y.record_id, y.venue, t.symbol, t.price, y.us FROM y JOIN venue_trades t ON t.record_id = y.record_id
  WHERE y.us IS NOT NULL AND t.price IS NOT NULL AND NOT isnan(t.price))"""


def _archive(venue: str, name: str) -> str:
    return f"{name} AS (SELECT symbol, us, max(record_id) AS record_id, arg_max(price, record_id) AS price FROM v WHERE venue = '{venue}' GROUP BY ALL)"


_SOURCES = f"""c AS ({tapes.ORACLES["target_counts"]}), t AS (SELECT * FROM c WHERE symbol IS NOT NULL AND us IS NOT NULL),
{tapes._ref(f"source = '{tapes.PRIMARY}'", "r1")}, {tapes._ref(f"source = '{tapes.FALLBACK}'", "r2")}, {tapes._align("r1", "a1")}, {tapes._align("r2", "a2")},
o AS (SELECT a1.symbol, a1.us, a1.swaps, a1.age_us AS g1, a1.mid AS m1, a2.age_us AS g2, a2.mid AS m2, least(a1.age_us, a2.age_us) AS age FROM a1 JOIN a2 USING (symbol, us)),
k AS (SELECT unnest({list(FRESH)})::BIGINT AS max_age_us),
s AS (SELECT min(max_age_us) AS max_age_us FROM (SELECT max_age_us FROM o, k GROUP BY 1
  HAVING sum(CASE WHEN age <= max_age_us THEN swaps ELSE 0 END) / greatest(sum(swaps), 1) >= {COVERAGE}))"""

ORACLES = {
    "trade_asof": f"""{_V}, {_archive(VENUES[0], "r")}, j AS (SELECT v.record_id, v.us, r.record_id AS ref_id, r.price AS mid, v.us - r.us AS age FROM v ASOF LEFT JOIN r ON v.symbol = r.symbol AND v.us >= r.us)
SELECT record_id, CASE WHEN age <= {TRADE_AGE} THEN ref_id END AS ref_id, CASE WHEN age <= {TRADE_AGE} THEN mid END AS mid, CASE WHEN age <= {TRADE_AGE} THEN age END AS age_us,
  CASE WHEN age <= {TRADE_AGE} THEN TRUE END AS no_lookahead FROM j""",
    "trade_fallback": f"""{_V}, {_archive(VENUES[0], "r1")}, {_archive(VENUES[1], "r2")}, other AS (SELECT * FROM v WHERE venue NOT IN {VENUES}),
a1 AS (SELECT e.record_id, r1.record_id AS i1, r1.price AS p1, e.us - r1.us AS g1 FROM other e ASOF LEFT JOIN r1 ON e.symbol = r1.symbol AND e.us >= r1.us),
a2 AS (SELECT e.record_id, r2.record_id AS i2, r2.price AS p2, e.us - r2.us AS g2 FROM other e ASOF LEFT JOIN r2 ON e.symbol = r2.symbol AND e.us >= r2.us)
SELECT record_id, CASE WHEN g1 <= {TRADE_AGE} THEN '{VENUES[0]}' WHEN g2 <= {TRADE_AGE} THEN '{VENUES[1]}' END AS chosen,
  CASE WHEN g1 <= {TRADE_AGE} THEN i1 WHEN g2 <= {TRADE_AGE} THEN i2 END AS ref_id, CASE WHEN g1 <= {TRADE_AGE} THEN p1 WHEN g2 <= {TRADE_AGE} THEN p2 END AS mid FROM a1 JOIN a2 USING (record_id)""",
    "smallest_tolerance": f"WITH {_SOURCES} SELECT max_age_us FROM s",
    "rebuilt_reference": f"""WITH {_SOURCES}, {tapes._M},
x AS (SELECT symbol, us AS target_us, CASE WHEN g1 <= max_age_us THEN '{tapes.PRIMARY}' WHEN g2 <= max_age_us THEN '{tapes.FALLBACK}' END AS source,
  CASE WHEN g1 <= max_age_us THEN us - g1 WHEN g2 <= max_age_us THEN us - g2 END AS us, CASE WHEN g1 <= max_age_us THEN m1 WHEN g2 <= max_age_us THEN m2 END AS mid, TRUE AS aligns FROM o, s)
SELECT * FROM x WHERE source IS NOT NULL
UNION ALL SELECT symbol, NULL, source, tm - tm % 300000000, arg_max(mid, ROW(tm, ref_id)), FALSE FROM m GROUP BY symbol, source, tm - tm % 300000000""",
    "repair_merge": f"""WITH {tapes._BOTH}, p AS (SELECT target_id, a1.ref_id AS i1, a2.ref_id AS i2 FROM a1 JOIN a2 USING (target_id))
SELECT target_id, COALESCE(i1, i2) AS ref_id, CASE WHEN i1 IS NOT NULL THEN 0 ELSE 1 END AS rank FROM p WHERE COALESCE(i1, i2) IS NOT NULL""",
    "klines": f"""{_V}, bars AS (SELECT venue, symbol, us - us % 300000000 + 299999999 AS end_us, arg_max(price, ROW(us, record_id)) AS mid FROM v GROUP BY ALL)
SELECT CASE WHEN venue = '{VENUES[0]}' THEN end_us // 1000 * 1000 ELSE end_us END AS us, mid, 'archive_5m' AS source, FALSE AS alignment_eligible, TRUE AS regime_eligible FROM bars""",
    "window_counts": "SELECT event, count(*) AS n FROM pool_events WHERE timestamp IS NOT NULL GROUP BY event",
    "reference_last": """SELECT ref_id, source, symbol FROM (SELECT *, row_number() OVER (PARTITION BY source, symbol, timestamp ORDER BY ref_id DESC) AS rn FROM reference) WHERE rn = 1""",
    "fresh_reference": "SELECT ref_id FROM reference WHERE NOT COALESCE(alignment_eligible, FALSE) OR (age_seconds <= 1 AND NOT isnan(age_seconds))",
    "direct_coverage": """SELECT (SELECT count(DISTINCT (symbol, target_timestamp)) FROM reference WHERE alignment_eligible AND age_seconds <= 1 AND NOT isnan(age_seconds)
  AND symbol IS NOT NULL AND target_timestamp IS NOT NULL) AS covered,
  (SELECT count(DISTINCT (symbol, target_timestamp)) FROM swap_targets WHERE symbol IS NOT NULL AND target_timestamp IS NOT NULL) AS targets""",
    "distinct_days": "SELECT source, count(DISTINCT epoch_us(timestamp) // 86400000000) AS days FROM reference WHERE timestamp IS NOT NULL GROUP BY source",
    "window_gaps": f"""WITH {tapes._M}, w AS (SELECT min(tm) AS a, max(tm) AS z FROM m), p AS (SELECT source, symbol, tm FROM m UNION ALL SELECT DISTINCT source, symbol, a FROM m, w
  UNION ALL SELECT DISTINCT source, symbol, z FROM m, w), g AS (SELECT source, symbol, tm - lag(tm) OVER (PARTITION BY source, symbol ORDER BY tm) AS gap FROM p)
SELECT source, symbol, count(*) - 2 AS n, max(gap) AS max_gap_us FROM g GROUP BY source, symbol""",
    "largest_eligible": "SELECT source, COALESCE(max(mid) FILTER (alignment_eligible AND mid IS NOT NULL AND NOT isnan(mid)), '-inf'::DOUBLE) AS largest FROM reference GROUP BY source",
    "attach_first": f"""WITH {tapes._TAPE}, f AS (SELECT block_number, log_index, batch_no, trim(sqrt_price_x96) AS s FROM tape)
SELECT e.delivery_id, f.batch_no AS first_batch, CASE WHEN regexp_full_match(s, '[0-9]+') THEN COALESCE(NULLIF(ltrim(s, '0'), ''), '0') END AS root
FROM pool_events e LEFT JOIN f ON e.block_number = f.block_number AND e.log_index = f.log_index""",
    "decoded": r"""WITH e AS (SELECT delivery_id, event, TRY_CAST(trim(amount0_raw) AS DOUBLE) / pow(10::DOUBLE, token0_decimals) AS a0, TRY_CAST(trim(amount1_raw) AS DOUBLE) / pow(10::DOUBLE, token1_decimals) AS a1,
    trim(liquidity_delta) AS l, left(regexp_extract(lower(tx_hash), '^\s*(?:0x)?([0-9a-f]+)\s*$', 1), 30) AS h FROM pool_events LEFT JOIN pools USING (pool)),
x AS (SELECT *, CASE WHEN regexp_full_match(l, '[+-]?[0-9]+') THEN COALESCE(NULLIF(ltrim(l, '+-0'), ''), '0') END AS size FROM e)
SELECT delivery_id, round(a0, 6) AS amount0, round(a1, 6) AS amount1, CASE WHEN event = 'Mint' THEN size WHEN event = 'Burn' THEN CASE WHEN size = '0' THEN size ELSE '-' || size END END AS delta,
  CASE WHEN h <> '' THEN CAST(list_reduce(list_transform(string_split(h, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS HUGEINT)), lambda a, b: a * 16 + b) AS VARCHAR) END AS hash_head FROM x""",
    "pro_rata_fees": f"""WITH {tapes._TAPE}, t AS (SELECT tape.*, epoch_us(timestamp) AS us, fee_tier_pips AS tier, token0_decimals AS d0, token1_decimals AS d1 FROM tape JOIN pools ON tape.pool = pools.pool WHERE event = 'Swap'),
{tapes._ref()}, {tapes._align()}, p AS (SELECT *, COALESCE(CASE WHEN TRY_CAST(sqrt_price_x96 AS DOUBLE) > 0 THEN pow(TRY_CAST(sqrt_price_x96 AS DOUBLE) / pow(2::DOUBLE, 96), 2) * pow(10::DOUBLE, d0 - d1) END, mid) AS price,
  greatest(TRY_CAST(liquidity AS DOUBLE), 0) AS active FROM a),
l AS (SELECT *, 10000 / ((sqrt(price * 1.25) - sqrt(price)) / (sqrt(price) * sqrt(price * 1.25)) * price + sqrt(price) - sqrt(price * 0.8)) * pow(10::DOUBLE, (d0 + d1) / 2) AS own,
  CASE WHEN amount0 > 0 AND NOT isnan(amount0) THEN amount0 * price WHEN amount1 > 0 AND NOT isnan(amount1) THEN amount1 END * tier / 1e6 AS fee FROM p)
SELECT delivery_id, round(ln(price), 9) AS log_price, round(ln(price / pow(10::DOUBLE, d0 - d1)), 9) AS log_raw,
  CASE WHEN COALESCE(active, 0) + own > 0 THEN round(fee * own / (COALESCE(active, 0) + own), 7) ELSE 0 END AS part FROM l""",
    "price_ticks": "SELECT delivery_id, tick FROM pool_events JOIN pools ON pool_events.pool = pools.pool WHERE event = 'Swap'",
    "fee_and_curvature": f"""WITH {tapes._TAPE}, t AS (SELECT tape.*, epoch_us(timestamp) AS us, fee_tier_pips AS tier, token0_decimals AS d0, token1_decimals AS d1 FROM tape JOIN pools ON tape.pool = pools.pool WHERE event = 'Swap'),
{tapes._ref()}, {tapes._align()},
b AS (SELECT *, TRY_CAST(liquidity AS DOUBLE) AS active, first_value(mid) OVER w AS p0, lead(us) OVER w AS nxt FROM a WHERE mid > 0 AND TRY_CAST(liquidity AS DOUBLE) IS NOT NULL WINDOW w AS (PARTITION BY pool ORDER BY block_number, log_index)),
c AS (SELECT *, sqrt(p0 * 0.8) AS sa, sqrt(p0 * 1.25) AS sb, greatest(mid * 1e-4, 1e-6) AS h, CASE WHEN amount0 > 0 AND NOT isnan(amount0) THEN amount0 * mid WHEN amount1 > 0 AND NOT isnan(amount1) THEN amount1 END AS v FROM b),
e AS (SELECT *, 10000 / ((sb - sqrt(p0)) / (sqrt(p0) * sb) * p0 + sqrt(p0) - sa) AS own, list_transform([mid + h, mid, mid - h], lambda p:
  (sb - least(greatest(sqrt(p), sa), sb)) / (least(greatest(sqrt(p), sa), sb) * sb) * p + least(greatest(sqrt(p), sa), sb) - sa) AS f FROM c),
g AS (SELECT *, own * pow(10::DOUBLE, (d0 + d1) / 2) AS raw, greatest(0, -0.5 * own * (f[1] - 2 * f[2] + f[3]) / (h * h) * mid * mid * 0.5) AS loss, mid > p0 * 0.8 AND mid < p0 * 1.25 AND v IS NOT NULL AS counts FROM e),
k AS (SELECT pool, count(*) AS n, sum(CASE WHEN counts THEN v * tier / 1e6 * CASE WHEN lp_fee_fraction IS NULL OR isnan(lp_fee_fraction) THEN 1 ELSE lp_fee_fraction END * raw / (greatest(active, 0) + raw) END) AS fee,
  sum(CASE WHEN counts THEN loss * greatest(nxt - us, 0) END) AS weighed, sum(CASE WHEN counts THEN greatest(nxt - us, 0) END) AS gap, avg(CASE WHEN counts THEN loss END) AS plain,
  greatest((max(us) - min(us)) / 1e6, 1) AS seconds FROM g GROUP BY pool)
SELECT pool, n, round(COALESCE(fee, 0) / 10000 * (365 * 86400 / seconds), 6) AS fee_yield, round(COALESCE(CASE WHEN gap > 0 THEN weighed / gap END, plain, 0) / 10000, 6) AS loss_yield FROM k WHERE n >= 2""",
    "value_increments": f"""WITH {tapes._PRICE}, p AS (SELECT pool, block_number, log_index, price, first_value(price) OVER w AS p0, lag(price) OVER w AS before FROM x WINDOW w AS (PARTITION BY pool ORDER BY block_number, log_index)),
i AS (SELECT *, abs(price / p0 - 1) < 0.02 AS inside FROM p)
SELECT block_number, log_index, COALESCE(round(ln(price / before), 9), 0) + 0.0::DOUBLE AS change, inside, COALESCE(lag(inside) OVER (PARTITION BY pool ORDER BY block_number, log_index), FALSE) AS was_inside FROM i""",
    "seeded_rates": f"""WITH {tapes._M}, h AS (SELECT source, symbol, tm - tm % 3600000000 AS slot_us, least(arg_max(mid, ROW(tm, ref_id)) * 1e-3, 0.5) AS rate FROM m GROUP BY ALL),
s AS (SELECT source, symbol, (SELECT min(slot_us) FROM h) AS slot_us, arg_min(rate, slot_us) AS rate FROM h GROUP BY source, symbol),
u AS (SELECT * FROM h UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source = s.source AND h.symbol = s.symbol AND h.slot_us = s.slot_us)), x AS (SELECT *, rate / 31536000 AS x FROM u)
SELECT source, symbol, slot_us, round(exp(31536000 * (x - x * x / 2 + x * x * x / 3)) - 1, 8) AS yearly FROM x""",
    "blocks_around": """WITH b AS (SELECT block_number, min(epoch_us(timestamp)) AS tm FROM pool_events WHERE timestamp IS NOT NULL GROUP BY 1),
l AS (SELECT tm, max(block_number) AS block FROM b GROUP BY 1), f AS (SELECT tm, min(block_number) AS block FROM b GROUP BY 1), t AS (SELECT target_id, epoch_us(target_timestamp) AS us FROM swap_targets),
x AS (SELECT t.*, l.block AS last_before FROM t ASOF LEFT JOIN l ON t.us >= l.tm)
SELECT x.target_id, x.last_before, f.block AS first_after FROM x ASOF LEFT JOIN f ON x.us <= f.tm""",
    "chunk_seeds": f"""WITH {tapes._TAPE}, t AS (SELECT *, lower(trim(pool)) AS p FROM tape), e AS (SELECT DISTINCT p AS pool, block_number - block_number % {CHUNK_BLOCKS} AS first_block FROM t),
c AS (SELECT p AS pool, block_number, arg_max(fee_protocol0_new | (fee_protocol1_new << 4), log_index) AS packed FROM t WHERE event = 'SetFeeProtocol' AND fee_protocol0_new IS NOT NULL AND fee_protocol1_new IS NOT NULL GROUP BY ALL)
SELECT e.pool, first_block, COALESCE(packed, 0)::INTEGER AS packed FROM e ASOF LEFT JOIN c ON e.pool = c.pool AND e.first_block > c.block_number""",
    "seeded_fee_state": f"""WITH {tapes._TAPE}, o AS (SELECT lower(trim(pool)) AS p, arg_min(fee_protocol_packed, ROW(block_number, log_index, state_id)) AS packed FROM fee_states WHERE fee_protocol_packed IS NOT NULL GROUP BY 1),
s AS (SELECT event, lower(trim(pool)) AS p, block_number, log_index, last_value(CASE WHEN event = 'SetFeeProtocol' THEN fee_protocol0_new | (fee_protocol1_new << 4) END IGNORE NULLS)
  OVER (PARTITION BY lower(trim(pool)) ORDER BY block_number, log_index) AS packed FROM tape)
SELECT block_number, log_index, COALESCE(s.packed, o.packed)::INTEGER AS packed FROM s LEFT JOIN o USING (p) WHERE event = 'Swap'""",
    "resumed_parts": "SELECT event, count(*) AS n, max(delivery_id) AS last_id FROM pool_events GROUP BY event",
    "zip_round_trip": "SELECT venue, count(*) AS n, max(record_id) AS last_id, max(CASE WHEN NOT isnan(price) THEN price END) AS largest FROM venue_trades GROUP BY venue",
    "percentile_interval": f"""WITH {tapes._M} SELECT source, symbol, count(*) AS n, round(quantile_cont(mid, 0.025), 6) AS low, round(quantile_cont(mid, 0.975), 6) AS high FROM m GROUP BY source, symbol""",
}
