"""Queries do the whole job: what a shorter list, a fixed window or a dropped part would leave out."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np

from tidemark.operators import fold, inference, series
from tidemark.plans import tapes


def test_rates_are_integrated_over_all_readings(spark, tmp_path):
    start = datetime(2025, 1, 5, 0, 10, tzinfo=timezone.utc)
    data = [("m", "a", i, 100.0 + i, True, start + timedelta(hours=i)) for i in range(200)] + [("m", "b", 999, 100.0, True, start + timedelta(hours=190))]
    df = spark.createDataFrame(data, "source string, symbol string, ref_id bigint, mid double, regime_eligible boolean, timestamp timestamp")
    df.write.parquet(str(tmp_path / "reference.parquet"))
    got = {r.symbol: (r.total, r.covered) for r in tapes.rate_integral_whole(spark, str(tmp_path)).collect()}
    want = 1.0
    for i in range(200):
        want *= (1 + (100 + i) * 1e-3) ** (1 / 8760)
    assert abs(got["a"][0] - (want - 1)) < 1e-11 and got["a"][1]
    assert abs(got["b"][0] - (1.1 ** (10 / 8760) - 1)) < 1e-11 and not got["b"][1]
    assert series.yield_over(df.selectExpr("symbol", "ref_id as us", "mid as r"), ["symbol"], "us", "r", 0, 0).count() == 0


def looped(tape, capital, low, high, band, bps):
    """The replay as one loop over (pool price, reference, fee, others' liquidity, funding)."""
    lower, upper = tape[0][0] * low, tape[0][0] * high

    def amounts(p):
        at = math.sqrt(min(max(p, lower), upper))
        return (1 / at - 1 / math.sqrt(upper)), (at - math.sqrt(lower))

    a0, a1 = amounts(tape[0][1])
    mine = capital / (a0 * tape[0][1] + a1)
    out, held, last = [], 0.0, None
    for i, (p, r, fee, others, paid) in enumerate(tape):
        a0, a1 = (mine * x for x in amounts(p))
        value, inside = a0 * r + a1, lower < p < upper
        lp, hedge, funding = (value - last[0], -held * (r - last[1]), held * paid) if last else (0.0, 0.0, 0.0)
        earned = fee * mine / (max(others, 0.0) + mine) if others is not None and inside and (last is None or last[2]) else 0.0
        new = a0 if last is None or abs(a0 - held) * r > band else held
        cost, trades = abs(new - held) * r * bps / 1e4, int(new != held)
        if i == len(tape) - 1:
            cost, trades = cost + new * r * bps / 1e4, trades + int(new > 0)
        out.append((lp, earned, hedge, funding, -cost, lp + earned + hedge + funding - cost, trades))
        held, last = new, (value, r, inside)
    return out


def test_replay_with_share_funding_and_close(spark):
    rng = np.random.default_rng(5)
    p = 3000 * np.exp(rng.normal(0, 0.03, 300).cumsum())
    tape = [(float(x), float(x * rng.uniform(0.999, 1.001)), float(rng.uniform(0, 9)), float(rng.uniform(0, 5000)), float(rng.choice([0.0, 0.1]))) for x in p]
    tape[7] = (*tape[7][:3], None, 0.0)
    df = spark.createDataFrame([("k", i, 0, *x) for i, x in enumerate(tape)], "pool string, i int, day int, p double, r double, fee double, others double, paid double")
    got = fold.replay(df, "pool", ["i"], "day", "p", "r", 10_000.0, 0.8, 1.25, "fee", 50.0, 2.0, "others", "paid").orderBy("i").collect()
    want = looped(tape, 10_000.0, 0.8, 1.25, 50.0, 2.0)
    crossed = sum(not 0.8 * p[0] < x < 1.25 * p[0] for x in p)
    assert 0 < crossed < 300 and len(got) == 300
    for g, w in zip(got, want):
        assert np.allclose((g.lp_inc, g.fee_inc, g.hedge_inc, g.funding_inc, g.cost_inc, g.net_inc, g.trades), w, rtol=1e-9, atol=1e-7)


def test_swaps_of_both_sides_earn_tier_times_fraction_times_share(spark, tmp_path):
    at = datetime(2025, 1, 5, 0, 59, 50, tzinfo=timezone.utc)
    root = str(int(2**96 * math.sqrt(2000e-12)))
    swap = lambda i, s, a0, a1, own: (i, "P ", "Swap", 100 + i, 1, at + timedelta(seconds=s), a0, a1, root, str(10**18), own, None, None)
    data = [
        swap(1, 0, 1.0, -2000.0, 0.1), swap(2, 4, -1.0, 2000.0, 0.1), (3, "P", "SetFeeProtocol", 102, 9, at, None, None, None, None, None, 4, 5),
        swap(4, 8, 3.0, -6000.0, 0.1), swap(5, 12, -1.0, 2000.0, 0.1), swap(6, 100, 1.0, -1.0, 0.1),
    ]
    kind = "delivery_id bigint, pool string, event string, block_number bigint, log_index int, timestamp timestamp, amount0 double, amount1 double, sqrt_price_x96 string, liquidity string, lp_fee_fraction double, fee_protocol0_new int, fee_protocol1_new int"
    write = lambda rows, kind, name: spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    write(data, kind, "pool_events")
    write([("p", "S", 3000, 18, 6)], "pool string, symbol string, fee_tier_pips int, token0_decimals int, token1_decimals int", "pools")
    write([(1, "P", 100, 0, 0, 100), (2, "P", 100, 0, 6, 900)], "state_id bigint, pool string, block_number bigint, log_index int, fee_protocol_packed int, recorded_block bigint", "fee_states")
    ref = [(i, "S", "x", at + timedelta(seconds=i), 2100.0, True, False) for i in range(14)] + [(99, "S", tapes.METRIC, at - timedelta(seconds=60), 200.0, False, True)]
    write(ref, "ref_id bigint, symbol string, source string, timestamp timestamp, mid double, alignment_eligible boolean, regime_eligible boolean", "reference")
    r = tapes.replay_daily(spark, str(tmp_path)).collect()
    lower, upper = 1600.0, 2500.0
    mine = 10_000 / ((1 / math.sqrt(2100) - 1 / math.sqrt(upper)) * 2100 + math.sqrt(2100) - math.sqrt(lower))
    share = mine / (10**18 / 10**12 + mine)
    paid = 2100 * (1 - 1 / 6) + 2000 + 3 * 2100 * (1 - 1 / 4) + 2000 * (1 - 1 / 5)
    held = mine * (1 / math.sqrt(2000) - 1 / math.sqrt(upper))
    assert len(r) == 1 and abs(r[0].fee_inc - paid * 0.003 * share) < 1e-9
    assert abs(r[0].cost_inc + 2 * held * 2100 * 2e-4) < 1e-9
    assert abs(r[0].funding_inc - held * 200 * 0.2 / 8760) < 1e-9
    sweep = {x.capital: x for x in tapes.capital_replay(spark, str(tmp_path), (1e4, 1e5)).collect()}
    assert abs(sweep[1e4].net - r[0].net_inc) < 1e-9 and sweep[1e5].trades == 2


def summed(x, end):
    """tau by the loop of the reference."""
    d = np.asarray(x) - np.mean(x)
    rho = [float(np.mean(d[: len(d) - k] * d[k:])) / float(np.mean(d * d)) for k in range(end + 1)]
    total, k = 0.0, 1
    while k <= end:
        part = sum(rho[k : k + 2])
        if part <= 0:
            break
        total, k = total + part, k + 2
    return max(1.0, 1 + 2 * total), k


def test_block_length_follows_positive_pairs_beyond_the_first_lags(spark):
    x = list(np.sin(np.arange(300) / 40))
    want, stop = summed(x, 299)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    assert abs(inference.mean_block_length(df, "i", "v", 4).first().tau - want) < 1e-9
    assert stop > 5
