import gzip
import math
import random
import zipfile
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import amm
from tidemark.operators import asof, fold, inference, lots, series
from tidemark.operators.fold import follow
from tidemark.sources import archives
from tidemark.streaming.dedup import flag_repeated


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_against_brute_force(spark, direction):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 40_000_000, 377_000)])) for i in range(200)]
    right = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 40_000_000, 750_000)])) for i in range(60)]
    l = spark.createDataFrame(left, "id int, k string, us bigint")
    r = spark.createDataFrame(right, "rid int, k string, at bigint").withColumn("us", F.lit(1))
    for tol in (0, 500_000, 2_000_000):
        got = dict(rows(asof.asof_join(l, r, ["k"], "us", "at", "rid", ["rid"], tol, direction).select("id", "ref_rid")))
        for i, k, t in left:
            fit = [(abs(t - u), j) for j, m, u in right if k is not None and m == k and t is not None and u is not None and abs(t - u) <= tol and (u <= t) == (direction == "backward" or u == t)]
            assert got[i] == (min(fit)[1] if fit else None), (i, tol)
    assert asof.asof_join(l.limit(0), r, ["k"], "us", "at", "rid", ["rid"], 5).count() == 0


def test_coverage_and_fallback(spark):
    m = spark.createDataFrame([(1, 100, 5), (2, None, 1), (3, 900, None), (4, 400, 4)], "id int, age bigint, n bigint")
    assert [r[:4] for r in rows(asof.coverage_by_age(m, "age", "n", [500, 100], 0.9).orderBy("max_age_us"))] == [(100, 10, 5, 5), (500, 10, 9, 1)]
    p = spark.createDataFrame([(1, 1.0), (2, None)], "id int, v double")
    f = spark.createDataFrame([(1, 9.0), (2, 2.0), (3, None)], "id int, v double")
    assert sorted(rows(asof.prefer(p, f, "id", ["v"]))) == [(1, 1.0, "primary"), (2, 2.0, "fallback"), (3, None, None)]


def test_fifo_against_a_queue(spark):
    rng = random.Random(9)
    tape = [(rng.choice("ab"), i, rng.choice([None, 0, *range(-60, 60)]), i // 2) for i in range(300)]
    want = []
    for key in "ab":
        queue = deque()
        for k, _, a, b in tape:
            if k != key or not a:
                continue
            if a > 0:
                queue.append([b, a])
            else:
                out = -a
                while out and queue:
                    use = min(out, queue[0][1])
                    want.append((k, queue[0][0], b, use, b - queue[0][0]))
                    out -= use
                    queue[0][1] -= use
                    if not queue[0][1]:
                        queue.popleft()
    df = spark.createDataFrame(tape, "k string, i int, a int, b bigint")
    got = lots.fifo_lots(df, ["k"], ["i"], "a", "b").select("k", "in_block", "out_block", F.col("amount").cast("int"), "lifetime")
    assert sorted(rows(got)) == sorted(want)
    short = lots.fifo_lots(df, ["k"], ["i"], "a", "b", 3)
    assert short.count() == sum(w[4] <= 3 for w in want)


def test_interval_sums_and_overlap(spark):
    rng = random.Random(2)
    ev = [(rng.choice("ab"), rng.randrange(1000), float(rng.randrange(9))) for _ in range(200)] + [("a", None, 1.0), (None, 5, 1.0)]
    iv = [(i, rng.choice("ab"), s := rng.randrange(900), s + rng.randrange(300)) for i in range(60)] + [(99, "a", None, 5), (98, "zz", 1, 900)]
    e = spark.createDataFrame(ev, "k string, t bigint, v double")
    i = spark.createDataFrame(iv, "id int, k string, s bigint, e bigint")
    got = {r.id: (r.total, r.n_events) for r in lots.sums_over_intervals(i, e, "k", "s", "e", "t", "v", 37).collect()}
    for n, k, s, z in iv:
        fit = [v for m, t, v in ev if s is not None and m == k and t is not None and s < t <= z]
        assert got[n] == ((sum(fit), len(fit)) if s is not None else (None, None))
    lot = spark.createDataFrame([("p", 10, 12, -10, 10, 100), ("p", 11, 11, 0, 5, 7)], "pool string, in_block bigint, out_block bigint, tick_lower int, tick_upper int, amount bigint")
    pts = spark.createDataFrame([(1, "p", 11, 0), (2, "p", 12, 9), (3, "p", 12, 10), (4, "p", 11, 5), (5, None, 11, 0)], "id int, pool string, b bigint, t int")
    out = {r.id: r.active for r in lots.active_amounts(pts, lot, "pool", "b", "t", 3).collect()}
    assert out == {1: 107.0, 2: 100.0, 3: 0.0, 4: 100.0, 5: 0.0}


def slow(t, p, b):
    out = []
    for x, y, z in zip(t, p, b):
        out.append(x if not out or abs(x - out[-1]) * y > z else out[-1])
    return out


def test_band_path_in_batch_and_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = []
    for k in ["a", "b", None]:
        t, p, b = rng.normal(size=(3, 1500)).cumsum(1) if k else rng.normal(size=(3, 40))
        p, b = abs(p) + 1, abs(b)
        assert np.array_equal(follow(t, p, b, None), slow(t, p, b))
        data += [(k, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(t, p, b))]
    df = spark.createDataFrame(data, "k string, i bigint, t double, p double, b double").repartition(7)
    got = {(r.k, r.i): r.held for r in fold.band_path(df, "k", ["i"], "t", "p", "b").collect()}
    for k in ["a", "b", None]:
        own = [x for x in data if x[0] == k]
        assert [got[k, x[1]] for x in own] == slow(*zip(*[x[2:] for x in own]))
    for part in range(3):
        df.where((F.col("i") / 500).cast("int") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).where("k is not null")
    q = fold.band_stream(s, "k", "i", "t", "p", "b").writeStream.format("memory").queryName("held").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    stream = {(r.k, r.i): r.held for r in spark.table("held").collect()}
    assert stream == {x: v for x, v in got.items() if x[0] is not None}


def test_replay_increments_add_up(spark):
    rng = np.random.default_rng(1)
    price = 3500 * np.exp(rng.normal(0, 0.004, 600).cumsum())
    df = spark.createDataFrame([("p", i, 0, float(x), float(x), 1.0) for i, x in enumerate(price)], "pool string, i int, day int, pool_price double, ref double, fee double")
    r = fold.replay(df, "pool", ["i"], "day", "pool_price", "ref", 10_000.0, 0.8, 1.2, "fee", 50.0, 2.0).orderBy("i").collect()
    assert abs(sum(x.net_inc for x in r) - sum(x.lp_inc + x.fee_inc + x.hedge_inc + x.cost_inc for x in r)) < 1e-6
    held = [x.held for x in r]
    cash = -sum(held[i - 1] * (price[i] - price[i - 1]) for i in range(1, 600))
    assert abs(sum(x.hedge_inc for x in r) - cash) < 1e-6 and len(r) == 600


def test_streamed_ranges_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    data = [(i, rng.randrange(5), rng.randrange(60)) for i in range(900)]
    df = spark.createDataFrame(data, "delivery_id bigint, block_number bigint, log_index int")
    for part in range(3):
        df.where((F.col("delivery_id") / 300).cast("int") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flag_repeated(s, span=16).writeStream.format("memory").queryName("flags").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    seen, want = set(), set()
    for i, b, n in data:
        if (b, n) in seen:
            want.add(i)
        seen.add((b, n))
    assert {r.delivery for r in spark.table("flags").where("surplus").collect()} == want


def test_series(spark):
    d = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 3 * series.DAY_US, 2.0, 2), ("a", 10, None, 3), (None, 5, 1.0, 4)], "k string, us bigint, v double, i int")
    assert sorted(rows(series.daily_sums(d, ["k"], "us", "v", True).where("k = 'a'"))) == [("a", 0, 1.0), ("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 2.0)]
    assert series.largest_gaps(d.where("k = 'a'"), ["k"], "us", 1000).first().max_gap_us == 3 * series.DAY_US - 10
    year = 365 * 86400 * 10**6
    r = spark.createDataFrame([("a", -5, 0.1), ("b", year // 2, 0.1)], "k string, us bigint, r double")
    out = {x.k: (round(x.total, 10), x.covered) for x in series.yield_over(r, ["k"], "us", "r", 0, year).collect()}
    assert out == {"a": (0.1, True), "b": (round(1.1**0.5 - 1, 10), False)}


def test_inference(spark):
    rng = np.random.default_rng(0)
    x = [0.0]
    for e in rng.normal(size=2000):
        x.append(0.9 * x[-1] + e)
    ar = spark.createDataFrame(list(enumerate(map(float, x))), "i int, v double")
    iid = spark.createDataFrame(list(enumerate(map(float, rng.normal(size=2000)))), "i int, v double")
    long, short = (inference.mean_block_length(d, "i", "v", 60).first().blocks for d in (ar, iid))
    assert long > 8 > short >= 1
    b = inference.bootstrap_sums(iid, "i", "v", 200, 5.0)
    ci = inference.interval(b, "total").first()
    assert ci.low < sum(r.v for r in iid.collect()) < ci.high and rows(b.orderBy("rep"))[:3] == rows(b.orderBy("rep"))[:3]
    got = {r.effect: (r.reps, r.power) for r in inference.power(iid, "i", "v", 200, (-1.0, 1.0), 10, 20, 1.0).collect()}
    assert got == {-1.0: (10, 0.0), 1.0: (10, 1.0)}
    assert inference.power(iid.limit(0), "i", "v", 20, (1.0,), 3, 3).count() == 0 == inference.bootstrap_sums(iid.limit(0), "i", "v", 5, 2.0).count()
    s = iid.withColumn("s", F.when(F.col("i") % 4 == 0, 1).otherwise(-1)).withColumn("v", F.lit(2.0))
    assert {round(r[1], 9) for r in rows(inference.shuffled_sign_null(s, "s", "v", 5))} == {round(2 * (500 - 1500) / 2000, 9)}
    n = rows(inference.shuffled_sign_null(iid.withColumn("s", F.when(F.col("i") % 2 == 0, 1).otherwise(-1)), "s", "v", 200))
    assert abs(np.mean([v for _, v in n])) < 0.01 and 0.015 < np.std([v for _, v in n]) < 0.03


def test_position_arithmetic(spark):
    c = F.lit
    one = spark.range(1)
    a0, a1 = amm.position_amounts(amm.liquidity_for_value(c(10000.0), c(3500.0), c(2800.0), c(4200.0)), c(3500.0), c(2800.0), c(4200.0))
    r = one.select(
        (a0 * 3500 + a1).alias("v"), amm.price_of_sqrt(c(math.sqrt(3500 / 1e12) * 2**96), 18, 6).alias("p"), amm.tick_of_price(amm.price_of_tick(c(100), 18, 6) * 1.00001, 18, 6).alias("t"),
        amm.position_amounts(c(1.0), c(-1.0), c(1.0), c(2.0))[0].alias("bad"), amm.compounded(c(0.05e27)).alias("apy"), amm.pack_nibbles(c(4), c(6)).alias("pk"),
        amm.wide_text(c(" -000" + str(2**159))).alias("w"), amm.wide_text(c("1.5")).alias("nw"), amm.wide_text(c("000")).alias("z"),
        amm.gamma(c(1.0), c(100.0), c(50.0), c(200.0)).alias("g"), amm.annualised(c(0.1), c(365.0)).alias("an"), amm.clipped_share(c(3.0), c(0.0)).alias("sh"),
    ).first()
    assert abs(r.v - 10000) < 1e-6 and abs(r.p - 3500) < 1e-6 and r.t == 100 and r.bad is None and 0.0512 < r.apy < 0.0514
    assert r.pk == 100 and r.w == "-" + str(2**159) and r.nw is None and r.z == "0" and abs(r.g + 0.5 * 100**-1.5) < 1e-6 and abs(r.an - 0.1) < 1e-9 and r.sh == 0


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", "1,3000.5,,1735689600000000\n2,3001,7,1735689600000\n")
    got = archives.read_zip_csv(spark, str(tmp_path), ["id", "price", "q", "t"], chunk_rows=1)
    assert sorted(rows(got.select("id", "price", "q", F.unix_micros(archives.epoch_time(F.col("t")))))) == [("1", "3000.5", None, 1735689600000000), ("2", "3001", "7", 1735689600000000)]
    with gzip.open(tmp_path / "y.csv.gz", "wt") as f:
        f.write("timestamp,price,extra\n1,2.5,a\nbad,3,b\n")
    g = archives.read_gzip_csv(spark, str(tmp_path / "y.csv.gz"), "timestamp bigint, price double, more string", ["timestamp", "price"])
    assert sorted(rows(g), key=str) == [(1, 2.5, None), (None, 3.0, None)]
    with pytest.raises(ValueError):
        archives.read_gzip_csv(spark, str(tmp_path / "y.csv.gz"), "price double", ["lost"])
    df = spark.createDataFrame([(1, str(2**200)), (2, None)], "day int, wide string")
    archives.write_table(df, str(tmp_path / "t"), ["wide"], ["day"])
    assert sorted(rows(archives.read_parts(spark, str(tmp_path / "t")).select("day", "wide")), key=str) == [(1, str(2**200)), (2, None)]
    assert archives.file_identities(spark, str(tmp_path / "t")).where("name like 'part-%'").count() == 2
    n = spark.createDataFrame([("2026-01-01 00:00:00", None, 1.0, 3.0), ("2026-01-01 00:00:01", 5.0, 1.0, 3.0)], "timestamp string, price double, bid double, ask double")
    assert sorted(r.mid for r in archives.normalise_reference(n, "s").collect()) == [2.0, 5.0]
