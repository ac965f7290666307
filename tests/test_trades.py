import math
import random
import zipfile
from collections import defaultdict
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import amm
from tidemark.operators import asof, fold, inference, lots, ordered, series
from tidemark.session import scratch, written
from tidemark.sources import archives

rows = lambda df: [tuple(r) for r in df.collect()]


def test_quantiles_against_numpy(spark):
    rng = random.Random(1)
    data = [(k, rng.choice([0.0, -0.0, 1e-320, None, float("nan"), rng.gauss(0, 100), rng.gauss(0, 1e-9), 1e300, -5.0])) for k in ("hot", "cold", None) for _ in range(300 if k == "hot" else 8)]
    df = spark.createDataFrame([*data, ("none", None)], "k string, v double").repartition(5)
    wanted = {"a": 0.0, "b": 0.5, "c": 0.975, "d": 1.0}
    got = {r.k: r for r in series.quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"hot", "cold", None}
    for k, r in got.items():
        v = [x for n, x in data if n == k and x is not None and x == x]
        assert r.n == len(v) and all(math.isclose(r[n], np.quantile(v, q), rel_tol=1e-9, abs_tol=1e-300) for n, q in wanted.items())
    assert len(rows(series.quantiles(df, [], "v", wanted))) == 1 and series.quantiles(df.limit(0), ["k"], "v", wanted).count() == 0


def test_gaps_to_the_ends_of_a_window(spark):
    d = spark.createDataFrame([("a", 10), ("a", 40), ("a", 45), ("a", 400), ("b", 500), (None, 20), ("c", None)], "k string, t bigint")
    got = {r.k: (r.n, r.max_gap_us) for r in series.gaps_in_window(d, ["k"], "t", 0, 100, 16).collect()}
    assert got == {"a": (3, 55), "b": (0, 100), None: (1, 80), "c": (0, 100)}


def test_blocks_on_both_sides(spark):
    b = spark.createDataFrame([(5, 100), (6, 100), (7, 250_000_000_000)], "block bigint, at bigint")
    i = spark.createDataFrame([(1, 99), (2, 100), (3, 101), (4, 250_000_000_001), (5, None), (2, 100)], "id int, us bigint")
    got = sorted(rows(asof.bounds_of(i, "us", b, "block", "at").select("id", "last_before", "first_after")))
    assert got == [(1, None, 5), (2, 6, 5), (2, 6, 5), (3, 6, 7), (4, 7, None), (5, None, None)]


def test_lookup_fails_only_where_it_must(spark):
    e = spark.createDataFrame([(1, 10), (2, 11), (None, 12)], "b int, at int")
    t = spark.createDataFrame([(1, None), (2, "x")], "b int, at string")
    assert sorted(rows(ordered.lookup(e, t, ["b"], {"name": "at"})), key=str) == [(1, 10, None), (2, 11, "x"), (None, 12, None)]
    assert len(rows(ordered.lookup(e.where("b is not null"), t, ["b"], {"name": "at"}, required=True))) == 2
    with pytest.raises(Exception, match="no row for"):
        ordered.lookup(e, t, ["b"], {"name": "at"}, required=True).collect()


def test_first_source_with_a_match(spark):
    l = spark.createDataFrame([(1, "a", 100), (2, "a", 500), (3, "b", 100), (4, "a", None), (1, "a", 100)], "id int, k string, us bigint")
    r = spark.createDataFrame([(1, "a", "p", 90, 1.0), (2, "a", "f", 99, 2.0), (3, "a", "f", 495, 3.0), (4, "a", "x", 500, 9.0), (5, "b", "p", 101, 4.0)], "rid int, k string, s string, at bigint, mid double")
    p = asof.prefer_source(l, r, ["k"], "id", "us", "at", "rid", ["mid"], "s", ("p", "f"), 50)
    assert sorted(rows(p.select("id", "chosen", "ref_us", "ref_mid"))) == [(1, "p", 90, 1.0), (2, "f", 495, 3.0), (3, None, None, None), (4, None, None, None)]
    cover = spark.createDataFrame([(1, False), (2, True), (3, True)], "max_age_us bigint, passes boolean")
    assert asof.smallest_passing(cover).first()[0] == 2 and asof.smallest_passing(cover.where("not passes")).first()[0] is None


def test_one_row_by_a_unique_number(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (None, 9, "c"), (None, 8, "d"), (2, None, "e")], "k int, i int, v string")
    for unique in (True, False):
        assert sorted(rows(ordered.keep_one(df, ["k"], "i", unique=unique)), key=str) == [(1, 3, "b"), (None, 8, "d")]
        assert sorted(rows(ordered.keep_one(df, ["k"], "i", True, unique)), key=str) == [(1, 5, "a"), (None, 9, "c")]


def test_edge_of_the_band(spark):
    rng = np.random.default_rng(4)
    t, p, b = rng.normal(size=3000).cumsum(), abs(rng.normal(size=3000)) + 0.5, abs(rng.normal(size=3000)) * 3
    p[7] = 0.0
    want, held = [], None
    for x, y, z in zip(t, p, b):
        if held is None:
            held = x
        elif y > 0 and abs(x - held) * y > z:
            held = x - math.copysign(z / y, x - held)
        want.append(held)
    df = spark.createDataFrame([("k", i, *map(float, v)) for i, v in enumerate(zip(t, p, b))], "k string, i int, t double, p double, b double").repartition(5)
    got = fold.band_path(df, "k", ["i"], "t", "p", "b", edge=True).orderBy("i").collect()
    assert np.allclose([r.held for r in got], want, atol=1e-9)
    assert fold.band_path(df.limit(0), "k", ["i"], "t", "p", "b", edge=True).count() == 0


def test_lots_of_three_blocks_by_owner_and_range(spark):
    """A burn of one range takes nothing from another range, nor from another owner's lots."""
    tape = [("A", 0, 10, 100, 1, "50"), ("A", 0, 10, 101, 2, "-20"), ("a", 0, 10, 103, 3, "-20"), ("a", 0, 10, 104, 4, "-10"), ("a", 0, 20, 100, 5, "70"), ("b", 0, 10, 101, 6, "-30")]
    df = spark.createDataFrame(tape, "owner string, lo int, hi int, block bigint, i int, amount string").withColumn("owner", F.lower("owner"))
    got = lots.fifo_lots(df, ["owner", "lo", "hi"], ["block", "i"], "amount", "block", 3)
    assert sorted(rows(got.select("owner", "lo", "hi", "in_block", "out_block", F.col("amount").cast("int"), "lifetime"))) == [("a", 0, 10, 100, 101, 20, 1), ("a", 0, 10, 100, 103, 20, 3)]


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(12)
    lot = [(rng.choice("pq"), b := rng.randrange(40), b + rng.randrange(6), t := rng.randrange(-6000, 6000), t + rng.randrange(1, 5000), rng.randrange(1, 10**6)) for _ in range(150)]
    pts = [(i, rng.choice(["p", "q", None]), rng.randrange(45), rng.choice([None, *range(-6000, 6000, 137)]), "x") for i in range(200)]
    l = spark.createDataFrame(lot, "pool string, in_block bigint, out_block bigint, tick_lower int, tick_upper int, amount bigint")
    p = spark.createDataFrame([*pts, pts[0]], "id int, pool string, b int, t int, active string").drop("active")
    got = lots.active_amounts(p, l, "pool", "b", "t", 3, tick_width=512).collect()
    assert len(got) == 201
    for r in got:
        assert r.active == sum(a for k, x, y, lo, hi, a in lot if None not in (r.pool, r.t) and k == r.pool and y - x <= 3 and x <= r.b <= y and lo <= r.t < hi)
    assert lots.active_amounts(p, l.limit(0), "pool", "b", "t", 3).agg(F.sum("active")).first()[0] == 0.0


def test_swap_markouts(spark):
    s = spark.createDataFrame([(1, "k", 0, -2.0, 5.0, 2.0), (2, "k", 0, 2.0, -5.0, 2.0), (3, "k", 0, float("nan"), 5.0, 2.0), (4, "k", 0, 1.0, 0.0, 2.0), (5, "k", 0, 1.0, 2.0, None)], "id int, k string, us bigint, a0 double, a1 double, mid double")
    r = spark.createDataFrame([(1, "k", 30_500_000, 3.0)], "rid int, k string, at bigint, mid double")
    got = sorted(rows(inference.swap_markouts(s, r, "k", "id", "us", "at", "rid", "mid", "mid", "a0", "a1", (30, 60), 1_000_000).where("horizon_seconds = 30").select("id", "direction", "exec_price", F.round("edge_bps", 6), F.round("info_bps", 6), F.round("exec_bps", 6))))
    assert got == [(1, 1, 2.5, -2000.0, 5000.0, 2000.0), (2, -1, 2.5, 2000.0, -5000.0, -2000.0), (3, None, None, None, None, None), (4, -1, None, None, -5000.0, None)]


def test_sign_null_by_group(spark):
    rng = np.random.default_rng(5)
    data = [(h, int(rng.choice([1, -1])), float(rng.normal() * h) if rng.random() > 0.2 else None) for h in (1, 10) for _ in range(1500)]
    null = inference.shuffled_sign_null(spark.createDataFrame(data, "h int, s int, v double"), "s", "v", 300, by="h")
    got = {r.h: r for r in inference.null_summary(null, "h").collect()}
    assert set(got) == {1, 10} and null.count() == 600
    for h, r in got.items():
        v = np.array([x for g, _, x in data if g == h and x is not None])
        s = np.array([x for g, x, _ in data if g == h])
        brute = [float(np.mean(rng.permutation(s)[: len(v)] * v)) for _ in range(600)]
        assert abs(r.null_low - np.quantile(brute, 0.025)) < 0.02 * h and abs(r.null_high - np.quantile(brute, 0.975)) < 0.02 * h


def test_decoding(spark):
    c, one = F.lit, spark.range(1)
    r = one.select(
        amm.scaled(c("-1500000"), 6).alias("a"), amm.signed_delta(c(" -007"), c("Mint")).alias("m"), amm.signed_delta(c("7"), c("Burn")).alias("b"), amm.signed_delta(c("0"), c("Burn")).alias("z"),
        amm.signed_delta(c("7"), c("Swap")).alias("s"), amm.pro_rata_fee(c(10.0), c(1.0), c(3.0)).alias("f"), amm.pro_rata_fee(c(10.0), c(1.0), c(-3.0)).alias("all"), amm.pro_rata_fee(c(10.0), c(0.0), c(0.0)).alias("none"),
        amm.price_or_reference(c(0.0), c(7.0), 18, 6).alias("p"), amm.raw_price(c(3500.0), 18, 6).alias("raw"), amm.input_value(c(2.0), c(-9.0), c(3.0)).alias("i0"), amm.input_value(c(float("nan")), c(9.0), c(3.0)).alias("i1"),
        amm.input_value(c(0.0), c(None), c(3.0)).alias("i2"), amm.raw_liquidity(c(2.0), 18, 6).alias("l"),
    ).first()
    assert (r.a, r.m, r.b, r.z, r.s, r.f, r["all"], r.none, r.p, r.i0, r.i1, r.i2) == (-1.5, "7", "-7", "0", None, 2.5, 10.0, 0.0, 7.0, 6.0, 9.0, None)
    assert math.isclose(r.raw, 3500 / 1e12) and math.isclose(r.l, 2e12)
    rng = random.Random(2)
    texts = [None, "", "0x", "zz", "0x0", "FF", " 0xff ", "f" * 64, "1" + "0" * 63, "0" * 65, *[f"0x{rng.getrandbits(rng.randrange(1, 257)):x}" for _ in range(60)]]
    want = [str(int(t, 16)) if t and t.strip().lower().removeprefix("0x").strip("0123456789abcdef") == "" and t.strip().lower() != "0x" and len(t.strip()) <= 66 and len(t.strip().lower().removeprefix("0x")) <= 64 else None for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", amm.hex_integer("t")).orderBy("i").collect()
    assert [x[1] for x in got] == want


def test_windows(spark):
    at = lambda *a: datetime(*a, tzinfo=UTC)
    d = spark.createDataFrame([(1, at(2025, 1, 1)), (2, at(2025, 1, 2, 23, 59, 59, 999999)), (3, at(2025, 1, 3)), (4, None)], "i int, ts timestamp")
    ids = lambda a, z: [r.i for r in archives.in_window(d, "ts", a, z).orderBy("i").collect()]
    assert ids("2025-01-01", "2025-01-02") == [1, 2] and ids("2025-01-01", "2025-01-02T00:00:00Z") == [1] and ids("2025-01-02", "2025-01-03 00:00:00+00:00") == [2, 3]
    with pytest.raises(ValueError):
        archives.in_window(d, "ts", "2025-01-03", "2025-01-02")


def test_reference_rows(spark):
    r = spark.createDataFrame([(1, "a", "t1"), (3, "a", "t1"), (2, "a", "t2"), (5, "b", "t1"), (6, "a", None), (7, "a", None)], "i int, source string, timestamp string")
    assert sorted(x.i for x in archives.keep_last_by_time(r, ["source"], "i").collect()) == [2, 3, 5, 7]
    f = spark.createDataFrame([(1, True, 0.5), (2, True, 2.0), (3, True, None), (4, False, 9.0), (5, None, None), (6, True, float("nan"))], "i int, alignment_eligible boolean, age_seconds double")
    assert sorted(x.i for x in archives.fresh_or_inexact(f, 1.0).collect()) == [1, 4, 5]
    k = spark.createDataFrame([("1735689600000", "3.5"), (" 1735689600000000", "4"), ("x", "1"), ("1735689600000", "NaN"), (None, None)], "close_time string, close string")
    assert sorted(rows(archives.klines_reference(k, "s").select(F.unix_micros("timestamp"), "mid", "source", "alignment_eligible", "regime_eligible"))) == [(1735689600000000, 3.5, "s", False, True), (1735689600000000, 4.0, "s", False, True)]
    seed = spark.createDataFrame([("a", 0, 0.1), ("b", 5, 0.2)], "k string, us bigint, r double")
    up = spark.createDataFrame([("a", 0, 0.3), ("a", 7, 0.4)], "k string, us bigint, r double")
    assert sorted(rows(archives.seeded_rates(seed, up, ["k"], "us", "r"))) == [("a", 0, 0.3), ("a", 7, 0.4), ("b", 5, 0.2)]


def test_archives_with_other_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.CSV", "1,a\n\n2\n")
        z.writestr("x.csv.CHECKSUM", "beef  x.csv")
        z.writestr("folder/y.txt", '3,"b,c"\n')
    got = sorted(rows(archives.read_zip_csv(spark, str(tmp_path), ["i", "t"])))
    assert got == [("1", "a"), ("2", None), ("3", "b,c")]
    with pytest.raises(Exception, match="fields instead of"):
        archives.read_zip_csv(spark, str(tmp_path), ["i"]).collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.md", "nothing")
    with pytest.raises(Exception, match="no table"):
        archives.read_zip_csv(spark, str(tmp_path / "z.zip"), ["i", "t"]).collect()


def test_scratch_tables_go(spark):
    with scratch():
        d = written(spark.range(5), "gone")
        path = d.inputFiles()[0]
        assert d.count() == 5
    with pytest.raises(Exception, match="(?i)path_not_found|not exist|no such file"):
        spark.read.parquet(path).count()


def test_keys_of_any_kind_keep_their_totals(spark):
    rng = random.Random(9)
    iv = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(500)]), rng.randrange(900)) for _ in range(120)]
    ev = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(900)]), rng.choice([None, 1.0, 2.5])) for _ in range(300)]
    i, e = spark.createDataFrame(iv + iv[:5], "k string, s bigint, z bigint"), spark.createDataFrame(ev, "k string, t bigint, v double")
    want = defaultdict(int)
    for k, s, z in iv + iv[:5]:
        fit = [v or 0.0 for m, t, v in ev if s is not None and k is not None and m == k and t is not None and min(s, z) < t <= max(s, z)]
        sign = -1 if s is not None and s > z else 1
        want[k, s, z, None if s is None else sign * sum(fit), None if s is None else sign * len(fit)] += 1
    got = defaultdict(int)
    for r in lots.sums_over_intervals(i, e, "k", "s", "z", "t", "v", 64).collect():
        got[tuple(r)] += 1
    assert {k: n for k, n in got.items()} == dict(want)


def test_resamples_are_those_of_their_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=90)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(200, None), (201, float("nan")), (202, float("inf"))], "i int, v double").repartition(4)
    for mean in (1.0, 7.0, 400.0):
        blocks = inference.resample_blocks(spark, 12, 90, 90, mean, 11).collect()
        want = defaultdict(float)
        at = defaultdict(int)
        for b in sorted(blocks):
            assert b.at == at[b.rep] and 0 <= b.start < 90
            at[b.rep] += b.n
            want[b.rep] += sum(v[(b.start + k) % 90] for k in range(b.n))
        assert set(at.values()) == {90} and len(at) == 12
        got = dict(rows(inference.bootstrap_sums(df, "i", "v", 12, mean)))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)
    n = np.array([b.n for b in inference.resample_blocks(spark, 40, 10**6, 2000, 8.0, 1).collect()])
    assert 7.5 < n.mean() < 8.5


def test_draws_never_go_through_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 13)) for i in range(3000)], "i int, v double")
    sent = inference.bootstrap_sums(df, "i", "v", 20, 2.0)
    plan = sent._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan  # the draws are on the left
    monkeypatch.setattr(inference, "SENT_POINTS", 2999)
    merged = inference.bootstrap_sums(df, "i", "v", 20, 2.0)
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(rows(sent)) == sorted(rows(merged)) and sent.count() == 20


def test_power_against_loops(spark):
    v = np.random.default_rng(7).normal(size=60)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    take = lambda x, bs: np.concatenate([x[(b.start + np.arange(b.n)) % len(x)] for b in bs])
    by = defaultdict(list)
    for b in sorted(inference.resample_blocks(spark, 8, 60, 25, 3.0, 17).collect()):
        by[b.rep].append(b)
    inner = defaultdict(list)
    for b in sorted(inference.resample_blocks(spark, 8 * 10, 25, 25, 3.0, 18).collect()):
        inner[b.rep].append(b)
    want = {}
    for effect in (0.2, 0.5):
        passed = 0
        for o in range(8):
            x = take(v - v.mean(), by[o]) + effect
            passed += np.quantile([take(x, inner[o * 10 + k]).mean() for k in range(10)], 0.025) > 0
        want[effect] = passed / 8
    assert {r.effect: r.power for r in inference.power(df, "i", "v", 25, (0.2, 0.5), 8, 10, 3.0).collect()} == want


def test_digests_and_resuming(spark, tmp_path):
    at = str(tmp_path / "d")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "part int, v string")
    archives.resume_parts(df.where("part = 1"), at, "part")
    before = archives.directory_digest(spark, at).first()
    archives.resume_parts(df.withColumn("v", F.concat("v", F.lit("!"))), at, "part")
    assert sorted(rows(spark.read.parquet(at).select("part", "v")), key=str) == [(1, "a"), (2, "b!"), (None, "c!")]
    archives.resume_parts(df, at, "part")
    after = archives.directory_digest(spark, at).first()
    assert spark.read.parquet(at).count() == 3 and after.sha256 == archives.directory_digest(spark, at).first().sha256 != before.sha256
    assert after.length > before.length and after.files > before.files


def test_fold_goes_on_over_many_chunks(spark):
    """A target that drifts within the band for whole chunks, and two keys in one task."""
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        n = 2000
        data = [(k, i, i * 1e-3, 1.0, b) for k, b in (("x", 5.0), ("y", 0.0105), (None, 0.5005)) for i in range(n)]
        df = spark.createDataFrame(data, "k string, i int, t double, p double, b double").repartition(7)
        got = {(r.k, r.i): r.held for r in fold.band_path(df, "k", ["i"], "t", "p", "b").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in ("x", "y", None):
        held = None
        for k, i, t, p, b in (x for x in data if x[0] == key):
            held = t if held is None or abs(t - held) * p > b else held
            assert got[key, i] == held
