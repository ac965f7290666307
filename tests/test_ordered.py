import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tapes import slow
from tidemark.operators import fold, lots, ordered
from tidemark.plans import tapes


def test_one_row_per_key(spark):
    rows = [(1, "a", 5, None), (1, "a", 5, None), (1, "b", 3, 2.0), (None, "c", 9, 1.0), (None, "d", None, 1.0), (2, None, 7, 0.0)]
    df = spark.createDataFrame(rows, "k int, `odd.name` string, i int, v double")
    assert sorted(map(tuple, ordered.keep_one(df, ["k"], "i").collect()), key=str) == [(1, "b", 3, 2.0), (2, None, 7, 0.0), (None, "c", 9, 1.0)]
    assert sorted(map(tuple, ordered.keep_one(df, ["k"], "i", last=True).collect()), key=str) == [(1, "a", 5, None), (2, None, 7, 0.0), (None, "c", 9, 1.0)]
    assert ordered.keep_one(df.limit(0), ["k"], "i").count() == 0


def test_previous_row_across_chunks(spark):
    rng = random.Random(5)
    rows = [(k, t, rng.choice([None, t * 2])) for k in ("hot", "cold", None) for t in rng.sample(range(-500, 500), 300 if k == "hot" else 4)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint").repartition(5)
    for width in (1, 37, 10_000):
        got = ordered.with_previous(ordered.time_chunks(df, "t", width), ["k"], ["t"], ["t", "v"]).collect()
        assert len(got) == len(rows)
        for k in ("hot", "cold", None):
            own = sorted(r[1:] for r in rows if r[0] == k)
            assert [r._prev and tuple(r._prev) for r in sorted((r for r in got if r.k == k), key=lambda r: r.t)] == [None, *own[:-1]]


def test_chunks_cut_a_hot_key(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3600, "hot").otherwise("cold").alias("k"), F.col("id").alias("i"))
    c = ordered.ordered_chunks(df, ["k"], ["i"], "t")
    per = c.groupBy("k", ordered.CHUNK).agg(F.min("i").alias("a"), F.max("i").alias("z"), F.count("*").alias("n")).where("k = 'hot'").orderBy("a").collect()
    assert len(per) >= 3 and sum(r.n for r in per) == 3600 and max(r.n for r in per) < 2000
    assert all(x.z < y.a and x[1] < y[1] for x, y in zip(per, per[1:]))


def test_step_function_equals_the_walk():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 150))
        t, p = rng.normal(size=n).cumsum() * rng.choice([0.1, 1.0]), abs(rng.normal(size=n)) + 0.5
        b = abs(rng.normal(size=n)) * rng.choice([0.0, 0.1, 1.0, 5.0])
        s = fold.steps(t, p, b)
        for held in (None, *rng.normal(size=5) * 3):
            assert fold.after(s, held) == fold.follow(t, p, b, held)[-1]


def test_fold_of_one_key_over_all_chunks(spark):
    rng = np.random.default_rng(8)
    t, p, b = rng.normal(size=4000).cumsum(), abs(rng.normal(size=4000)) + 1, abs(rng.normal(size=4000)) * 4
    df = spark.createDataFrame([("x", i, 2**60 + i, *map(float, v)) for i, v in enumerate(zip(t, p, b))], "k string, i bigint, big bigint, t double, p double, b double").repartition(6)
    got = fold.band_path(df, "k", ["i"], "t", "p", "b").orderBy("i").collect()
    assert [r.held for r in got] == slow(t, p, b) and all(r.big == 2**60 + r.i for r in got)
    assert fold.band_path(df.limit(0), "k", ["i"], "t", "p", "b").count() == 0
    none = df.withColumn("t", F.when(F.col("i") % 2 == 0, F.lit(float("nan"))))
    assert fold.band_path(none, "k", ["i"], "t", "p", "b").count() == 0


def test_lots_of_wide_amounts_and_no_rows(spark):
    big = 10**30
    rows = [("a", 1, str(big), 10), ("a", 2, str(-big - 5), 11), ("a", 3, "-7", 12), ("a", 4, "x", 13), (None, 1, "4", 1), (None, 2, "-3", 9)]
    df = spark.createDataFrame(rows, "k string, i int, a string, b bigint")
    got = sorted(((r.k, r.in_block, r.out_block, int(r.amount)) for r in lots.fifo_lots(df, ["k"], ["i"], "a", "b").collect()), key=str)
    assert got == [("a", 10, 11, big), (None, 1, 9, 3)]
    assert lots.fifo_lots(df.limit(0), ["k"], ["i"], "a", "b").count() == 0


def test_replays_by_capital_grow_with_it(spark):
    got = {r.capital: r for r in tapes.capacity_sweep(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == [1e3, 1e4, 1e5] and got[1e3].trades <= got[1e4].trades <= got[1e5].trades
    alone = tapes.capital_replay(spark, "/root/testdata/sf0.001", (1e4,)).first()
    assert alone.net == pytest.approx(got[1e4].net, abs=1e-6) and alone.trades == got[1e4].trades


def test_running_sums_and_numbers(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(-300, 300), rng.choice([None, *range(9)])) for k in ("hot", "cold", None) for _ in range(200 if k == "hot" else 3)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint").repartition(5)
    for width in (7, 10_000):
        got = ordered.running_sums(ordered.time_chunks(df, "t", width), ["k"], ["t"], "v", "s").collect()
        assert len(got) == len(rows)
        assert all(r.s == sum(v or 0 for k, t, v in rows if k == r.k and t <= r.t) for r in got)
    n = ordered.numbered(df.distinct(), ["k", "t", "v"], "i").collect()
    by_order = sorted(n, key=lambda r: (r.k is not None, r.k or "", r.t, r.v is not None, r.v or 0))
    assert [r.i for r in by_order] == list(range(len(set(rows))))
    assert ordered.numbered(df.limit(0), ["t"], "i").count() == 0
