import random

from tidemark.operators.grid import regular_grid

SCHEMA = "source string, slot_epoch string, ts timestamp, mid double"


def frame(spark, rows):
    df = spark.createDataFrame([(k, "clash", float(t) if t is not None else None, v) for k, t, v in rows], "source string, slot_epoch string, t double, mid double")
    return df.selectExpr("source", "slot_epoch", "timestamp_micros(cast(t * 1e6 as bigint)) as ts", "mid")


def grid(df, **kw):
    out = regular_grid(df, ["source"], "ts", "mid", **kw).collect()
    return {(r.source, r.slot_epoch): (r.status, r.n_readings, r.value) for r in out}


def test_gaps_are_filled_marked_and_extended(spark):
    rows = [("a", 10, 1.0), ("a", 20, 2.0), ("a", 910, 5.0), ("a", 5000, 7.0), ("a", None, 1.0), ("a", 300, None), ("a", 310, float("nan")), (None, 0, 3.0), (None, 650, 4.0)]
    g = grid(frame(spark, rows), end_epoch=5700, start_epoch=-300)
    assert g["a", -300] == ("leading", 0, None)
    assert g["a", 0] == ("observed", 2, 2.0)
    assert g["a", 300][0] == "interpolated" and abs(g["a", 300][2] - (2 + 3 * 280 / 890)) < 1e-12
    assert g["a", 900] == ("observed", 1, 5.0) and g["a", 1200] == ("missing", 0, None)
    assert g["a", 5100] == ("trailing", 0, None) and ("a", 6000) not in g
    assert g[None, 300][0] == "interpolated"


def test_every_period_once_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(0, 60000), rng.random()) for _ in range(120)]
    g = grid(frame(spark, rows * 2), chunk_periods=7, max_interpolated_seconds=1e9)
    for s in "ab":
        have = {t // 300 * 300 for k, t, _ in rows if k == s}
        assert {t for k, t in g if k == s} == set(range(min(have), max(have) + 300, 300))
        assert {t for (k, t), v in g.items() if k == s and v[0] == "observed"} == have


def test_empty(spark):
    assert grid(frame(spark, [("a", None, 1.0)])) == {}
