import random
from datetime import UTC, datetime

import pytest

from tidemark.llm.nearest_time import pair_tables

at = lambda s: datetime.fromtimestamp(s, UTC)


def brute(left, right, tol, direction):
    out = {}
    for i, e, t in left:
        if None in (i, e, t):
            continue
        fit = [
            (abs(t - u), u > t, k) for k, f, u in right
            if None not in (k, f, u) and f == e and abs(t - u) <= tol and (direction == "nearest" or (u <= t if direction == "backward" else u >= t))
        ]
        out[i] = min(fit)[2] if fit else None
    return out


LEAST = -(1 << 63)


def tables(spark, tmp_path, files, seed=8, n=300):
    """Records of two entities over 2000 seconds, with files that overlap in time; NULLs, ties and the smallest ids."""
    rng = random.Random(seed)
    left = [(i, rng.choice("ab"), rng.randrange(4000) / 2) for i in range(n)]
    right = [(i, rng.choice("ab"), rng.randrange(8000) / 4) for i in range(n)]
    left += [(1000, None, 5.0), (1001, "a", None), (None, "a", 5.0), (1002, "zz", 7.0), (LEAST, "a", 9.25), (LEAST + 1, "b", 1999.0)]
    right += [(2000, None, 5.0), (2001, "a", None), (2002, "b", right[5][2]), (LEAST, "a", 9.0)]
    for name, rows in (("left", left), ("right", right)):
        for k in range(files):
            file_of = lambda i, t: 0 if t is None else min(files - 1, int((t + (i or 0) * 7 % 60) // 500))
            part = [(i, e, None if t is None else at(t), "x") for i, e, t in rows if file_of(i, t) == k]
            spark.createDataFrame(part, "id bigint, symbol string, ts timestamp, slice string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return left, right


def pairs(spark, tmp_path, tol, direction, **how):
    out = pair_tables(spark, f"{tmp_path}/left", f"{tmp_path}/right/", "symbol", "id", "ts", "id", "ts", tol, direction, **how).collect()
    got = {r.left_id: r.right_id for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_against_brute_force_below_at_and_above_the_slice(spark, tmp_path, direction):
    left, right = tables(spark, tmp_path, 4, n=60)
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    for tol in (3.0, 20.0, 150.0):
        assert pairs(spark, tmp_path, tol, direction, rows_per_batch=50, slice_seconds=20) == brute(left, right, tol, direction)
    assert spark.conf.get("spark.sql.shuffle.partitions") == shuffled


@pytest.mark.parametrize("files", [1, 4])
def test_state_is_bounded_by_span_and_tolerance(spark, tmp_path, files):
    """Whatever the files and their times of modification, state holds a span's records and those within the tolerance."""
    left, right = tables(spark, tmp_path, files)
    progress: list = []
    assert pairs(spark, tmp_path, 3.0, "backward", rows_per_batch=60, slice_seconds=1, progress=progress) == brute(left, right, 3.0, "backward")
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    given = [p.numInputRows for p in progress if p.numInputRows]
    # a right record is in four slices of one second and in no state longer than two spans
    assert len(given) > 8 and max(held) <= 4 * 2 * 60 and held[-1] == 0
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress if p.stateOperators) == 0


def test_a_busy_instant(spark, tmp_path):
    rows = [(i, "a", at(5.0)) for i in range(200)] + [(900, "a", at(500.0))]
    for name in ("left", "right"):
        spark.createDataFrame(rows, "id bigint, symbol string, ts timestamp").write.parquet(f"{tmp_path}/{name}")
    got = pairs(spark, tmp_path, 3.0, "nearest", rows_per_batch=50)
    assert got == {**dict.fromkeys(range(200), 0), 900: 900}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, symbol string, ts timestamp")
    none.write.parquet(f"{tmp_path}/left")
    none.write.parquet(f"{tmp_path}/right")
    assert pairs(spark, tmp_path, 3.0, "backward") == {}
    spark.createDataFrame([(1, "a", at(5.0))], "id bigint, symbol string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/left")
    assert pairs(spark, tmp_path, 3.0, "backward") == {1: None}
