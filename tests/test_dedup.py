import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.dedup import SeenRanges, first_deliveries, hash_number, surplus_deliveries

SCHEMA = "delivery_id bigint, block_number bigint, log_index int, tx_hash string, producer string"


@given(st.lists(st.integers(-30, 30)))
@settings(max_examples=200)
def test_ranges_stay_disjoint(numbers):
    seen, model = SeenRanges(), set()
    for n in numbers:
        assert seen.accept(n) == (n not in model)
        model.add(n)
    r = seen.ranges()
    assert all(a <= b for a, b in r) and all(x[1] + 1 < y[0] for x, y in zip(r, r[1:]))
    assert {n for a, b in r for n in range(a, b + 1)} == model


def test_against_brute_force_with_a_hot_message(spark):
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(50), 1 if i % 3 == 0 else rng.randrange(200), "0xAB", "x") for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r[0] for r in surplus_deliveries(df, span=64).collect()}
    first = {}
    for d, b, n, *_ in sorted(rows):
        first.setdefault((b, n), d)
    assert got == {r[0] for r in rows} - set(first.values())
    assert first_deliveries(df).count() == len(first)


def test_malformed_identifiers_are_looked_up(spark):
    rows = [
        (1, 5, 3, "0x00AB", None), (2, None, 3, "ab ", None), (3, None, 3, "AB", None),  # known by hash
        (4, None, 3, "cd", None), (5, None, 3, "0xCD", None),  # a message of its own
        (6, None, 4, None, None), (7, None, 4, None, None), (8, 5, None, "ab", None), (9, 5, 3, None, None),
        (None, 5, 3, "ab", None), (10, None, 3, "zz", None),
    ]
    got = {r[0] for r in surplus_deliveries(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2, 3, 5, 9}
    assert surplus_deliveries(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spellings_of_a_hash(spark):
    df = spark.createDataFrame([("0x0aB ",), (" AB",), ("",), ("0x",), ("xyz",), (None,), ("1" * 65,), ("0" * 70 + "ab",)], "h string")
    a = "ab".rjust(64, "0")
    assert [r[0] for r in df.select(hash_number("h")).collect()] == [a, a, None, None, None, None, None, a]
