import random

from tidemark.operators.pointintime import as_known


def test_against_brute_force(spark):
    rng = random.Random(5)
    events = [(i, rng.choice(["a", "b", None]), rng.randrange(60), rng.randrange(4), "e") for i in range(400)]
    events += [(900, "a", None, 1, "e"), (901, "a", 30, None, "e"), (0, *events[0][1:])]
    changes = []
    for i in range(60):
        b = rng.randrange(50)
        changes.append((i, rng.choice("ab"), b, rng.randrange(4), rng.choice([b, b, b + rng.randrange(9), None]), i * 10))
    e = spark.createDataFrame(events, "id int, pool string, b bigint, l int, state string")
    c = spark.createDataFrame(changes, "cid int, pool string, b bigint, l int, known bigint, v int")
    out = as_known(e, c, "pool", ("b", "l"), ("b", "l"), "known", ["cid", "v"], chunk_width=7)
    assert out.columns == ["id", "pool", "b", "l", "state", "known_cid", "known_v"]
    got = sorted((r.id, r.known_cid if r.known_cid is not None else -1) for r in out.collect())

    def right(p, b, l):
        if None in (p, b, l):
            return -1
        fit = [x for x in changes if x[1] == p and x[4] is not None and (x[2], x[3]) <= (b, l) and x[4] <= b]
        return max(fit, key=lambda x: (x[2], x[3], x[4], x[0]))[0] if fit else -1

    assert got == sorted((i, right(p, b, l)) for i, p, b, l, _ in events)


def test_empty_sides(spark):
    e = spark.createDataFrame([(1, "a", 1, 1)], "id int, pool string, b int, l int")
    c = spark.createDataFrame([], "pool string, b int, l int, k int, v int")
    assert as_known(e, c, "pool", ("b", "l"), ("b", "l"), "k", ["v"]).collect()[0].known_v is None
    assert as_known(e.limit(0), c, "pool", ("b", "l"), ("b", "l"), "k", ["v"]).count() == 0
