import itertools
import random
from pathlib import Path

from tidemark.llm.packing import container_texts, encoder, fill_containers, fullest, minimum_bin_slack, packing_report, VOCABULARY


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(0, 80)
        counts = {n: x.count(n) for n in x}
        got = fullest(counts, sorted(counts, reverse=True), room)
        assert all(counts[n] >= k for n, k in got)
        best = max(s for r in range(len(x) + 1) for c in itertools.combinations(x, r) if (s := sum(c)) <= room)
        assert sum(n * k for n, k in got) == best


def test_bins_hold_every_item_once():
    rng = random.Random(4)
    x = [rng.randrange(1, 100) for _ in range(500)]
    bins = list(minimum_bin_slack(x, 100))
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(x[i] for i in b) <= 100 for b in bins)
    # no packing needs fewer bins than the volume, nor than the items of which no two fit together
    # and the heuristic comes within a hundredth of that
    assert len(bins) <= 1.01 * max(-(-sum(x) // 100), sum(n > 50 for n in x))


def test_every_token_comes_out_once(spark):
    rows = [(1, "a b c " * 400), (2, "hello world"), (3, None), (4, ""), (5, "naïve <|endoftext|> text " * 30), (5, "copy"), (6, "z" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 as grp", "0 as container_id")
    e = encoder(Path(VOCABULARY).read_bytes())
    out = fill_containers(df, capacity=256, items_per_group=4).collect()
    total = {}
    for r in out:
        assert 0 < r.n_tokens <= 256
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for i, t in rows:
        if t:
            want[i] = want.get(i, 0) + len(e.encode_ordinary(t))
    assert total == want
    by = {}
    for r in out:
        by[r.container_id] = by.get(r.container_id, 0) + r.n_tokens
    assert all(by[r.container_id] == r.container_tokens <= 256 for r in out)
    assert all(r.n_tokens == 256 for r in out if r.doc_id == 1 and r.first_token < want[1] // 256 * 256)
    assert fill_containers(df.limit(0)).count() == 0
    unique = df.where("text != 'copy'")
    packed = fill_containers(unique, capacity=256)
    tokens = sorted(x for r in container_texts(unique, packed).collect() for x in r.tokens)
    assert tokens == sorted(x for i, t in rows if t and t != "copy" for x in e.encode_ordinary(t))


def test_little_room_is_left(spark):
    out = fill_containers(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    n = out.selectExpr("count(distinct container_id) n", "sum(n_tokens) s").first()
    assert n.s / (n.n * 4096) > 0.995


def test_report_tells_what_is_wrong(spark):
    df = spark.createDataFrame([(i, "word " * (10 + i)) for i in range(40)] + [(50, "long " * 600), (51, None)], "doc_id bigint, text string")
    packed = fill_containers(df, capacity=256).cache()
    told = lambda p: packing_report(df, p, capacity=256).first().asDict()
    right = {"n_texts": 41, "n_lost": 0, "n_broken": 0, "n_split": 0, "n_over": 0, "well_filled": True}
    assert told(packed) == right
    assert told(packed.where("doc_id != 3"))["n_lost"] == 1
    assert told(packed.selectExpr("0L as container_id", "doc_id", "first_token", "n_tokens", "container_tokens"))["n_over"] == 1
    assert told(packed.selectExpr("container_id", "doc_id", "0 as first_token", "n_tokens", "container_tokens"))["n_broken"] == 1
    half = packed.where("doc_id = 5").selectExpr("container_id", "doc_id", "first_token + n_tokens - 1 as first_token", "1 as n_tokens", "container_tokens")
    cut = packed.selectExpr("container_id", "doc_id", "first_token", "n_tokens - if(doc_id = 5, 1, 0) as n_tokens", "container_tokens")
    assert told(cut.unionByName(half))["n_split"] == 1
    assert packing_report(df.limit(0), packed.limit(0)).first().n_texts == 0
