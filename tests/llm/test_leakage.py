import random
import re

import numpy as np

from tidemark.llm.leakage import MASKS, best_runs, leaked_items, leaked_passages, words
from tidemark.llm.lookalike import Rewriter, representatives

FORM = Rewriter(representatives())


def grams(t):
    w = words(t or "", FORM)
    return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}


def brute(docs, items):
    having = {}
    for i, t in items:
        for g in grams(t):
            having.setdefault(g, set()).add(i)
    return {(d, i) for d, t in docs if d is not None for g in grams(t) for i in having.get(g, ())}


def test_masks_cover_every_position():
    assert all(any(m[i] == "1" for m in MASKS) for i in range(12)) and {len(m) for m in MASKS} == {12}


def test_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").select("item_id", "text").collect()]
    w = items[0][1].split()
    docs += [(-1, " ".join(w[:11])), (-2, None), (-3, ""), (-4, "x_" + "\n".join(w[3:20]).upper()), (None, items[0][1]), (-5, items[0][1]), (-5, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item", "2 as pos")
    i = spark.createDataFrame([*items, (-9, None), (-8, "few words")], "item_id bigint, text string")
    want = brute(docs, items)
    got = [tuple(r) for r in leaked_items(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (-5, items[0][0]) in want
    assert {tuple(r) for r in leaked_items(d.where("doc_id < 1500"), i, size=10).collect()} == {x for x in want if x[0] < 1500}
    assert leaked_items(d.limit(0), i).count() == 0 == leaked_items(d, i.limit(0)).count()


def brute_runs(equal, mismatch=3):
    """Maximal scoring runs by their definition: the best run of all, then of what is left on both sides."""
    if not any(equal):
        return []
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -mismatch))))
    a, z = max(((i, j) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)), key=lambda x: (score[x[1]] - score[x[0]], x[0] - x[1]))
    shifted = [(x + z, y + z, n) for x, y, n in brute_runs(equal[z:], mismatch)]
    return [*brute_runs(equal[:a], mismatch), (a, z, int(sum(equal[a:z]))), *shifted]


def test_best_runs():
    rng = random.Random(3)
    for n in [0, 1, 5, *[40] * 200]:
        equal = [rng.random() < rng.choice([0.5, 0.8, 0.95]) for _ in range(n)]
        assert best_runs(np.array(equal, bool)) == brute_runs(equal)


def plain(t):
    """Words by a rule of its own, for ASCII texts."""
    return re.sub(r"[^a-z0-9]+", " ", t.lower()).split()


def test_passages_against_comparing_every_diagonal(spark):
    rng = random.Random(5)
    lexicon = [f"w{i}" for i in range(200)]
    items = [(k, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(8, 70)))) for k in range(12)]
    docs = []
    for k in range(40):
        w = [rng.choice(lexicon) for _ in range(60)]
        for _ in range(rng.randrange(3)):
            part = plain(rng.choice(items)[1])[rng.randrange(20) :][: rng.randrange(50)]
            w += [x if rng.random() > 0.1 else "Other" for x in part] + [rng.choice(lexicon)]
        docs.append((k, "\n".join(w)))
    want = set()
    for d, t in docs:
        a = plain(t)
        for i, u in items:
            b = plain(u)
            for diagonal in range(-len(b), len(a)):
                start = max(0, -diagonal)
                equal = [a[p + diagonal] == b[p] for p in range(start, min(len(b), len(a) - diagonal))]
                hits = [p for p in range(len(equal) - 11) if any(all(equal[p + k] for k, bit in enumerate(m) if bit == "1") for m in MASKS)]
                if hits:
                    for x, z, n in brute_runs(equal):
                        if n >= 12 and any(p < z and p + 12 > x for p in hits):
                            want.add((d, i, start + x + diagonal, start + x, z - x, n))
    extra = [(None, items[0][1]), (90, None), (91, ""), (5, docs[5][1])]
    got = leaked_passages(spark.createDataFrame([*docs, *extra], "doc_id bigint, text string").selectExpr("*", "1 as item", "2 as hits"),
                          spark.createDataFrame([*items, (99, None)], "item_id bigint, text string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_unequal_words_between_equal_ones_are_no_passage(spark):
    w = [f"w{i}" for i in range(36)]
    other = [*w[:12], *[f"x{i}" for i in range(12)], *w[24:]]
    d = spark.createDataFrame([(1, " ".join(other)), (2, " ".join(["pad"] * 5 + [*w[:14], "other", *w[15:]]))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    r = sorted(map(tuple, leaked_passages(d, i).collect()))
    assert r == [(1, 7, 0, 0, 12, 12), (1, 7, 24, 24, 12, 12), (2, 7, 5, 0, 36, 35)]


def test_recall_of_substituted_passages(spark):
    """Passages of 30 words with one word in ten replaced at random places: at least 0.9 of them come out."""
    rng = random.Random(11)
    items = [(k, " ".join(f"t{k}x{j}" for j in range(30))) for k in range(300)]
    docs = []
    for k, t in items:
        w = t.split()
        for j in rng.sample(range(30), 3):
            w[j] = "replaced"
        docs.append((k, " ".join(["before"] * 7 + w + ["after"] * 9)))
    r = leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len({x.doc_id for x in r if x.doc_id == x.item_id}) >= 270 and all(x.doc_id == x.item_id for x in r)
