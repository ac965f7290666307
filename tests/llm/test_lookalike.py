from tidemark.llm.lookalike import Rewriter, corpus_representatives, look_alike_classes, look_alike_pairs, member_counts, representatives

FORM = Rewriter(representatives())


def test_same_looks():
    for a, b in [("ｆｅｅ１", "fee1"), ("café", "café"), ("a​b­c", "abc"), ("a  b", "a  b"), ("a‑b", "a-b"),
                 ("сос", "coc"), ("е́", "é"), ("ё", "ë"), ("ｅ́", "é"), ("e​́", "é"), ("デ", "デ"), ("ΝΟ", "NO")]:
        assert FORM(a) == FORM(b), (a, b)


def test_real_differences():
    for a, b in [("x²", "x2"), ("l", "1"), ("O", "0"), ("A", "a"), ("é", "e"), ("a b", "a  b"), ("µ", "μ"), ("½", "1/2"), ("a\tb", "a b"), ("№", "No"), ("ﬁ", "fi")]:
        assert FORM(a) != FORM(b), (a, b)


def test_classes_and_ascii():
    assert all(sum(s.isascii() and s != "" for s in g) <= 1 for g in look_alike_classes())
    text = "".join(map(chr, range(128)))
    assert FORM(text) == text and FORM("") == ""


def test_pairs(spark):
    rows = [(1, "café x"), (2, "café x"), (3, "café x"), (4, "cafe x"), (5, None), (6, ""), (7, "​"), (8, ""), (None, "café x"), (9, "ｃafé x"), (2, "café x"),
            (10, "😀 tail cаfe x"), (11, "😀 tail cafe x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as look", "2 as raw")
    got = sorted(tuple(r) for r in look_alike_pairs(df).collect())
    assert got == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9), (6, 7), (7, 8), (10, 11)]
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_frequency_chooses(spark):
    df = spark.createDataFrame([(1, "é é é")], "doc_id bigint, text string")
    assert corpus_representatives(df)["é"] == "é" and representatives()["é"] == "é"


def test_long_sequences_are_counted(spark):
    three = "e\u0323\u0302"  # one letter in three code points
    n = {r.member: r.n for r in member_counts(spark.createDataFrame([(f"x{three}{three} e\u0323",), ("\u0302",), (None,)], "text string")).collect()}
    assert (n[three], n["e\u0323"]) == (2, 3)


def test_whole_table_against_brute_force(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    by = {}
    for r in t.collect():
        by.setdefault(FORM(r.text), []).append((r.doc_id, r.text))
    want = {(min(a, c), max(a, c)) for g in by.values() for a, b in g for c, d in g if a != c and b != d}
    assert {tuple(r) for r in look_alike_pairs(t).collect()} == want and want
