import pytest

from annalist.llm import unify


@pytest.mark.parametrize(
    "a, b",
    [("ﬡב", "אב"), ("ℵ", "א"), ("ײ", "יי"), ("Ｍ１", "M1"), ("Мах", "Max"), ("a​b", "ab"), ("a  b", "a b"), ("é", "é"), ("\xad‏x", "x"), ("רש״י", 'רש"י')],
)
def test_forms_alike(a, b):
    assert unify.unify_text(a) == unify.unify_text(b)


@pytest.mark.parametrize("a, b", [("אָב", "אב"), ("word", "words"), ("a b", "ab"), ("Word", "word")])
def test_forms_differ(a, b):
    assert unify.unify_text(a) != unify.unify_text(b)


def test_fold_and_idempotence():
    assert unify.unify_text("Straße", fold=True) == unify.unify_text("STRASSE", fold=True)
    for t in ("ﬡ Ｍ  x", "ẛ̣", "ſt", "", "  ", "İ", "ΐ"):
        for fold in (False, True):
            once = unify.unify_text(t, fold)
            assert unify.unify_text(once, fold) == once
    assert unify.unify_text(None) is None
    assert unify.unify_text(" \t ") == ""


def brute(rows):
    out = set()
    for i, (ra, sa, ta) in enumerate(rows):
        for rb, sb, tb in rows[i + 1 :]:
            fa, fb = unify.unify_text(ta), unify.unify_text(tb)
            if fa and fa == fb and ta != tb and sa == sb and sa is not None:
                out.add((min(ra, rb), max(ra, rb)))
    return out


def test_pairs_against_brute_force(spark):
    texts = ["אב גד", "אב  גד", "אב\xa0גד", "ﬡב גד", None, "", "  ", "אב גד", "x" * 50_000, "x" * 50_000 + "​", "שלום", "שלום"]
    rows = [(i, ["s", "t", None][i % 3], t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame([(r, s, t, 7, "k") for r, s, t in rows], "row_id bigint, scope string, body string, key int, raw string")
    got = {tuple(r) for r in unify.lookalike_pairs(df, "body", "row_id", "scope").collect()}
    assert got == brute(rows)
    every = {tuple(r) for r in unify.lookalike_pairs(df, "body", "row_id").collect()}
    assert every == brute([(r, "", t) for r, _, t in rows])


def test_empty_table_and_clash(spark):
    df = spark.createDataFrame([], "row_id bigint, body string")
    assert unify.lookalike_pairs(df, "body", "row_id").collect() == []
    one = spark.createDataFrame([(1, "Ａ", "old"), (2, None, "old")], "row_id bigint, body string, form string")
    assert [r.form for r in unify.unify(one, "body", "form").orderBy("row_id").collect()] == ["a", None]


def test_classes_against_pairs(spark):
    texts = ["אב גד", "אב  גד", "אב\xa0גד", "ﬡב גד", None, "", "x", "x", "X", "y\u200b", "y", "y", "z", "z"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "row_id bigint, sentence string, row int").repartition(3)
    pairs = [(r.row_a, r.row_b) for r in unify.lookalike_pairs(df, "sentence", "row_id").collect()]
    got = {r.row: (r["class"], r.ways, r.links) for r in unify.lookalike_classes(df, "sentence", "row_id").collect()}
    links = {i: sum(i in p for p in pairs) for i in range(len(texts))}
    assert {i: n for i, (_, _, n) in got.items()} == {i: n for i, n in links.items() if n}
    assert got[0] == (0, 4, 3) and got[9] == (9, 2, 2) and got[10] == (9, 2, 1)
    folded = {r.row: r["class"] for r in unify.lookalike_classes(df, "sentence", "row_id", fold=True).collect()}
    assert folded[6] == folded[7] == folded[8] == 6


def test_a_hot_form_is_no_square(spark):
    """80,001 rows of one form, one of them in other characters: 80,000 pairs, in seconds."""
    from pyspark.sql import functions as F

    df = spark.range(80_001).select(F.col("id").alias("row_id"), F.when(F.col("id") == 40_000, F.lit("אב\xa0גד")).otherwise(F.lit("אב גד")).alias("sentence"))
    pairs = unify.lookalike_pairs(df, "sentence", "row_id")
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("row_a < row_b AND (row_a = 40000 OR row_b = 40000)")).alias("ok")).collect()[0]
    assert r.n == r.ok == 80_000
