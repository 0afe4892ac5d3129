import math
from collections import Counter

from annalist.llm import terms

TEXTS = ["a a a a a b", "a b c", None, "", "  ", "a\xa0c", "d " * 30_000, "a b c", "d"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, [0, 1, None][i % 3], "x") for i, t in enumerate(texts)], "row_id bigint, chunk string, scluster int, term string").repartition(3)


def test_frequencies(spark):
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(frame(spark), "chunk", 2, 0.5).collect()}
    occ, rec = Counter(), Counter()
    for t in TEXTS:
        occ.update((t or "").split())
        rec.update(set((t or "").split()))
    n = sum(t is not None for t in TEXTS)
    want = {w: (occ[w], rec[w], "rare" if rec[w] < 2 else "common" if rec[w] / n > 0.5 else None) for w in occ}
    assert got == want


def test_frequencies_of_nothing(spark):
    assert terms.term_frequencies(frame(spark, []), "chunk").collect() == []
    assert terms.term_frequencies(frame(spark, [None, None]), "chunk").collect() == []


def g2(k11, k12, k21, k22):
    n = k11 + k12 + k21 + k22
    s = sum(k * math.log(k * n / (r * c)) for k, r, c in ((k11, k11 + k12, k11 + k21), (k12, k11 + k12, k12 + k22), (k21, k21 + k22, k11 + k21), (k22, k21 + k22, k12 + k22)) if k)
    return 2 * s * (1 if k11 * (k21 + k22) >= k21 * (k11 + k12) else -1)


def test_record_scores(spark):
    counts = [Counter((t or "").split()) for t in TEXTS]
    total = sum(counts, Counter())
    words = sum(total.values())
    got = {(r.record, r.term): r.score for r in terms.distinctive_in_records(frame(spark), "row_id", "chunk").collect()}
    assert set(got) == {(i, w) for i, c in enumerate(counts) for w in c}
    for (i, w), s in got.items():
        size = sum(counts[i].values())
        k = counts[i][w]
        assert math.isclose(s, g2(k, total[w] - k, size - k, words - total[w] - size + k), rel_tol=1e-6, abs_tol=1e-4)
    few = terms.distinctive_in_records(frame(spark), "row_id", "chunk", least=5).collect()
    assert {(r.record, r.term) for r in few} == {(0, "a"), (6, "d")}


def test_group_scores(spark):
    got = {(r.grp, r.term): (r.n, r.records, r.all_records, r.group_records) for r in terms.distinctive_in_groups(frame(spark), "scluster", "chunk").collect()}
    assert got[(0, "a")] == (5, 1, 3, 3)
    assert got[(1, "a")] == (2, 2, 3, 3)
    assert (1, "d") not in got
    assert terms.distinctive_in_groups(frame(spark, []), "scluster", "chunk").collect() == []


def test_repeated_ids_count_as_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "a")], "row_id bigint, chunk string")
    assert {(r.term, r.records) for r in terms.term_frequencies(df, "chunk").collect()} == {("a", 3), ("b", 1)}
    assert len(terms.distinctive_in_records(df, "row_id", "chunk").collect()) == 4
