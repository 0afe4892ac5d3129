import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.functions import cleaning, text, vectors
from annalist.operators import catalog, chunking, labels, lmscore, models, ngrams, order, profile, sequence, sessions, skew, stats


def test_words_split_at_all_white_space(spark):
    t = "a\xa0b c　d\x85e​f  \tg"
    df = spark.createDataFrame([(t,), ("",), ("  ",), (None,)], "t string")
    got = [r[0] for r in df.select(text.words("t")).collect()]
    assert got == [t.split(), [], [], None]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(text.ngrams("t", 2)).collect()] == [["a b", "b c"], [], []]


# --- skew ---------------------------------------------------------------------------------------------------------


def chunks(spark, n=2000):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        f = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"f{rng.randint(0, 200)}"
        rows.append((f, None if i % 17 == 0 else "" if i % 19 == 0 else "x y " * (i % 5), i, rng.choice([1, 2, None]), 5))
    return rows, spark.createDataFrame(rows, "filename string, chunk string, chronological_index bigint, scluster int, n bigint").repartition(5)


def test_salted_equals_plain(spark):
    rows, df = chunks(spark)
    got = {r.filename: (r.n_rows, r.n_chunks, r.n_words, r.first_index, r.last_index, r.clusters) for r in skew.file_profile(df).collect()}
    want = {}
    for f in {r[0] for r in rows}:
        m = [r for r in rows if r[0] == f]
        want[f] = (len(m), sum(r[1] is not None for r in m), sum(len((r[1] or "").split()) for r in m), min(r[2] for r in m), max(r[2] for r in m), len({r[3] for r in m} - {None}))
    assert got == want


def test_hot_keys_are_spread(spark):
    _, df = chunks(spark)
    hot = skew.heavy_keys(df, "filename", 0.02)
    assert {r.filename for r in hot.collect()} >= {"hot"} and hot.count() <= 50
    assert {r.filename for r in skew.dominant_files(df).collect()} == {"hot"}


def test_skew_edges(spark):
    _, df = chunks(spark, 10)
    assert skew.file_profile(df.limit(0)).collect() == []
    assert skew.dominant_files(df.limit(0)).collect() == []
    same = df.limit(1).crossJoin(spark.range(100).select()).select("filename", "chunk", "chronological_index", "scluster")
    assert [r.n_rows for r in skew.file_profile(same).collect()] == [100]
    with pytest.raises(ValueError):
        skew.heavy_keys(df, "filename", 0)
    with pytest.raises(ValueError):
        skew.salted_aggregate(df, "filename", {"a": F.count("chunk")}, {})


# --- order and chunks ---------------------------------------------------------------------------------------------


def test_global_index_and_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 30), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id bigint").repartition(6)
    got = {r.id: r.idx for r in order.global_index(df, "v", "id").collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    run = order.running_total(df, ["g"], "id", F.col("v").cast("long"), "before", block=37)
    for r in run.collect():
        assert r.before == sum(v for g, v, i in rows if g == r.g and i < r.id)
    assert order.global_index(df.limit(0), "v").collect() == []


def test_chunk_provenance(spark):
    """A unit that goes on in the next row, rows without words, a last short chunk."""
    rows = [
        ("A-B-Sefaria.jsonl", "A_B_Sefaria_1_1", 1, "a b c", 1), ("A-B-Sefaria.jsonl", "A_B_Sefaria_1_1_2", 2, "d e", 4), ("A-B-Sefaria.jsonl", "A_B_Sefaria_1_2", 3, "", 1),
        ("A-B-Sefaria.jsonl", "A_B_Sefaria_1_3", 4, "f g h", None), ("C-Sefaria.jsonl", "elsewhere", 5, "x", 3), ("C-Sefaria.jsonl", "C_Sefaria_2", 6, None, 1),
    ]
    seg = spark.createDataFrame(rows, "filename string, location string, segment bigint, sentence string, from_word int")
    got = {(r.filename[0], r.chunk_number): r for r in chunking.chunk_table(seg, 4).collect()}
    assert set(got) == {("A", 1), ("A", 2), ("C", 1)}
    one, two = got[("A", 1)], got[("A", 2)]
    assert (one.chunk, one.ref_spans, one.end_segment, one.end_segment_word) == ("a b c d", "1–4: 1_1 [1–4]", 2, 1)
    assert (two.chunk, two.ref_spans, two.start_unit_word, two.end_unit) == ("e f g h", "1–1: 1_1 [5–5] | 2–4: 1_3 [1–3]", 5, "1_3")
    assert got[("C", 1)].ref_spans == "1–1: elsewhere [3–3]"


def test_labels(spark):
    df = spark.createDataFrame([("A-B_b-C-X1_Sefaria.jsonl",), ("A-B-C-.json",), ("A-B.json",), ("A-Sefaria.jsonl",)], "f string")
    assert [r[0] for r in df.select(labels.grouping_label("f", 2)).collect()] == ["A-B b", "A-B", "A-B", "A"]
    c = spark.createDataFrame([("1",), ("x",), (None,), ("2.0",)], "scluster string")
    assert sorted(r[0] for r in labels.numeric_clusters(c).collect()) == [1, 2]
    with pytest.raises(ValueError, match="chunk"):
        labels.ensure_columns(c, ["chunk"])


def test_stream_ngrams_cross_chunks(spark):
    f = spark.createDataFrame([(1, 0, "a b"), (1, 1, ""), (2, 2, "x"), (1, 3, "c"), (1, 4, "d e")], "scluster int, idx bigint, chunk string")
    got = sorted((r.scluster, r.gram) for r in ngrams.stream_ngrams(f, 3).collect())
    assert got == [(1, "a b c"), (1, "b c d"), (1, "c d e")]
    top = ngrams.class_tf_idf(f, (3,))
    assert {r.scluster: r.ngrams for r in ngrams.cluster_ngram_text(top, f).collect()}[2] == ngrams.NONE


# --- vectors and profiles -----------------------------------------------------------------------------------------


def test_affinities(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, [float(x) for x in rng.standard_normal(5) + (i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, k int, vec array<float>").repartition(4)
    x, k = np.array([r[2] for r in rows], np.float32).astype(float), np.array([r[1] for r in rows])
    m = np.stack([x[k == c].mean(0) for c in range(3)])
    s = x @ m.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(m, axis=1)
    for r in profile.affinities(df, "row_id", "k", "vec").collect():
        assert math.isclose(r.own_sim, s[r.row_id, r.k], abs_tol=1e-9)
        other = [c for c in range(3) if c != r.k]
        assert r.other == max(other, key=lambda c: s[r.row_id, c])
    one = profile.affinities(df.where("k = 0"), "row_id", "k", "vec").collect()
    assert all(r.other is None and r.margin is None for r in one)
    assert profile.group_means(df.limit(0), "k", "vec").collect() == []


def test_valid_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],), ([None, 1.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.valid("v", 2)).collect()] == [True, False, False, False, False, False]


def test_density_of_equal_values(spark):
    df = spark.createDataFrame([(5, 1), (5, 1)], "x bigint, y int")
    assert {(r.density_raw, r.density_normalized, r.marker_size) for r in profile.density(df, "x", "y").collect()} == {(2, 0.0, 4.0)}


def test_concentrations_bridge_one_bin(spark):
    """Smoothed by hand: 6 3 0 3 6 3 0 0 2 4, threshold 1.8; the one empty bin between 1 and 3 is bridged, two are not."""
    counts = {0: 12, 4: 12, 9: 8}
    rows = [(1, b) for b, n in counts.items() for _ in range(n)]
    got = profile.concentrations(spark.createDataFrame(rows, "k int, bin int"), "k", bins=10).collect()
    assert sorted((r.from_pct, r.to_pct, r.n) for r in got) == [(0, 60, 24), (80, 100, 8)]


# --- sequences ----------------------------------------------------------------------------------------------------


def exhaustive(x, penalty, min_size):
    n = len(x)
    cost = lambda a, b: ((x[a:b] - x[a:b].mean(0)) ** 2).sum()
    best = (cost(0, n), ())
    for k in range(1, n // min_size):
        for cps in itertools.combinations(range(min_size, n - min_size + 1), k):
            e = (0, *cps, n)
            if min(b - a for a, b in zip(e, e[1:])) >= min_size:
                best = min(best, (sum(cost(a, b) for a, b in zip(e, e[1:])) + penalty * k, cps))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_pelt_is_optimal(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((5, 2)) * 0.4, rng.standard_normal((6, 2)) * 0.4 + 1.5])
    for penalty in (0.1, 0.5, 2.0):
        cps = sequence.pelt(x, penalty)
        e = [0, *cps, len(x)]
        got = sum(((x[a:b] - x[a:b].mean(0)) ** 2).sum() for a, b in zip(e, e[1:])) + penalty * len(cps)
        assert math.isclose(got, exhaustive(x, penalty, 2)[0], rel_tol=1e-9)
    assert len(sequence.pelt(x, 0.1)) >= len(sequence.pelt(x, 2.0))


def test_pelt_edges():
    assert sequence.pelt(np.ones((30, 2)), 0.5) == []
    assert sequence.pelt(np.ones((3, 2)), 0.5) == []


def test_pelt_in_ranges(spark):
    """Ranges with their neighbours' margins find the points of the whole sequence."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((30, 3)) * 2, 12, axis=0) + rng.standard_normal((360, 3)) * 0.2
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "t bigint, x array<double>")
    whole = sequence.pelt(x, 1.0)
    assert len(whole) >= 25
    for span in (50, 4_000):
        assert sorted(r.t for r in sequence.pelt_points(df, 1.0, span, 40).collect()) == whole, span


def test_segments(spark):
    seq = spark.range(10).withColumnRenamed("id", "idx")
    pts = spark.createDataFrame([(4,), (7,), (7,), (99,)], "x int")
    got = {r.idx: r.segment for r in sequence.assign_segments(seq, "idx", pts).collect()}
    assert [got[i] for i in range(10)] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert {r.segment for r in sequence.assign_segments(seq, "idx", pts.limit(0)).collect()} == {1}


def gap_statistic(x, t):
    """The definition: t (n - t) / n |mean before - mean after|^2."""
    return t * (len(x) - t) / len(x) * ((x[:t].mean(0) - x[t:].mean(0)) ** 2).sum()


def test_split_scan_and_permutations():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((43, 3))
    t, stat = sequence.split_scan(x, 5)
    assert t[0] == 5 and t[-1] == 38 and np.allclose(stat, [gap_statistic(x, k) for k in t])
    got = sequence.permuted_maxima(x, 4, 5, 6, np.random.default_rng(9))
    again = np.random.default_rng(9)
    for r in range(6):
        y = x[[i for b in again.permutation(11) for i in range(43) if i // 4 == b]]
        assert math.isclose(got[r], max(gap_statistic(y, k) for k in range(5, 39)))


def test_planted_splits_are_found(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((80, 3)), rng.standard_normal((60, 3)) + 2, rng.standard_normal((60, 3)) - 2])
    short = rng.standard_normal((15, 3))
    rows = [("long", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("short", i, [float(v) for v in r]) for i, r in enumerate(short)]
    df = spark.createDataFrame(rows, "g string, t bigint, x array<double>").repartition(3)
    found = [(r.g, r.t, r.p, r.depth) for r in sequence.significant_splits(df, "g", 10, 5).collect()]
    assert {g for g, *_ in found} == {"long"} and min(p for *_, p, _ in found) == 1 / 200
    for want in (80, 140):
        assert any(abs(t - want) <= 2 for _, t, *_ in found)
    assert {d for *_, d in found} >= {0, 1}
    best = sequence.binary_segmentation(df.where("g = 'long'").select("t", "x"), 3, 10).collect()
    assert [r.place for r in best] == [1, 2, 3] and {round(r.t / 10) for r in best[:2]} == {8, 14}
    assert best[0].gain == pytest.approx(max(gap_statistic(x, t) for t in range(10, 191)))
    assert sequence.binary_segmentation(df.where("g = 'short'").select("t", "x"), 3, 10).collect() == []


def test_kernel_segmentation():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((20, 2)) * 0.3, rng.standard_normal((15, 2)) * 0.3 + 3])
    place, t, gain = sequence.kernel_segmentation(x, 2, 3)[0]
    assert (place, t) == (1, 20)
    d = ((x[:, None] - x) ** 2).sum(-1)
    k = np.exp(-d / np.median(d[np.triu_indices(35, 1)]))
    cost = lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)
    assert math.isclose(gain, cost(0, 35) - cost(0, 20) - cost(20, 35), abs_tol=1e-8)
    # labels as unit vectors: kernel and squared deviations differ by a factor only, so the order is the same
    one = np.eye(3)[[0] * 9 + [1] * 7 + [2] * 8]
    assert [t for _, t, _ in sequence.kernel_segmentation(one, 2, 2)] == [16, 9] or [t for _, t, _ in sequence.kernel_segmentation(one, 2, 2)] == [9, 16]
    assert sequence.kernel_segmentation(x[:5], 2, 3) == []
    with pytest.raises(ValueError):
        sequence.kernel_segmentation(np.zeros((3_001, 1)), 1, 2)


def test_permuted_splits_use_whole_vectors(spark):
    import hashlib

    rng = np.random.default_rng(1)
    x = rng.standard_normal((203, 4))
    x[100:, 3] += 3  # a split in the last dimension only
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "t bigint, x array<double>")
    got = {r.rep: r.stat for r in sequence.permuted_splits(df, 10, 199, 20).collect()}
    parts = [x[i : i + 10] for i in range(0, len(x), 10)]
    for rep in range(200):
        at = sorted(range(len(parts)), key=lambda b: f"{b:09}" if rep == 0 else hashlib.md5(f"{rep}-{b}".encode()).hexdigest())
        assert got[rep] == pytest.approx(sequence.split_scan(np.concatenate([parts[b] for b in at]), 20)[1].max(), abs=1e-8)
    assert (1 + sum(got[r] >= got[0] for r in range(1, 200))) / 200 < 0.01


def test_smoothing_of_every_dimension(spark, tmp_path):
    from annalist.plans.sequence_queries import _KERNEL, kernel_smoothing_whole

    x = np.random.default_rng(2).standard_normal((30, 5)).astype(np.float32)
    rows = [(i, f"l{i % 2}", [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.label, r.t, r.d): r.smooth for r in kernel_smoothing_whole(spark, str(tmp_path)).collect()}
    want = {(f"l{k}", t + 1, d + 1): v for k in (0, 1) for d in range(5) for t, v in enumerate(np.convolve(x[k::2, d].astype(float), _KERNEL, "same") / 6.6)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_jensen_shannon(spark):
    seq = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 1, 1, 0])], "idx bigint, label int")
    got = {r.x: r for r in sequence.adjacent(sequence.blocks(seq, "idx", "label", 4), 4).collect()}
    assert set(got) == {4, 8}
    assert math.isclose(got[4].jsd, math.sqrt(math.log(2))) and math.isclose(got[4].score, math.sqrt(2))
    assert sorted((c.label, c.delta) for c in got[8].contributions) == [(0, 0.5), (1, -0.5)]


def test_circular_shift(spark):
    """By hand: labels 0 0 1 1, split in the middle; shifts 0 and 2 part them wholly (4), shifts 1 and 3 not at all (0)."""
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "idx bigint, label int")
    shifts = sequence.circular_shift(df, "idx", "label", 2)
    assert {r.shift: r.chi2 for r in shifts.collect()} == {0: 4.0, 1: 0.0, 2: 4.0, 3: 0.0}
    assert tuple(sequence.shift_p(shifts).head()) == (4.0, 0.5)
    # labels 0 1 1 1 0 0, split after two: before 1|1 of 3|3 at shift 0, 0|2 or 2|0 where the row of equals is cut off
    df = spark.createDataFrame(list(enumerate([0, 1, 1, 1, 0, 0])), "idx bigint, label int")
    assert {r.shift: r.chi2 for r in sequence.circular_shift(df, "idx", "label", 2).collect()} == {0: 0.0, 1: 3.0, 2: 3.0, 3: 0.0, 4: 3.0, 5: 3.0}


# --- statistics and the rest --------------------------------------------------------------------------------------


def test_benjamini_hochberg(spark):
    p = [0.001, 0.2, 0.03, 0.04, 0.04, 1.0, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    order_ = np.argsort(p, kind="stable")
    ranked = np.array(p)[order_] * len(p) / (np.arange(len(p)) + 1)
    want = np.empty(len(p))
    want[order_] = np.minimum(np.minimum.accumulate(ranked[::-1])[::-1], 1)
    for block in (2, 20_000):
        got = {r.id: r.q for r in stats.benjamini_hochberg(df, "p", block=block).collect()}
        assert all(math.isclose(got[i], want[i]) for i in got)


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, v double")
    assert sorted((r.g, r.v, r.r) for r in stats.average_ranks(df, "g", "v", "r").collect()) == [("a", 1.0, 3.0), ("a", 3.0, 1.5), ("a", 3.0, 1.5), ("b", 2.0, 1.0)]


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(0, 5, 10), (1, 6, 20)], "a int, b int, n bigint")
    assert stats.adjusted_rand(same).head()[0] == 1.0


def test_nucleus(spark):
    df = spark.createDataFrame([("a", 0.4, "b", 0.3, "c", 0.2), (None, None, "b", 0.9, None, None)], "pred_1 string, prob_1 double, pred_2 string, prob_2 double, pred_3 string, prob_3 double")
    p = df.select(lmscore.predictions(df).alias("p"))
    assert [[x.word for x in r[0]] for r in p.select(lmscore.nucleus(F.col("p"), 0.65, 1)).collect()] == [["a", "b"], ["b"]]
    assert [len(r[0]) for r in p.select(lmscore.nucleus(F.col("p"), 0.1, 5)).collect()] == [3, 1]


def test_tag_positions(spark):
    tags = spark.createDataFrame([("t", 1, "NOUN"), ("t", 2, "VERB")], "text_id string, word_position int, pos string")
    w = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2)], "text_id string, word_position int")
    assert [r.pos for r in lmscore.join_tags(w, tags).orderBy("word_position").collect()] == ["NOUN", "VERB", None]
    with pytest.raises(ValueError):
        lmscore.zero_based(tags.withColumn("word_position", F.col("word_position") + 4))


def test_sessions(spark):
    rows = [("s", 0, None), ("s", 60, "x"), ("s", 200, None), ("s", 5000, "y"), ("s", 5010, None), ("t", 0, None), ("t", 5, None)]
    df = spark.createDataFrame(rows, "session string, sec int, label string").withColumn("ts", F.timestamp_seconds("sec"))
    got = sessions.worked_gaps(df, "session", "ts", "label", "sec", 900).groupBy("filled").agg(F.sum("seconds")).collect()
    assert {r[0]: r[1] for r in got} == {"x": 200.0, "y": 10.0, "other": 5.0}


def test_categories_and_cleaning(spark):
    df = spark.createDataFrame([(["A", "B", "עב", "1:2", "Book", "Sefaria", "print"],), (["A", "Book", "Sefaria"],), (None,)], "c array<string>")
    got = [tuple(r) for r in df.select(*catalog.parse_categories("c").values()).collect()]
    assert got == [("A > B", "עב", "1:2", "Book"), ("A", "", "", "Book"), ("", "", "", "")]
    t = spark.createDataFrame([("<b>אָב</b>,  [note] x&nbsp;y",)], "t string")
    assert t.select(cleaning.clean_corpus_text("t")).head()[0] == "אב x y"


def test_fuzzy_names(spark):
    a = spark.createDataFrame([("Midrash Rabbah",), ("midrash  tehilim",), ("Zzz",), (None,)], "name string")
    b = spark.createDataFrame([("midrash rabbah",), ("Midrash Tehillim",)], "name string")
    got = {r.name: (r.match, r.status) for r in catalog.fuzzy_names(a, b, "name").collect()}
    assert got == {"Midrash Rabbah": ("midrash rabbah", "exact"), "midrash  tehilim": ("Midrash Tehillim", "likely"), "Zzz": (None, "none")}


def test_fuzzy_names_equal_full_comparison(spark):
    import difflib

    rng = random.Random(3)
    parts = ["agga", "dat", "pho", "resokh", "com", "mentary", "sha", "hug", "et", "vol", "mid", "rash", "zuta", "rabba"]
    name = lambda: " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))
    a, b = sorted({name() for _ in range(80)} | {"x" * 70, "qqq", "a"}), sorted({name() for _ in range(300)} | {"x" * 66 + "y"})
    want = {x: max((difflib.SequenceMatcher(None, x, y).ratio(), y) for y in b) for x in a}
    frames = [spark.createDataFrame([(x,) for x in n], "name string") for n in (a, b)]
    got = {r.name: r for r in catalog.fuzzy_names(*frames, "name", left_block=32, right_block=64).collect()}
    assert {x: (round(s, 3), y if s >= 0.6 else None) for x, (s, y) in want.items()} == {x: (r.score, r.match) for x, r in got.items()}


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.standard_normal(4) * 0.1 + 3 * (i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<float>")
    out, cost = models.kmeans(df, "vec", 3)
    again, _ = models.kmeans(df, "vec", 3)
    lab = {r.row_id: r.scluster for r in out.collect()}
    assert len({lab[i] for i in range(0, 90, 3)}) == 1 and lab == {r.row_id: r.scluster for r in again.collect()}
    assert models.kmeans(df, "vec", 2)[1] > cost
    s = models.sweep(df, "vec", "row_id", [2, 3, 5]).toPandas().set_index("k")
    assert s.silhouette.idxmax() == 3
    assert models.silhouette(np.ones((3, 2)), np.zeros(3)) is None


def test_corpus_elbow_reads_the_corpus(spark, tmp_path):
    from annalist.plans.stats_queries import corpus_elbow

    rng = np.random.default_rng(4)
    x = np.repeat(10 * np.eye(4, 64), 25, axis=0) + rng.standard_normal((100, 64)) / 10
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "row_id bigint, vec array<float>").coalesce(1).write.parquet(f"{tmp_path}/rabani_unsmoothed_table.parquet")
    got = sorted(corpus_elbow(spark, str(tmp_path)).collect(), key=lambda r: r.k)
    assert [r.k for r in got] == list(range(2, 21))
    assert 0 < got[-1].inertia < got[0].inertia < ((x - x.mean(axis=0)) ** 2).sum()
    y = np.array([r.inertia for r in got])
    bend = np.abs((y - y[-1]) / (y[0] - y[-1]) - (1 - np.arange(19) / 18)) / math.sqrt(2)
    assert [r.elbow for r in got] == [i == int(bend.argmax()) for i in range(19)]
    assert [r.bend for r in got] == pytest.approx(list(bend), abs=1e-8)


def test_kernel_splits_at_every_length(spark, tmp_path, monkeypatch):
    """The strips give what the whole kernel matrix gives, and no length is refused."""

    def whole(x, most, least):
        d = np.maximum(((x[:, None] - x) ** 2).sum(axis=2), 0)
        apart = d[np.triu_indices(len(x), 1)]
        k = np.exp(-d / (np.median(apart[apart > 0]) if (apart > 0).any() else 1.0))
        cost = lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)
        open_, out = {(0, len(x))}, []
        while len(out) < most:
            options = [(cost(a, b) - cost(a, t) - cost(t, b), -t, a, b) for a, b in open_ for t in range(a + least, b - least + 1)]
            if not options:
                break
            gain, t, a, b = max((round(o[0], 9), *o[1:]) for o in options)
            open_ = open_ - {(a, b)} | {(a, -t), (-t, b)}
            out.append((len(out) + 1, -t, gain))
        return out

    rng = np.random.default_rng(8)
    for held in (1, 50, 700, 1_000_000):
        monkeypatch.setattr(sequence, "KERNEL_VALUES", held)
        for x in (rng.standard_normal((60, 3)) + (np.arange(60) > 23)[:, None] * 2, np.ones((9, 2)), rng.integers(0, 2, (31, 1)) * 1.0, rng.standard_normal((3, 2)), rng.standard_normal((5, 2))):
            got, want = sequence.kernel_splits(x, 6, 2), whole(x, 6, 2)
            assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-9)
            d = ((x[:, None] - x) ** 2).sum(axis=2)[np.triu_indices(len(x), 1)]
            assert sequence.median_distance(x) == pytest.approx(np.median(d[d > 0]) if (d > 0).any() else 1.0, rel=1e-12)
    monkeypatch.undo()
    x = rng.standard_normal((3_200, 8)) + (np.arange(3_200) >= 1_234)[:, None] * 3
    assert sequence.kernel_splits(x, 1, 2)[0][1] == 1_234
    from annalist.plans import sequence_queries

    monkeypatch.setattr(sequence_queries, "B", 1)
    rows = [("a", i, i, [float(j) for j in v] + [1.0] * 56) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "filename string, chunk_number int, row_id bigint, vec array<double>").write.parquet(f"{tmp_path}/rabani_unsmoothed_table.parquet")
    assert {(r.place, r.block) for r in sequence_queries.binseg_rbf(spark, str(tmp_path)).collect()} > {(1, 1_234)}


def test_queries_take_all_permutations_seeds_and_epochs(spark, tmp_path):
    from annalist.plans import model_queries, more_queries, sequence_queries

    x = np.random.default_rng(5).standard_normal((120, 64))
    x[60:] += 2
    rows = [(i, "a", i, [float(v) for v in r], "alpha beta gamma") for i, r in enumerate(x)]
    spark.createDataFrame(rows, "row_id bigint, filename string, chunk_number int, vec array<double>, chunk string").write.parquet(f"{tmp_path}/rabani_unsmoothed_table.parquet")
    found = sequence_queries.recursive_segmentation(spark, str(tmp_path)).collect()
    assert any(r.t == 60 for r in found) and all(r.p == 0.005 for r in found)
    assert {(r.word, len(r.vec)) for r in model_queries.word_vectors(spark, str(tmp_path)).collect()} == {("alpha", 100), ("beta", 100), ("gamma", 100)}
    spark.createDataFrame([(i, 1.0 * (i < 15) + i / 1000) for i in range(30)], "text_id int, surprisal_bits double").write.parquet(f"{tmp_path}/word_measurements.parquet")
    assert more_queries.label_permutation_whole(spark, str(tmp_path)).first().p == pytest.approx(1 / 5001)
    assert more_queries._SEEDS == 5


def test_word_vectors_are_trained_in_parcels(spark, monkeypatch):
    """The parts grow with the words, and every word is trained on in every epoch."""
    df = spark.createDataFrame([(f"alpha beta {'gamma' if i % 2 else 'delta'} beta",) for i in range(40)] + [(None,), ("",)], "chunk string")
    assert models.train_word_vectors(df, "chunk").getNumPartitions() == 1
    monkeypatch.setattr(models, "PARCEL_WORDS", 50)
    m = models.train_word_vectors(df, "chunk")
    assert (m.getNumPartitions(), m.getMaxIter(), m.getVectorSize(), m.getMinCount()) == (3, 10, 100, 5)
    assert {r.word for r in m.getVectors().collect()} == {"alpha", "beta", "gamma", "delta"}


def test_layout():
    rng = np.random.default_rng(2)
    p = rng.standard_normal((8, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    q, stress = models.mds(d)
    assert stress < 1e-3 and np.allclose(np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1)), d, atol=0.05)
    c, r = models.bubbles(q, np.array([100, 50, 20, 20, 10, 5, 2, 1.0]))
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) - (r[:, None] + r[None])
    np.fill_diagonal(gap, 1)
    assert gap.min() > -1e-6


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("aba",), ("aba",), (" ",), (None,)], "chunk string")
    v = [r.vec for r in models.hashed_embedding(df, "chunk").collect()]
    assert v[0] == v[1] and v[2] is None and v[3] is None
    e = models.embed_with(df, "chunk", lambda: lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert [r.vec for r in e.collect()] == [[3.0, 1.0], [3.0, 1.0], [1.0, 1.0], [0.0, 1.0]]


def test_cache_key_is_canonical(spark):
    import hashlib

    from annalist.plans.catalog_queries import cache_key

    row = cache_key(spark, "/root/testdata/sf0.001").head()
    files = sorted(r.filename for r in spark.read.parquet("/root/testdata/sf0.001/corpus_catalog.parquet").where(F.col("cat1") == row.cat1).collect())
    want = hashlib.sha256(json.dumps({"files": files, "size": 50}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:24]
    assert row.key == want


def test_alignment(spark):
    from annalist.operators import alignment

    w = spark.createDataFrame([("a", 0, 'שד"ל'), ("a", 1, "-"), ("a", 2, "ab"), ("b", 0, "ab"), ("c", 0, "ab"), ("c", 1, "cd")], "text_id string, word_position int, word string")
    rows = [("a", 0, "שד", "N", True), ("a", 1, '"', "PUNCT", False), ("a", 2, "ל", "V", False), ("a", 3, "ab", "A", False), ("a", 4, ".", "PUNCT", False), ("b", 0, "xy", "N", False), ("c", 0, "abc", "N", False), ("c", 1, "d", "N", False)]
    t = spark.createDataFrame(rows, "text_id string, token_position int, token string, pos string, has_prefix boolean")
    got = {(r.text_id, r.word_position): (r.pos, r.has_prefix) for r in alignment.align_tokens(w, t).collect()}
    assert got == {("a", 0): ("N", True), ("a", 1): ("X", False), ("a", 2): ("A", False)}


def test_alignment_joins_nothing(spark, tmp_path):
    """Words are far more than the documents' size tells, so a join of them may be planned with a broadcast."""
    from annalist.operators import alignment
    from annalist.plans import more_queries

    rows = [(1, 'ab,c d -- שד"ל'), (1, "xyz"), (2, ""), (3, None), (None, "a!"), (4, "-abcd " * 3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = more_queries.token_alignment(spark, str(tmp_path))
    assert "Join" not in d._jdf.queryExecution().toString()
    got = sorted(((r.text_id or 0), r.word_position, r.pos) for r in d.collect())
    assert got == sorted([(1, 0, "T2"), (1, 1, "T1"), (1, 2, "X"), (1, 3, "T2"), (1, 0, "T0"), (0, 0, "T1"), *[(4, i, "T1") for i in range(3000)]])
    w = spark.createDataFrame([("a", 5, "ab"), ("a", 7, None), ("a", 9, "c"), ("b", 0, "-"), ("c", 0, "--"), (None, 0, "a"), ("d", 0, "ab"), ("e", 0, "ab")], "text_id string, word_position int, word string")
    t = [("a", 0, "a", "PUNCT", True), ("a", 1, "b", None, None), ("a", 2, "c", "PUNCT", True), ("c", 0, "-", "N", True), (None, 0, "a", "N", True), ("d", 0, "a", "N", True), ("e", 0, "abc", "N", True)]
    t = spark.createDataFrame(t, "text_id string, token_position bigint, token string, pos string, has_prefix boolean")
    a = alignment.align_tokens(w, t)
    assert "Join" not in a._jdf.queryExecution().toString()
    assert sorted(map(tuple, a.collect())) == [("a", 5, "PUNCT", False), ("a", 7, "X", False), ("a", 9, "PUNCT", False), ("c", 0, "X", False)]


def test_tree_of_titles():
    from annalist.operators.alignment import flatten_titles

    tree = [{"heCategory": "א", "contents": [{"title": "T", "heTitle": "ת"}, {"heCategory": "ב", "contents": [{"title": " U ", "heTitle": "ו", "nodes": [{"title": "V", "heTitle": "ז"}]}]}]}, {"title": "T", "heTitle": "later"}, "x"]
    assert flatten_titles(tree) == [("T", "ת", ["א"]), ("U", "ו", ["א", "ב"]), ("V", "ז", ["א", "ב"])]


def test_blocks_change_nothing(spark):
    """Carried values and moving means are the same however small the blocks."""
    rng = random.Random(3)
    rows = [("ab"[i > 70], i, rng.choice([None, rng.random()])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, idx bigint, v double").repartition(4)
    for block in (7, 1000):
        for strict in (False, True):
            for r in order.carry_forward(df, ["g"], "idx", F.col("v"), "c", strict, block).collect():
                seen = [v for g, i, v in rows if g == r.g and v is not None and (i < r.idx if strict else i <= r.idx)]
                assert r.c == (seen[-1] if seen else None)
        for r in order.moving_mean(df, "g", "idx", "v", "m", 10, 9, 5, max(block, 20)).collect():
            near = [v for g, i, v in rows if g == r.g and r.idx - 10 <= i <= r.idx + 9 and v is not None]
            assert (r.m is None) == (len(near) < 5) and (r.m is None or math.isclose(r.m, sum(near) / len(near)))
