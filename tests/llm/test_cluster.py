import numpy as np

from annalist.llm import cluster


def brute(x, threshold):
    """Average linkage by merging the single best pair at a time."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        m = np.stack([x[g].mean(0) for g in groups])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        i, j = divmod(int(s.argmax()), len(groups))
        if s[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_equals_brute_force():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 16)) * 2
    x = np.concatenate([c + rng.standard_normal((12, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for t in (0.3, 0.6, 0.9):
        member = cluster.average_linkage(x, np.ones(len(x)), t)[2]
        assert {frozenset(np.flatnonzero(member == k).tolist()) for k in set(member.tolist())} == brute(x, t)


def test_ties_end():
    x = np.tile(np.eye(4)[0], (9, 1))
    assert len(set(cluster.average_linkage(x, np.ones(9), 0.5)[2].tolist())) == 1


def data(spark, n=3000, parts=4):
    rng = np.random.default_rng(0)
    centres = np.linalg.qr(rng.standard_normal((64, 64)))[0][:4]
    rows = []
    for i in range(n):
        k = 0 if i % 3 == 0 else i % 4  # one group holds a third and more
        v = centres[k] + rng.standard_normal(64) * 0.05
        label = None if i % 97 == 0 else (k + 1) % 4 if i % 101 == 0 else k
        rows.append((i, [float(a) for a in v], label, k))
    bad = [(n, None, 1, -1), (n + 1, [0.0] * 64, 1, -1), (n + 2, [1.0] * 16, 1, -1), (n + 3, [float("nan")] * 64, 1, -1), (n + 4, [None] * 64, 1, -1)]
    df = spark.createDataFrame([(r, v, lab, "x", 1) for r, v, lab, _ in rows + bad], "row_id bigint, vec array<float>, scluster int, cid string, n int").repartition(parts)
    return df, rows


def test_groups_and_labels(spark):
    df, rows = data(spark)
    got = {(r.row, r.prevailing) for r in cluster.relabelled(df, "row_id", "vec", "scluster").collect()}
    assert got == {(i, k) for i, _, lab, k in rows if lab != k}
    d = cluster.describe_clusters(df, "row_id", "vec", "scluster", typical=3).collect()
    assert len(d) == 4 and sum(r.n for r in d) == len(rows) and all(len(r.typical) == 3 and 0.5 < r.cohesion < 1 for r in d)


def test_passes_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 64)
    df, rows = data(spark)
    got = {(r.row, r.prevailing) for r in cluster.relabelled(df, "row_id", "vec", "scluster").collect()}
    assert got == {(i, k) for i, _, lab, k in rows if lab != k}


def mixed(spark, n=2400, parts=6):
    """Groups as mixed as in practice: kindred centres (cosine 0.6), rows with cosine 0.8 to one another, stray rows."""
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    centres = [base[0], base[1], base[2]] + [0.6 * base[i] + 0.8 * base[3 + i] for i in range(3)] + [base[6 + i] for i in range(4)]
    rows, code = [], []
    for i in range(n):
        k = 0 if i % 3 == 0 else i % len(centres)
        v = centres[k] + rng.standard_normal(64) * (0.5 / 8) if i % 50 else rng.standard_normal(64)
        v = v / np.linalg.norm(v)
        rows.append((i, [float(a) for a in v], (k if i % 41 else (k + 1) % 10) if i % 37 else None))
        code.append(v)
    return spark.createDataFrame(rows, "row_id bigint, vec array<float>, scluster int").repartition(parts), np.array(code)


def pair_agreement(a, b):
    """F1 of the pairs of rows in one group."""
    from collections import Counter

    two = lambda c: sum(v * (v - 1) / 2 for v in c.values())
    return 2 * two(Counter(zip(a, b, strict=True))) / (two(Counter(a)) + two(Counter(b)))


def test_agreement_with_exact_linkage(spark, monkeypatch):
    """Sparse blocks, several passes and more groups than a block holds, against average linkage of all rows at once."""
    df, x = mixed(spark)
    profile = cluster.merge_profile(df, "vec", "scluster")
    t = cluster.derived_threshold(profile)
    assert 0.6 < t < 0.8
    exact = cluster.average_linkage(x, np.ones(len(x)), t)[2]
    for block in (1024, 128, 32):
        monkeypatch.setattr(cluster, "BLOCK", block)
        got = {r.row: r.group for r in cluster.cluster_rows(df, "row_id", "vec", "scluster", threshold=t)[0].collect()}
        assert len(got) == len(x)
        assert pair_agreement(exact.tolist(), [got[i] for i in range(len(x))]) >= 0.9, block


def test_strays_are_left(spark, monkeypatch):
    """Rows like no other form groups of their own, counted like all others; the passes end although nothing merges."""
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rows = [(i, [float(j == i) for j in range(64)], 1 if i % 2 else None) for i in range(64)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<float>, scluster int")
    d = cluster.describe_clusters(df, "row_id", "vec", "scluster").collect()
    assert len(d) == 64 and all(r.n == 1 and r.cohesion is None for r in d)
    assert cluster.derived_threshold(cluster.merge_profile(df, "vec", "scluster")) == cluster.THRESHOLD


def test_nothing(spark):
    df, _ = data(spark, 6)
    assert cluster.relabelled(df.limit(0), "row_id", "vec", "scluster").collect() == []
    assert cluster.describe_clusters(df.where("vec IS NULL"), "row_id", "vec", "scluster").collect() == []
    unlabelled = df.withColumn("scluster", df.scluster * None)
    assert cluster.relabelled(unlabelled, "row_id", "vec", "scluster").collect() == []
