from annalist.llm import mix


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, same bigint")


TARGETS = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 4), ("gone", 0.1, 2), (None, 0.1, 1), ("zero", 0.0, 1)]


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def rows(scale=1):
    big = [(i, "big", 50 + i % 70, 1) for i in range(900 * scale)]
    small = [(10_000 + i, "small", 40 + i % 30, 2 if i < 40 else 1) for i in range(120)]
    tiny = [(20_000 + i, "tiny", 30 + i, 1) for i in range(60)] + [(29_999, "tiny", 9_000, 1)]
    return big + small + tiny + [(30_000, None, 5, 1), (30_001, "elsewhere", 5, 1)]


def test_shares_and_repeats(spark):
    s, t = sizes(spark, rows()), targets(spark)
    m = mix.mixture(s, t)
    got = m.collect()
    assert len({r.doc_id for r in got}) == len(got)
    limit = {"big": 1, "small": 3, "tiny": 4}
    assert all(1 <= r.copies <= limit[r.source] for r in got)
    rep = {r.source: r for r in mix.shares(m, s, t).collect()}
    assert set(rep) == {"big", "small", "tiny", "gone"} and rep["gone"].actual_share == 0
    for name, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.2)):
        assert abs(rep[name].actual_share - share) < 0.01, rep[name]
    assert {(r.doc_id, r.copies) for r in mix.mixture(s, t).collect()} == {(r.doc_id, r.copies) for r in got}


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document's mean number of copies is its expected number."""
    base = [(i, "a", 10, 2 if i < 50 else 1) for i in range(200)] + [(1000 + i, "b", 10, 1) for i in range(100)]
    s, t = sizes(spark, base), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])
    counts = mix.multiplicities(s)
    planned = mix.plan(counts, t, 1000)
    assert dict(zip(planned.source, planned.planned, strict=True)) == {"a": 500.0, "b": 500.0}
    cut = mix.cuts(s, counts, planned)
    rate = dict(zip(cut.source, cut.rate, strict=True))
    hits = dict.fromkeys((r[0] for r in base), 0)
    for seed in range(12):
        for r in mix.pareto_sample(s, mix.cuts(s, counts, planned, seed), seed).collect():
            hits[r.doc_id] += r.copies
    twice = sum(hits[i] for i in range(50)) / 50 / 12
    once = sum(hits[i] for i in range(50, 200)) / 150 / 12
    assert abs(twice - rate["a"] / 2) < 0.06 and abs(once - rate["a"]) < 0.06


def test_a_document_above_its_source_keeps_its_probability(spark):
    """One document holds more than its source's whole share: drawn as often as its probability says, never dropped,
    and what it leaves open or overdraws is taken from the smaller classes, or reported."""
    base = [(i, "a", 8 + i % 5, 1) for i in range(400)] + [(999, "a", 9_000, 1)] + [(1000 + i, "b", 10, 1) for i in range(900)]
    s, t = sizes(spark, base), targets(spark, [("a", 0.5, 2), ("b", 0.5, 1)])
    counts = mix.multiplicities(s)
    planned = mix.plan(counts, t, 12_000)
    drawn = []
    for seed in range(14):
        m = mix.pareto_sample(s, mix.cuts(s, counts, planned, seed), seed).collect()
        drawn.append(any(r.doc_id == 999 for r in m))
        small = sum(r.tokens * r.copies for r in m if r.source == "a" and r.doc_id != 999)
        # drawn: it alone is above the plan and nothing else is needed; not drawn: the others are repeated to fill the plan
        assert small == 0 if drawn[-1] else abs(small - 6_000) < 60
    assert 0.2 < sum(drawn) / 14 < 0.85
    rep = {r.source: r for r in mix.shares(mix.mixture(s, t, 12_000), s, t, 12_000).collect()}
    assert abs(rep["b"].gap) <= 10 and rep["a"].gap == rep["a"].tokens - rep["a"].planned


def test_nothing(spark):
    none = sizes(spark, [])
    assert mix.mixture(none, targets(spark)).collect() == []
    assert mix.mixture(sizes(spark, rows()), targets(spark, [])).collect() == []
    assert {r.tokens for r in mix.shares(mix.mixture(none, targets(spark)), none, targets(spark)).collect()} == {0}


def test_sized(spark):
    texts = [(1, "a", "x y"), (2, "a", "x y"), (3, "a", None), (4, "a", ""), (5, None, "x"), (6, "b", "x y")]
    df = spark.createDataFrame(texts, "doc_id bigint, source string, text string")
    assert {(r.doc_id, r.same) for r in mix.sized(df, "doc_id", "source", "text").collect()} == {(1, 2), (2, 2), (6, 1)}
