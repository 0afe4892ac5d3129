import pytest

from annalist.llm import entities as e


@pytest.mark.parametrize(
    "name, want",
    [
        ("Commentary of Rokhoh Part II", ["commentary", "of", "rokhoh", "part", "ii"]),
        ("Yalqut Fakaro\u1e25 HaGadol", ["yalqut", "fakaroh", "ha", "gadol"]),
        ("Aggadat_Vuteh_Zuta", ["aggadat", "vuteh", "zuta"]),
        ("\u05de\u05f3 \u05e1\u05d9\u05e0\u05e9\u05d4 \u05d7\u05f4\u05d1", ["\u05de", "\u05e1\u05d9\u05e0\u05e9\u05d4", "\u05d7\u05d1"]),
        (None, []),
        ("", []),
        (" - ", []),
    ],
)
def test_words(name, want):
    assert e.name_words(name) == want


def test_tokens_and_letters():
    assert e.word_tokens("abc") == ["m:^a", "m:ab", "m:bc", "m:c$", "l:^ab", "l:abc", "l:bc$"]
    assert e.word_tokens("\u05d0\u05d1") == ["h:^\u05d0", "h:\u05d0\u05d1", "h:\u05d1$"]
    assert [e.edit_distance(*x) for x in (("abc", "abc"), ("abc", "acb"), ("kitten", "sitting"), ("", "ab"))] == [0, 2, 3, 2]


CAT = "filename string, he_title string, title string, words string, cat1 string, latin string"
OLD = "old_id bigint, old_filename string, he_name string, en_name string, category string, n_words bigint, print_place string, print_year int"


def tables(spark):
    kinds, cores = ["Midrash", "Sefer", "Yalkut", "Aggadat"], [a + b + c for a in ("Ro", "Ta", "Gi", "Vu", "Ke") for b in ("sek", "mol", "nad", "fir", "bug") for c in ("uh", "it", "on")]
    cat, old, want = [], [], set()
    for i, core in enumerate(cores):
        k = kinds[i % 4]
        for j, tail in enumerate(["", "_Zuta", "_Part_I"][: 1 + i % 3]):
            name = f"{k}_{core}{tail}"
            ed = f"PELMO{1600 + i}_" if j == 0 and i % 2 else ""
            f = f"Musar-Letters-{name}-{ed}Sefaria.jsonl"
            cat.append((f, None, None if i % 11 == 0 else name.replace("_", " "), str(1000 + 137 * i + 5000 * j), "Musar", "x"))
            if (i + j) % 4:
                en = f"{core}{tail.replace('_', ' ').replace('Part I', '1')}" + ("" if i % 3 else f", {k}")
                oid = 100 * i + j
                old.append((oid, f"Musar-Letters-{en}-.json", None, None if i % 13 == 0 else en.lower(), "Musar", 1000 + 137 * i + 5000 * j + 7, "Pelmo" if ed else None, 1600 + i if ed else None))
                want.add((f, oid))
    for i in range(25):  # works that the catalog lacks
        old.append((90_000 + i, f"Musar-Letters-Lost{'abcde'[i % 5] * 3}{i}-.json", None, None, "Musar", None, None, None))
    old.append((95_000, None, None, None, None, None, None, None))
    return spark.createDataFrame(cat, CAT), spark.createDataFrame(old, OLD), want


def test_match(spark):
    cat, old, want = tables(spark)
    rows = e.match(cat, old).collect()
    got = {(r.filename, r.old_id) for r in rows}
    assert len({r.old_id for r in rows}) == len(rows)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert all(0.5 <= r.confidence <= 1 for r in rows)


def test_walks_follow_the_graph(spark):
    """Every step of a walk leads to a node of the record before it, and on to nodes of a record that has it."""
    cat, old, _ = tables(spark)
    records, _, frequent = e.prepare(cat, old)
    nodes = [set(r.nodes) for r in records.collect()]
    assert {"midrash", "sefer", "zuta"} <= set(frequent) and any(f"w:{w}" in n for w in frequent for n in nodes)
    walks = [r.walk for r in e.random_walks(records).limit(200).collect()]
    assert len(walks) == 200
    for w in walks:
        assert any(n <= set(w) for n in ({w[0], w[1]},)) and len(w) > e.HOPS
        assert any(set(w[: min(e.BESIDE, 3)]) <= n for n in nodes)


@pytest.mark.parametrize("bits", [5, 11, 15, 21])
def test_blocking_recall(spark, bits):
    """Every pair that the comparison of all pairs accepts is found through the buckets, to nine tenths at least, with few
    planes and with as many as far larger tables have."""
    from pyspark.sql import functions as F

    cat, old, _ = tables(spark)
    records, _, frequent = e.prepare(cat, old)
    table = e.weighted(records, e.train_vectors(records))
    records = e.materialize(e.record_vectors(records, table, set(frequent), e.tables_for(bits)), "vectors")
    found = {(r.a, r.b) for r in e.candidates(records, bits).collect()}
    ids = records.select("rid", "side")
    every = ids.where("side = 'a'").select(F.col("rid").alias("a")).join(ids.where("side = 'b'").select(F.col("rid").alias("b")))
    good = {(r.a, r.b) for r in e.calibrate(e.compare(every, records, table, set(frequent))).where("confidence >= 0.5").collect()}
    assert good and len(good & found) >= 0.9 * len(good)


def test_nothing(spark):
    cat, old, _ = tables(spark)
    assert e.match(cat.limit(0), old.limit(0)).collect() == []
    assert e.match(cat, old.limit(0)).collect() == []
