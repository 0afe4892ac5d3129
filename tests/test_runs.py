import datetime as dt
import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from annalist.functions import cleaning
from annalist.functions.text import strip_points
from annalist.jobs import Jobs
from annalist.operators import catalog, labels, runs
from annalist.sources import files


def test_genre_rules(spark):
    rules = spark.createDataFrame([("late", "title", "A"), ("law", "category", "c"), ("law", "except", "B"), ("zoo", "category", "d")], "genre string, kind string, value string")
    df = spark.createDataFrame([("A", "c"), ("B", "c"), ("C", "c"), (None, "d"), ("C", None), (None, None)], "t string, c string")
    got = [r.genre for r in labels.assign_genres(df, "t", "c", rules).orderBy("t", "c").collect()]
    assert got == [None, "zoo", "late", None, None, "law"]
    assert labels.assign_genres(df.limit(0), "t", "c", rules).collect() == []
    d = labels.assign_genres(df, "t", "c", rules)
    assert labels.require_counts(d, "genre", {"late": 1, "law": 1}) is d
    with pytest.raises(ValueError, match="law: 1 instead of 2; none: 0 instead of 1"):
        labels.require_counts(d, "genre", {"law": 2, "none": 1})


def test_manual_names_and_full_cascade(spark):
    a = spark.createDataFrame([("Midrash Rabbah",), ("midrash  tehilim",), ("Zzz",), ("Qqq",), (None,)], "name string")
    b = spark.createDataFrame([("midrash rabbah",), ("Midrash Tehillim",)], "name string")
    manual = spark.createDataFrame([("Zzz", "Midrash Tehillim"), ("Zzz", "Midrash Tehillim"), ("Midrash Rabbah", "never"), ("Qqq", None)], "name string, match string")
    got = {r.name: (r.match, r.status) for r in catalog.fuzzy_names(a, b, "name", manual=manual).collect()}
    assert got == {"Midrash Rabbah": ("midrash rabbah", "exact"), "midrash  tehilim": ("Midrash Tehillim", "likely"), "Zzz": ("Midrash Tehillim", "manual"), "Qqq": (None, "none")}
    names = spark.createDataFrame([("One",), ("One of Two",), ("Onee Thrree Fourr",), ("Zzz",), ("Qqq",)], "n string")
    titles = spark.createDataFrame([("ONE",), ("Onee Three Four",)], "t string")
    by_hand = spark.createDataFrame([("Zzz", "Z"), ("One", "never")], "n string, t string")
    full = {r.n: (r.t, r.how) for r in catalog.title_cascade_full(names, titles, "n", "t", manual=by_hand).collect()}
    assert full == {"One": ("ONE", "equal"), "One of Two": ("ONE", "shortened"), "Onee Thrree Fourr": ("Onee Three Four", "fuzzy"), "Zzz": ("Z", "manual"), "Qqq": (None, "none")}


def test_cleaning_steps(spark):
    one = lambda t, **k: spark.createDataFrame([(t,)], "t string").select(cleaning.clean_standard("t", **k)).head()[0]
    assert one("<b>\u05d0\u05b8\u05d1</b> (x) [\u05d2] \u05d3-\u05d4-\u05d5, abc \u05d6\u05f3 *") == "\u05d0\u05d1 \u05d2 \u05d3 \u05d4 \u05d5 \u05d6"
    assert one("\ufb2a\u200f\ufb31") == "\u05e9\u05d1"
    assert one("<\u05d0> [\u05d1] \u05d2") == "\u05d1 \u05d2" and one("<\u05d0> [\u05d1] \u05d2", square_notes=True) == "\u05d0 \u05d2"
    assert one(None) is None and one("") == ""
    clean, n = cleaning.clean_unit("t")
    t = spark.createDataFrame([("\u05e4\u05e1\u05e7\u05d0 \u05d0 \u05d0\u05d5\u05ea \u05d1  \u05d2\u05b8 (\u05d3 \u05d4) ()",), (None,)], "t string").select(clean, n).collect()
    assert [tuple(r) for r in t] == [("\u05d2 ()", 1), (None, None)]
    s = spark.createDataFrame([("\ufb2f\u00e9 \uff21",), (None,), ("",)], "t string").select(strip_points("t")).collect()
    assert [r[0] for r in s] == ["\u05d0e A", None, ""]


def test_distinct_ids(spark):
    df = spark.createDataFrame([(1, "f", "a b"), (2, "f", "a_b"), (3, "g", "a b"), (4, "f", "--"), (5, "f", "x" * 80)], "row_id int, f string, loc string")
    assert {r.row_id: r.unit for r in cleaning.distinct_ids(df, "f", "loc", "row_id").collect()} == {1: "a_b", 2: "a_b__2", 3: "a_b", 4: "unit", 5: "x" * 60}


def test_validation(spark):
    rows = [("f", "1_part_1", 1, "a b", "o", 1, 2, 2, ["c"]), ("f", "1_part_2", 2, "a b c d e", "o", 4, 8, 5, []), ("f", None, 5, None, None, 0, 1, None, None)]
    df = spark.createDataFrame(rows, "filename string, location string, segment bigint, sentence string, orig_sentence string, from_word int, to_word int, text_length int, categories array<string>").withColumn("row_id", F.col("segment"))
    got = {r.check: r.violations for r in catalog.validation_checks(df, {"row_id"}).collect()}
    want = {"fields are there": 5, "no other fields": 1, "types are right": 0, "parts follow one another": 1, "no empty text": 1, "no empty original": 1, "categories are given": 2, "at least 5 words": 2}
    assert {k: got[k] for k in want} == want and got["segments follow one another in a file"] == 2 and got["from_word is 1 or more"] == 1


def test_compare_runs(spark):
    kind = "params map<string,string>, files array<string>, results map<string,double>"
    a = spark.createDataFrame([({"k": "8", "chunk_size": "50"}, ["x", "y"], {"n": 1.0})], kind)
    b = spark.createDataFrame([({"k": "9", "chunk_size": "50", "model": "m"}, ["y", "z", "w"], {"n": 1.0})], kind)
    got = {(r.part, r.name): (r.a, r.b, r.differs) for r in runs.compare_runs(a, b).collect()}
    assert got[("param", "k")] == ("8", "9", True) and got[("param", "chunk_size")][2] is False and got[("param", "model")] == (None, "m", True)
    assert got[("files", "common")][0] == "1" and got[("files", "only_b")] == ("0", "2", True) and got[("result", "n")][2] is False
    assert got[("verdict", "clusterings")][0] == "files differ; model differs"
    c = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "chronological_index bigint, scluster int")
    same = {(r.part, r.name): r.a for r in runs.compare_runs(a, a, c, c.withColumn("scluster", F.col("scluster") + 7)).collect()}
    assert same[("verdict", "clusterings")] == "comparable" and float(same[("agreement", "adjusted_rand")]) == 1.0
    assert not any(r.part == "agreement" for r in runs.compare_runs(a, b, c, c).collect())


def test_digest_and_corpus(spark, tmp_path):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("f", i, f"t{i}") for i in range(5)] + [("g", 0, "t0"), ("g", 1, None)]
    df = spark.createDataFrame(rows, "g string, i int, t string").repartition(3)
    want = {"f": h(h(h("t0") + h("t1")) + h(h("t2") + h("t3")) + h(h("t4"))), "g": h(h(h("t0")))}
    assert {r.g: r.digest for r in runs.corpus_digest(df, "g", ["i"], "t", 2).collect()} == want
    out = runs.write_corpus(df, str(tmp_path / "c"), F.col("t").isNotNull(), "g", ["i"], "t")
    assert (out["rows"], out["dropped"]) == (6, 1) and len(out["digest"]) == 64
    assert runs.write_corpus(df.orderBy(F.desc("i")), str(tmp_path / "d"), F.col("t").isNotNull(), "g", ["i"], "t") == out
    assert runs.corpus_digest(df.limit(0), "g", ["i"], "t").collect() == []


def test_grid_goes_on():
    def run(c):
        if c["k"] == 2:
            raise ValueError("no")
        return {"p": c["k"] / 10}

    done = runs.run_grid([{"k": 1}], run)
    again = runs.run_grid([{"k": 1}, {"k": 2}, {"k": 3}], lambda c: {"p": 0} if c["k"] == 1 else run(c), done)
    assert [r.get("p") for r in again.values()] == [0.1, None, 0.3] and "ValueError: no" in list(again.values())[1]["error"]


def test_cache_titles_and_import(spark, tmp_path):
    c = files.Cache(spark, str(tmp_path / "cache"))
    key = c.key(["b", "a"], 50)
    assert key == c.key(["a", "b"], 50) != c.key(["a", "b"], 60) and c.get(key) is None
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [c.get_or_make(key, make)[1] for _ in range(2)] == [False, True] and made == [1] and c.get(key).count() == 3
    (tmp_path / "titles.json").write_text('{"filename": "f", "title": "T"}\n{"filename": "g", "ti\nnull\n{"title": "x"}\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_titles(spark, str(tmp_path / "titles.json")).collect()] == [("f", "T", None)]
    chunks = spark.createDataFrame([("F", "1", 2, "c d"), ("F", "1", 1, None), (None, "1", 1, "x")], "filename string, hierarchy string, chunk_number int, chunk string")
    s = files.Store(spark, str(tmp_path / "store"))
    assert [tuple(r) for r in s.import_cache(chunks.where("filename IS NOT NULL"), "m", 50).collect()] == [("F", 2, 2, 1, 2)]
    s.import_cache(chunks.where("filename IS NOT NULL"), "m", 50)
    assert [tuple(r) for r in s.models().collect()] == [("m", 50, 1, 2)]


def test_run_log_tolerates_and_copies(spark, tmp_path):
    log = files.RunLog(spark, str(tmp_path))
    t = log.record(dt.datetime(2024, 1, 1), 2.0, "{}", ["a"], 3, 4, "{}")
    (tmp_path / "runs" / "old.json").write_text('{"token": "old", "started": "2020-01-01T00:00:00"}\n{broken\n', encoding="utf-8")
    got = {r.token: (r.files, r.results, r.seconds) for r in log.runs().collect()}
    assert got == {t: (["a"], "{}", 2.0), "old": ([], "{}", None)}
    new = log.copy_as_new(t, dt.datetime(2024, 2, 1))
    assert new != t and [r.token for r in log.runs().collect()] == [new, t, "old"] and log.find("{}", ["a"]) == new
    with pytest.raises(ValueError):
        log.copy_as_new("none", dt.datetime(2024, 2, 1))


def test_jobs(spark):
    jobs, gate = Jobs(spark), threading.Event()

    def work(job):
        job.stage = "counting"
        gate.wait(20)
        return spark.range(1000, numPartitions=4).count()

    a = jobs.start("k", work)
    assert jobs.start("k", work) is a and a.state == "running" and 0 <= a.progress() < 1
    gate.set()
    assert a.wait(60).result == 1000 and a.state == "done" and a.progress() == 1.0 and a.stage == "counting"
    bad = jobs.start("k", lambda job: 1 / 0).wait(60)
    assert bad is not a and bad.state == "failed" and isinstance(bad.error, ZeroDivisionError)
