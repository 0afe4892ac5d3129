import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.sources import files
from annalist.streaming import sessions


def test_json_lines(spark, tmp_path):
    (tmp_path / "A-B-Sefaria.jsonl").write_text('{"location": "x", "segment": 1, "sentence": "a b"}\n\n{broken\n{"location": "y", "segment": 2, "sentence": null}\n', encoding="utf-8")
    df = files.read_segments(spark, str(tmp_path))
    assert sorted((r.filename, r.segment, r.sentence) for r in df.collect()) == [("A-B-Sefaria.jsonl", 1, "a b"), ("A-B-Sefaria.jsonl", 2, None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"u\no', [1.5])], "x string, y string, v array<double>")
    files.write_csv(df, str(tmp_path / "out"))
    first = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv").read_bytes()
    assert first.startswith(b"\xef\xbb\xbf")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()] == [("a", 'q"u\no', "[1.5]")]
    assert files.resolve(spark, str(tmp_path / "none"), str(tmp_path / "out")).endswith("out")
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, str(tmp_path / "none"))


def test_append_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert files.append_missing(df, str(tmp_path / "t"), ["k"]) == 2
    assert files.append_missing(df, str(tmp_path / "t"), ["k"]) == 0
    assert files.append_missing(df.withColumn("k", F.col("k") + 1), str(tmp_path / "t"), ["k"]) == 1


def test_store(spark, tmp_path):
    rows = [("F2", "2.1", 1, "c d"), ("F1", "1.1-3", 2, "b"), ("F1", "1.1-3", 1, "a a a")]
    c = spark.createDataFrame(rows, "filename string, hierarchy string, chunk_number int, chunk string")
    s = files.Store(spark, str(tmp_path))
    assert s.add(c, "m", 50) == 3 and s.add(c, "m", 50) == 0 and s.add(c, "m", 100) == 3
    assert {r.filename: (r.n_chunks, r.words) for r in s.index("m", 50).collect()} == {"F1": (2, 4), "F2": (1, 2)}
    assert [(r.idx, r.chunk) for r in s.load(["F2", "F1"], "m", 50).orderBy("idx").collect()] == [(0, "a a a"), (1, "b"), (2, "c d")]
    with pytest.raises(ValueError, match="F9"):
        s.load(["F9", "F1"], "m", 50)
    titles = spark.createDataFrame([("F1", "", "One")], "filename string, he_title string, title string")
    assert {r.filename: r.name for r in s.catalogue("m", 50, titles).collect()} == {"F1": "One", "F2": "F2"}
    plan = s.chunks("m", 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan


def test_run_log(spark, tmp_path):
    log = files.RunLog(spark, str(tmp_path))
    t0 = dt.datetime(2026, 1, 1)
    a = log.record(t0, 1.5, '{"k":8}', ["b", "a"], 10, 500, "{}")
    assert log.runs().head().meta is None
    b = log.record(t0 + dt.timedelta(hours=1), 1.0, '{"k":9}', ["a"], 1, 50, "{}")
    log.annotate(a, t0, "first")
    log.annotate(a, t0 + dt.timedelta(hours=2), "renamed", tags=["x"])
    got = log.runs().collect()
    assert [r.token for r in got] == [b, a] and got[1].meta.name == "renamed"
    assert log.find('{"k":8}', ["a", "b"]) == a and log.find('{"k":8}', ["a"]) is None


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [("u", 0), ("u", 100), ("u", 5000), ("v", 50), ("w", 90_000)]
    df = spark.createDataFrame(rows, "user string, sec int").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in sessions.session_totals(df, "user", "ts").collect()}
    stream = sessions.session_totals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "ts")
    q = stream.writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT * FROM totals").collect()}
    assert got == {r for r in batch if r[0] != "w"}  # the newest session is still open


def test_stream_sink_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    for check in ("c1", "c2"):
        src = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        sessions.append_stream(src, str(tmp_path / "out"), ["k"], str(tmp_path / check)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
