"""Sources and sinks: JSON lines, CSV, the store of chunk vectors, the run log, resumable writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType(
    [T.StructField("location", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("sentence", T.StringType()), T.StructField("orig_sentence", T.StringType()),
     T.StructField("from_word", T.IntegerType()), T.StructField("to_word", T.IntegerType()), T.StructField("text_length", T.IntegerType()), T.StructField("title", T.StringType()),
     T.StructField("he_title", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("type", T.StringType())]
)


def read_segments(spark: SparkSession, path: str, schema: T.StructType = SEGMENT) -> DataFrame:
    """JSON lines, one file per work: blank and malformed lines are skipped, ``filename`` is the file's name."""
    bad = "_malformed"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return df.withColumn("filename", name).where(F.col(bad).isNull()).drop(bad)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog from CSV or Parquet with all columns as strings; rows without hierarchy are left to the caller."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return df.withColumnRenamed("file", "filename") if "filename" not in df.columns else df


def resolve(spark: SparkSession, *paths: str) -> str:
    """The first path that exists."""
    conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001
    for p in paths:
        hp = spark._jvm.org.apache.hadoop.fs.Path(p)  # noqa: SLF001
        if hp.getFileSystem(conf).exists(hp):
            return p
    raise FileNotFoundError(", ".join(paths))


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with header, as one folder of part files; with ``bom`` each begins with a byte-order mark, which
    spreadsheets want. Arrays and structs are written as JSON."""
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    out = df.select(*flat)
    if bom and out.columns:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, all strings, a byte-order mark removed."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Several named tables, in place of the sheets of a workbook."""
    for name, df in tables.items():
        write_csv(df, f"{folder.rstrip('/')}/{name}")


def append_missing(df: DataFrame, path: str, key: list[str], partition: list[str] | None = None) -> int:
    """Append the rows whose key the table at ``path`` lacks; the number of appended rows. Can be repeated at will.

    The new rows are found by an anti join and written once; a job that is lost halfway leaves nothing half written.
    """
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001 - no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    from annalist.session import materialize

    new = materialize(df, "append")
    n = new.count()
    if n:
        w = new.write.mode("append")
        (w.partitionBy(*partition) if partition else w).parquet(path)
    return n


def cache_counts(chunks: DataFrame) -> DataFrame:
    """(filename, n_chunks, words, first, last) of a table of chunks."""
    from annalist.functions.text import word_count

    words = F.sum(F.coalesce(F.when(F.col("chunk").isNotNull(), word_count("chunk")), F.lit(0)).cast("long"))
    return chunks.where("filename IS NOT NULL").groupBy("filename").agg(F.count(F.lit(1)).alias("n_chunks"), words.alias("words"), F.min("chunk_number").alias("first"), F.max("chunk_number").alias("last"))


class Store:
    """Chunk vectors by model and chunk size: one Parquet table, partitioned, so a selection reads only its part."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, chunks: DataFrame, model: str, size: int) -> int:
        """Append the files that are not there yet; the number of chunks appended."""
        df = chunks.withColumn("model", F.lit(model)).withColumn("chunk_size", F.lit(size))
        spark = self.spark
        try:
            done = spark.read.parquet(f"{self.root}/chunks").where((F.col("model") == model) & (F.col("chunk_size") == size)).select("filename").distinct()
            df = df.join(done, "filename", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        from annalist.session import materialize

        new = materialize(df, "store")
        n = new.count()
        if n:
            new.repartitionByRange("filename").write.mode("append").partitionBy("model", "chunk_size").parquet(f"{self.root}/chunks")
        return n

    def chunks(self, model: str, size: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/chunks").where((F.col("model") == model) & (F.col("chunk_size") == size))

    def index(self, model: str, size: int) -> DataFrame:
        """(filename, n_chunks, words, hierarchy)."""
        from annalist.functions.text import word_count

        return self.chunks(model, size).groupBy("filename").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(word_count("chunk")).alias("words"), F.first("hierarchy", ignorenulls=True).alias("hierarchy"))

    def models(self) -> DataFrame:
        """(model, chunk_size, files, chunks) of everything in the store."""
        return self.spark.read.parquet(f"{self.root}/chunks").groupBy("model", "chunk_size").agg(F.count_distinct("filename").alias("files"), F.count(F.lit(1)).alias("chunks"))

    def import_cache(self, cached: DataFrame, model: str, size: int) -> DataFrame:
        """Take a cached table of chunks into the store, files that are there already left alone; the (filename, n_chunks,
        words, first, last) of what the table holds."""
        self.add(cached, model, size)
        return cache_counts(cached)

    def catalogue(self, model: str, size: int, titles: DataFrame) -> DataFrame:
        """Index with names: Hebrew, else English, else the last part of the filename."""
        last = F.element_at(F.split(F.regexp_replace("filename", r"\.jsonl?$", ""), "-"), -1)
        j = self.index(model, size).join(titles.select("filename", "he_title", "title"), "filename", "left")
        return j.withColumn("name", F.coalesce(F.nullif("he_title", F.lit("")), F.nullif("title", F.lit("")), last))

    def load(self, files: list[str], model: str, size: int) -> DataFrame:
        """The chunks of the files in chronological order with ``idx``; an error names files that are missing."""
        from annalist.operators.catalog import hierarchy_key
        from annalist.operators.order import global_index

        wanted = self.spark.createDataFrame([(f,) for f in files], "filename string")
        c = self.chunks(model, size).where(F.col("filename").isin(files) if len(files) <= 1000 else F.lit(True)).join(F.broadcast(wanted), "filename", "left_semi")
        missing = [r[0] for r in wanted.join(c.select("filename").distinct(), "filename", "left_anti").collect()]
        if missing:
            raise ValueError(f"not in the store: {', '.join(sorted(missing))}")
        return global_index(c.withColumn("__h", hierarchy_key("hierarchy")), "__h", "filename", "chunk_number").drop("__h")


def missing_path(e: Exception) -> bool:
    """Whether a read failed because there is nothing yet."""
    return any(c in str(e) for c in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title, he_title) from JSON lines; records that do not parse or lack a filename are left out, of a file
    named twice the first by title counts."""
    return parse_titles(spark.read.text(path), "value")


def parse_titles(df: DataFrame, record: str) -> DataFrame:
    """read_titles of JSON texts in a column."""
    t = df.select(F.from_json(F.col(record), "filename string, title string, he_title string", {"mode": "PERMISSIVE"}).alias("t")).where("t.filename IS NOT NULL")
    return t.groupBy("t.filename").agg(F.min(F.struct("t.title", "t.he_title")).alias("m")).select("filename", "m.title", "m.he_title")


class Cache:
    """Results by the hash of their canonical key: written once, read back by whoever asks for the same key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(files: list[str], size: int, **more) -> str:
        import hashlib
        import json

        return hashlib.sha256(json.dumps({"files": sorted(files), "size": size, **more}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]

    def get(self, key: str) -> DataFrame | None:
        """The table of a key; None where there is none. A table that was not written to its end counts as none."""
        try:
            resolve(self.spark, f"{self.root}/{key}/_SUCCESS")
        except FileNotFoundError:
            return None
        return self.spark.read.parquet(f"{self.root}/{key}")

    def get_or_make(self, key: str, make) -> tuple[DataFrame, bool]:
        """(table, whether it was there)."""
        found = self.get(key)
        if found is not None:
            return found, True
        make().write.mode("overwrite").parquet(f"{self.root}/{key}")
        return self.spark.read.parquet(f"{self.root}/{key}"), False


class RunLog:
    """Records of runs as JSON documents in one table; notes are appended, the latest wins."""

    RUN = "token string, started timestamp, seconds double, params string, files array<string>, chunks bigint, words bigint, results string"
    META = "token string, changed timestamp, name string, runner string, notes string, tags array<string>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def record(self, started, seconds: float, params: str, files: list[str], chunks: int, words: int, results: str) -> str:
        token = uuid.uuid4().hex
        self.spark.createDataFrame([(token, started, float(seconds), params, sorted(files), chunks, words, results)], self.RUN).write.mode("append").json(f"{self.root}/runs")
        return token

    def annotate(self, token: str, changed, name: str, runner: str = "", notes: str = "", tags: list[str] | None = None) -> None:
        self.spark.createDataFrame([(token, changed, name, runner, notes, tags or [])], self.META).write.mode("append").json(f"{self.root}/meta")

    def runs(self) -> DataFrame:
        """Runs, newest first, with their latest notes. Records that do not parse are left out; what older records lack is
        filled in (no files, no results, seconds unknown)."""
        bad = "_malformed"
        runs = self.spark.read.schema(f"{self.RUN}, {bad} string").option("columnNameOfCorruptRecord", bad).json(f"{self.root}/runs")
        runs = runs.where(F.col(bad).isNull() & F.col("token").isNotNull()).drop(bad)
        runs = runs.withColumns({"files": F.coalesce("files", F.array().cast("array<string>")), "results": F.coalesce("results", F.lit("{}")), "params": F.coalesce("params", F.lit("{}"))})
        try:
            meta = self.spark.read.schema(self.META).json(f"{self.root}/meta").groupBy("token").agg(F.max_by(F.struct("name", "runner", "notes", "tags"), "changed").alias("meta"))
        except Exception as e:  # noqa: BLE001 - no notes yet
            if not missing_path(e):
                raise
            meta = self.spark.createDataFrame([], "token string, meta struct<name:string,runner:string,notes:string,tags:array<string>>")
        return runs.join(meta, "token", "left").orderBy(F.desc("started"), "token")

    def copy_as_new(self, token: str, started) -> str:
        """A new run with the parameters, files and results of an old one; its token."""
        r = self.runs().where(F.col("token") == token).head()
        if r is None:
            raise ValueError(f"no run {token}")
        return self.record(started, r.seconds or 0.0, r.params, list(r.files), r.chunks or 0, r.words or 0, r.results)

    def find(self, params: str, files: list[str]) -> str | None:
        """Token of the newest run with the same parameters and files."""
        key = F.sha2(F.to_json(F.struct(F.lit(params).alias("p"), F.array(*[F.lit(f) for f in sorted(files)]).alias("f"))), 256)
        own = F.sha2(F.to_json(F.struct(F.col("params").alias("p"), F.col("files").alias("f"))), 256)
        row = self.runs().where(own == key).select("token").head()
        return row[0] if row else None
