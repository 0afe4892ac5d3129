"""Session helpers: cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a single machine) a
    temporary folder is made and remembered in the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("annalist.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("annalist.shared.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, lost executors do no harm."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annalist/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._annalist_path = path  # noqa: SLF001 - lets discard() find the files
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize(); nothing may read it afterwards."""
    path = getattr(df, "_annalist_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
