"""Per-key results although a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY, _SALT, _HEAVY = "__k", "__salt", "__heavy"


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, with their counts: (key, n, total).

    There can be no more than 1/share of them, which bounds what the caller broadcasts. Null is a key like any
    other. Counting combines on the map side; only one row per task and key is shuffled.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    counts = df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("n") / F.col("total") >= share)


def salted_aggregate(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    salts: int = 32,
    share: float = 0.01,
    seed: int = 7,
) -> DataFrame:
    """Two-stage aggregation by ``key`` that spreads heavy keys over ``salts`` tasks.

    Rows of keys that hold at least ``share`` of the table get a random salt, all others salt 0; ``partial`` is
    computed per (key, salt), then ``merge[name](name)`` combines the partial results per key. The partial results
    must be mergeable (count, sum, min, max, sums of vectors as structs, sketches ...). All rows count.

    Defined cases: a null key is a group of its own; an empty table gives no rows; repeated rows all count; a
    column of df called like an output does no harm, since only the key and the expressions of ``partial`` are read.
    """
    if set(partial) != set(merge):
        raise ValueError("partial and merge must name the same results")
    hot = heavy_keys(df, key, share).select(F.col(f"`{key}`").alias(_HEAVY), F.lit(True).alias(_KEY))
    salted = df.join(F.broadcast(hot), F.col(f"`{key}`").eqNullSafe(F.col(_HEAVY)), "left").withColumn(
        _SALT, F.when(F.col(_KEY), F.floor(F.rand(seed) * salts)).otherwise(F.lit(0)).cast("int")
    )
    first = salted.groupBy(F.col(f"`{key}`").alias(_HEAVY), _SALT).agg(*[e.alias(f"__p_{n}") for n, e in partial.items()])
    out = first.groupBy(_HEAVY).agg(*[merge[n](f"__p_{n}").alias(n) for n in partial])
    return out.withColumnRenamed(_HEAVY, key)


def file_profile(chunks: DataFrame, salts: int = 32, share: float = 0.01) -> DataFrame:
    """Results per file of a chunk table: rows, non-null chunks, words, characters, first and last index, clusters.

    Columns read: filename, chunk, chronological_index, scluster. ``clusters`` is the number of distinct non-null
    scluster values; the partial result is the set itself, which is as small as the number of clusters.
    """
    from annalist.functions.text import word_count

    n_words = F.when(F.col("chunk").isNotNull(), word_count("chunk")).otherwise(0).cast("long")
    partial = {
        "n_rows": F.count(F.lit(1)),
        "n_chunks": F.count("chunk"),
        "n_words": F.sum(n_words),
        "n_chars": F.sum(F.coalesce(F.length("chunk"), F.lit(0)).cast("long")),
        "first_index": F.min("chronological_index"),
        "last_index": F.max("chronological_index"),
        "cluster_set": F.collect_set("scluster"),
    }
    merge = {n: F.sum for n in ("n_rows", "n_chunks", "n_words", "n_chars")} | {"first_index": F.min, "last_index": F.max}
    merge["cluster_set"] = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    out = salted_aggregate(chunks, "filename", partial, merge, salts, share)
    return out.withColumn("clusters", F.size("cluster_set").cast("long")).drop("cluster_set")


def dominant_files(chunks: DataFrame, share: float = 0.02, salts: int = 32) -> DataFrame:
    """Non-null filenames that hold at least ``share`` of all rows (null filenames count in the total)."""
    per_file = salted_aggregate(chunks, "filename", {"n": F.count(F.lit(1))}, {"n": F.sum}, salts)
    total = per_file.agg(F.sum("n").alias("total"))
    kept = per_file.join(F.broadcast(total)).where(F.col("filename").isNotNull() & (F.col("n") / F.col("total") >= share))
    return kept.select("filename")
