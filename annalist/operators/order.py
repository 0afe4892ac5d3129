"""The one chronological order, and running sums along it, without a window that holds everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.session import materialize


def global_index(df: DataFrame, *keys, out: str = "idx") -> DataFrame:
    """df with ``out`` = 0..n-1 in the order of ``keys`` (columns or names; nulls where the keys put them).

    Rows are range-partitioned and sorted; a row's index is its place in its partition plus the rows of the
    partitions before, one number per partition. No task sees more than its partition, whatever the keys' skew.
    """
    cols = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__q"))
    placed = materialize(placed, "ordered")
    per = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__b"))  # one row per partition
    return placed.join(F.broadcast(before), "__p").withColumn(out, F.col("__b") + F.col("__q")).drop("__p", "__q", "__b")


def running_total(df: DataFrame, group: list[str], order: str, value: Column, out: str, block: int = 20_000) -> DataFrame:
    """df with ``out`` = sum of ``value`` over the rows before, per group in the order of the integer ``order``.

    Two levels: sums per block of ``order``, their running sum, and a window within each block; a group that holds a
    third of all rows is spread over its blocks.
    """
    names = [f"__rt_g{i}" for i in range(len(group))]
    d = df.withColumn("__rt_v", value).withColumn("__rt_k", F.floor(F.col(order) / block))
    sums = d.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("__rt_k").alias("__rt_k2")).agg(F.sum("__rt_v").alias("__rt_s"))
    w = Window.partitionBy(*names).orderBy("__rt_k2").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__rt_b", F.coalesce(F.sum("__rt_s").over(w), F.lit(0))).drop("__rt_s")
    cond = F.col("__rt_k").eqNullSafe(F.col("__rt_k2"))
    for g, n in zip(group, names, strict=True):
        cond = cond & F.col(g).eqNullSafe(F.col(n))
    inner = Window.partitionBy(*group, "__rt_k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out_value = F.col("__rt_b") + F.coalesce(F.sum("__rt_v").over(inner), F.lit(0))
    return d.join(sums, cond, "left").withColumn(out, out_value).drop("__rt_v", "__rt_k", "__rt_k2", "__rt_b", *names)


def carry_forward(df: DataFrame, group: list[str], order: str, value: Column, out: str, strict: bool = False, block: int = 20_000) -> DataFrame:
    """df with ``out`` = the last non-null ``value`` so far, per group in the order of the integer ``order``; with
    ``strict`` of the rows before only. Two levels, as in running_total: no window runs over a whole group.
    """
    names = [f"__cf_g{i}" for i in range(len(group))]
    d = df.withColumn("__cf_v", value).withColumn("__cf_k", F.floor(F.col(order) / block))
    last = d.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("__cf_k").alias("__cf_k2")).agg(F.max_by("__cf_v", F.when(F.col("__cf_v").isNotNull(), F.col(order))).alias("__cf_l"))
    w = Window.partitionBy(*names).orderBy("__cf_k2").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("__cf_b", F.last("__cf_l", ignorenulls=True).over(w)).drop("__cf_l")
    cond = F.col("__cf_k").eqNullSafe(F.col("__cf_k2"))
    for g, n in zip(group, names, strict=True):
        cond = cond & F.col(g).eqNullSafe(F.col(n))
    inner = Window.partitionBy(*group, "__cf_k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    filled = F.coalesce(F.last("__cf_v", ignorenulls=True).over(inner), F.col("__cf_b"))
    return d.join(last, cond, "left").withColumn(out, filled).drop("__cf_v", "__cf_k", "__cf_k2", "__cf_b", *names)


def moving_mean(df: DataFrame, group: str, order: str, value: str, out: str, before: int, after: int, least: int, block: int = 20_000) -> DataFrame:
    """df with ``out`` = mean of ``value`` over the rows from ``before`` before to ``after`` behind, null below ``least``
    values; ``order`` counts the rows of the whole table without gaps, groups one after the other.

    Rows near the border of a block are also sent to the neighbouring block, so every block has its surroundings.
    """
    k = F.floor(F.col(order) / block)
    near = F.array_distinct(F.array(F.floor((F.col(order) - after) / block), k, F.floor((F.col(order) + before) / block)))
    d = df.withColumn("__mm_own", k).withColumn("__mm_k", F.explode(near))
    w = Window.partitionBy(group, "__mm_k").orderBy(order).rowsBetween(-before, after)
    mean = F.when(F.count(value).over(w) >= least, F.avg(value).over(w))
    return d.withColumn(out, mean).where(F.col("__mm_own") == F.col("__mm_k")).drop("__mm_own", "__mm_k")
