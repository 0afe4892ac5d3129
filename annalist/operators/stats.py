"""Ranks, adjusted p-values, agreement of labellings, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.order import global_index, running_total


def average_ranks(df: DataFrame, group: str, value: str, out: str, descending: bool = True) -> DataFrame:
    """df with the rank of ``value`` in its group, ties sharing the mean of their places.

    Counts of distinct values are put in order by range partitions and summed by blocks, then joined back: a group
    that holds a third of all rows is never sorted by one task.
    """
    c = df.groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    c = global_index(c, "__g", F.col("__v").desc() if descending else F.col("__v").asc(), out="__k")
    c = running_total(c, ["__g"], "__k", F.col("__n"), "__b").select("__g", "__v", (F.col("__b") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(c, (F.col(group) == F.col("__g")) & (F.col(value) == F.col("__v"))).drop("__g", "__v")


def spearman(df: DataFrame, group: str, x: str, y: str, least: int = 20) -> DataFrame:
    """(group, n, rho) of groups with at least ``least`` rows; rows must have both values."""
    r = average_ranks(average_ranks(df.select(group, x, y), group, x, "__rx"), group, y, "__ry")
    return r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("__rx", "__ry"), F.stddev_pop("__rx") * F.stddev_pop("__ry")).alias("rho")).where(F.col("n") >= least)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q", block: int = 20_000) -> DataFrame:
    """df with adjusted p-values: the least p * m / rank over all ranks from the row's own on, at most 1.

    The running minimum goes over blocks of ranks first and within blocks after.
    """
    d = global_index(df, p, out="__k")
    m = d.agg(F.count(F.lit(1)).alias("__m"))
    d = d.join(F.broadcast(m)).withColumn("__a", F.col(p) * F.col("__m") / (F.col("__k") + 1)).withColumn("__blk", F.floor(F.col("__k") / block))
    per = d.groupBy("__blk").agg(F.min("__a").alias("__min"))
    after = Window.orderBy(F.desc("__blk")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    per = per.select("__blk", F.min("__min").over(after).alias("__after"))
    w = Window.partitionBy("__blk").orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(per), "__blk")
    return d.withColumn(out, F.least(F.min("__a").over(w), F.coalesce("__after", F.lit(1.0)), F.lit(1.0))).drop("__k", "__m", "__a", "__blk", "__after")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """(ari) of a contingency table (a, b, n)."""

    def pairs(c):
        return (F.col(c) * (F.col(c) - 1) / 2).cast("double")

    ra, rb = table.groupBy("a").agg(F.sum("n").alias("n")), table.groupBy("b").agg(F.sum("n").alias("n"))
    one = table.agg(F.sum(pairs("n")).alias("s"), F.sum("n").alias("n")).join(ra.agg(F.sum(pairs("n")).alias("sa"))).join(rb.agg(F.sum(pairs("n")).alias("sb")))
    expected = F.col("sa") * F.col("sb") / F.nullif(pairs("n"), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.coalesce((F.col("s") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def correspondence(table: DataFrame) -> DataFrame:
    """(a, b, share, back): the best b of every a, with the shares of a and of b in per cent, rounded half to even."""
    w = Window.partitionBy("a")
    t = table.withColumn("row", F.sum("n").over(w)).withColumn("col", F.sum("n").over(Window.partitionBy("b")))
    t = t.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "b"))).where("r = 1")
    return t.select("a", "b", F.bround(100 * F.col("n") / F.col("row")).cast("int").alias("share"), F.bround(100 * F.col("n") / F.col("col")).cast("int").alias("back"))


def residuals(df: DataFrame, y: str, x: str, out: str = "residual") -> DataFrame:
    """df with y minus its least-squares line on x."""
    fit = df.agg(F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__i"))
    return df.join(F.broadcast(fit)).withColumn(out, F.col(y) - F.col("__s") * F.col(x) - F.col("__i")).drop("__s", "__i")


def elbow(curve: DataFrame) -> DataFrame:
    """(k, inertia, bend, gain, elbow, band_low, band_high, flat) of a sweep (k, inertia): a few dozen rows."""
    w = Window.partitionBy().orderBy("k")
    whole = Window.partitionBy().orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k0, k1, i0, i1 = (f(c).over(whole) for f, c in ((F.first, "k"), (F.last, "k"), (F.first, "inertia"), (F.last, "inertia")))
    d = curve.select("k", "inertia", F.try_divide(F.col("k") - k0, k1 - k0).alias("xn"), F.try_divide(F.col("inertia") - i1, i0 - i1).alias("yn"), F.coalesce(100 * F.try_divide(F.lag("inertia").over(w) - F.col("inertia"), F.lag("inertia").over(w)), F.lit(0.0)).alias("gain"))
    d = d.withColumn("bend", F.round(F.abs(F.col("yn") - (1 - F.col("xn"))) / F.sqrt(F.lit(2.0)), 9))
    every = Window.partitionBy()
    d = d.withColumn("most", F.max("bend").over(every))
    near = F.when(F.col("bend") >= 0.85 * F.col("most"), F.col("k"))
    return d.select("k", "inertia", "bend", "gain", (F.col("k") == F.min(F.when(F.col("bend") == F.col("most"), F.col("k"))).over(every)).alias("elbow"), F.min(near).over(every).alias("band_low"), F.max(near).over(every).alias("band_high"), (F.col("most") < 0.08).alias("flat"))
