"""What clusters are made of, where they lie and how tight they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.vectors import cosine

#: Centroids are sent to all tasks; more groups than this are refused (at 100 numbers, 8 MB).
MOST_GROUPS = 10_000


def group_means(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, n, mean): mean vector of every group of valid vectors.

    Sums are made batch by batch in double precision where the rows are read; what is shuffled is one row per batch
    and group, however many rows a group has.
    """
    kind = df.schema[key].dataType

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            sums = np.add.reduceat(x[order], start, axis=0)
            n = np.diff(np.r_[start, len(order)])
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order][start])), pa.array(n.astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], names=["key", "n", "total"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])
    part = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec")).mapInArrow(run, schema)
    dims = part.select("key", F.posexplode("total").alias("d", "v")).groupBy("key", "d").agg(F.sum("v").alias("v"))
    mean = dims.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("total"))
    size = part.groupBy("key").agg(F.sum("n").alias("n"))
    return size.join(mean, "key").select(F.col("key").alias(key), "n", F.transform("total", lambda v: v / F.col("n")).alias("mean"))


def affinities(df: DataFrame, row_id: str, key: str, vec: str) -> DataFrame:
    """(row_id, key, own_sim, other, other_sim, margin): cosine to the own and to the best other centroid.

    df must hold valid vectors and non-null keys. Ties go to the lowest key; with one group the others are null. The
    centroids are a table of groups, refused above MOST_GROUPS, and the products run as matrix products per batch.
    """
    means = group_means(df, key, vec).orderBy(key).limit(MOST_GROUPS + 1).collect()
    if len(means) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    keys = [r[key] for r in means]
    m = np.array([r["mean"] for r in means]) if means else np.zeros((0, 1))
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    place = {k: i for i, k in enumerate(keys)}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            sim = x @ m.T / np.linalg.norm(x, axis=1, keepdims=True)
            own = np.array([place[k] for k in b.column(1).to_pylist()])
            at = np.arange(len(own))
            own_sim = sim[at, own]
            if len(keys) > 1:
                sim[at, own] = -np.inf
                best = np.round(sim, 9).argmax(1)
                other, other_sim = pa.array([keys[i] for i in best], b.column(1).type), pa.array(sim[at, best])
                margin = pa.array(own_sim - sim[at, best])
            else:
                other, other_sim, margin = pa.nulls(len(at), b.column(1).type), pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own_sim), other, other_sim, margin], names=["row", "key", "own_sim", "other", "other_sim", "margin"])

    schema = T.StructType([T.StructField("row", df.schema[row_id].dataType), T.StructField("key", df.schema[key].dataType), T.StructField("own_sim", T.DoubleType()), T.StructField("other", df.schema[key].dataType), T.StructField("other_sim", T.DoubleType()), T.StructField("margin", T.DoubleType())])
    return df.select(row_id, key, vec).mapInArrow(run, schema).withColumnRenamed("row", row_id).withColumnRenamed("key", key)


def mean_similarity(means: DataFrame, key: str) -> DataFrame:
    """(a, b, sim): cosine of every pair of group means, a table of groups squared."""
    a = means.select(F.col(key).alias("a"), F.col("mean").alias("ma"))
    b = means.select(F.col(key).alias("b"), F.col("mean").alias("mb"))
    return a.join(F.broadcast(b)).select("a", "b", F.round(cosine("ma", "mb"), 6).alias("sim"))


def nearest_groups(sim: DataFrame, k: int) -> DataFrame:
    """(a, rank, b, sim): the k most similar other groups, ties to the lower key."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return sim.where("a <> b").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("a", "rank", "b", "sim")


def sizes(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share): rows of every group and their share."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def composition(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, n, pct_of_group, pct_of_key): cross table with both shares in per cent, and the lift."""
    c = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    g, k, t = c.groupBy(group).agg(F.sum("n").alias("gn")), c.groupBy(key).agg(F.sum("n").alias("kn")), c.agg(F.sum("n").alias("tn"))
    j = c.join(g, group).join(k, key).join(F.broadcast(t))
    return j.select(group, key, "n", F.round(100 * F.col("n") / F.col("gn"), 6).alias("pct_of_group"), F.round(100 * F.col("n") / F.col("kn"), 6).alias("pct_of_key"), F.round((F.col("n") / F.col("gn")) / (F.col("kn") / F.col("tn")), 6).alias("lift"))


def top_per_group(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mode_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value, ties to the lowest."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(c, group, 1, F.desc("n"), F.col(value)).drop("rank")


def density(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """df with density_raw, density_normalized and marker_size from a 2-D histogram with closed right edges."""
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def cell(c: str, lo: str, hi: str):
        # a single value lies in the middle of a range widened by a half on both sides
        wide = F.when(F.col(hi) == F.col(lo), F.lit(bins // 2)).otherwise(F.floor((F.col(c) - F.col(lo)) * bins / F.nullif(F.col(hi) - F.col(lo), F.lit(0))))
        return F.least(wide, F.lit(bins - 1)).cast("int")

    d = df.join(F.broadcast(r)).withColumn("bx", cell(x, "x0", "x1")).withColumn("by", cell(y, "y0", "y1")).drop("x0", "x1", "y0", "y1")
    h = d.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("density_raw"))  # at most bins x bins rows
    e = h.agg(F.min("density_raw").alias("lo"), F.max("density_raw").alias("hi"))
    norm_ = F.when(F.col("hi") > F.col("lo"), (F.col("density_raw") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).otherwise(F.lit(0.0))
    h = h.join(F.broadcast(e)).withColumn("density_normalized", norm_).withColumn("marker_size", 4 + 8 * F.sqrt("density_normalized")).drop("lo", "hi")
    return d.join(F.broadcast(h), ["bx", "by"]).drop("bx", "by")


def axis_bins(df: DataFrame, idx: str, bins: int = 40) -> DataFrame:
    """df with ``pos`` (percentile rank x 100 of the dense index) and ``bin`` = clip(ceil(pos * bins / 100) - 1)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    d = df.join(F.broadcast(total)).withColumn("pos", 100.0 * (F.col(idx) + 1) / F.col("total"))
    b = F.ceil((F.col(idx) + 1) * bins / F.col("total")) - 1
    return d.withColumn("bin", F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")).drop("total")


def concentrations(binned: DataFrame, key: str, bins: int = 40, least: float = 0.05) -> DataFrame:
    """(key, from_pct, to_pct, share_pct, n): stretches of the axis a group is concentrated in.

    Bins at 30 % of the fullest after a 1-2-1 smoothing, one-bin dips bridged; stretches below ``least`` are left
    out. Works on the table of groups x bins.
    """
    c = binned.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = c.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    g = grid.join(c, [key, "bin"], "left").na.fill(0, ["n"])
    w = Window.partitionBy(key).orderBy("bin")
    g = g.withColumn("smooth", (F.coalesce(F.lag("n").over(w), F.lit(0)) + 2 * F.col("n") + F.coalesce(F.lead("n").over(w), F.lit(0))) / 4)
    g = g.withColumn("on", F.col("smooth") >= 0.3 * F.max("smooth").over(Window.partitionBy(key)))
    # dips are bridged from left to right: a bin turned on is a neighbour for the next one, but the one after a dip is on already
    g = g.withColumn("on", F.col("on") | (F.coalesce(F.lag("on").over(w), F.lit(False)) & F.coalesce(F.lead("on").over(w), F.lit(False))))
    g = g.withColumn("island", F.sum((F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int")).over(w))
    size = c.groupBy(key).agg(F.sum("n").alias("size"))
    s = g.where("on").groupBy(key, "island").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("n").alias("n")).join(size, key)
    s = s.where(F.col("n") >= least * F.col("size"))
    return s.select(key, F.bround(100 * F.col("lo") / bins).cast("int").alias("from_pct"), F.bround(100 * (F.col("hi") + 1) / bins).cast("int").alias("to_pct"), F.bround(100 * F.col("n") / F.col("size")).cast("int").alias("share_pct"), "n")

