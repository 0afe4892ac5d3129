"""N-grams of clusters: counts, class-based TF-IDF, rate ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text import ngrams, tokens, words
from annalist.operators.order import global_index
from annalist.session import materialize

NONE = "No n-grams available"


def cluster_ngrams(frame: DataFrame, n: int) -> DataFrame:
    """(scluster, gram, n, first): counts of word n-grams within chunks; ``first`` orders them by their first (idx, place)."""
    g = frame.select("scluster", "idx", F.posexplode(ngrams(words("chunk"), n)).alias("place", "gram"))
    return g.groupBy("scluster", "gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("idx") * F.lit(1 << 31) + F.col("place")).alias("first"))


def top_ngrams(frame: DataFrame, n: int, k: int = 20) -> DataFrame:
    """(scluster, rank, gram, n): the k most frequent n-grams of every cluster, ties in the order they are first seen."""
    c = cluster_ngrams(frame, n)
    w = Window.partitionBy("scluster").orderBy(F.desc("n"), "first")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("scluster", "rank", "gram", "n")


def stream_ngrams(frame: DataFrame, *sizes: int) -> DataFrame:
    """(scluster, size, gram): every n-gram of a cluster's token stream, across the borders of its chunks.

    Chunks without tokens are skipped. A chunk is followed by the first tokens of the next chunks of its cluster,
    which come by equi-joins on the place in the order of (cluster, idx): no window runs over a whole cluster.
    """
    most = max(sizes)
    t = frame.select("scluster", "idx", tokens("chunk").alias("t")).where("size(t) > 0")
    d = global_index(t, "scluster", "idx", out="g")
    heads = d.select("scluster", "g", F.slice("t", 1, max(most - 1, 1)).alias("h"))
    for i in range(1, most):
        nxt = heads.select(F.col("scluster").alias("c"), (F.col("g") - i).alias("at"), F.col("h").alias(f"h{i}"))
        d = d.join(nxt, (F.col("g") == F.col("at")) & (F.col("scluster") == F.col("c")), "left").drop("c", "at")
    none = F.array().cast("array<string>")
    d = d.select("scluster", "t", F.concat(none, *[F.coalesce(f"h{i}", none) for i in range(1, most)]).alias("tail"))

    def of(n: int):
        stream = F.concat("t", F.slice("tail", 1, n - 1)) if n > 1 else F.col("t")
        return F.transform(ngrams(stream, n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("gram")))

    return d.select("scluster", F.explode(F.concat(*[of(n) for n in sizes])).alias("x")).select("scluster", "x.size", "x.gram")


def class_tf_idf(frame: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), k: int = 20) -> DataFrame:
    """(scluster, size, rank, gram, tf_count, df, score): top n-grams by c-TF-IDF.

    score = count / all n-grams of the cluster * (ln((1 + N) / (1 + df)) + 1), N the number of clusters, df the
    number of clusters that hold the n-gram; ties go to the greater n-gram.
    """
    clusters = frame.agg(F.count_distinct("scluster").alias("clusters"))
    c = stream_ngrams(frame, *sizes).groupBy("size", "gram", "scluster").agg(F.count(F.lit(1)).alias("tf_count"))
    c = materialize(c, "ngram-counts")
    # A factor of the inverse frequency lies between 1 and its value at df = 1, so an n-gram whose count times that
    # value stays below the k-th greatest count of its cluster cannot be among the k best: only the others are scored.
    hist = c.groupBy("size", "scluster", "tf_count").agg(F.count(F.lit(1)).alias("grams"))
    down = Window.partitionBy("size", "scluster").orderBy(F.desc("tf_count"))  # one row per distinct count
    kth = hist.withColumn("upto", F.sum("grams").over(down)).groupBy("size", "scluster").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("tf_count"))), F.lit(0)).alias("kth"), F.sum(F.col("grams") * F.col("tf_count")).alias("total"))
    bounds = kth.join(F.broadcast(clusters))
    most = F.ln((1 + F.col("clusters")) / F.lit(2.0)) + 1
    near = c.join(F.broadcast(bounds), ["size", "scluster"]).where(F.col("tf_count") * most >= F.col("kth") - F.col("total") * 2e-9)  # rows: clusters x sizes
    df = c.join(near.select("size", "gram").distinct(), ["size", "gram"], "left_semi").groupBy("size", "gram").agg(F.count(F.lit(1)).alias("df"))
    g = near.join(df, ["size", "gram"])
    score = F.col("tf_count") / F.col("total") * (F.ln((1 + F.col("clusters")) / (1 + F.col("df"))) + 1)
    w = Window.partitionBy("size", "scluster").orderBy(F.desc("score"), F.desc("gram"))
    g = g.withColumn("score", F.round(score, 9)).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(32)))
    # salted parts cut the candidates of a large cluster before they are ranked together
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("size", "scluster", "salt").orderBy(F.desc("score"), F.desc("gram")))).where(F.col("r") <= k)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("scluster", "size", "rank", "gram", "tf_count", "df", "score")


def cluster_ngram_text(top: DataFrame, frame: DataFrame, separator: str = "<br>") -> DataFrame:
    """(scluster, ngrams): rendered list per cluster, a fixed text where a cluster has none."""
    text = top.groupBy("scluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("size", "rank", "gram"))), lambda s: s["gram"]), separator).alias("ngrams"))
    return frame.select("scluster").distinct().join(text, "scluster", "left").na.fill(NONE, ["ngrams"])


def rate_ratio(frame: DataFrame, least: int = 30, k: int = 8) -> DataFrame:
    """(scluster, rank, word, n, ratio): words whose rate in a cluster most exceeds their overall rate."""
    per = frame.select("scluster", F.explode(words("chunk")).alias("word")).groupBy("word", "scluster").agg(F.count(F.lit(1)).alias("n"))
    every = per.groupBy("word").agg(F.sum("n").alias("all_n"))
    size = per.groupBy("scluster").agg(F.sum("n").alias("size"))
    total = per.agg(F.sum("n").alias("total"))
    c = per.where(F.col("n") >= least).join(every, "word").join(F.broadcast(size), "scluster").join(F.broadcast(total))
    c = c.withColumn("ratio", F.round((F.col("n") / F.col("size")) / (F.col("all_n") / F.col("total")), 6))
    w = Window.partitionBy("scluster").orderBy(F.desc("ratio"), "word")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("scluster", "rank", "word", "n", "ratio")
