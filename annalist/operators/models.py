"""Embedding, clustering and layout: MLlib where it has the model, small numpy kernels for tables of clusters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More points than this are not laid out on the driver.
MOST_POINTS = 2_000


def hashed_embedding(df: DataFrame, text: str, out: str = "vec", dim: int = 64, sizes: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """df with a vector per text: the mean of its words' unit vectors, a word's vector being the signed, hashed counts
    of its character n-grams. Deterministic, needs no model. Null or blank text gives a null vector."""

    def word_vector(w: str) -> np.ndarray:
        v = np.zeros(dim, np.float32)
        s = f"<{w}>"
        for n in sizes:
            for i in range(max(len(s) - n + 1, 0)):
                h = zlib.crc32(s[i : i + n].encode())
                v[(h >> 1) % dim] += 1 if h & 1 else -1
        length = np.linalg.norm(v)
        return v / length if length else v

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}  # words of this batch, each made once
        out_ = []
        for t in texts:
            ws = t.split() if t is not None else []
            for w in ws:
                if w not in known:
                    known[w] = word_vector(w)
            out_.append(np.mean([known[w] for w in ws], axis=0).astype(np.float32) if ws else None)
        return pd.Series(out_, index=texts.index, dtype=object)

    return df.withColumn(out, embed(F.col(text)))


def embed_with(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "vec") -> DataFrame:
    """df with vectors of a model of the caller's: ``load`` runs once per task and returns a function of a batch."""

    embed = F.pandas_udf(_iterator(load), "array<float>")
    return df.withColumn(out, embed(F.col(text)))


def _iterator(load):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            yield pd.Series([np.asarray(v, np.float32) for v in model(list(texts.fillna("")))], index=texts.index, dtype=object)

    return run


#: Words that a partition of the skip-gram training has at least; with smaller ones fewer near words are found again (README).
PARCEL_WORDS = 1_000_000


def train_word_vectors(df: DataFrame, text: str, dim: int = 100, min_count: int = 5, epochs: int = 10, seed: int = 42):
    """Skip-gram vectors of the words of a corpus (MLlib's Word2Vec; no subwords). Every epoch takes all words, in
    parcels side by side whose vectors are averaged after it; a corpus of less than two parcels is one sequence."""
    from pyspark.ml.feature import Word2Vec

    from annalist.functions.text import words

    w = df.where(F.col(text).isNotNull()).select(words(text).alias("w"))
    parts = max(1, (w.agg(F.sum(F.size("w"))).first()[0] or 0) // PARCEL_WORDS)
    return Word2Vec(vectorSize=dim, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=parts, inputCol="w", outputCol="v").fit(w)


def _features(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__f", array_to_vector(F.col(vec).cast("array<double>")))


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, starts: int = 1, fit_on: DataFrame | None = None, out: str = "scluster"):
    """(df with labels, cost): the best of ``starts`` runs, fitted on df or on ``fit_on`` and applied to all of df."""
    from pyspark.ml.clustering import KMeans

    train = _features(fit_on if fit_on is not None else df, vec).select("__f").persist()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="__f", predictionCol=out).fit(train) for i in range(starts)]
    finally:
        train.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(_features(df, vec)).drop("__f"), best.summary.trainingCost


def balanced_sample(df: DataFrame, stratum: str, row_id: str, per_stratum: int, seed: int = 0) -> DataFrame:
    """At most ``per_stratum`` rows of every stratum, by a hash of id and seed; cut within salted parts first."""
    from annalist.operators.profile import top_per_group

    h = F.xxhash64(F.lit(seed), row_id)
    d = df.withColumn("__h", h).withColumn("__part", F.struct(F.col(stratum), F.pmod("__h", F.lit(32))))
    part = top_per_group(d, "__part", per_stratum, "__h", row_id).drop("rank")
    return top_per_group(part, stratum, per_stratum, "__h", row_id).drop("rank", "__h", "__part")


def sweep(df: DataFrame, vec: str, row_id: str, ks: list[int], sample: int = 20_000, silhouette_sample: int = 2_000, seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette): k-means on a sample of at most ``sample`` rows, the silhouette (plain Euclidean, all
    pairs) on at most ``silhouette_sample`` of them. Samples are the feature here, as in the interactive sweep."""
    points = df.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(sample).select(row_id, vec).persist()
    rows = []
    try:
        for k in ks:
            labelled, cost = kmeans(points, vec, k, seed)
            few = labelled.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(silhouette_sample).select(vec, "scluster").toPandas()
            rows.append((k, float(cost), silhouette(np.stack(few[vec].to_numpy()).astype(float), few["scluster"].to_numpy()) if len(few) else None))
    finally:
        points.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette with Euclidean distances; 0 for members of clusters of one, None below two clusters."""
    ids, code = np.unique(labels, return_inverse=True)
    if len(ids) < 2:
        return None
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    sums = np.stack([d[:, code == c].sum(1) for c in range(len(ids))], 1)
    n = np.bincount(code)
    at = np.arange(len(x))
    own = sums[at, code] / np.maximum(n[code] - 1, 1)
    other = sums / n
    other[at, code] = np.inf
    near = other.min(1)
    return float(np.where(n[code] > 1, (near - own) / np.maximum(np.maximum(own, near), 1e-300), 0).mean())


def mds(distance: np.ndarray, starts: int = 4, rounds: int = 300, seed: int = 42) -> tuple[np.ndarray, float]:
    """Points in the plane by stress majorisation; the first start is the classical solution."""
    n = len(distance)
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    d = np.maximum((distance + distance.T) / 2, 0)
    np.fill_diagonal(d, 0)
    centre = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-centre @ (d * d) @ centre / 2)
    first = vector[:, -2:] * np.sqrt(np.maximum(value[-2:], 0)) if n > 1 else np.zeros((n, 2))
    rng = np.random.default_rng(seed)
    best, least = first, np.inf
    for s in range(starts):
        p = first.copy() if s == 0 else rng.standard_normal((n, 2))
        for _ in range(rounds):
            e = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
            b = -np.where(e > 1e-12, d / np.maximum(e, 1e-12), 0)
            np.fill_diagonal(b, 0)
            np.fill_diagonal(b, -b.sum(1))
            p = b @ p / max(n, 1)
        stress = float(((np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) - d) ** 2).sum() / 2)
        if stress < least:
            best, least = p, stress
    return best, least


def bubbles(points: np.ndarray, sizes: np.ndarray, pad: float = 0.15, rounds: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """(centres, radii): circles with areas in proportion to sizes, relaxed until none overlap.

    In every round each circle moves by half the sum of its overlaps, all at once; what overlap is left after the last
    round is removed by stretching the whole picture.
    """
    p = points.astype(float).copy()
    n = len(p)
    if not n:
        return p, np.zeros(0)
    spread = max(float(np.ptp(p, axis=0).max()), 1e-9)
    r = np.sqrt(sizes / max(sizes.sum(), 1)) * spread / 2
    need = (r[:, None] + r) * (1 + pad)
    np.fill_diagonal(need, 0)
    angle = np.arange(n) * 2.399963  # circles in one place part in as many directions
    p += 1e-9 * spread * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    for _ in range(rounds):
        way = p[:, None] - p
        apart = np.sqrt((way**2).sum(-1))
        over = np.maximum(need - apart, 0)
        if over.max() <= 1e-9 * spread:
            return p, r
        p += (way * (over / np.maximum(apart, 1e-12))[..., None]).sum(1) / 2
    apart = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    np.fill_diagonal(apart, 1)
    middle = p.mean(0)
    return middle + (p - middle) * max(float((need / np.maximum(apart, 1e-12)).max()), 1.0), r


def layout(spark: SparkSession, sim: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, x, y, radius): map of clusters from their similarities (a, b, sim) and sizes (key, n). Both tables have
    one row per cluster (pair); above MOST_POINTS clusters this is refused."""
    n = sizes.orderBy(key).limit(MOST_POINTS + 1).toPandas()
    if len(n) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} clusters")
    place = {k: i for i, k in enumerate(n[key])}
    d = np.ones((len(n), len(n)))
    for r in sim.collect():
        if r.a in place and r.b in place:
            d[place[r.a], place[r.b]] = min(max(1 - r.sim, 0), 2)
    p, radius = bubbles(mds(d)[0], n["n"].to_numpy(float)) if len(n) else (np.zeros((0, 2)), np.zeros(0))
    rows = [(k, float(x), float(y), float(r)) for k, (x, y), r in zip(n[key], p, radius, strict=True)]
    return spark.createDataFrame(rows, f"`{key}` {sizes.schema[key].dataType.simpleString()}, x double, y double, radius double")


def jitter(df: DataFrame, row_id: str, centres: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """df with (px, py): a place inside its cluster's circle, uniform over the disc, by hash of the id."""
    u = lambda s: (F.pmod(F.xxhash64(row_id, F.lit(s)), F.lit(1 << 30)).cast("double") / (1 << 30))
    j = df.join(F.broadcast(centres), key)  # refused above MOST_POINTS rows when it was made
    rad, ang = F.sqrt(u(seed)) * F.col("radius"), u(seed + 1) * 2 * np.pi
    return j.withColumn("px", F.col("x") + rad * F.cos(ang)).withColumn("py", F.col("y") + rad * F.sin(ang)).drop("x", "y", "radius")

