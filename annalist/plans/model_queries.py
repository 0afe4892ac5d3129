"""Clustering, embedding and layout: checked by properties, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import vectors
from annalist.operators import labels, models, profile
from annalist.plans.registry import Registry, table
from annalist.streaming.sessions import session_totals

R = Registry()


def _vecs(spark, sf_dir):
    t = table(spark, sf_dir, "rabani_unsmoothed_table").where(vectors.valid("vec", 64))
    return t.select("row_id", "filename", "vec")


@R.add("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    return models.kmeans(_vecs(spark, sf_dir), "vec", 12)[0].select("row_id", "scluster")


@R.add("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return models.sweep(_vecs(spark, sf_dir), "vec", "row_id", [4, 8, 12, 16])


@R.add("projected_balanced_fit")
def projected_balanced_fit(spark, sf_dir):
    """Fitted on the same number of chunks per category, applied to all."""
    v = _vecs(spark, sf_dir).withColumn("genre", labels.grouping_label("filename", 1))
    sample = models.balanced_sample(v.where("genre IS NOT NULL"), "genre", "row_id", 200)
    return models.kmeans(v, "vec", 12, starts=3, fit_on=sample)[0].select("row_id", "genre", "scluster")


@R.add("hashed_embedding")
def hashed_embedding(spark, sf_dir):
    t = table(spark, sf_dir, "rabani_unsmoothed_table").select("row_id", "chunk")
    return models.hashed_embedding(t, "chunk").select("row_id", "vec")


@R.add("word_vectors")
def word_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    v = models.train_word_vectors(table(spark, sf_dir, "rabani_unsmoothed_table"), "chunk").getVectors()
    return v.select("word", vector_to_array("vector").alias("vec"))


def _map(spark, sf_dir):
    t = table(spark, sf_dir, "rabani_unsmoothed_table").where(F.col("scluster").isNotNull() & vectors.valid("vec", 64)).select("row_id", "scluster", "vec")
    m = profile.group_means(t, "scluster", "vec")
    return t, models.layout(spark, profile.mean_similarity(m, "scluster"), m.select("scluster", "n"), "scluster")


@R.add("mds_map")
def mds_map(spark, sf_dir):
    return _map(spark, sf_dir)[1]


@R.add("bubble_layout")
def bubble_layout(spark, sf_dir):
    t, centres = _map(spark, sf_dir)
    return models.jitter(t.select("row_id", "scluster"), "row_id", centres, "scluster")


@R.add("session_windows", "WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600 * 1e6 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id AS session, count(*) AS events, CAST(floor(epoch_us(min(ts)) / 1e6) AS BIGINT) AS started_s FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    s = session_totals(table(spark, sf_dir, "events"), "user_id", "ts", "60 minutes")
    return s.select("session", "events", F.unix_timestamp("started").alias("started_s"))
