"""N-grams, vectors and profiles of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import vectors
from annalist.operators import labels, ngrams, profile

from annalist.plans.corpus_queries import FRAME_SQL, _GROUPED, frame, split_sql
from annalist.plans.registry import Registry, table

R = Registry()

VALID = "vec IS NOT NULL AND len(vec) = 64 AND list_sum(list_transform(vec, lambda x: abs(x))) > 0"
_MEANS = f"""v AS (SELECT * FROM frame WHERE {VALID}), e AS (SELECT scluster, unnest(range(1, 65)) AS d, unnest(vec)::DOUBLE AS x FROM v),
  m AS (SELECT scluster, list(x ORDER BY d) AS mean FROM (SELECT scluster, d, avg(x) AS x FROM e GROUP BY ALL) GROUP BY scluster)"""
_TOK = "regexp_extract_all(chunk, '[\\p{L}\\p{N}_]+')"


def _grams_sql(n: int) -> str:
    w = split_sql("chunk")
    return f"""g AS (SELECT scluster, idx, unnest(range(0, len(w) - {n - 1})) AS place, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS gram
      FROM (SELECT scluster, idx, {w} AS w FROM frame) WHERE len(w) >= {n}),
      c AS (SELECT scluster, gram, count(*) AS n, min(idx * 1000000 + place) AS first FROM g GROUP BY scluster, gram)"""


for _n, _name in ((1, "unigram"), (2, "bigram"), (3, "trigram")):

    def _top(spark, sf_dir, n=_n):
        return ngrams.top_ngrams(frame(spark, sf_dir, "chunk"), n)

    R.add(
        f"ngram_{_name}_top",
        f"WITH {FRAME_SQL}, {_grams_sql(_n)} SELECT scluster, rank, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY scluster ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 20",
    )(_top)


def _ctfidf_sql(n: int) -> str:
    grams = " || ' ' || ".join(["t"] + [f"lead(t, {i}) OVER w" for i in range(1, n)])
    return f"""SELECT scluster, {n} AS size, gram FROM (SELECT scluster, {grams} AS gram FROM tok WINDOW w AS (PARTITION BY scluster ORDER BY idx, k)) WHERE gram IS NOT NULL"""


@R.add(
    "ctfidf_top_ngrams",
    f"""WITH {FRAME_SQL}, tok AS (SELECT scluster, idx, unnest(range(len(t))) AS k, unnest(t) AS t FROM (SELECT scluster, idx, {_TOK} AS t FROM frame)),
      g AS ({_ctfidf_sql(1)} UNION ALL {_ctfidf_sql(2)} UNION ALL {_ctfidf_sql(3)}),
      c AS (SELECT scluster, size, gram, count(*) AS tf_count FROM g GROUP BY ALL),
      s AS (SELECT *, count(*) OVER (PARTITION BY size, gram) AS df, sum(tf_count) OVER (PARTITION BY size, scluster) AS total FROM c),
      z AS (SELECT scluster, size, gram, tf_count, df, round(tf_count / total * (ln((1 + (SELECT count(DISTINCT scluster) FROM frame)) / (1 + df)) + 1), 9) AS score FROM s)
      SELECT scluster, size, rank, gram, tf_count, df, score FROM (SELECT *, row_number() OVER (PARTITION BY size, scluster ORDER BY score DESC, gram DESC) AS rank FROM z) WHERE rank <= 20""",
)
def ctfidf_top_ngrams(spark, sf_dir):
    return ngrams.class_tf_idf(frame(spark, sf_dir, "chunk"))


@R.add(
    "rate_ratio_words",
    f"""WITH {FRAME_SQL}, t AS (SELECT scluster, unnest({split_sql("chunk")}) AS word FROM frame), c AS (SELECT scluster, word, count(*) AS n FROM t GROUP BY ALL),
      z AS (SELECT *, round((n / sum(n) OVER (PARTITION BY scluster)) / (sum(n) OVER (PARTITION BY word) / sum(n) OVER ()), 6) AS ratio FROM c)
      SELECT scluster, rank, word, n, ratio FROM (SELECT *, row_number() OVER (PARTITION BY scluster ORDER BY ratio DESC, word) AS rank FROM z WHERE n >= 30) WHERE rank <= 8""",
)
def rate_ratio_words(spark, sf_dir):
    return ngrams.rate_ratio(frame(spark, sf_dir, "chunk"))


def _vectors(spark, sf_dir, *extra):
    return frame(spark, sf_dir, "vec", *extra).where(vectors.valid("vec", 64))


def _long(means, key):
    return means.select(key, "n", F.posexplode("mean").alias("d", "x")).select(key, "n", (F.col("d") + 1).alias("d"), (F.round("x", 6) + 0.0).alias("x"))


@R.add("centroids", f"WITH {FRAME_SQL}, v AS (SELECT * FROM frame WHERE {VALID}), e AS (SELECT scluster, unnest(range(1, 65))::INT AS d, unnest(vec)::DOUBLE AS x FROM v) SELECT scluster, count(*) AS n, d, round(avg(x), 6) + 0 AS x FROM e GROUP BY scluster, d")
def centroids(spark, sf_dir):
    return _long(profile.group_means(_vectors(spark, sf_dir), "scluster", "vec"), "scluster")


_AFF = f"""{_MEANS}, s AS (SELECT row_id, v.scluster, m.scluster AS c, round(list_cosine_similarity(list_transform(vec, lambda x: x::DOUBLE), mean), 6) AS sim FROM v, m),
  o AS (SELECT row_id, scluster, sim AS own_sim FROM s WHERE c = scluster),
  b AS (SELECT row_id, c AS other, sim AS other_sim FROM s WHERE c <> scluster QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, c) = 1)"""


@R.add("chunk_affinities", f"WITH {FRAME_SQL}, {_AFF} SELECT row_id, scluster, own_sim, other, other_sim FROM o JOIN b USING (row_id)")
def chunk_affinities(spark, sf_dir):
    a = profile.affinities(_vectors(spark, sf_dir), "row_id", "scluster", "vec")
    return a.select("row_id", "scluster", F.round("own_sim", 6).alias("own_sim"), "other", F.round("other_sim", 6).alias("other_sim"))


_SIM = f"{_MEANS}, s AS (SELECT x.scluster AS a, y.scluster AS b, round(list_cosine_similarity(x.mean, y.mean), 6) AS sim FROM m x, m y)"


@R.add("centroid_similarity", f"WITH {FRAME_SQL}, {_SIM} SELECT * FROM s")
def centroid_similarity(spark, sf_dir):
    return profile.mean_similarity(profile.group_means(_vectors(spark, sf_dir), "scluster", "vec"), "scluster")


@R.add("nearest_clusters", f"WITH {FRAME_SQL}, {_SIM} SELECT a, rank, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s WHERE a <> b) WHERE rank <= 3")
def nearest_clusters(spark, sf_dir):
    return profile.nearest_groups(centroid_similarity(spark, sf_dir), 3)


@R.add("vector_standardise", f"WITH e AS (SELECT vec_id, unnest(range(1, 65))::INT AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT d, avg(x) AS mu, stddev_pop(x) AS sd FROM e GROUP BY d) SELECT vec_id, d, round((x - mu) / (sd + 1e-9), 5) + 0 AS z FROM e JOIN s USING (d)")
def vector_standardise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "x")).select("vec_id", (F.col("d") + 1).alias("d"), F.col("x").cast("double").alias("x"))
    s = e.groupBy("d").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    return e.join(F.broadcast(s), "d").select("vec_id", "d", (F.round((F.col("x") - F.col("mu")) / (F.col("sd") + 1e-9), 5) + 0.0).alias("z"))


@R.add("genre_centroids", f"WITH {_GROUPED.replace('1, 2)', '1, 1)')}, u AS (SELECT label, list_transform(vec, lambda x: x::DOUBLE) AS w FROM g WHERE {VALID}), u2 AS (SELECT label, list_transform(w, lambda x: x / (sqrt(list_dot_product(w, w)) + 1e-9)) AS w FROM u), e AS (SELECT label, unnest(range(1, 65))::INT AS d, unnest(w) AS x FROM u2), m AS (SELECT label, list(x ORDER BY d) AS w FROM (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL) GROUP BY label) SELECT label, unnest(range(1, 65))::INT AS d, round(unnest(list_transform(w, lambda x: x / (sqrt(list_dot_product(w, w)) + 1e-9))), 6) + 0 AS x FROM m")
def genre_centroids(spark, sf_dir):
    v = _vectors(spark, sf_dir).where("filename IS NOT NULL").select(labels.grouping_label("filename", 1).alias("label"), vectors.unit("vec").alias("vec"))
    m = profile.group_means(v, "label", "vec").select("label", "n", vectors.unit("mean").alias("mean"))
    return _long(m, "label").drop("n")


@R.add("cluster_sizes", f"WITH {FRAME_SQL} SELECT scluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM frame GROUP BY scluster")
def cluster_sizes(spark, sf_dir):
    return profile.sizes(table(spark, sf_dir, "rabani_unsmoothed_table").where("scluster IS NOT NULL"), "scluster")


_COMP = "c AS (SELECT filename, scluster, count(*) AS n FROM rabani_unsmoothed_table WHERE filename IS NOT NULL AND scluster IS NOT NULL GROUP BY ALL), z AS (SELECT filename, scluster, n, round(100 * n / sum(n) OVER (PARTITION BY filename), 6) AS pct_of_group, round(100 * n / sum(n) OVER (PARTITION BY scluster), 6) AS pct_of_key, round((n / sum(n) OVER (PARTITION BY filename)) / (sum(n) OVER (PARTITION BY scluster) / sum(n) OVER ()), 6) AS lift FROM c)"


def _composition(spark, sf_dir):
    return profile.composition(table(spark, sf_dir, "rabani_unsmoothed_table").where("filename IS NOT NULL AND scluster IS NOT NULL"), "filename", "scluster")


@R.add("composition_by_group", f"WITH {_COMP} SELECT filename, scluster, n, pct_of_group, pct_of_key FROM z")
def composition_by_group(spark, sf_dir):
    return _composition(spark, sf_dir).drop("lift")


@R.add("text_lift", f"WITH {_COMP} SELECT filename, scluster, lift FROM z")
def text_lift(spark, sf_dir):
    return _composition(spark, sf_dir).select("filename", "scluster", "lift")


@R.add("top_texts_per_cluster", f"WITH {_COMP} SELECT scluster, rank, filename, n, pct_of_key, pct_of_group FROM (SELECT *, row_number() OVER (PARTITION BY scluster ORDER BY n DESC, filename) AS rank FROM z) WHERE rank <= 10")
def top_texts_per_cluster(spark, sf_dir):
    return profile.top_per_group(_composition(spark, sf_dir), "scluster", 10, F.desc("n"), "filename").select("scluster", "rank", "filename", "n", "pct_of_key", "pct_of_group")


_DENS = f"""{FRAME_SQL}, r AS (SELECT min(idx) AS x0, max(idx) AS x1, min(scluster) AS y0, max(scluster) AS y1 FROM frame),
  b AS (SELECT row_id, least(floor((idx - x0) * 50 / (x1 - x0)), 49) AS bx, least(floor((scluster - y0) * 50 / (y1 - y0)), 49) AS by_ FROM frame, r),
  h AS (SELECT bx, by_, count(*) AS density_raw FROM b GROUP BY ALL), e AS (SELECT min(density_raw) AS lo, max(density_raw) AS hi FROM h)"""


@R.add("density_histogram", f"WITH {_DENS} SELECT row_id, density_raw, round((density_raw - lo) / (hi - lo), 6) AS density_normalized, round(4 + 8 * sqrt((density_raw - lo) / (hi - lo)), 6) AS marker_size FROM b JOIN h USING (bx, by_), e")
def density_histogram(spark, sf_dir):
    d = profile.density(frame(spark, sf_dir), "idx", "scluster")
    return d.select("row_id", "density_raw", F.round("density_normalized", 6).alias("density_normalized"), F.round("marker_size", 6).alias("marker_size"))


_BIN = f"{FRAME_SQL}, n AS (SELECT count(*) AS n FROM frame), b AS (SELECT *, 100.0 * (idx + 1) / n AS pos, CAST(least(greatest(ceil((idx + 1) * 40 / n) - 1, 0), 39) AS INT) AS bin FROM frame, n)"


@R.add("position_percentiles", f"WITH {_BIN} SELECT scluster, round(quantile_cont(pos, 0.1), 6) AS p10, round(quantile_cont(pos, 0.5), 6) AS p50, round(quantile_cont(pos, 0.9), 6) AS p90 FROM b GROUP BY scluster")
def position_percentiles(spark, sf_dir):
    b = profile.axis_bins(frame(spark, sf_dir), "idx")
    return b.groupBy("scluster").agg(F.percentile("pos", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).select("scluster", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@R.add("axis_bin_mode", f"WITH {_BIN}, c AS (SELECT bin, filename, count(*) AS n FROM b WHERE filename IS NOT NULL GROUP BY ALL) SELECT bin, filename, n FROM c QUALIFY row_number() OVER (PARTITION BY bin ORDER BY n DESC, filename) = 1")
def axis_bin_mode(spark, sf_dir):
    return profile.mode_per_group(profile.axis_bins(frame(spark, sf_dir), "idx"), "bin", "filename")


_CONC = f"""{_BIN}, c AS (SELECT scluster, bin, count(*) AS n FROM b GROUP BY ALL), grid AS (SELECT scluster, unnest(range(40))::INT AS bin FROM (SELECT DISTINCT scluster FROM c)),
  g AS (SELECT scluster, bin, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (scluster, bin)),
  s AS (SELECT *, (coalesce(lag(n) OVER w, 0) + 2 * n + coalesce(lead(n) OVER w, 0)) / 4 AS smooth FROM g WINDOW w AS (PARTITION BY scluster ORDER BY bin)),
  o AS (SELECT *, smooth >= 0.3 * max(smooth) OVER (PARTITION BY scluster) AS o FROM s),
  f AS (SELECT *, o OR (coalesce(lag(o) OVER w, false) AND coalesce(lead(o) OVER w, false)) AS f FROM o WINDOW w AS (PARTITION BY scluster ORDER BY bin)),
  i AS (SELECT *, sum(CASE WHEN f AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY scluster ORDER BY bin) AS island FROM (SELECT *, coalesce(lag(f) OVER (PARTITION BY scluster ORDER BY bin), false) AS before FROM f)),
  z AS (SELECT scluster, min(bin) AS lo, max(bin) AS hi, sum(n) AS n FROM i WHERE f GROUP BY scluster, island), t AS (SELECT scluster, sum(n) AS size FROM c GROUP BY scluster)"""


@R.add("concentration_ranges", f"WITH {_CONC} SELECT scluster, CAST(round_even(100 * lo / 40, 0) AS INT) AS from_pct, CAST(round_even(100 * (hi + 1) / 40, 0) AS INT) AS to_pct, CAST(round_even(100 * n / size, 0) AS INT) AS share_pct, CAST(n AS BIGINT) AS n FROM z JOIN t USING (scluster) WHERE n >= 0.05 * size")
def concentration_ranges(spark, sf_dir):
    return profile.concentrations(profile.axis_bins(frame(spark, sf_dir), "idx"), "scluster")


_GENRE = "CASE WHEN filename LIKE 'Midrash%' AND filename NOT LIKE '%Zuta%' THEN 'midrash' WHEN filename LIKE 'Halakhah%' THEN 'law' ELSE 'other' END"


@R.add("genre_lift", f"WITH t AS (SELECT scluster, {_GENRE} AS genre FROM rabani_unsmoothed_table WHERE filename IS NOT NULL AND scluster IS NOT NULL), k AS (SELECT scluster, avg((genre = 'midrash')::INT) AS share FROM t GROUP BY scluster), a AS (SELECT avg((genre = 'midrash')::INT) AS whole FROM t) SELECT scluster, round(share / whole, 6) AS lift FROM k, a")
def genre_lift(spark, sf_dir):
    """Lift of a genre given by rules: a category, minus exceptions by title."""
    t = table(spark, sf_dir, "rabani_unsmoothed_table").where("filename IS NOT NULL AND scluster IS NOT NULL").select("scluster", F.expr(f"({_GENRE}) = 'midrash'").cast("int").alias("late"))
    whole = t.agg(F.avg("late").alias("whole"))
    k = t.groupBy("scluster").agg(F.avg("late").alias("share")).join(F.broadcast(whole))
    return k.select("scluster", F.round(F.when(F.col("whole") > 0, F.col("share") / F.nullif("whole", F.lit(0.0))).otherwise(0.0), 6).alias("lift"))


@R.add("stretch_distribution", f"WITH {FRAME_SQL}, s AS (SELECT scluster, CASE WHEN idx < n * 0.3 THEN 'before' WHEN idx < n * 0.7 THEN 'middle' ELSE 'after' END AS stretch FROM frame, (SELECT count(*) AS n FROM frame)) SELECT stretch, scluster, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY stretch), 6) AS pct FROM s GROUP BY stretch, scluster")
def stretch_distribution(spark, sf_dir):
    f = frame(spark, sf_dir)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    s = f.join(F.broadcast(n)).select("scluster", F.when(F.col("idx") < F.col("n") * 0.3, "before").when(F.col("idx") < F.col("n") * 0.7, "middle").otherwise("after").alias("stretch"))
    return profile.composition(s, "stretch", "scluster").select("stretch", "scluster", "n", F.col("pct_of_group").alias("pct"))


@R.add(
    "cluster_summary",
    f"""WITH {_CONC}, {_AFF.replace(" s AS (", " sm AS (").replace("FROM s WHERE", "FROM sm WHERE").replace(" o AS (", " ow AS (").replace(" b AS (", " bs AS (")},
      k AS (SELECT scluster, count(*) AS chunks, count(DISTINCT filename) AS n_texts, round(quantile_cont(pos, 0.5), 4) AS p50 FROM b GROUP BY scluster),
      h AS (SELECT scluster, round(avg(own_sim), 5) AS cohesion FROM ow GROUP BY scluster),
      nn AS (SELECT scluster, other AS nearest FROM (SELECT ow.scluster, other, count(*) AS c FROM ow JOIN bs USING (row_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scluster ORDER BY c DESC, other) = 1)
      SELECT k.scluster, chunks, round(100 * chunks / sum(chunks) OVER (), 6) AS share, n_texts, p50, cohesion, nearest FROM k LEFT JOIN h USING (scluster) LEFT JOIN nn USING (scluster)""",
)
def cluster_summary(spark, sf_dir):
    f = frame(spark, sf_dir, "vec")
    b = profile.axis_bins(f, "idx")
    k = b.groupBy("scluster").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("filename").alias("n_texts"), F.round(F.percentile("pos", F.lit(0.5)), 4).alias("p50"))
    total = k.agg(F.sum("chunks").alias("total"))
    a = profile.affinities(f.where(vectors.valid("vec", 64)), "row_id", "scluster", "vec").withColumn("own_sim", F.round("own_sim", 6))
    h = a.groupBy("scluster").agg(F.round(F.avg("own_sim"), 5).alias("cohesion"))
    nearest = profile.mode_per_group(a, "scluster", "other").select("scluster", F.col("other").alias("nearest"))
    j = k.join(F.broadcast(total)).join(h, "scluster", "left").join(nearest, "scluster", "left")
    return j.select("scluster", "chunks", F.round(100 * F.col("chunks") / F.col("total"), 6).alias("share"), "n_texts", "p50", "cohesion", "nearest")


@R.add("rank_percent", f"WITH {FRAME_SQL} SELECT row_id, round(((rank() OVER (ORDER BY scluster)) + (count(*) OVER (PARTITION BY scluster) - 1) / 2) / count(*) OVER (), 9) AS pct FROM frame")
def rank_percent(spark, sf_dir):
    """Average rank / n of each row's cluster number, from the table of distinct values."""
    t = labels.numeric_clusters(table(spark, sf_dir, "rabani_unsmoothed_table").select("row_id", "scluster"))
    return average_rank_pct(t, "scluster").select("row_id", F.round("pct", 9).alias("pct"))


def average_rank_pct(df, value):
    from pyspark.sql import Window

    c = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("v")  # one row per distinct value of a label
    c = c.withColumn("below", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return df.join(c.select("v", ((F.col("below") + 1 + (F.col("n") - 1) / 2) / F.col("total")).alias("pct")), df[value] == F.col("v")).drop("v")
