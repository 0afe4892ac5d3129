"""Blocks, change points, segments, split scans and smoothing along the axis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import vectors
from annalist.operators import profile, sequence
from annalist.operators.order import global_index, moving_mean, running_total
from annalist.plans.cluster_queries import VALID
from annalist.plans.corpus_queries import FRAME_SQL, frame
from annalist.plans.registry import Registry, table
from annalist.session import materialize

R = Registry()
B = 50

#: Event types as labels, in the order of time.
_EVENTS = "ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, dense_rank() OVER (ORDER BY event_type) - 1 AS label FROM events)"
_SEQ = f"{FRAME_SQL}, seq AS (SELECT idx, scluster AS label FROM frame)"
_BLOCKS = f"""{_SEQ}, b AS (SELECT CAST(idx // {B} AS INT) AS block, label FROM seq), nb AS (SELECT count(*) // {B} AS full_ FROM seq),
  c0 AS (SELECT block, label, count(*) / {B} AS p FROM b, nb WHERE block < full_ GROUP BY ALL),
  comp AS (SELECT block, label, coalesce(p, 0) AS p FROM (SELECT block, label FROM (SELECT DISTINCT block FROM c0), (SELECT DISTINCT label FROM b)) LEFT JOIN c0 USING (block, label))"""
_ADJ = f"""{_BLOCKS}, lagged AS (SELECT *, lag(p) OVER (PARTITION BY label ORDER BY block) AS q FROM comp),
  adj AS (SELECT block, block * {B} AS x, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS jsd, sqrt(sum((p - q) * (p - q))) AS score FROM lagged WHERE q IS NOT NULL GROUP BY block)"""


def _seq(spark, sf_dir):
    return frame(spark, sf_dir).select("idx", F.col("scluster").alias("label"), "row_id", "filename")


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    kinds = e.select("event_type").distinct().withColumn("label", (F.dense_rank().over(Window.orderBy("event_type")) - 1))  # a closed list of types
    return global_index(e.join(F.broadcast(kinds), "event_type"), "ts", "event_id").select("idx", "label")


@R.add("block_composition", f"WITH {_BLOCKS} SELECT block, label, round(p, 9) AS p FROM comp")
def block_composition(spark, sf_dir):
    return sequence.blocks(_seq(spark, sf_dir), "idx", "label", B).select("block", "label", F.round("p", 9).alias("p"))


@R.add("jsd_curve", f"WITH {_ADJ} SELECT CAST(x AS INT) AS x, round(jsd, 6) AS jsd FROM adj")
def jsd_curve(spark, sf_dir):
    return sequence.adjacent(sequence.blocks(_seq(spark, sf_dir), "idx", "label", B), B).select("x", F.round("jsd", 6).alias("jsd"))


#: Change points of the axis by PELT (squared deviations of block compositions, at least two blocks apart).
PENALTY = 0.1
_CPS = f"""{_ADJ}, cu AS (SELECT block, label, sum(p) OVER w AS s, sum(p * p) OVER w AS q FROM comp WINDOW w AS (PARTITION BY label ORDER BY block)),
  edge AS (SELECT block + 1 AS b, label, s, q FROM cu UNION ALL SELECT DISTINCT 0, label, 0, 0 FROM cu),
  cost AS (SELECT a.b AS s, z.b AS t, round(sum(z.q - a.q) - sum((z.s - a.s) ** 2) / (z.b - a.b), 9) AS c FROM edge a JOIN edge z ON a.label = z.label AND z.b - a.b >= 2 GROUP BY a.b, z.b),
  ct AS (SELECT t, list(c ORDER BY s) AS cl FROM cost GROUP BY t),
  dp AS (SELECT CAST(1 AS BIGINT) AS t, [-{PENALTY}, 1e300]::DOUBLE[] AS f, [0, 0]::BIGINT[] AS l UNION ALL
    SELECT t, list_append(f, list_min(k)), list_append(l, CAST(list_position(k, list_min(k)) - 1 AS BIGINT)) FROM
      (SELECT CAST(ct.t AS BIGINT) AS t, f, l, list_transform(range(1, len(cl) + 1), lambda i: round(f[i] + cl[i] + {PENALTY}, 9)) AS k FROM dp JOIN ct ON ct.t = dp.t + 1)),
  done AS (SELECT l FROM dp ORDER BY t DESC LIMIT 1), back AS (SELECT l[len(l)] AS p FROM done UNION ALL SELECT l[p + 1] FROM back, done WHERE p > 0),
  cps AS (SELECT CAST(p AS INT) AS block, CAST(p * {B} AS INT) AS x FROM back WHERE p > 0)"""


def _points(comp):
    """(block, x) of the change points of a composition of blocks."""
    rows = comp.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda s: s["p"]).alias("x"))
    t = sequence.pelt_points(rows.select(F.col("block").cast("long").alias("t"), "x"), PENALTY)
    return t.select(F.col("t").cast("int").alias("block"), (F.col("t") * B).cast("int").alias("x"))


@R.add("pelt_changepoints", f"WITH RECURSIVE {_CPS} SELECT block, x FROM cps")
def pelt_changepoints(spark, sf_dir):
    return _points(sequence.blocks(_seq(spark, sf_dir), "idx", "label", B))


@R.add("changepoint_scores", f"WITH RECURSIVE {_CPS} SELECT CAST(x AS INT) AS x, round(score, 6) AS score, label, round(p - q, 6) AS delta FROM cps JOIN adj USING (block, x) JOIN lagged USING (block) WHERE abs(p - q) > 1e-6")
def changepoint_scores(spark, sf_dir):
    comp = materialize(sequence.blocks(_seq(spark, sf_dir), "idx", "label", B), "composition")
    at = sequence.adjacent(comp, B).join(_points(comp).select("block"), "block")
    return at.select("x", F.round("score", 6).alias("score"), F.explode("contributions").alias("c")).select("x", "score", "c.label", F.round("c.delta", 6).alias("delta"))


_SEGS = f"{_CPS}, sg AS (SELECT f.*, CAST(1 + (SELECT count(*) FROM cps WHERE x <= f.idx) AS INT) AS segment FROM frame f)"


def _segments(spark, sf_dir, *extra):
    f = materialize(frame(spark, sf_dir, *extra), "frame")
    comp = sequence.blocks(f.select("idx", F.col("scluster").alias("label")), "idx", "label", B)
    return sequence.assign_segments(f, "idx", materialize(_points(comp).select("x"), "points"))


@R.add("segment_assignment", f"WITH RECURSIVE {_SEGS} SELECT row_id, segment FROM sg")
def segment_assignment(spark, sf_dir):
    return _segments(spark, sf_dir).select("row_id", "segment")


@R.add("segment_texts", f"WITH RECURSIVE {_SEGS} SELECT segment, filename, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY segment), 6) AS pct_of_segment, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY filename), 6) AS pct_of_text FROM sg WHERE filename IS NOT NULL GROUP BY segment, filename")
def segment_texts(spark, sf_dir):
    t = sequence.segment_texts(_segments(spark, sf_dir).where("filename IS NOT NULL"), "segment", "filename")
    return t.select("segment", "filename", "n", F.round("pct_of_segment", 6).alias("pct_of_segment"), F.round("pct_of_text", 6).alias("pct_of_text"))


@R.add(
    "segment_composition",
    f"""WITH RECURSIVE {_SEGS}, c AS (SELECT segment, filename, 100 * count(*) / sum(count(*)) OVER (PARTITION BY segment) AS ps, 100 * count(*) / sum(count(*)) OVER (PARTITION BY filename) AS pt FROM sg WHERE filename IS NOT NULL GROUP BY segment, filename),
      l AS (SELECT segment, filename, CASE WHEN pt >= 99.5 THEN '100%' ELSE CAST(CAST(round_even(pt, 0) AS BIGINT) AS VARCHAR) || '%' END || ' of ' || filename || ' (' || CAST(CAST(round_even(ps, 1) AS DECIMAL(10, 1)) AS VARCHAR) || '% of segment)' AS line FROM c)
      SELECT segment, min(idx) AS "start", max(idx) AS "end", count(*) AS n, first(composition) AS composition FROM sg JOIN (SELECT segment, string_agg(line, ' + ' ORDER BY filename) AS composition FROM l GROUP BY segment) USING (segment) WHERE filename IS NOT NULL GROUP BY segment""",
)
def segment_composition(spark, sf_dir):
    return sequence.segment_table(_segments(spark, sf_dir).where("filename IS NOT NULL"), "segment", "filename", "idx")


@R.add("segment_cluster_frequency", f"WITH RECURSIVE {_SEGS}, c AS (SELECT segment, scluster, count(*) AS n FROM sg GROUP BY ALL) SELECT segment, rank, scluster, n, share FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY segment), 6) AS share, row_number() OVER (PARTITION BY segment ORDER BY n DESC, scluster) AS rank FROM c) WHERE rank <= 5")
def segment_cluster_frequency(spark, sf_dir):
    c = profile.composition(_segments(spark, sf_dir), "segment", "scluster")
    return profile.top_per_group(c, "segment", 5, F.desc("n"), "scluster").select("segment", "rank", "scluster", "n", F.round(F.col("pct_of_group") / 100, 6).alias("share"))


_SEGM = f"""{_SEGS}, v AS (SELECT * FROM sg WHERE {VALID}), e AS (SELECT segment, unnest(range(1, 65)) AS d, unnest(vec)::DOUBLE AS x FROM v),
  m AS (SELECT segment, list(x ORDER BY d) AS mean FROM (SELECT segment, d, avg(x) AS x FROM e GROUP BY ALL) GROUP BY segment)"""


@R.add("segment_means", f"WITH RECURSIVE {_SEGM} SELECT segment, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, round(any_value(list_sum(mean)), 5) AS mean_sum, array_to_string(list_sort(list_distinct(list(string_split(filename, '-')[1]))), ', ') AS collections FROM v JOIN m USING (segment) GROUP BY segment")
def segment_means(spark, sf_dir):
    v = _segments(spark, sf_dir, "vec").where(vectors.valid("vec", 64))
    m = profile.group_means(v, "segment", "vec")
    e = v.groupBy("segment").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.array_join(F.array_sort(F.collect_set(F.split("filename", "-")[0])), ", ").alias("collections"))
    return m.join(e, "segment").select("segment", "n", "first_idx", "last_idx", F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 5).alias("mean_sum"), "collections")


@R.add("segment_neighbors", f"WITH RECURSIVE {_SEGM}, s AS (SELECT x.segment AS a, y.segment AS b, round(list_cosine_similarity(x.mean, y.mean), 6) AS sim FROM m x, m y WHERE x.segment <> y.segment) SELECT a, rank, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s) WHERE rank <= 5")
def segment_neighbors(spark, sf_dir):
    m = profile.group_means(_segments(spark, sf_dir, "vec").where(vectors.valid("vec", 64)), "segment", "vec")
    return profile.nearest_groups(profile.mean_similarity(m, "segment"), 5)


_CHI = f"""{_EVENTS}, tot AS (SELECT label, count(*) AS total FROM ev GROUP BY label), n AS (SELECT count(*) AS n, greatest(5, floor(0.02 * count(*))) AS least FROM ev),
  cum AS (SELECT e.idx AS t, k.label, k.total, sum((e.label = k.label)::INT) OVER (PARTITION BY k.label ORDER BY e.idx) - (e.label = k.label)::INT AS before FROM ev e, tot k),
  chi AS (SELECT t, sum((before - t * total / n) ** 2 / (t * total / n) + (total - before - (n - t) * total / n) ** 2 / ((n - t) * total / n)) AS chi2 FROM cum, n WHERE t >= least AND t <= n - least GROUP BY t)"""


def _least():
    return F.greatest(F.lit(5), F.floor(F.lit(0.02) * F.col("n")))


@R.add("chi2_split_profile", f"WITH {_CHI} SELECT t, round(chi2, 6) AS chi2, rank() OVER (ORDER BY round(chi2, 6) DESC) AS place FROM chi")
def chi2_split_profile(spark, sf_dir):
    p = sequence.split_profile(_events(spark, sf_dir), "idx", "label", _least()).select("t", F.round("chi2", 6).alias("chi2"))
    from annalist.session import materialize

    p = materialize(p, "profile")
    below = p.groupBy("chi2").agg(F.count(F.lit(1)).alias("c"))
    order = global_index(below, F.desc("chi2"), out="k")
    place = running_total(order.withColumn("one", F.lit(1)), ["one"], "k", F.col("c"), "above")
    return p.join(place.select("chi2", (F.col("above") + 1).alias("place")), "chi2").select("t", "chi2", "place")


@R.add("late_lift_delta", f"WITH {_EVENTS}, n AS (SELECT count(*) AS n FROM ev), l AS (SELECT label, avg((idx >= n * 0.5)::INT) / 0.5 AS lift FROM ev, n GROUP BY label), s AS (SELECT idx, lift FROM ev JOIN l USING (label)) SELECT round(avg(lift) FILTER (idx >= n // 3) - avg(lift) FILTER (idx < n // 3), 9) AS late_delta FROM s, n")
def late_lift_delta(spark, sf_dir):
    e = _events(spark, sf_dir)
    n = e.agg(F.count(F.lit(1)).alias("n"))
    e = e.join(F.broadcast(n))
    lift = e.groupBy("label").agg((F.avg((F.col("idx") >= F.col("n") * 0.5).cast("int")) / 0.5).alias("lift"))
    s = e.join(F.broadcast(lift), "label")
    after = F.col("idx") >= F.floor(F.col("n") / 3)
    return s.agg(F.round(F.avg(F.when(after, F.col("lift"))) - F.avg(F.when(~after, F.col("lift"))), 9).alias("late_delta"))


_ROLL = "doubled AS (SELECT idx + r * n AS t, label, n FROM ev, (SELECT count(*) AS n FROM ev), (SELECT unnest([0, 1]) AS r))"


@R.add(
    "chi2_circular_shift_p",
    f"""WITH {_EVENTS}, {_ROLL}, tot AS (SELECT label, count(*) AS total FROM ev GROUP BY label),
      cum AS (SELECT e.t, e.n, k.label, k.total, sum((e.label = k.label)::INT) OVER (PARTITION BY k.label ORDER BY e.t ROWS BETWEEN CURRENT ROW AND 3332 FOLLOWING) AS before FROM doubled e, tot k),
      sh AS (SELECT (n - t) % n AS shift, round(sum((before - 3333 * total / n) ** 2 / (3333 * total / n) + (total - before - (n - 3333) * total / n) ** 2 / ((n - 3333) * total / n)), 6) AS chi2 FROM cum WHERE t < n GROUP BY ALL)
      SELECT o.chi2 AS observed, count(*) FILTER (sh.chi2 >= o.chi2) / count(*) AS p FROM sh, (SELECT chi2 FROM sh WHERE shift = 0) o GROUP BY o.chi2""",
)
def chi2_circular_shift_p(spark, sf_dir):
    return sequence.shift_p(sequence.circular_shift(_events(spark, sf_dir), "idx", "label", 3333))


_CUMV = "long AS (SELECT vec_id, row_number() OVER (PARTITION BY d ORDER BY vec_id) - 1 AS t, d, x FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)), w AS (SELECT d, count(*) AS n, sum(x) AS s, sum(x * x) AS sq FROM long GROUP BY d), r AS (SELECT t, d, n, s, sq, coalesce(sum(x) OVER (PARTITION BY d ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM long JOIN w USING (d)), st AS (SELECT t, sum(t * (n - t) / n * (before / t - (s - before) / (n - t)) ** 2) AS stat, sum(t * (n - t) / n * (before / t - (s - before) / (n - t)) ** 2) / sum(sq - s * s / n) AS r2 FROM r WHERE t >= 20 AND t <= n - 20 GROUP BY t)"


def _long(spark, sf_dir):
    e = global_index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", out="t")
    return e.select("t", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))


@R.add("step_r2_profile", f"WITH {_CUMV} SELECT t, round(r2, 6) AS r2 FROM st")
def step_r2_profile(spark, sf_dir):
    return sequence.split_statistics(_long(spark, sf_dir), 20).select("t", F.round("r2", 6).alias("r2"))


@R.add("best_split", f"WITH {_CUMV} SELECT t, round(stat, 4) AS stat FROM st ORDER BY round(stat, 6) DESC, t LIMIT 1")
def best_split(spark, sf_dir):
    return sequence.split_statistics(_long(spark, sf_dir), 20).orderBy(F.desc(F.round("stat", 6)), "t").limit(1).select("t", F.round("stat", 4).alias("stat"))


@R.add(
    "block_permutation_p",
    """WITH x AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS t, embedding[1]::DOUBLE AS x FROM embeddings), b AS (SELECT t // 25 AS blk, t, x FROM x),
      o AS (SELECT rep, t, x, CAST(row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN lpad(CAST(blk AS VARCHAR), 9, '0') ELSE md5(rep || '-' || blk) END, t) - 1 AS BIGINT) AS u FROM b, (SELECT unnest(range(20)) AS rep)),
      r AS (SELECT rep, u, count(*) OVER (PARTITION BY rep) AS n, coalesce(sum(x) OVER (PARTITION BY rep ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(x) OVER (PARTITION BY rep) AS s FROM o),
      st AS (SELECT rep, max(round(u * (n - u) / n * (before / u - (s - before) / (n - u)) ** 2, 9)) AS stat FROM r WHERE u >= 20 AND u <= n - 20 GROUP BY rep)
      SELECT round(a.stat, 6) AS observed, (1 + count(*) FILTER (z.rep > 0 AND z.stat >= a.stat)) / 20 AS p FROM st z, (SELECT stat FROM st WHERE rep = 0) a GROUP BY a.stat""",
)
def block_permutation_p(spark, sf_dir):
    """Permutations of blocks in the order of a hash: replicate 0 is the sequence as it stands."""
    x = global_index(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x")), "vec_id", out="t")
    b = x.withColumn("blk", F.floor(F.col("t") / 25)).join(F.broadcast(spark.range(20).withColumnRenamed("id", "rep")))
    key = F.when(F.col("rep") == 0, F.lpad(F.col("blk").cast("string"), 9, "0")).otherwise(F.md5(F.concat_ws("-", F.col("rep").cast("string"), F.col("blk").cast("string"))))
    o = sequence.numbered(b.withColumn("key", key), "rep", "u", "key", "t")
    st = sequence.split_statistics(o.select("rep", F.col("u").alias("t"), F.lit(0).alias("d"), "x"), 20, ["rep"])
    best = st.groupBy("rep").agg(F.max(F.round("stat", 9)).alias("stat"))
    obs = best.where("rep = 0").select(F.col("stat").alias("observed"))
    return best.join(F.broadcast(obs)).groupBy("observed").agg(((1 + F.count_if((F.col("rep") > 0) & (F.col("stat") >= F.col("observed")))) / 20).alias("p")).select(F.round("observed", 6).alias("observed"), "p")


@R.add(
    "block_permutation_whole",
    """WITH x AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS t, embedding FROM embeddings), b AS (SELECT t // 25 AS blk, t, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM x),
      o AS (SELECT rep, t, blk, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN lpad(CAST(blk AS VARCHAR), 9, '0') ELSE md5(rep || '-' || blk) END, t) - 1 AS u FROM (SELECT DISTINCT t, blk FROM b), (SELECT unnest(range(200)) AS rep)),
      r AS (SELECT rep, d, u, count(*) OVER (PARTITION BY rep, d) AS n, coalesce(sum(x) OVER (PARTITION BY rep, d ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(x) OVER (PARTITION BY rep, d) AS s FROM o JOIN b USING (t)),
      q AS (SELECT rep, u, round(sum(u * (n - u) / n * (before / u - (s - before) / (n - u)) ** 2), 9) AS stat FROM r WHERE u >= 20 AND u <= n - 20 GROUP BY rep, u), st AS (SELECT rep, max(stat) AS stat FROM q GROUP BY rep)
      SELECT round(a.stat, 6) AS observed, (1 + count(*) FILTER (z.rep > 0 AND z.stat >= a.stat)) / 200 AS p FROM st z, (SELECT stat FROM st WHERE rep = 0) a GROUP BY a.stat""",
)
def block_permutation_whole(spark, sf_dir):
    """The test of block_permutation_p on whole vectors and with 199 permutations, so that p can fall below 0.01."""
    x = global_index(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x")), "vec_id", out="t")
    st = materialize(sequence.permuted_splits(x, 25, 199, 20), "permuted")
    obs = st.where("rep = 0").select(F.col("stat").alias("observed"))
    return st.join(F.broadcast(obs)).groupBy("observed").agg(((1 + F.count_if((F.col("rep") > 0) & (F.col("stat") >= F.col("observed")))) / 200).alias("p")).select(F.round("observed", 6).alias("observed"), "p")


# Fixed value: the smoothing kernel.
_KERNEL = [0.2, 0.5, 0.6, 0.7, 0.8, 1.0, 0.8, 0.7, 0.6, 0.5, 0.2]
_KSQL = " + ".join(f"{k} * coalesce({'lag' if i < 5 else 'lead'}(x, {abs(i - 5)}) OVER w, 0)" for i, k in enumerate(_KERNEL))


def kernel_smooth(long, group, order, value, weights):
    """Weighted sum of neighbours over the sum of all weights, zero beyond the ends, within ``group``; the sequence
    keeps its length however short it is. Neighbours meet by place, so no window runs over a whole work."""
    half = len(weights) // 2
    offsets = F.explode(F.array(*[F.struct(F.lit(i - half).alias("o"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])).alias("k")
    spread = long.select(*group, (F.col(order)).alias("__t"), F.col(value).alias("__x"), offsets).select(*group, (F.col("__t") + F.col("k.o")).alias(order), (F.col("__x") * F.col("k.w")).alias("__x"))
    got = spread.groupBy(*group, order).agg((F.sum("__x") / sum(weights)).alias("smooth"))
    return long.join(got, [*group, order], "left")


@R.add("kernel_smoothing", f"WITH l AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), l2 AS (SELECT label, t, 1 AS d, x FROM l UNION ALL SELECT label, t, 2, y FROM l) SELECT label, t, d, round(({_KSQL}) / 6.6, 6) + 0 AS smooth FROM l2 WINDOW w AS (PARTITION BY label, d ORDER BY t)")
def kernel_smoothing(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    g = running_total(global_index(e, "vec_id"), ["label"], "idx", F.lit(1), "before").withColumn("t", F.col("before") + 1)
    long = g.select("label", "t", F.posexplode(F.slice("embedding", 1, 2)).alias("d", "x")).select("label", "t", (F.col("d") + 1).alias("d"), F.col("x").cast("double").alias("x"))
    return kernel_smooth(long, ["label", "d"], "t", "x", _KERNEL).select("label", "t", "d", (F.round("smooth", 6) + 0.0).alias("smooth"))


@R.add("kernel_smoothing_whole", f"WITH l AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, embedding FROM embeddings), l2 AS (SELECT label, t, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding)::DOUBLE AS x FROM l) SELECT label, t, d, round(({_KSQL}) / 6.6, 6) + 0 AS smooth FROM l2 WINDOW w AS (PARTITION BY label, d ORDER BY t)")
def kernel_smoothing_whole(spark, sf_dir):
    """The smoothing of kernel_smoothing over every dimension of the vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    g = running_total(global_index(e, "vec_id"), ["label"], "idx", F.lit(1), "before").withColumn("t", F.col("before") + 1)
    long = g.select("label", "t", F.posexplode("embedding").alias("d", "x")).select("label", "t", (F.col("d") + 1).alias("d"), F.col("x").cast("double").alias("x"))
    return kernel_smooth(long, ["label", "d"], "t", "x", _KERNEL).select("label", "t", "d", (F.round("smooth", 6) + 0.0).alias("smooth"))


@R.add("rolling_mean_centered", "SELECT text_id, row_id, CASE WHEN len(l) >= 10 THEN round(list_avg(l), 6) END AS smooth FROM (SELECT text_id, row_id, list_filter(list(surprisal_bits) OVER w, lambda x: x IS NOT NULL AND NOT isnan(x)) AS l FROM word_measurements WINDOW w AS (PARTITION BY text_id ORDER BY word_position, row_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))")
def rolling_mean_centered(spark, sf_dir):
    """Centred mean of 20 values within each text, null below 10 values."""
    t = table(spark, sf_dir, "word_measurements").select("text_id", "row_id", "word_position", F.nanvl("surprisal_bits", F.lit(None).cast("double")).alias("s"))
    m = moving_mean(global_index(t, "text_id", "word_position", "row_id"), "text_id", "idx", "s", "smooth", 10, 9, 10)
    return m.select("text_id", "row_id", F.round("smooth", 6).alias("smooth"))


@R.add("genre_profile_signal", f"WITH {FRAME_SQL}, v AS (SELECT row_id, string_split(filename, '-')[1] AS label, list_transform(vec, lambda x: x::DOUBLE) AS w FROM frame WHERE filename IS NOT NULL AND {VALID}), u AS (SELECT row_id, label, list_transform(w, lambda x: x / (sqrt(list_dot_product(w, w)) + 1e-9)) AS w FROM v), e AS (SELECT label, unnest(range(1, 65)) AS d, unnest(w) AS x FROM u), m AS (SELECT label, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL) GROUP BY label), c AS (SELECT label, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-9)) AS c FROM m) SELECT row_id, c.label AS genre, round(list_dot_product(w, c.c), 5) + 0 AS signal FROM u, c")
def genre_profile_signal(spark, sf_dir):
    from annalist.operators import labels

    v = frame(spark, sf_dir, "vec").where(F.col("filename").isNotNull() & vectors.valid("vec", 64)).select("row_id", labels.grouping_label("filename", 1).alias("label"), vectors.unit("vec").alias("vec"))
    m = profile.group_means(v, "label", "vec").select(F.col("label").alias("genre"), vectors.unit("mean").alias("c"))  # one row per category
    return v.join(F.broadcast(m)).select("row_id", "genre", (F.round(vectors.dot("vec", "c"), 5) + 0.0).alias("signal"))


# --- without SQL ---------------------------------------------------------------------------------------------------


@R.add("binseg_order")
def binseg_order(spark, sf_dir):
    """The six most prominent change points of the axis, by squared deviations of block compositions."""
    comp = sequence.blocks(_seq(spark, sf_dir), "idx", "label", B)
    rows = comp.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda s: s["p"]).alias("x"))
    out = sequence.binary_segmentation(materialize(rows.select(F.col("block").cast("long").alias("t"), "x"), "axis"), 6, 2)
    return out.select("place", F.col("t").cast("int").alias("block"), "gain")


def _work_rows(spark, sf_dir):
    """(filename, t, x): the valid vectors of every work, t their place in it."""
    t = table(spark, sf_dir, "rabani_unsmoothed_table").where(F.col("filename").isNotNull() & vectors.valid("vec", 64)).select("filename", "chunk_number", "row_id", F.col("vec").alias("x"))
    placed = global_index(t, "filename", "chunk_number", "row_id")
    first = placed.groupBy(F.col("filename").alias("__f")).agg(F.min("idx").alias("__i"))
    return placed.join(first, F.col("filename") == F.col("__f")).select("filename", (F.col("idx") - F.col("__i")).alias("t"), "x")


@R.add("binseg_rbf")
def binseg_rbf(spark, sf_dir):
    """The most prominent change points of every work by the Gaussian kernel, over the mean vectors of its blocks."""
    w = _work_rows(spark, sf_dir).select(F.concat_ws("\t", F.floor(F.col("t") / B).cast("string"), "filename").alias("k"), "x")
    part = F.split("k", "\t", 2)
    m = profile.group_means(w, "k", "x").select(part[1].alias("filename"), part[0].cast("long").alias("t"), F.col("mean").alias("x"))
    return sequence.per_sequence(m, "filename", lambda x: sequence.kernel_splits(x, 6, 2), "filename string, place int, block int, gain double")


@R.add("recursive_segmentation")
def recursive_segmentation(spark, sf_dir):
    """Significant change points of every work's vectors, level by level."""
    return sequence.significant_splits(_work_rows(spark, sf_dir), "filename", 10, 5)
