"""Statistics, word measurements and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import vectors
from annalist.functions.text import clean_word, ngrams, words
from annalist.operators import lmscore, models, profile, sessions, stats
from annalist.plans.corpus_queries import FRAME_SQL, frame, split_sql
from annalist.plans.registry import Registry, table

R = Registry()

#: Not-a-number is unknown. (A CASE with isnan is folded away over Parquet statistics by some DuckDB versions.)
_M = "m AS (SELECT *, try_cast(nullif(CAST(surprisal_bits AS VARCHAR), 'nan') AS DOUBLE) AS s, try_cast(nullif(CAST(cos_dist_centroid AS VARCHAR), 'nan') AS DOUBLE) AS c FROM word_measurements)"


def _words(spark, sf_dir):
    t = table(spark, sf_dir, "word_measurements")
    return t.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("surprisal_bits", "cos_dist_centroid", "cos_dist_min")})


@R.add("bh_adjust", f"WITH {_M}, p AS (SELECT row_id, pow(2, -s) AS p FROM m WHERE s IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT row_id, round(least(1, min(p * n / k) OVER (ORDER BY k DESC)), 9) AS q FROM r")
def bh_adjust(spark, sf_dir):
    p = _words(spark, sf_dir).where("surprisal_bits IS NOT NULL").select("row_id", F.pow(F.lit(2.0), -F.col("surprisal_bits")).alias("p"))
    return stats.benjamini_hochberg(p, "p").select("row_id", F.round("q", 9).alias("q"))


_KEEP = "keep AS (SELECT row_id, text_id, s, c FROM m WHERE regexp_replace(coalesce(actual_word, ''), '[^א-תa-zA-Z]', '', 'g') <> '' AND word_position > 3 AND s BETWEEN 0 AND 300 AND c BETWEEN 0 AND 2)"


def _kept(spark, sf_dir):
    return _words(spark, sf_dir).where(lmscore.passes_filter()).select("row_id", "text_id", F.col("surprisal_bits").alias("s"), F.col("cos_dist_centroid").alias("c"))


@R.add("content_filter", f"WITH {_M}, {_KEEP} SELECT row_id, text_id FROM keep")
def content_filter(spark, sf_dir):
    return _kept(spark, sf_dir).select("row_id", "text_id")


_RANKS = f"{_M}, {_KEEP}, r AS (SELECT *, rank() OVER (PARTITION BY text_id ORDER BY s DESC) + (count(*) OVER (PARTITION BY text_id, s) - 1) / 2 AS rs, rank() OVER (PARTITION BY text_id ORDER BY c DESC) + (count(*) OVER (PARTITION BY text_id, c) - 1) / 2 AS rc FROM keep)"


@R.add("rank_gap_classes", f"WITH {_RANKS} SELECT row_id, rs AS rank_surprisal, rc AS rank_semantic, rs - rc AS rank_gap, rs - rc < 0 AS is_hl, rs - rc > 0 AS is_lh FROM r")
def rank_gap_classes(spark, sf_dir):
    r = stats.average_ranks(stats.average_ranks(_kept(spark, sf_dir), "text_id", "s", "rank_surprisal"), "text_id", "c", "rank_semantic")
    gap = F.col("rank_surprisal") - F.col("rank_semantic")
    return r.select("row_id", "rank_surprisal", "rank_semantic", gap.alias("rank_gap"), (gap < 0).alias("is_hl"), (gap > 0).alias("is_lh"))


@R.add("spearman_by_group", f"WITH {_RANKS} SELECT text_id, count(*) AS n, round(corr(rs, rc), 6) AS rho FROM r GROUP BY text_id HAVING count(*) >= 20")
def spearman_by_group(spark, sf_dir):
    return stats.spearman(_kept(spark, sf_dir), "text_id", "s", "c").select("text_id", "n", F.round("rho", 6).alias("rho"))


@R.add("text_summary", f"WITH {_M}, {_KEEP}, w AS (SELECT text_id, count(*) AS n_words FROM m GROUP BY text_id) SELECT text_id, n_words, count(*) AS n_kept, round(median(s), 6) AS median_surprisal, round(median(c), 6) AS median_cos FROM keep JOIN w USING (text_id) GROUP BY text_id, n_words HAVING count(*) >= 20")
def text_summary(spark, sf_dir):
    n = table(spark, sf_dir, "word_measurements").groupBy("text_id").agg(F.count(F.lit(1)).alias("n_words"))
    k = _kept(spark, sf_dir).groupBy("text_id").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.median("s"), 6).alias("median_surprisal"), F.round(F.median("c"), 6).alias("median_cos"))
    return k.where("n_kept >= 20").join(n, "text_id").select("text_id", "n_words", "n_kept", "median_surprisal", "median_cos")


@R.add("pearson", f"WITH {_M} SELECT round(corr(s, c), 6) AS r FROM m WHERE s IS NOT NULL AND c IS NOT NULL")
def pearson(spark, sf_dir):
    return _words(spark, sf_dir).where("surprisal_bits IS NOT NULL AND cos_dist_centroid IS NOT NULL").agg(F.round(F.corr("surprisal_bits", "cos_dist_centroid"), 6).alias("r"))


@R.add("ols_residual", f"WITH {_M}, k AS (SELECT row_id, s, prob_mass FROM m WHERE s IS NOT NULL AND prob_mass IS NOT NULL AND NOT isnan(prob_mass)), f AS (SELECT regr_slope(s, prob_mass) AS a, regr_intercept(s, prob_mass) AS b FROM k) SELECT row_id, round(s - a * prob_mass - b, 6) + 0 AS residual FROM k, f")
def ols_residual(spark, sf_dir):
    k = _words(spark, sf_dir).where("surprisal_bits IS NOT NULL AND prob_mass IS NOT NULL AND NOT isnan(prob_mass)").select("row_id", "surprisal_bits", "prob_mass")
    return stats.residuals(k, "surprisal_bits", "prob_mass").select("row_id", (F.round("residual", 6) + 0.0).alias("residual"))


_RUNS = f"{FRAME_SQL}, ab AS (SELECT scluster AS a, CAST(idx * 12 // (SELECT count(*) FROM frame) AS INT) AS b FROM frame), t AS (SELECT a, b, count(*) AS n FROM ab GROUP BY ALL)"


def _two_runs(spark, sf_dir):
    """Two labellings of one frame, joined on the chronological index: its clusters, and twelfths of the axis."""
    f = frame(spark, sf_dir).select("idx", F.col("scluster").alias("a"))
    n = f.agg(F.count(F.lit(1)).alias("n"))
    other = f.join(F.broadcast(n)).select("idx", F.floor(F.col("idx") * 12 / F.col("n")).cast("int").alias("b"))
    return stats.contingency(f.join(other, "idx"), "a", "b")


@R.add("crosstab", f"WITH {_RUNS} SELECT a, b, n FROM t")
def crosstab(spark, sf_dir):
    return _two_runs(spark, sf_dir)


@R.add("adjusted_rand", f"WITH {_RUNS}, s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM t), x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM t GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM s, x, y")
def adjusted_rand(spark, sf_dir):
    return stats.adjusted_rand(_two_runs(spark, sf_dir)).select(F.round("ari", 6).alias("ari"))


@R.add("cluster_correspondence", f"WITH {_RUNS} SELECT a, b, CAST(round_even(100 * n / r, 0) AS INT) AS share, CAST(round_even(100 * n / c, 0) AS INT) AS back FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c FROM t) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1")
def cluster_correspondence(spark, sf_dir):
    return stats.correspondence(_two_runs(spark, sf_dir))


@R.add("perplexity_rollup", f"WITH {_M} SELECT text_id, round(pow(2, avg(s)), 6) AS perplexity, round(avg(c), 6) AS mean_cos, round(100 * avg(in_nucleus::INT), 6) AS pct_nucleus FROM m GROUP BY text_id")
def perplexity_rollup(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("text_id").agg(F.round(F.pow(F.lit(2.0), F.avg("surprisal_bits")), 6).alias("perplexity"), F.round(F.avg("cos_dist_centroid"), 6).alias("mean_cos"), F.round(100 * F.avg(F.col("in_nucleus").cast("int")), 6).alias("pct_nucleus"))


@R.add("nucleus_cut", "SELECT row_id, CASE WHEN prob_1 IS NULL OR pred_1 IS NULL THEN CASE WHEN prob_2 IS NULL OR pred_2 IS NULL THEN 0 ELSE 1 END WHEN prob_1 < 0.25 AND prob_2 IS NOT NULL AND pred_2 IS NOT NULL THEN 2 ELSE 1 END AS kept FROM word_measurements")
def nucleus_cut(spark, sf_dir):
    t = table(spark, sf_dir, "word_measurements")
    p = t.select("row_id", lmscore.predictions(t).alias("p"))
    return p.select("row_id", F.size(lmscore.nucleus(F.col("p"), 0.25, 1)).alias("kept"))


@R.add("lemma_groups", "WITH l AS (SELECT row_id, pred_1 AS word, prob_1 AS prob FROM word_measurements UNION ALL SELECT row_id, pred_2, prob_2 FROM word_measurements), k AS (SELECT row_id, word, prob, left(word, 2) AS lemma FROM l WHERE word IS NOT NULL AND prob IS NOT NULL) SELECT row_id, lemma, first(word ORDER BY prob DESC, word) AS word, round(sum(prob), 6) AS prob FROM k GROUP BY row_id, lemma")
def lemma_groups(spark, sf_dir):
    t = table(spark, sf_dir, "word_measurements")
    long = t.select("row_id", F.explode(lmscore.predictions(t)).alias("p")).select("row_id", "p.word", "p.prob").withColumn("lemma", F.substring("word", 1, 2))
    return lmscore.lemma_groups(long, "row_id", "lemma", "word", "prob").select("row_id", "lemma", "word", F.round("prob", 6).alias("prob"))


@R.add("lemma_counts_parsed", "WITH k AS (SELECT unnest(json_keys(lemma_counts)) AS lemma, lemma_counts AS j FROM word_measurements WHERE lemma_counts IS NOT NULL) SELECT lemma, CAST(sum(CAST(json_extract_string(j, '$.\"' || lemma || '\"') AS INT)) AS BIGINT) AS n FROM k GROUP BY lemma")
def lemma_counts_parsed(spark, sf_dir):
    e = table(spark, sf_dir, "word_measurements").select(F.explode(F.from_json("lemma_counts", "map<string,int>")).alias("lemma", "c"))
    return e.groupBy("lemma").agg(F.sum("c").alias("n"))


_PD = f"{_M}, l AS (SELECT row_id, 1 AS k, prob_1 AS p, cos_dist_min AS d, pred_1 = actual_word AS same FROM m UNION ALL SELECT row_id, 2, prob_2, c, pred_2 = actual_word FROM m), o AS (SELECT * FROM l WHERE p IS NOT NULL AND d IS NOT NULL AND NOT isnan(d))"


def _pd(spark, sf_dir):
    t = _words(spark, sf_dir)
    two = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"prob_{k}").alias("p"), F.col(d).alias("d"), (F.col(f"pred_{k}") == F.col("actual_word")).alias("same")) for k, d in ((1, "cos_dist_min"), (2, "cos_dist_centroid"))])
    return t.select("row_id", F.explode(two).alias("x")).select("row_id", "x.*").where("p IS NOT NULL AND d IS NOT NULL")


@R.add("weighted_topk_distance", f"WITH {_PD} SELECT row_id, k, round(sum(p * d) OVER w / sum(p) OVER w, 6) AS dist FROM o WHERE p > 0 WINDOW w AS (PARTITION BY row_id ORDER BY k)")
def weighted_topk_distance(spark, sf_dir):
    w = Window.partitionBy("row_id").orderBy("k")  # at most 50 predictions of one word
    return _pd(spark, sf_dir).where("p > 0").select("row_id", "k", F.round(F.sum(F.col("p") * F.col("d")).over(w) / F.sum("p").over(w), 6).alias("dist"))


@R.add("self_mass_removal", f"WITH {_PD} SELECT row_id, round((sum(p * d) - sum(CASE WHEN same THEN p * d ELSE 0 END)) / nullif(sum(p) - sum(CASE WHEN same THEN p ELSE 0 END), 0), 6) AS cos_excl, round(sum(CASE WHEN same THEN p ELSE 0 END) / nullif(sum(p), 0), 6) AS q_self FROM o GROUP BY row_id")
def self_mass_removal(spark, sf_dir):
    own = lambda x: F.sum(F.when(F.col("same"), x).otherwise(0.0))
    pd_ = F.col("p") * F.col("d")
    return _pd(spark, sf_dir).groupBy("row_id").agg(F.round((F.sum(pd_) - own(pd_)) / F.nullif(F.sum("p") - own(F.col("p")), F.lit(0.0)), 6).alias("cos_excl"), F.round(own(F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0)), 6).alias("q_self"))


@R.add("quadrant_view", f"WITH {_M}, k AS (SELECT row_id, text_id, s, c FROM m WHERE s IS NOT NULL AND c IS NOT NULL), g AS (SELECT text_id, median(s) AS ms, median(c) AS mc, avg(s) AS as_, avg(c) AS ac, stddev_samp(s) AS ds, stddev_samp(c) AS dc FROM k GROUP BY text_id) SELECT row_id, CASE WHEN s >= ms THEN 'H' ELSE 'L' END || CASE WHEN c >= mc THEN 'H' ELSE 'L' END AS quadrant, round((s - as_) / nullif(ds, 0) - (c - ac) / nullif(dc, 0), 5) AS divergence FROM k JOIN g USING (text_id)")
def quadrant_view(spark, sf_dir):
    k = _words(spark, sf_dir).where("surprisal_bits IS NOT NULL AND cos_dist_centroid IS NOT NULL").select("row_id", "text_id", F.col("surprisal_bits").alias("s"), F.col("cos_dist_centroid").alias("c"))
    g = k.groupBy("text_id").agg(F.median("s").alias("ms"), F.median("c").alias("mc"), F.avg("s").alias("as_"), F.avg("c").alias("ac"), F.stddev_samp("s").alias("ds"), F.stddev_samp("c").alias("dc"))
    j = k.join(g, "text_id")
    side = lambda x, m: F.when(F.col(x) >= F.col(m), "H").otherwise("L")
    z = (F.col("s") - F.col("as_")) / F.nullif("ds", F.lit(0.0)) - (F.col("c") - F.col("ac")) / F.nullif("dc", F.lit(0.0))
    return j.select("row_id", F.concat(side("s", "ms"), side("c", "mc")).alias("quadrant"), F.round(z, 5).alias("divergence"))


@R.add("unit_logprob_rollup", f"WITH {_M} SELECT text_id, CAST(word_position // 10 AS INT) AS unit, round(sum(s), 6) AS bits, min_by(prob_mass, CAST(word_position AS BIGINT) * 1000000000 + row_id) AS first_mass, count(*) AS n FROM m GROUP BY ALL")
def unit_logprob_rollup(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("unit", F.floor(F.col("word_position") / 10).cast("int"))
    return w.groupBy("text_id", "unit").agg(F.round(F.sum("surprisal_bits"), 6).alias("bits"), F.min_by("prob_mass", F.struct("word_position", "row_id")).alias("first_mass"), F.count(F.lit(1)).alias("n"))


@R.add("sliding_windows", f"WITH n AS (SELECT doc_id, len({split_sql('text')}) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n > 64 THEN CAST(ceil((n - 64) / 32) AS BIGINT) * 32 + 1 ELSE 1 END, 32)) AS s FROM n WHERE n > 0) SELECT doc_id, s AS \"start\", least(s + 64, n) AS \"end\", CASE WHEN s = 0 THEN 0 ELSE s + 32 END AS score_from FROM w")
def sliding_windows(spark, sf_dir):
    n = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(words("text")).alias("n"))
    return lmscore.token_windows(n, "doc_id", "n", 64, 32)


_LET = "regexp_replace(coalesce(actual_word, ''), '[^א-תa-zA-Z]', '', 'g')"


@R.add("block_vocabulary", f"WITH w AS (SELECT text_id, CAST(word_position // 50 AS INT) AS block, {_LET} AS form FROM word_measurements), v AS (SELECT form FROM w WHERE form <> '' GROUP BY form ORDER BY count(*) DESC, form LIMIT 100) SELECT text_id, block, form, count(*) AS n FROM w JOIN v USING (form) GROUP BY ALL")
def block_vocabulary(spark, sf_dir):
    w = table(spark, sf_dir, "word_measurements").select("text_id", F.floor(F.col("word_position") / 50).cast("int").alias("block"), clean_word(F.coalesce("actual_word", F.lit(""))).alias("form"))
    v = w.where("form <> ''").groupBy("form").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "form").limit(100).select("form")
    return w.join(F.broadcast(v), "form").groupBy("text_id", "block", "form").agg(F.count(F.lit(1)).alias("n"))


@R.add("block_trigrams", f"WITH w AS (SELECT text_id, CAST(word_position // 50 AS INT) AS block, {_LET} AS form FROM word_measurements), g AS (SELECT text_id, block, unnest(list_transform(range(1, length(form) - 1), lambda i: substr(form, i, 3))) AS gram FROM w WHERE length(form) >= 3), v AS (SELECT gram FROM g GROUP BY gram ORDER BY count(*) DESC, gram LIMIT 300), c AS (SELECT text_id, block, gram, count(*) AS n FROM g JOIN v USING (gram) GROUP BY ALL) SELECT text_id, block, gram, round(n / sum(n) OVER (PARTITION BY text_id, block), 6) AS share FROM c")
def block_trigrams(spark, sf_dir):
    w = table(spark, sf_dir, "word_measurements").select("text_id", F.floor(F.col("word_position") / 50).cast("int").alias("block"), clean_word(F.coalesce("actual_word", F.lit(""))).alias("form"))
    g = w.where("length(form) >= 3").select("text_id", "block", F.explode(F.transform(F.sequence(F.lit(1), F.length("form") - 2), lambda i: F.substr(F.col("form"), i, F.lit(3)))).alias("gram"))
    v = g.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "gram").limit(300).select("gram")
    c = g.join(F.broadcast(v), "gram").groupBy("text_id", "block", "gram").agg(F.count(F.lit(1)).alias("n"))
    return c.select("text_id", "block", "gram", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("text_id", "block")), 6).alias("share"))


@R.add("shingle_overlap", f"WITH d AS (SELECT doc_id, source, {split_sql('text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, source, unnest(range(1, len(w) - 3)) AS k, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM d WHERE len(w) >= 5), o AS (SELECT DISTINCT s FROM g WHERE source = 'old_store'), h AS (SELECT DISTINCT doc_id, k + j AS p FROM g JOIN o USING (s), (SELECT unnest(range(5)) AS j) WHERE source = 'act_files') SELECT doc_id, count(*) AS marked FROM h GROUP BY doc_id")
def shingle_overlap(spark, sf_dir):
    """Words of one source that lie in a five-word shingle of another source."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", words("text").alias("w"))
    g = d.select("doc_id", "source", F.posexplode(ngrams("w", 5)).alias("k", "s"))
    o = g.where("source = 'old_store'").select("s").distinct()
    h = g.where("source = 'act_files'").join(o, "s", "left_semi")
    return h.select("doc_id", F.explode(F.sequence(F.col("k"), F.col("k") + 4)).alias("p")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("marked"))


@R.add("multiset_overlap", f"WITH d AS (SELECT source, unnest({split_sql('text')}) AS w FROM documents WHERE text IS NOT NULL AND source IN ('old_store', 'act_files')), a AS (SELECT w, count(*) AS n FROM d WHERE source = 'old_store' GROUP BY w), b AS (SELECT w, count(*) AS n FROM d WHERE source = 'act_files' GROUP BY w) SELECT round(sum(least(a.n, b.n)) / greatest((SELECT sum(n) FROM a), (SELECT sum(n) FROM b), 1), 3) AS overlap, round((SELECT sum(n) FROM b) / greatest((SELECT sum(n) FROM a), 1), 3) AS word_ratio FROM a JOIN b USING (w)")
def multiset_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IN ('old_store', 'act_files')").select("source", F.explode(words("text")).alias("w"))
    c = d.groupBy("w").agg(F.count_if(F.col("source") == "old_store").alias("a"), F.count_if(F.col("source") == "act_files").alias("b"))
    s = c.agg(F.sum(F.least("a", "b")).alias("s"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return s.select(F.round(F.col("s") / F.greatest("a", "b", F.lit(1)), 3).alias("overlap"), F.round(F.col("b") / F.greatest("a", F.lit(1)), 3).alias("word_ratio"))


_EV = """e AS (SELECT *, CASE WHEN event_type IN (SELECT event_type FROM events GROUP BY event_type ORDER BY event_type LIMIT 2) THEN event_type END AS label FROM events),
  f AS (SELECT *, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'other') AS filled,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM e)"""


def _labelled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().orderBy("event_type").limit(2).withColumnRenamed("event_type", "label")
    return e.join(F.broadcast(kinds), e.event_type == F.col("label"), "left")


@R.add("label_forward_fill", f"WITH {_EV} SELECT event_id, filled FROM f")
def label_forward_fill(spark, sf_dir):
    return sessions.filled_labels(_labelled(spark, sf_dir), "user_id", "ts", "label", "event_id").select("event_id", "filled")


@R.add("sessionize_gaps", f"WITH {_EV} SELECT filled AS label, round(sum(epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) AS seconds, count(DISTINCT user_id) AS sessions FROM f WHERE epoch_us(nxt) - epoch_us(ts) <= 21600 * 1e6 GROUP BY filled")
def sessionize_gaps(spark, sf_dir):
    g = sessions.worked_gaps(_labelled(spark, sf_dir), "user_id", "ts", "label", "event_id", 21600)
    return g.groupBy(F.col("filled").alias("label")).agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.count_distinct("user_id").alias("sessions"))


@R.add("worktime_by_day", f"WITH {_EV} SELECT CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, filled AS label, round(sum(epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) AS seconds FROM f WHERE epoch_us(nxt) - epoch_us(ts) <= 21600 * 1e6 GROUP BY ALL")
def worktime_by_day(spark, sf_dir):
    g = sessions.worked_gaps(_labelled(spark, sf_dir), "user_id", "ts", "label", "event_id", 21600)
    return g.groupBy("day", F.col("filled").alias("label")).agg(F.round(F.sum("seconds"), 3).alias("seconds"))


@R.add("marker_labels", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)midrash') THEN 'midrash' WHEN regexp_matches(text, '(?i)printer|scribe') THEN 'print' END AS label FROM documents")
def marker_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sessions.label_by_pattern("text", [("midrash", "(?i)midrash"), ("print", "(?i)printer|scribe")]).alias("label"))


@R.add("elbow_table", "WITH c AS (SELECT k, 1000 * exp(-k / 4) + 500 / k AS inertia FROM (SELECT unnest(range(2, 31)) AS k)), z AS (SELECT k, inertia, coalesce(100 * (lag(inertia) OVER (ORDER BY k) - inertia) / lag(inertia) OVER (ORDER BY k), 0) AS gain, round(abs((inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) - (1 - (k - 2) / 28)) / sqrt(2), 9) AS bend FROM c), m AS (SELECT max(bend) AS most FROM z) SELECT k, round(inertia, 6) AS inertia, bend, round(gain, 6) AS gain, k = (SELECT min(k) FROM z, m WHERE bend = most) AS elbow, (SELECT min(k) FROM z, m WHERE bend >= 0.85 * most) AS band_low, (SELECT max(k) FROM z, m WHERE bend >= 0.85 * most) AS band_high, most < 0.08 AS flat FROM z, m")
def elbow_table(spark, sf_dir):
    c = spark.range(2, 31).select(F.col("id").alias("k"), (1000 * F.exp(-F.col("id") / 4) + 500 / F.col("id")).alias("inertia"))
    return stats.elbow(c).select("k", F.round("inertia", 6).alias("inertia"), "bend", F.round("gain", 6).alias("gain"), "elbow", "band_low", "band_high", "flat")


@R.add("corpus_elbow")
def corpus_elbow(spark, sf_dir):
    """The elbow of the corpus' own sweep: inertias of k = 2..20 over the chunks' vectors (at most 20,000, as there)."""
    v = table(spark, sf_dir, "rabani_unsmoothed_table").where(vectors.valid("vec", 64)).select("row_id", "vec")
    return stats.elbow(models.sweep(v, "vec", "row_id", list(range(2, 21))).select("k", "inertia"))


@R.add("stratified_sample", "SELECT doc_id, source FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) <= 4")
def stratified_sample(spark, sf_dir):
    """The same number of rows of every stratum, by a hash of the id; rows are cut within salted parts first."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source", F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string"))).alias("h"))
    part = profile.top_per_group(d.withColumn("part", F.concat_ws("|", "source", F.substring("h", 32, 1))), "part", 4, "h", "doc_id").drop("rank")
    return profile.top_per_group(part, "source", 4, "h", "doc_id").select("doc_id", "source")
