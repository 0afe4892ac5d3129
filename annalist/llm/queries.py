"""Named queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.llm import cluster, entities, mix, moderation, split, terms, tokenize, unify
from annalist.plans.registry import Registry, table
from annalist.session import materialize

R = Registry()

_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '{_SPACE}'), lambda w: w <> '')"


@R.add("p1_found")
def p1_found(spark, sf_dir):
    seg = unify.lookalike_pairs(table(spark, sf_dir, "corpus_segments"), "sentence", "row_id")
    wm = unify.lookalike_pairs(table(spark, sf_dir, "word_measurements"), "actual_word", "row_id", "text_id")
    return seg.select(F.lit("corpus_segments").alias("tbl"), "*").unionByName(wm.select(F.lit("word_measurements").alias("tbl"), "*"))


def _classes(spark, sf_dir, fold):
    seg = unify.lookalike_classes(table(spark, sf_dir, "corpus_segments"), "sentence", "row_id", fold=fold)
    wm = unify.lookalike_classes(table(spark, sf_dir, "word_measurements"), "actual_word", "row_id", "text_id", fold)
    return seg.select(F.lit("corpus_segments").alias("tbl"), "*").unionByName(wm.select(F.lit("word_measurements").alias("tbl"), "*"))


@R.add("p1_classes")
def p1_classes(spark, sf_dir):
    """Rows written in several ways with their class and number of links; p1_found has the pairs."""
    return _classes(spark, sf_dir, False)


@R.add("p1_folded_classes")
def p1_folded_classes(spark, sf_dir):
    """The same with full case folding, so that case makes no difference."""
    return _classes(spark, sf_dir, True)


def _plain_sql(tbl, column):
    return rf"""SELECT '{tbl}' AS tbl, row_id, CASE WHEN regexp_full_match({column}, '[\x00-\x7fא-ת]*') THEN lower(trim(regexp_replace({column}, '[\x09-\x0d\x1c-\x20]+', ' ', 'g'))) END AS form FROM {tbl}"""


@R.add("p1_plain_forms", f"{_plain_sql('corpus_segments', 'sentence')} UNION ALL {_plain_sql('word_measurements', 'actual_word')}")
def p1_plain_forms(spark, sf_dir):
    """The form of every text that holds ASCII and plain Hebrew letters only, null for others: there SQL can say it."""
    out = []
    for tbl, column in (("corpus_segments", "sentence"), ("word_measurements", "actual_word")):
        form = unify.unify(table(spark, sf_dir, tbl).select("row_id", column), column, "form")
        plain = F.rlike(F.col(column), F.lit(r"\A[\x00-\x7fא-ת]*\z"))
        out.append(form.select(F.lit(tbl).alias("tbl"), "row_id", F.when(plain, F.col("form")).alias("form")))
    return out[0].unionByName(out[1])


@R.add("p1_unified_sentences")
def p1_unified_sentences(spark, sf_dir):
    return unify.unify(table(spark, sf_dir, "corpus_segments").select("row_id", "sentence"), "sentence", "form").select("row_id", "form")


@R.add("p1_unified_words")
def p1_unified_words(spark, sf_dir):
    words = table(spark, sf_dir, "word_measurements").select("row_id", "actual_word")
    return unify.unify(words, "actual_word", "form").select("row_id", "form")


_P3 = f"""WITH t AS (SELECT row_id, unnest({_words("chunk")}) AS term FROM rabani_unsmoothed_table),
  f AS (SELECT term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM t GROUP BY term),
  n AS (SELECT count(chunk) AS with_text FROM rabani_unsmoothed_table)
  SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * with_text THEN 'common' END AS mark FROM f, n"""


@R.add("p3_term_frequencies", _P3)
def p3_term_frequencies(spark, sf_dir):
    return terms.term_frequencies(table(spark, sf_dir, "rabani_unsmoothed_table"), "chunk")


@R.add("p3_found", f"SELECT term, mark FROM ({_P3}) WHERE mark IS NOT NULL")
def p3_found(spark, sf_dir):
    return p3_term_frequencies(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


_P5_BASE = f"""t AS (SELECT row_id, scluster, unnest({_words("chunk")}) AS term FROM rabani_unsmoothed_table),
  pair AS (SELECT row_id, term, count(*) AS n FROM t GROUP BY row_id, term),
  held AS (SELECT term, sum(n) AS occurrences, count(*) AS records FROM pair GROUP BY term),
  size AS (SELECT row_id, sum(n) AS size FROM pair GROUP BY row_id),
  total AS (SELECT sum(size) AS all_words FROM size)"""
_LLR = """2 * (a * ln(a) + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d) ELSE 0 END
   - (a + b) * ln(a + b) - CASE WHEN c + d > 0 THEN (c + d) * ln(c + d) ELSE 0 END - (a + c) * ln(a + c) - CASE WHEN b + d > 0 THEN (b + d) * ln(b + d) ELSE 0 END + (a + b + c + d) * ln(a + b + c + d))"""


@R.add(
    "p5_record_scores",
    f"""WITH {_P5_BASE}, k AS (SELECT row_id, term, n, occurrences, records, n::DOUBLE AS a, (occurrences - n)::DOUBLE AS b, (size - n)::DOUBLE AS c,
      (all_words - occurrences - size + n)::DOUBLE AS d FROM pair JOIN held USING (term) JOIN size USING (row_id), total)
      SELECT row_id AS record_key, term, n, CAST(occurrences AS BIGINT) AS occurrences, records,
        round(greatest({_LLR}, 0) * CASE WHEN a * (c + d) >= c * (a + b) THEN 1 ELSE -1 END, 3) + 0 AS score FROM k""",
)
def p5_record_scores(spark, sf_dir):
    out = terms.distinctive_in_records(table(spark, sf_dir, "rabani_unsmoothed_table"), "row_id", "chunk")
    return out.select(F.col("record").alias("record_key"), "term", "n", "occurrences", "records", (F.round("score", 3) + 0.0).alias("score"))


@R.add(
    "p5_found",
    f"""WITH {_P5_BASE},
      g AS (SELECT scluster, p.term, count(*) AS records FROM pair p JOIN rabani_unsmoothed_table r USING (row_id) WHERE scluster IS NOT NULL GROUP BY scluster, p.term),
      w AS (SELECT term, sum(records) AS all_records FROM g GROUP BY term),
      s AS (SELECT scluster, count(*) AS group_records FROM rabani_unsmoothed_table WHERE scluster IS NOT NULL GROUP BY scluster)
      SELECT 'chunk' AS level_name, row_id AS record_key, term FROM pair JOIN held USING (term) WHERE n >= 5 AND records <= 5
      UNION ALL SELECT 'cluster', scluster::BIGINT, term FROM g JOIN w USING (term) JOIN s USING (scluster)
        WHERE records >= 8 AND records >= 0.02 * group_records AND records >= 0.8 * all_records""",
)
def p5_found(spark, sf_dir):
    t = table(spark, sf_dir, "rabani_unsmoothed_table")
    chunk = terms.distinctive_in_records(t, "row_id", "chunk", least=5).where("score > 0 AND records <= 5")
    cluster = terms.distinctive_in_groups(t, "scluster", "chunk", least_records=8).where(
        "score > 0 AND records / group_records >= 0.02 AND records / all_records >= 0.8"
    )
    return chunk.select(F.lit("chunk").alias("level_name"), F.col("record").cast("long").alias("record_key"), "term").unionByName(
        cluster.select(F.lit("cluster").alias("level_name"), F.col("grp").cast("long").alias("record_key"), "term")
    )


def _pieces(spark, sf_dir, whole):
    seg = split.split_oversized(table(spark, sf_dir, "corpus_segments"), "sentence", ["row_id", "filename", "location", "from_word"], 250, 20, whole)
    chunk = split.split_oversized(table(spark, sf_dir, "rabani_unsmoothed_table"), "chunk", ["row_id", "filename", "chunk_number"], 50, 5, whole)
    return seg, chunk


@R.add("p6_pieces")
def p6_pieces(spark, sf_dir):
    """Every piece with its place: location and words of the unit, or filename, chunk number and words of the chunk."""
    seg, chunk = _pieces(spark, sf_dir, True)
    return seg.toDF("row_id", "filename", "location", "unit_from", "piece_no", "pieces", "from_word", "to_word", "piece").select(
        F.lit("corpus_segments").alias("tbl"), "row_id", "filename", "location", F.lit(None).cast("int").alias("chunk_number"), "piece_no", "pieces", "from_word", "to_word",
        (F.col("unit_from") + F.col("from_word") - 1).alias("unit_word"), "piece",
    ).unionByName(chunk.select(F.lit("rabani_unsmoothed_table").alias("tbl"), "*"), allowMissingColumns=True)


def _restored_sql(tbl: str, column: str, limit: int) -> str:
    return f"SELECT '{tbl}' AS tbl, row_id, array_to_string({_words(column)}, ' ') AS words, true AS within FROM {tbl} WHERE {column} IS NOT NULL"


@R.add("p6_restored", f"{_restored_sql('corpus_segments', 'sentence', 250)} UNION ALL {_restored_sql('rabani_unsmoothed_table', 'chunk', 50)}")
def p6_restored(spark, sf_dir):
    """The words of every row put together again from its pieces, overlaps left out, and whether all pieces are within the
    limit and overlap as asked (the last word of a piece is that many words behind the first of the next)."""
    from annalist.functions.text import words

    out = []
    for tbl, pieces, limit, overlap in zip(("corpus_segments", "rabani_unsmoothed_table"), _pieces(spark, sf_dir, True), (250, 50), (20, 5), strict=True):
        names = ["row_id", *["x"] * (len(pieces.columns) - 6), "piece_no", "pieces", "from_word", "to_word", "piece"]
        p = pieces.toDF(*[n if n != "x" else f"x{i}" for i, n in enumerate(names)]).select("row_id", "piece_no", "from_word", "to_word", words("piece").alias("w"))
        g = p.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "from_word", "to_word", "w"))).alias("p"))  # the pieces of one row
        rest = F.transform("p", lambda s, i: F.when(i == 0, s["w"]).otherwise(F.slice(s["w"], overlap + 1, F.greatest(F.size(s["w"]), F.lit(1)))))
        near = F.forall(F.transform("p", lambda s, i: (i == 0) | (F.get("p", i - 1)["to_word"] - s["from_word"] + 1 == overlap)), lambda x: x)
        within = F.forall("p", lambda s: F.size(s["w"]) <= limit) & near
        out.append(g.select(F.lit(tbl).alias("tbl"), "row_id", F.array_join(F.flatten(rest), " ").alias("words"), within.alias("within")))
    return out[0].unionByName(out[1])


def _n_words(column: str) -> str:
    return f"len({_words(column)})"


@R.add(
    "p6_found",
    f"""SELECT 'corpus_segments' AS tbl, row_id FROM corpus_segments WHERE {_n_words("sentence")} > 250
      UNION ALL SELECT 'rabani_unsmoothed_table', row_id FROM rabani_unsmoothed_table WHERE {_n_words("chunk")} > 50""",
)
def p6_found(spark, sf_dir):
    seg, chunk = (p.where("piece_no = 1 AND pieces > 1").select("row_id") for p in _pieces(spark, sf_dir, False))
    return seg.select(F.lit("corpus_segments").alias("tbl"), "row_id").unionByName(chunk.select(F.lit("rabani_unsmoothed_table").alias("tbl"), "row_id"))


@R.add("p7_found")
def p7_found(spark, sf_dir):
    out = cluster.relabelled(table(spark, sf_dir, "rabani_unsmoothed_table"), "row_id", "vec", "scluster")
    return out.select(F.col("row").alias("row_id"), F.col("prevailing").alias("scluster"))


@R.add("p7_clusters")
def p7_clusters(spark, sf_dir):
    return cluster.describe_clusters(table(spark, sf_dir, "rabani_unsmoothed_table"), "row_id", "vec", "scluster")


@R.add("p7_threshold")
def p7_threshold(spark, sf_dir):
    """What the threshold is read off: mass of merges within and across labels by similarity, and the threshold."""
    profile = materialize(cluster.merge_profile(table(spark, sf_dir, "rabani_unsmoothed_table"), "vec", "scluster"), "profile")
    return profile.withColumn("threshold", F.lit(cluster.derived_threshold(profile)))


@R.add("p8_ids")
def p8_ids(spark, sf_dir):
    return tokenize.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.add("p8_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded(spark, sf_dir):
    return tokenize.decode(p8_ids(spark, sf_dir), "doc_id", spark)


def _moderated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, _ = moderation.train(docs, table(spark, sf_dir, "doc_labels"))
    return moderation.score_documents(docs, model, ["doc_id", "source"])


@R.add("p10_scores")
def p10_scores(spark, sf_dir):
    return _moderated(spark, sf_dir)


@R.add("p10_rates")
def p10_rates(spark, sf_dir):
    return moderation.source_rates(_moderated(spark, sf_dir))


@R.add("p10_quality")
def p10_quality(spark, sf_dir):
    """How the held-out labels agree with the model, all of them and those that it does not contradict strongly."""
    _, report = moderation.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return spark.createDataFrame(report, moderation.REPORT)


@R.add("p10_found")
def p10_found(spark, sf_dir):
    flags = F.array(*[F.when(F.col(f"flag_{c}"), F.lit(c)) for c in moderation.CATEGORIES])
    return _moderated(spark, sf_dir).select("doc_id", F.explode(flags).alias("category")).where("category IS NOT NULL")


def _sized(spark, sf_dir):
    return mix.sized(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


@R.add("p9_mixture")
def p9_mixture(spark, sf_dir):
    return mix.mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@R.add("p9_shares")
def p9_shares(spark, sf_dir):
    sizes, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix.shares(mix.mixture(sizes, targets), sizes, targets)


@R.add("p4_found")
def p4_found(spark, sf_dir):
    return p4_matches(spark, sf_dir).select("filename", "old_id")


@R.add("p4_matches")
def p4_matches(spark, sf_dir):
    return entities.match(table(spark, sf_dir, "corpus_catalog"), table(spark, sf_dir, "old_catalog"))
