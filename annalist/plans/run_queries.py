"""Genres, names by hand, cleaning in full, validation, runs, digests and the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import cleaning, vectors
from annalist.functions.text import strip_points
from annalist.operators import catalog, labels, models, runs, sequence
from annalist.plans.corpus_queries import split_sql
from annalist.plans.registry import Registry, table
from annalist.session import materialize
from annalist.sources import files

R = Registry()


@R.add(
    "genre_rules",
    """WITH t AS (SELECT DISTINCT title FROM corpus_catalog WHERE experiment_1 = '1' AND title IS NOT NULL), x AS (SELECT DISTINCT title FROM corpus_catalog WHERE experiment_2 = '1' AND title IS NOT NULL)
      SELECT filename, CASE WHEN title IN (FROM t) THEN 'chosen' WHEN cat1 = 'Midrash' AND (title IS NULL OR title NOT IN (FROM x)) THEN 'homily' WHEN cat1 = 'Halakhah' THEN 'law' END AS genre FROM corpus_catalog""",
)
def genre_rules(spark, sf_dir):
    """Genres by titles, and by category with exceptions."""
    c = table(spark, sf_dir, "corpus_catalog").select("filename", "title", "cat1", "experiment_1", "experiment_2")
    titles = lambda flag, genre, kind: c.where(f"{flag} = '1' AND title IS NOT NULL").select(F.lit(genre).alias("genre"), F.lit(kind).alias("kind"), F.col("title").alias("value")).distinct()
    fixed = spark.createDataFrame([("homily", "category", "Midrash"), ("law", "category", "Halakhah")], "genre string, kind string, value string")
    rules = fixed.unionByName(titles("experiment_1", "chosen", "title")).unionByName(titles("experiment_2", "homily", "except"))
    return labels.assign_genres(c, "title", "cat1", rules).select("filename", "genre")


@R.add("title_cascade_full")
def title_cascade_full(spark, sf_dir):
    """Names by equality, shortening, similarity, and a hand-made table (here: names of the editions' own files)."""
    c, old = table(spark, sf_dir, "corpus_catalog"), table(spark, sf_dir, "old_catalog")
    manual = old.where("en_name IS NOT NULL AND in_store = 'yes'").groupBy(F.col("en_name")).agg(F.min("old_filename").alias("title"))
    return catalog.title_cascade_full(old.select("en_name"), c.where("title IS NOT NULL").select("title"), "en_name", "title", manual=manual)


def _standard_sql(column: str) -> str:
    out = column
    for step in cleaning.cleaning_steps():
        if step:
            pattern, to = step[0].replace("'", "''"), step[1].replace("$", "\\")
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        else:
            out = f"translate({out}, '{cleaning.PRESENTATION[0]}', '{cleaning.PRESENTATION[1]}')"
    return f"trim({out})"


@R.add("standard_cleaning", f"SELECT row_id, {_standard_sql('orig_sentence')} AS clean FROM corpus_segments")
def standard_cleaning(spark, sf_dir):
    """All fourteen steps of the corpus' cleaning."""
    return table(spark, sf_dir, "corpus_segments").select("row_id", cleaning.clean_standard("orig_sentence").alias("clean"))


def _unit_sql(column: str) -> str:
    out = f"regexp_replace({column}, '\\([^)]{{1,60}}\\)', ' ', 'g')"
    for pattern, to in cleaning.UNIT_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


@R.add("unit_cleaning", f"SELECT row_id, {_unit_sql('orig_sentence')} AS clean, len(regexp_extract_all(orig_sentence, '\\([^)]{{1,60}}\\)')) AS citations FROM corpus_segments")
def unit_cleaning(spark, sf_dir):
    """Text of units without citations, points, direction marks and headings, and the number of citations."""
    clean, n = cleaning.clean_unit("orig_sentence")
    return table(spark, sf_dir, "corpus_segments").select("row_id", clean.alias("clean"), n.cast("long").alias("citations"))


@R.add(
    "unit_ids",
    """WITH b AS (SELECT row_id, filename, regexp_replace(right(regexp_replace(regexp_replace(location, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), '^_+', '') AS u FROM corpus_segments WHERE location IS NOT NULL),
      n AS (SELECT row_id, CASE WHEN u = '' THEN 'unit' ELSE u END AS u, filename FROM b)
      SELECT row_id, CASE WHEN row_number() OVER w > 1 THEN u || '__' || row_number() OVER w ELSE u END AS unit FROM n WINDOW w AS (PARTITION BY filename, u ORDER BY row_id)""",
)
def unit_ids(spark, sf_dir):
    """Identifiers of units, unique within their file."""
    t = table(spark, sf_dir, "corpus_segments").where("location IS NOT NULL").select("row_id", "filename", "location")
    return cleaning.distinct_ids(t, "filename", "location", "row_id").select("row_id", "unit")


@R.add("strip_points")
def strip_points_query(spark, sf_dir):
    """Text without points and accents, precomposed letters included."""
    return table(spark, sf_dir, "corpus_segments").select("row_id", strip_points("orig_sentence").alias("plain"))


_KNOWN = ["row_id", "filename", "snapshot_date", "print_type", "loaded_at"]
_N = f"len({split_sql("coalesce(sentence, '')")})"


@R.add(
    "validation_checks",
    f"""WITH s AS (SELECT *, {_N} AS n, regexp_extract(location, '_part_([0-9]+)$', 1) AS part, lag(to_word) OVER (PARTITION BY filename, regexp_replace(location, '_part_[0-9]+$', '') ORDER BY from_word NULLS FIRST, segment NULLS FIRST, row_id) AS before FROM corpus_segments),
      g AS (SELECT filename, max(segment) - min(segment) + 1 - count(DISTINCT segment) AS gaps FROM corpus_segments WHERE segment IS NOT NULL GROUP BY filename)
      SELECT * FROM (VALUES ('fields are there', 0), ('no other fields', 0), ('types are right', 0)) v("check", violations)
      UNION ALL SELECT 'text_length is the number of words', count(*) FILTER (text_length <> n) FROM s UNION ALL SELECT 'from_word is 1 or more', count(*) FILTER (from_word < 1) FROM s
      UNION ALL SELECT 'to_word follows from from_word', count(*) FILTER (to_word <> from_word + text_length - 1) FROM s
      UNION ALL SELECT 'parts follow one another', count(*) FILTER (part <> '' AND part <> '1' AND before + 1 IS DISTINCT FROM from_word) FROM s
      UNION ALL SELECT 'no empty text', count(*) FILTER (coalesce(trim(sentence), '') = '') FROM s UNION ALL SELECT 'no empty original', count(*) FILTER (coalesce(trim(orig_sentence), '') = '') FROM s
      UNION ALL SELECT 'categories are given', count(*) FILTER (coalesce(len(categories), 0) <= 0) FROM s UNION ALL SELECT 'at most 250 words', count(*) FILTER (n > 250) FROM s
      UNION ALL SELECT 'at least 5 words', count(*) FILTER (n < 5) FROM s UNION ALL SELECT 'location is given', count(*) FILTER (coalesce(location, '') = '') FROM s
      UNION ALL SELECT 'segments follow one another in a file', CAST(coalesce(sum(gaps), 0) AS BIGINT) FROM g UNION ALL SELECT 'segments are unique', count(segment) - count(DISTINCT segment) FROM s""",
)
def validation_checks(spark, sf_dir):
    """The checks of the corpus, fields and types included."""
    return catalog.validation_checks(table(spark, sf_dir, "corpus_segments"), set(_KNOWN))


@R.add("json_titles", "SELECT filename, title, he_title FROM corpus_catalog WHERE length(filename) % 7 <> 0")
def json_titles(spark, sf_dir):
    """Titles from JSON records, some of them cut off, which are left out."""
    c = table(spark, sf_dir, "corpus_catalog")
    j = F.to_json(F.struct("filename", "title", "he_title"))
    return files.parse_titles(c.select(F.when(F.length("filename") % 7 == 0, F.substring(j, 1, 8)).otherwise(j).alias("j")), "j")


@R.add(
    "cache_import_counts",
    f"""SELECT filename, count(*) AS n_chunks, CAST(sum(coalesce(len({split_sql("chunk")}), 0)) AS BIGINT) AS words, min(chunk_number) AS "first", max(chunk_number) AS "last" FROM rabani_unsmoothed_table WHERE filename IS NOT NULL GROUP BY filename""",
)
def cache_import_counts(spark, sf_dir):
    """What an import of the chunk table into the store would hold per file."""
    return files.cache_counts(table(spark, sf_dir, "rabani_unsmoothed_table"))


@R.add("corpus_digest", "SELECT filename, count(*) AS rows, sha256(sha256(string_agg(sha256(sentence), '' ORDER BY segment NULLS LAST, row_id))) AS digest FROM corpus_segments WHERE sentence IS NOT NULL AND filename IS NOT NULL GROUP BY filename")
def corpus_digest(spark, sf_dir):
    """Digest of every file's text, by blocks of 10,000 rows."""
    return runs.corpus_digest(table(spark, sf_dir, "corpus_segments").select("filename", "segment", "row_id", "sentence"), "filename", ["segment", "row_id"], "sentence")


_RUN = "SELECT list_sort(list(filename)) AS files, count(*) AS n, CAST(coalesce(sum(try_cast(words AS BIGINT)), 0) AS BIGINT) AS words FROM corpus_catalog WHERE experiment_{} = '1'"


@R.add(
    "run_comparison",
    f"""WITH a AS ({_RUN.format(5)}), b AS ({_RUN.format(6)}), f AS (SELECT len(list_intersect(a.files, b.files)) AS c, len(list_filter(a.files, lambda x: NOT list_contains(b.files, x))) AS oa, len(list_filter(b.files, lambda x: NOT list_contains(a.files, x))) AS ob FROM a, b)
      SELECT 'param' AS part, 'chunk_size' AS name, '50' AS a, '50' AS b, false AS differs UNION ALL SELECT 'param', 'k', '8', '12', true UNION ALL SELECT 'param', 'model', 'm', 'm', false UNION ALL SELECT 'param', 'penalty', NULL, '0.1', true
      UNION ALL SELECT 'result', 'files', a.n::VARCHAR, b.n::VARCHAR, a.n <> b.n FROM a, b UNION ALL SELECT 'result', 'words', a.words::VARCHAR, b.words::VARCHAR, a.words <> b.words FROM a, b
      UNION ALL SELECT 'files', 'common', c::VARCHAR, c::VARCHAR, false FROM f UNION ALL SELECT 'files', 'only_a', oa::VARCHAR, '0', oa > 0 FROM f UNION ALL SELECT 'files', 'only_b', '0', ob::VARCHAR, ob > 0 FROM f
      UNION ALL SELECT 'verdict', 'clusterings', CASE WHEN oa + ob > 0 THEN 'files differ' ELSE 'comparable' END, NULL, oa + ob > 0 FROM f""",
)
def run_comparison(spark, sf_dir):
    """Parameters, files, results and verdict of two runs over the selections of two experiments."""
    c = table(spark, sf_dir, "corpus_catalog")

    def run(i, params):
        d = c.where(f"experiment_{i} = '1'").agg(F.array_sort(F.collect_list("filename")).alias("files"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr("try_cast(words AS bigint)")), F.lit(0)).alias("words"))
        result = F.create_map(F.lit("files"), F.col("n"), F.lit("words"), F.col("words"))
        return d.select(F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).alias("params"), "files", result.alias("results"))

    return runs.compare_runs(run(5, {"chunk_size": "50", "k": "8", "model": "m"}), run(6, {"chunk_size": "50", "k": "12", "model": "m", "penalty": "0.1"}))


@R.add("panel_dots", "SELECT source, lang, n, round(share, 9) AS share, round(8 + 14 * sqrt(share), 6) AS size FROM (SELECT source, lang, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share FROM documents GROUP BY source, lang)")
def panel_dots(spark, sf_dir):
    """Dots of a panel: languages by source, their size by the share."""
    d = runs.panel_dots(table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang")
    return d.select("source", "lang", "n", F.round("share", 9).alias("share"), F.round("size", 6).alias("size"))


@R.add("grid_results")
def grid_results(spark, sf_dir):
    """The grid: for every number of clusters and block size the best split of the axis and its significance."""
    from annalist.operators.order import global_index

    t = table(spark, sf_dir, "rabani_unsmoothed_table").where(vectors.valid("vec", 64)).select("row_id", "chronological_index", "vec")
    axis = materialize(global_index(t, "chronological_index", "row_id"), "axis")
    fitted = {k: materialize(models.kmeans(axis, "vec", k)[0].select("idx", "scluster"), "fitted") for k in (6, 10)}

    def run(c):
        comp = sequence.blocks(fitted[c["k"]], "idx", "scluster", c["size"])
        rows = comp.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda s: s["p"]).alias("x")).select(F.col("block").cast("long").alias("t"), "x")
        st = {r.rep: r.stat for r in sequence.permuted_splits(materialize(rows, "grid"), 5, 199, 2).collect()}  # one number per permutation
        hits = sum(st[r] >= st[0] for r in st if r)
        return {"statistic": float(st.get(0, 0.0)), "p": (1 + hits) / 200}

    done = runs.run_grid([{"k": k, "size": size} for k in (6, 10) for size in (50, 100)], run)
    rows = [(r["k"], r["size"], r.get("statistic"), r.get("p"), r.get("error")) for r in done.values()]
    return spark.createDataFrame(rows, "k int, size int, statistic double, p double, error string")
