"""Catalog, reconciliation, cleaning, runs and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import cleaning
from annalist.functions.text import hyphen_words, safe_name, sentences, strip_marks
from annalist.operators import catalog, labels, profile
from annalist.plans.registry import Registry, table

R = Registry()


def _cat(spark, sf_dir):
    return table(spark, sf_dir, "corpus_catalog")


@R.add("experiment_selection", "SELECT filename FROM corpus_catalog WHERE experiment_6 = '1' AND hierarchy IS NOT NULL")
def experiment_selection(spark, sf_dir):
    return catalog.experiment_files(_cat(spark, sf_dir), "experiment_6")


@R.add("catalog_scan", "SELECT filename, list_transform(string_split(hierarchy, '.'), lambda x: CAST(string_split(x, '-')[1] AS INT)) AS hierarchy_key, string_split(filename, '-')[1] AS level1 FROM corpus_catalog WHERE hierarchy IS NOT NULL")
def catalog_scan(spark, sf_dir):
    c = _cat(spark, sf_dir).dropna(subset=["hierarchy"])
    return c.select("filename", catalog.hierarchy_key("hierarchy").alias("hierarchy_key"), labels.grouping_label("filename", 1).alias("level1"))


@R.add("top_level_filter", "SELECT filename FROM corpus_catalog WHERE string_split(filename, '-')[1] IN ('Midrash', 'Tanaitic')")
def top_level_filter(spark, sf_dir):
    return _cat(spark, sf_dir).where(F.split("filename", "-")[0].isin("Midrash", "Tanaitic")).select("filename")


@R.add("available_files", "SELECT DISTINCT filename FROM corpus_segments WHERE filename IN (SELECT filename FROM corpus_catalog)")
def available_files(spark, sf_dir):
    return catalog.available(table(spark, sf_dir, "corpus_segments").select("filename"), _cat(spark, sf_dir).select("filename"), "filename")[0].distinct()


@R.add("unfinished_anti_join", "SELECT filename FROM corpus_catalog c WHERE NOT EXISTS (SELECT 1 FROM rabani_unsmoothed_table r WHERE r.filename = c.filename)")
def unfinished_anti_join(spark, sf_dir):
    return catalog.available(_cat(spark, sf_dir).select("filename"), table(spark, sf_dir, "rabani_unsmoothed_table").select("filename"), "filename")[1]


_CATS = """c AS (SELECT row_id, coalesce(categories, []) AS c FROM corpus_segments), s AS (SELECT row_id, c, CASE WHEN list_contains(c, 'Sefaria') THEN len(c) - list_position(list_reverse(c), 'Sefaria') ELSE len(c) - 1 END AS src FROM c),
  h AS (SELECT row_id, c, src, list_slice(c, 1, greatest(src - 1, 0)) AS head FROM s), f AS (SELECT *, list_position(list_transform(head, lambda x: regexp_matches(x, '[א-ת]')), true) AS first FROM h)"""


@R.add("parse_categories", f"WITH {_CATS} SELECT row_id, array_to_string(CASE WHEN first > 0 THEN list_slice(head, 1, first - 1) ELSE head END, ' > ') AS sefaria_path, CASE WHEN first > 0 THEN head[first] ELSE '' END AS scholarly_category, CASE WHEN first > 0 THEN array_to_string(list_slice(head, first + 1, len(head)), ' ') ELSE '' END AS composition_id, CASE WHEN src >= 1 THEN c[src] ELSE '' END AS book FROM f")
def parse_categories(spark, sf_dir):
    return table(spark, sf_dir, "corpus_segments").select("row_id", *[c.alias(n) for n, c in catalog.parse_categories("categories").items()])


@R.add("edition_from_filename", "SELECT filename, regexp_extract(filename, '-([^-]+)_Sefaria\\.jsonl$', 1) AS edition FROM corpus_catalog")
def edition_from_filename(spark, sf_dir):
    return _cat(spark, sf_dir).select("filename", catalog.edition_of("filename").alias("edition"))


@R.add("normal_names", "SELECT old_id, trim(regexp_replace(lower(en_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name FROM old_catalog")
def normal_names(spark, sf_dir):
    return table(spark, sf_dir, "old_catalog").select("old_id", catalog.normal_name("en_name").alias("name"))


@R.add("reconcile_full_outer", "SELECT coalesce(a.n, b.n) AS name, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN 'same' WHEN a.n IS NOT NULL THEN 'no new' ELSE 'no old' END AS status FROM (SELECT DISTINCT lower(en_name) AS n FROM old_catalog WHERE en_name IS NOT NULL) a FULL JOIN (SELECT DISTINCT lower(title) AS n FROM corpus_catalog WHERE title IS NOT NULL) b ON a.n = b.n")
def reconcile_full_outer(spark, sf_dir):
    old = table(spark, sf_dir, "old_catalog").select(F.lower("en_name").alias("name"))
    return catalog.reconcile(old, _cat(spark, sf_dir).select(F.lower("title").alias("name")), "name")


@R.add("title_cascade", "WITH t AS (SELECT title, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM corpus_catalog WHERE title IS NOT NULL), n AS (SELECT DISTINCT en_name, string_split(trim(regexp_replace(lower(en_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM old_catalog WHERE en_name IS NOT NULL), c AS (SELECT en_name, unnest(range(len(w))) AS dropped, w FROM n), j AS (SELECT en_name, title, CAST(dropped AS INT) AS dropped FROM c JOIN t ON t.k = array_to_string(list_slice(w, 1, len(w) - dropped), ' ') WHERE t.k <> '') SELECT en_name, title, dropped FROM j QUALIFY row_number() OVER (PARTITION BY en_name ORDER BY dropped, title) = 1")
def title_cascade(spark, sf_dir):
    names = table(spark, sf_dir, "old_catalog").where("en_name IS NOT NULL").select("en_name").distinct()
    return catalog.title_cascade(names, _cat(spark, sf_dir).where("title IS NOT NULL").select("title"), "en_name", "title")


@R.add("carry_over", "SELECT category, min_by(en_name, old_id) AS en_name, max_by(in_store, CASE WHEN in_store IS NOT NULL THEN old_id END) AS in_store, string_agg(print_place, '; ' ORDER BY old_id) FILTER (print_place IS NOT NULL AND print_place <> '') AS print_place FROM old_catalog WHERE category IS NOT NULL GROUP BY category")
def carry_over(spark, sf_dir):
    old = table(spark, sf_dir, "old_catalog").select("category", "old_id", "en_name", "in_store", "print_place")
    return catalog.carry_over(old, "category", "old_id", ["in_store"], "print_place")


@R.add("category_rollup", "SELECT coalesce(cat1, 'total') AS cat1, files, with_hierarchy, editions, words FROM (SELECT cat1, grouping(cat1) AS g, count(*) AS files, count(hierarchy) AS with_hierarchy, count(DISTINCT nullif(edition, '')) AS editions, CAST(sum(try_cast(words AS BIGINT)) AS BIGINT) AS words FROM corpus_catalog GROUP BY ROLLUP (cat1))")
def category_rollup(spark, sf_dir):
    c = _cat(spark, sf_dir).rollup("cat1").agg(F.count(F.lit(1)).alias("files"), F.count("hierarchy").alias("with_hierarchy"), F.count_distinct(F.nullif("edition", F.lit(""))).alias("editions"), F.sum(F.expr("try_cast(words AS bigint)")).alias("words"))
    return c.withColumn("cat1", F.coalesce("cat1", F.lit("total")))


@R.add("custom_order", "SELECT filename, row_number() OVER (ORDER BY coalesce(nullif(list_position(['Tanaitic', 'Midrash', 'Halakhah'], cat1), 0), 99), filename) AS place FROM corpus_catalog")
def custom_order(spark, sf_dir):
    from annalist.operators.order import global_index

    wanted = F.array(*[F.lit(x) for x in ("Tanaitic", "Midrash", "Halakhah")])
    place = F.array_position(wanted, F.col("cat1"))
    c = _cat(spark, sf_dir).select("filename", F.when(place > 0, place).otherwise(99).alias("key"))
    return global_index(c, "key", "filename").select("filename", (F.col("idx") + 1).alias("place"))


@R.add("catalog_groups", "SELECT cat1, count(*) AS files, count(*) FILTER (experiment_6 = '1') AS picked, CAST(coalesce(sum(try_cast(words AS BIGINT)) FILTER (experiment_6 = '1'), 0) AS BIGINT) AS picked_words FROM corpus_catalog GROUP BY cat1")
def catalog_groups(spark, sf_dir):
    on = F.coalesce(F.col("experiment_6") == "1", F.lit(False))
    return _cat(spark, sf_dir).groupBy("cat1").agg(F.count(F.lit(1)).alias("files"), F.count_if(on).alias("picked"), F.coalesce(F.sum(F.when(on, F.expr("try_cast(words AS bigint)"))), F.lit(0)).alias("picked_words"))


@R.add("selection_guard", "SELECT files, words, chunks, round(mb, 6) AS mb, round(seconds, 6) AS seconds, mb > 500 AS refused FROM (SELECT *, 315 + 3.08 * chunks / 1000 + 20.3 * words / 1e6 AS mb, chunks * 10 / 8 * 0.00113 + 0.5 AS seconds FROM (SELECT count(*) AS files, CAST(sum(try_cast(words AS BIGINT)) AS BIGINT) AS words, CAST(sum(ceil(try_cast(words AS BIGINT) / 50)) AS BIGINT) AS chunks FROM corpus_catalog WHERE experiment_6 = '1'))")
def selection_guard(spark, sf_dir):
    n = F.expr("try_cast(words AS bigint)")
    s = _cat(spark, sf_dir).where("experiment_6 = '1'").agg(F.count(F.lit(1)).alias("files"), F.sum(n).alias("words"), F.sum(F.ceil(n / 50)).cast("long").alias("chunks"))
    mb = cleaning.predicted_megabytes(F.col("chunks"), F.col("words"))
    return s.select("files", "words", "chunks", F.round(mb, 6).alias("mb"), F.round(cleaning.predicted_seconds(F.col("chunks"), F.lit(10)), 6).alias("seconds"), (mb > 500).alias("refused"))


def _steps_sql(column: str) -> str:
    out = column
    for pattern, to in cleaning.CORPUS_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


@R.add("html_clean", f"SELECT row_id, {_steps_sql('orig_sentence')} AS clean FROM corpus_segments")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "corpus_segments").select("row_id", cleaning.clean_corpus_text("orig_sentence").alias("clean"))


@R.add("citation_cleaning", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\([^()]{0,60}\\)', ' ', 'g'), ' +', ' ', 'g'), '^ | $', '', 'g') AS clean, len(regexp_extract_all(text, '\\([^()]{0,60}\\)')) AS citations FROM documents")
def citation_cleaning(spark, sf_dir):
    clean, n = cleaning.clean_citations("text")
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"), n.cast("long").alias("citations"))


@R.add("strip_marks", "SELECT row_id, regexp_replace(orig_sentence, '\\p{Mn}+', '', 'g') AS plain FROM corpus_segments")
def strip_marks_query(spark, sf_dir):
    return table(spark, sf_dir, "corpus_segments").select("row_id", strip_marks("orig_sentence").alias("plain"))


@R.add("hyphen_words", "SELECT doc_id, len(list_filter(flatten(list_transform(string_split_regex(text, '[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: string_split(w, '-'))), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL")
def hyphen_words_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(hyphen_words("text")).cast("long").alias("n"))


@R.add("safe_names", "SELECT filename, left(regexp_replace(filename, '[^A-Za-z0-9._-]+', '_', 'g'), 120) AS safe, regexp_replace(right(regexp_replace(he_title, '[^\\p{L}\\p{N}]+', '_', 'g'), 60), '^_+', '') AS unit_id FROM corpus_catalog")
def safe_names(spark, sf_dir):
    return _cat(spark, sf_dir).select("filename", safe_name("filename").alias("safe"), cleaning.unit_id("he_title").alias("unit_id"))


@R.add("sentence_split", r"SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS place, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?;])[\x09-\x0d ]+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(sentences("text")).alias("place", "sentence"))


@R.add("quality_checks", """WITH s AS (SELECT *, len(list_filter(string_split_regex(coalesce(sentence, ''), '[\x09-\x0d\x1c-\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) AS n FROM corpus_segments)
  SELECT 'filename missing' AS "check", count(*) FILTER (filename IS NULL) AS violations FROM s UNION ALL SELECT 'location missing', count(*) FILTER (location IS NULL) FROM s
  UNION ALL SELECT 'sentence missing', count(*) FILTER (sentence IS NULL OR trim(sentence) = '') FROM s UNION ALL SELECT 'title missing', count(*) FILTER (title IS NULL) FROM s
  UNION ALL SELECT 'he_title missing', count(*) FILTER (he_title IS NULL) FROM s UNION ALL SELECT 'text_length missing', count(*) FILTER (text_length IS NULL) FROM s
  UNION ALL SELECT 'text_length wrong', count(*) FILTER (text_length <> n) FROM s UNION ALL SELECT 'from_word below 1', count(*) FILTER (from_word < 1) FROM s
  UNION ALL SELECT 'to_word wrong', count(*) FILTER (to_word <> from_word + text_length - 1) FROM s UNION ALL SELECT 'print_type unknown', count(*) FILTER (print_type IS NULL OR print_type NOT IN ('print edition', 'born digital')) FROM s
  UNION ALL SELECT 'segment repeated', count(segment) - count(DISTINCT segment) FROM s""")
def quality_checks(spark, sf_dir):
    return catalog.quality_checks(table(spark, sf_dir, "corpus_segments"))


@R.add("run_set_compare", "WITH a AS (SELECT filename FROM corpus_catalog WHERE experiment_5 = '1'), b AS (SELECT filename FROM corpus_catalog WHERE experiment_6 = '1') SELECT 'common' AS part, filename FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_a', filename FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_b', filename FROM (FROM b EXCEPT FROM a)")
def run_set_compare(spark, sf_dir):
    a, b = (_cat(spark, sf_dir).where(f"experiment_{i} = '1'").select("filename") for i in (5, 6))
    part = lambda n, d: d.select(F.lit(n).alias("part"), "filename")
    return part("common", a.intersect(b)).unionByName(part("only_a", a.subtract(b))).unionByName(part("only_b", b.subtract(a)))


@R.add("cache_key", "SELECT cat1, sha256('{\"files\":[' || string_agg('\"' || filename || '\"', ',' ORDER BY filename) || '],\"size\":50}')[1:24] AS key FROM corpus_catalog GROUP BY cat1")
def cache_key(spark, sf_dir):
    """Key of a selection: hash of its sorted files and the chunk size as canonical JSON. One list per selection, as
    long as a selection is."""
    g = _cat(spark, sf_dir).groupBy("cat1").agg(F.array_sort(F.collect_list("filename")).alias("files"))
    return g.select("cat1", F.substring(F.sha2(F.to_json(F.struct("files", F.lit(50).alias("size"))), 256), 1, 24).alias("key"))


@R.add("newest_first", "SELECT doc_id, CAST(loaded_at + INTERVAL 3 HOUR AS DATE) AS day, row_number() OVER (PARTITION BY CAST(loaded_at + INTERVAL 3 HOUR AS DATE) ORDER BY loaded_at DESC, doc_id) AS place FROM documents")
def newest_first(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "loaded_at", F.to_date(F.col("loaded_at") + F.make_interval(hours=F.lit(3))).alias("day"))
    return d.select("doc_id", "day", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("loaded_at"), "doc_id")).alias("place"))  # a day's rows


@R.add("run_results", "WITH c AS (SELECT scluster, count(*) AS n, avg(length(chunk)) AS m FROM rabani_unsmoothed_table WHERE scluster IS NOT NULL GROUP BY scluster) SELECT count(*) AS clusters, round(avg(m), 6) AS mean_of_means, round(max(n) / sum(n), 6) AS largest_share FROM c")
def run_results(spark, sf_dir):
    c = table(spark, sf_dir, "rabani_unsmoothed_table").where("scluster IS NOT NULL").groupBy("scluster").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("chunk")).alias("m"))
    return c.agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


@R.add("packed_columns", "SELECT text_id, '[' || string_agg(CAST(CAST(round_even(least(greatest(coalesce(prob_mass, 0), 0), 1) * 1000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY word_position, row_id) || ']' AS packed FROM word_measurements GROUP BY text_id")
def packed_columns(spark, sf_dir):
    """A text's column clipped, scaled to whole numbers and packed as JSON, for a viewer of one text."""
    v = F.bround(F.least(F.greatest(F.coalesce("prob_mass", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 1000).cast("long")
    g = table(spark, sf_dir, "word_measurements").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("word_position", "row_id", v.alias("v")))).alias("a"))
    return g.select("text_id", F.to_json(F.transform("a", lambda s: s["v"])).alias("packed"))


@R.add("isolated_references", "SELECT row_id, regexp_replace(end_unit, '([0-9]+(?:[:_][0-9]+)*)$', '⁦\\1⁩') AS shown, chunk_number || '–' || end_segment_word AS place FROM rabani_unsmoothed_table")
def isolated_references(spark, sf_dir):
    return table(spark, sf_dir, "rabani_unsmoothed_table").select("row_id", cleaning.isolate_reference("end_unit").alias("shown"), F.concat(F.col("chunk_number").cast("string"), F.lit("–"), F.col("end_segment_word").cast("string")).alias("place"))


@R.add("chance_levels", "SELECT m, round(1 - pow(1 - 2 * 250 / 33194, m), 9) AS chance FROM (SELECT unnest(range(1, 13)) AS m)")
def chance_levels(spark, sf_dir):
    return spark.range(1, 13).select(F.col("id").alias("m"), F.round(cleaning.chance_level(F.col("id"), F.lit(250.0), F.lit(33194.0)), 9).alias("chance"))


@R.add("parameter_grid", "SELECT size, k, smoothing FROM (SELECT unnest([25, 50, 100, 200]) AS size), (SELECT unnest([6, 8, 10, 12, 14, 16, 20]) AS k), (SELECT unnest([false, true]) AS smoothing)")
def parameter_grid(spark, sf_dir):
    grid = spark.range(1, numPartitions=1)
    for name, values in {"size": [25, 50, 100, 200], "k": [6, 8, 10, 12, 14, 16, 20], "smoothing": [False, True]}.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id")


@R.add("vector_text_parse", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def vector_text_parse(spark, sf_dir):
    """Vectors written as text and parsed back."""
    from annalist.functions.vectors import parse

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json("embedding").alias("s"))
    return e.select("vec_id", F.round(F.aggregate(parse("s"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@R.add("fuzzy_match")
def fuzzy_match(spark, sf_dir):
    old = table(spark, sf_dir, "old_catalog").select(F.col("en_name").alias("name"))
    return catalog.fuzzy_names(old, _cat(spark, sf_dir).select(F.col("title").alias("name")), "name")


@R.add("top_texts_by_source", "WITH c AS (SELECT source, filename, count(*) AS n FROM documents WHERE source IS NOT NULL AND filename IS NOT NULL GROUP BY source, filename) SELECT source, rank, filename, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, filename) AS rank FROM c) WHERE rank <= 3")
def top_texts_by_source(spark, sf_dir):
    c = table(spark, sf_dir, "documents").where("source IS NOT NULL AND filename IS NOT NULL").groupBy("source", "filename").agg(F.count(F.lit(1)).alias("n"))
    return profile.top_per_group(c, "source", 3, F.desc("n"), "filename").select("source", "rank", "filename", "n")
