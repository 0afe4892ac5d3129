"""Corpus, chunks, order and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.text import snippet, tokens, words
from annalist.operators import chunking, labels, order
from annalist.plans.registry import Registry, table

R = Registry()

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def split_sql(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '{SPACE}'), lambda w: w <> '')"


_UNITS = f"""seg AS (SELECT filename, segment, {split_sql("sentence")} AS w, greatest(coalesce(from_word, 1), 1) AS from_word,
    regexp_replace(filename, '\\.jsonl?$', '') AS stem, location FROM corpus_segments WHERE sentence IS NOT NULL),
  seg2 AS (SELECT filename, segment, w, len(w) AS n, from_word, CASE WHEN starts_with(location, replace(stem, '-', '_') || '_') THEN substr(location, length(stem) + 2) ELSE location END AS ref
    FROM seg WHERE len(w) > 0),
  unit AS (SELECT filename, segment, w, n, from_word,
    last_value(CASE WHEN rn = 1 OR from_word <= 1 THEN ref END IGNORE NULLS) OVER (PARTITION BY filename ORDER BY segment ROWS UNBOUNDED PRECEDING) AS unit,
    coalesce(sum(n) OVER (PARTITION BY filename ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY segment) AS rn FROM seg2))"""
_WORDS = f"""{_UNITS}, word AS (SELECT filename, segment, unit, from_word + k - 1 AS unit_word, k AS segment_word, CAST(start + k - 1 AS BIGINT) AS p, w[k] AS word,
    CAST((start + k - 1) // 50 + 1 AS INT) AS chunk_number FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM unit))"""


@R.add("chunk_words", f"WITH {_WORDS} SELECT filename, chunk_number, p, word, segment, segment_word, unit, unit_word FROM word")
def chunk_words(spark, sf_dir):
    return chunking.chunk_words(table(spark, sf_dir, "corpus_segments"), 50)


@R.add(
    "chunk_provenance_spans",
    f"""WITH {_WORDS}, q AS (SELECT *, row_number() OVER c AS q, CASE WHEN lag(unit) OVER c IS DISTINCT FROM unit THEN 1 ELSE 0 END AS new FROM word WINDOW c AS (PARTITION BY filename, chunk_number ORDER BY p)),
      i AS (SELECT *, sum(new) OVER (PARTITION BY filename, chunk_number ORDER BY p) AS island FROM q),
      s AS (SELECT filename, chunk_number, island, min(q) AS lo, min(q) || '–' || max(q) || ': ' || first(unit) || ' [' || min_by(unit_word, q) || '–' || max_by(unit_word, q) || ']' AS span FROM i GROUP BY ALL)
      SELECT c.filename, c.chunk_number, chunk, ref_spans, start_segment, start_segment_word, end_segment, end_segment_word, start_unit, start_unit_word, end_unit, end_unit_word FROM
      (SELECT filename, chunk_number, string_agg(word, ' ' ORDER BY p) AS chunk, min_by(segment, p) AS start_segment, min_by(segment_word, p) AS start_segment_word, max_by(segment, p) AS end_segment,
         max_by(segment_word, p) AS end_segment_word, min_by(unit, p) AS start_unit, min_by(unit_word, p) AS start_unit_word, max_by(unit, p) AS end_unit, max_by(unit_word, p) AS end_unit_word FROM word GROUP BY ALL) c
      JOIN (SELECT filename, chunk_number, string_agg(span, ' | ' ORDER BY lo) AS ref_spans FROM s GROUP BY ALL) USING (filename, chunk_number)""",
)
def chunk_provenance_spans(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "corpus_segments"), 50)


@R.add(
    "asof_unit_lookup",
    f"""WITH {_UNITS}, lk AS (SELECT filename, unnest([0, 49, 137, 1000]) AS p FROM corpus_catalog)
      SELECT l.filename, CAST(l.p AS BIGINT) AS p, u.segment, u.unit FROM lk l ASOF LEFT JOIN unit u ON l.filename = u.filename AND l.p >= u.start""",
)
def asof_unit_lookup(spark, sf_dir):
    places = table(spark, sf_dir, "corpus_catalog").select("filename", F.explode(F.array(*[F.lit(p) for p in (0, 49, 137, 1000)])).alias("p"))
    return chunking.unit_at(table(spark, sf_dir, "corpus_segments"), places)


#: The prepared chunk frame: clusters that are numbers, in chronological order.
FRAME_SQL = """frame AS (SELECT row_id, filename, coalesce(chunk, '') AS chunk, chunk_number, scluster, vec, CAST(row_number() OVER (ORDER BY hierarchy_list NULLS LAST, filename NULLS LAST, chunk_number NULLS LAST, row_id) - 1 AS BIGINT) AS idx
  FROM rabani_unsmoothed_table WHERE scluster IS NOT NULL)"""


def frame(spark, sf_dir, *extra):
    t = labels.numeric_clusters(table(spark, sf_dir, "rabani_unsmoothed_table").select("row_id", "filename", "hierarchy_list", "chunk_number", "scluster", *extra))
    if "chunk" in extra:
        t = t.withColumn("chunk", F.coalesce("chunk", F.lit("")))
    return order.global_index(t, "hierarchy_list", "filename", "chunk_number", "row_id").drop("hierarchy_list")


@R.add("chronological_index", f"WITH {FRAME_SQL} SELECT row_id, filename, chunk_number, scluster, idx FROM frame")
def chronological_index(spark, sf_dir):
    return frame(spark, sf_dir)


@R.add(
    "chunk_number_synthesis",
    "SELECT row_id, row_number() OVER (PARTITION BY filename ORDER BY chronological_index, row_id) AS chunk_number FROM rabani_unsmoothed_table WHERE filename IS NOT NULL",
)
def chunk_number_synthesis(spark, sf_dir):
    t = table(spark, sf_dir, "rabani_unsmoothed_table").where("filename IS NOT NULL").select("row_id", "filename", "chronological_index")
    return order.running_total(order.global_index(t, "chronological_index", "row_id"), ["filename"], "idx", F.lit(1), "before").select("row_id", (F.col("before") + 1).alias("chunk_number"))


_LABEL = """CASE WHEN filename LIKE '%.jsonl' THEN array_to_string(list_slice(list_filter(string_split(replace(regexp_replace(filename, '\\.jsonl$', ''), '_', ' '), '-'), lambda x, i: NOT (x LIKE '%Sefaria' AND i = len(string_split(filename, '-')))), 1, 2), '-')
  ELSE array_to_string(list_slice(string_split(regexp_replace(filename, '-?\\.json$', ''), '-'), 1, 2), '-') END"""


@R.add(
    "grouping_labels",
    f"SELECT filename, {_LABEL} AS label FROM (SELECT filename FROM corpus_catalog UNION ALL SELECT old_filename FROM old_catalog)",
)
def grouping_labels(spark, sf_dir):
    files = table(spark, sf_dir, "corpus_catalog").select("filename").unionByName(table(spark, sf_dir, "old_catalog").select(F.col("old_filename").alias("filename")))
    return files.select("filename", labels.grouping_label("filename", 2).alias("label"))


_GROUPED = f"{FRAME_SQL}, g AS (SELECT *, {_LABEL} AS label FROM frame WHERE filename IS NOT NULL)"
_MERGED = f"""{_GROUPED}, sp AS (SELECT label, max(idx) - min(idx) AS span FROM g GROUP BY label), tot AS (SELECT max(idx) - min(idx) AS total FROM g)"""


@R.add(
    "merge_small_groups",
    f"WITH {_MERGED} SELECT row_id, CASE WHEN span < total * 0.025 THEN string_split(label, '-')[1] ELSE label END AS label FROM g JOIN sp USING (label), tot",
)
def merge_small_groups(spark, sf_dir):
    f = frame(spark, sf_dir).where("filename IS NOT NULL").withColumn("label", labels.grouping_label("filename", 2))
    return labels.merge_small_groups(f, "label", "idx").select("row_id", "label")


@R.add(
    "text_boundaries",
    f"""WITH {_GROUPED}, b AS (SELECT label, min(idx) AS lo, max(idx) AS hi FROM g GROUP BY label), t AS (SELECT max(idx) - min(idx) AS total FROM g)
      SELECT label, lo, hi, CAST((row_number() OVER (ORDER BY lo, label) - 1) % 2 AS INT) AS shade, CASE WHEN hi - lo >= 0.025 * total THEN CASE WHEN length(label) > 30 THEN left(label, 27) || '...' ELSE label END END AS shown FROM b, t""",
)
def text_boundaries(spark, sf_dir):
    f = frame(spark, sf_dir).where("filename IS NOT NULL").withColumn("label", labels.grouping_label("filename", 2))
    return labels.boundaries(f, "label", "idx")


@R.add("snippet_projection", "SELECT row_id, left(chunk, 120) AS text_start FROM rabani_unsmoothed_table")
def snippet_projection(spark, sf_dir):
    return table(spark, sf_dir, "rabani_unsmoothed_table").select("row_id", snippet("chunk", 120).alias("text_start"))


@R.add(
    "script_filter",
    f"""SELECT doc_id, len(w) AS words FROM (SELECT doc_id, {split_sql("text")} AS w FROM documents WHERE text IS NOT NULL)
      WHERE len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '[א-ת]'))) * 2 >= len(w)""",
)
def script_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"))
    return d.where("size(w) > 0 AND size(filter(w, x -> x rlike '[א-ת]')) * 2 >= size(w)").select("doc_id", F.size("w").alias("words"))


@R.add(
    "training_corpus_counts",
    f"""SELECT source, count(*) AS rows_kept, CAST(sum(len({split_sql("text")})) AS BIGINT) AS words_kept FROM documents
      WHERE text IS NOT NULL AND len({split_sql("text")}) > 0 AND len(list_filter({split_sql("text")}, lambda x: regexp_matches(x, '[א-ת]'))) * 2 >= len({split_sql("text")}) GROUP BY source""",
)
def training_corpus_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", words("text").alias("w"))
    d = d.where("size(w) > 0 AND size(filter(w, x -> x rlike '[א-ת]')) * 2 >= size(w)")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("rows_kept"), F.sum(F.size("w")).alias("words_kept"))


@R.add(
    "free_text_search",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'printer') AND contains(lower(text), 'homily')",
)
def free_text_search(spark, sf_dir):
    return labels.search(table(spark, sf_dir, "documents"), "text", "printer homily").select("doc_id")


@R.add(
    "word_tokens",
    "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n_tokens FROM documents WHERE text IS NOT NULL",
)
def word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(tokens("text")).cast("long").alias("n_tokens"))


@R.add(
    "corpus_scan_aggregates",
    f"""SELECT filename, count(*) AS segments, CAST(sum(coalesce(nullif(text_length, 0), len({split_sql("coalesce(sentence, '')")}))) AS BIGINT) AS words, min_by(location, segment) AS first_ref, max_by(location, segment) AS last_ref
      FROM corpus_segments GROUP BY filename""",
)
def corpus_scan_aggregates(spark, sf_dir):
    t = table(spark, sf_dir, "corpus_segments")
    n = F.coalesce(F.nullif("text_length", F.lit(0)), F.size(words(F.coalesce("sentence", F.lit("")))))
    return t.groupBy("filename").agg(F.count(F.lit(1)).alias("segments"), F.sum(n).alias("words"), F.min_by("location", "segment").alias("first_ref"), F.max_by("location", "segment").alias("last_ref"))


@R.add(
    "unit_run_boundaries",
    f"""WITH {_UNITS} SELECT filename, segment, unit, CAST(start AS BIGINT) AS start FROM (SELECT *, lag(unit) OVER (PARTITION BY filename ORDER BY segment) AS before FROM unit) WHERE before IS DISTINCT FROM unit""",
)
def unit_run_boundaries(spark, sf_dir):
    u = order.running_total(chunking.unit_starts(table(spark, sf_dir, "corpus_segments")), ["filename"], "segment", F.col("n").cast("long"), "start")
    return u.where("new").select("filename", "segment", "unit", "start")
