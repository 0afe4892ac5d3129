"""Problem 2: per-file results of the chunk table."""

from __future__ import annotations

from annalist.operators import skew
from annalist.plans.registry import Registry, table

R = Registry()

_WORDS = r"len(list_filter(string_split_regex(chunk, '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> ''))"


@R.add(
    "p2_found",
    """SELECT filename FROM rabani_unsmoothed_table WHERE filename IS NOT NULL GROUP BY filename
       HAVING count(*) >= 0.02 * (SELECT count(*) FROM rabani_unsmoothed_table)""",
)
def p2_found(spark, sf_dir):
    return skew.dominant_files(table(spark, sf_dir, "rabani_unsmoothed_table"))


@R.add(
    "p2_file_profile",
    f"""SELECT filename, count(*) AS n_rows, count(chunk) AS n_chunks,
        CAST(sum(coalesce({_WORDS}, 0)) AS BIGINT) AS n_words, CAST(sum(coalesce(length(chunk), 0)) AS BIGINT) AS n_chars,
        min(chronological_index) AS first_index, max(chronological_index) AS last_index,
        count(DISTINCT scluster) AS clusters
        FROM rabani_unsmoothed_table GROUP BY filename""",
)
def p2_file_profile(spark, sf_dir):
    return skew.file_profile(table(spark, sf_dir, "rabani_unsmoothed_table"))
