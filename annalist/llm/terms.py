"""Problems 3 and 5: term frequencies over the whole collection, and how characteristic a term is of a record.

Terms are words between white space, taken as they stand. Every row is a record, repeated rows too. Null text makes
no terms; empty or blank text is a record without terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.session import materialize

#: Terms in at least this share of the rows are hot: at most 1/HOT_SHARE times as many as a row has distinct words in
#: the mean (2,500 for rows of 50 words).
HOT_SHARE = 0.02


def _pairs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted run of one batch: (terms, term code, row of the batch, occurrences) of each (term, row) pair."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    flat, rows = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(flat, "")
    flat, rows = flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    # the external sort's run: pairs in the order of term, then record; equal neighbours are counted
    keys = np.sort(codes * max(len(texts), 1) + rows)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], np.int64)
    counts = np.diff(np.r_[starts, len(keys)])
    return coded.dictionary, keys[starts] // max(len(texts), 1), keys[starts] % max(len(texts), 1), counts


def _runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, occurrences, rows holding it) of one batch, by a run-length scan of its sorted pairs."""
    terms, code, _, count = _pairs(texts)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.array([], np.int64)
    rows = np.diff(np.r_[first, len(code)])
    occurrences = np.add.reduceat(count, first) if len(first) else np.array([], np.int64)
    return terms.take(pa.array(code[first])), occurrences.astype(np.int64), rows.astype(np.int64)


def term_runs(df: DataFrame, column: str) -> DataFrame:
    """(term, occurrences, records) of every Arrow batch of rows: the sorted runs that the merge below combines.

    A record lies in one batch only, so occurrences and records of a term add up over the runs. A hot term has one
    row per batch, not one per occurrence.
    """

    def run(batches):
        for b in batches:
            terms, occurrences, rows = _runs(b.column(0))
            yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(occurrences), pa.array(rows)], names=["term", "occurrences", "records"])

    return df.select(F.col(f"`{column}`").alias("text")).mapInArrow(run, "term string, occurrences long, records long")


def _scan(batches):
    """Run-length scan of rows in the order of term: equal neighbours add up, across batches too."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        terms = b.column(0)
        start = np.flatnonzero(np.r_[True, pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)])
        names = terms.take(pa.array(start)).to_pylist()
        sums = [np.add.reduceat(b.column(i).to_numpy(), start) for i in (1, 2)]
        if held and held[0] == names[0]:
            sums[0][0] += held[1]
            sums[1][0] += held[2]
        elif held:
            names, sums = [held[0], *names], [np.r_[held[i + 1], s] for i, s in enumerate(sums)]
        held = (names[-1], sums[0][-1], sums[1][-1])
        yield pa.RecordBatch.from_arrays([pa.array(names[:-1], pa.string()), pa.array(sums[0][:-1]), pa.array(sums[1][:-1])], names=["term", "occurrences", "records"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], names=["term", "occurrences", "records"])


def term_frequencies(df: DataFrame, column: str, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """(term, occurrences, records, mark) of every term of ``column``.

    External sort: pairs of term and record are sorted within each batch into runs, the runs are range-partitioned
    by term and sorted (Spark spills as needed), and one scan adds up equal neighbours. ``mark`` is ``rare`` for
    terms in fewer than ``rare_below`` records, ``common`` for terms in more than ``common_share`` of the records
    with non-null text (of both, ``rare``), else null. An empty table, or one of null texts only, gives no rows.
    """
    runs = materialize(term_runs(df, column), "term-runs")  # the range partitions are found by a sample of these
    merged = runs.repartitionByRange("term").sortWithinPartitions("term").mapInArrow(_scan, "term string, occurrences long, records long")
    total = df.agg(F.count(F.col(f"`{column}`")).alias("with_text"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") / F.col("with_text") > common_share, "common")
    return merged.join(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))


def record_terms(df: DataFrame, record: str, column: str, least: int = 1) -> DataFrame:
    """One reading of the text, two kinds of rows. ``n`` not null: (record, term, n, size), terms that stand at least
    ``least`` times in a row, with the words of that row. ``n`` null: (term, occurrences, records) of every batch.

    Nothing is shuffled: a row's words are counted where the row is read.
    """
    kind = df.schema[record].dataType
    out = T.StructType([T.StructField("record", kind), T.StructField("term", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n", "size", "occurrences", "records")]])

    def run(batches):
        for b in batches:
            terms, code, row, count = _pairs(b.column(1))
            terms, none = terms.cast(pa.string()), pa.nulls
            sizes = np.bincount(row, weights=count, minlength=b.num_rows).astype(np.int64)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.array([], np.int64)
            k = len(first)
            if k:
                sums = [pa.array(np.add.reduceat(count, first).astype(np.int64)), pa.array(np.diff(np.r_[first, len(code)]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([none(k, b.column(0).type), terms.take(pa.array(code[first])), none(k, pa.int64()), none(k, pa.int64()), *sums], names=out.names)
            keep = count >= least
            code, row, count = code[keep], row[keep], count[keep]
            m = len(code)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), terms.take(pa.array(code)), pa.array(count.astype(np.int64)), pa.array(sizes[row]), none(m, pa.int64()), none(m, pa.int64())], names=out.names
            )

    return df.select(F.col(f"`{record}`").alias("r"), F.col(f"`{column}`").alias("text")).mapInArrow(run, out)


def group_term_runs(df: DataFrame, group: str, column: str) -> DataFrame:
    """(grp, term, n, records) of every batch of rows and non-null group; they add up over the batches."""
    def run(batches):
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            coded = b.column(0).dictionary_encode()
            terms, code, row, count = _pairs(b.column(1))
            grp = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] if len(row) else np.array([], np.int64)
            wide = max(len(coded.dictionary), 1)
            key = code * wide + grp
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], np.int64)
            n = np.add.reduceat(count, first) if len(first) else np.array([], np.int64)
            rows = np.diff(np.r_[first, len(key)])
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(key[first] % wide)), terms.take(pa.array(key[first] // wide)).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(rows.astype(np.int64))],
                names=["grp", "term", "n", "records"],
            )

    out = T.StructType([T.StructField("grp", df.schema[group].dataType), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("records", T.LongType())])
    return df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{column}`").alias("text")).mapInArrow(run, out)


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Signed log-likelihood ratio (Dunning's G2) of a two-by-two table; negative where the term is under-used."""

    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(F.lit(0.0))

    total = k11 + k12 + k21 + k22
    g2 = 2 * (xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22) - xlogx(k11 + k12) - xlogx(k21 + k22) - xlogx(k11 + k21) - xlogx(k12 + k22) + xlogx(total))
    g2 = F.greatest(g2, F.lit(0.0))
    return F.when(k11.cast("double") * (k21 + k22) >= k21.cast("double") * (k11 + k12), g2).otherwise(-g2)


def _score(n: str, occurrences: str, size: str, all_words: str) -> Column:
    n, occurrences, size, all_words = map(F.col, (n, occurrences, size, all_words))
    return log_likelihood(n, occurrences - n, size - n, all_words - occurrences - size + n)


def distinctive_in_records(df: DataFrame, record: str, column: str, least: int = 1) -> DataFrame:
    """(record, term, n, occurrences, records, score): log-likelihood score of each term of each row against the
    rest of the collection.

    The table is n, the term elsewhere, the row's other words, all other words. ``least`` leaves out terms that
    stand fewer times in the row, before anything is shuffled. The totals always count all rows. The text is read once.
    The totals of hot terms are broadcast (1/HOT_SHARE times a row's distinct words bounds their number), so that no
    join has a hot key; the totals of all others meet their rows by term.
    """
    counted = materialize(record_terms(df, record, column, least), "record-terms")
    pairs = counted.where("n IS NOT NULL").select("record", "term", "n", "size")
    totals = counted.where("n IS NULL").groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    totals = materialize(totals, "term-totals")
    rows = df.count()
    size = totals.agg(F.sum("occurrences").alias("all_words"))  # one row
    hot = totals.where(F.col("records") >= max(HOT_SHARE * rows, 2))
    near = pairs.join(F.broadcast(hot), "term")
    far = pairs.join(F.broadcast(hot.select("term")), "term", "left_anti").join(totals.join(F.broadcast(hot.select("term")), "term", "left_anti"), "term")
    j = near.unionByName(far).join(F.broadcast(size))
    return j.select("record", "term", "n", "occurrences", "records", _score("n", "occurrences", "size", "all_words").alias("score"))


def distinctive_in_groups(df: DataFrame, group: str, column: str, least_records: int = 1) -> DataFrame:
    """(grp, term, n, records, all_records, group_records, score): the same score for groups of rows.

    Only rows with a non-null group count, in the group and in the rest alike. ``records`` are the rows of the group
    that hold the term, ``all_records`` those of all groups, ``group_records`` the rows of the group whether or not
    they have text. ``least_records`` leaves out terms in fewer rows of the group, after all are counted.

    The text is read once, into sums per batch, term and group; these are shuffled once, by term. Sizes of groups are
    sums of what is counted.
    """
    runs = group_term_runs(df, group, column).repartition("term")
    per = runs.groupBy("term", "grp").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))
    w = Window.partitionBy("term")  # one row per group that holds the term
    per = materialize(per.select("*", F.sum("n").over(w).alias("occurrences"), F.sum("records").over(w).alias("all_records")), "group-terms")
    sizes = per.groupBy("grp").agg(F.sum("n").alias("size"))
    counts = df.where(F.col(f"`{group}`").isNotNull()).groupBy(F.col(f"`{group}`").alias("grp")).agg(F.count(F.lit(1)).alias("group_records"))
    all_words = sizes.agg(F.sum("size").alias("all_words"))  # one row
    j = per.where(F.col("records") >= least_records).join(sizes.join(counts, "grp"), "grp").join(F.broadcast(all_words))
    return j.select("grp", "term", "n", "records", "all_records", "group_records", _score("n", "occurrences", "size", "all_words").alias("score"))
