"""Problem 7: groups of records with similar vectors, by reciprocal-nearest-neighbour average linkage.

The similarity of two groups is the mean cosine over all pairs of their members. For unit vectors that is the dot
product of the groups' mean vectors, so a group is carried as (sum of its unit vectors, size) and the linkage is
exact however large the groups are. In every round all pairs of groups that are each other's best are merged at
once, as long as their similarity reaches the threshold.

The graph is sparse: only records (later, groups) that lie in the same stretch of a random-hyperplane order are
linked. Each pass orders by other hyperplanes and links blocks of bounded size, so work grows in proportion to the
rows, and a region that holds a third of all rows is cut into as many blocks as it needs. The first pass runs where
the rows are read; only groups, about a hundredth of the rows, are shuffled after it. The passes end when all groups
have met in one block, or when PATIENCE passes in a row with new hyperplanes merged fewer than one group in a
thousand. Nothing is joined below the threshold: groups of one or a few rows may be left, with their own size.

The threshold is read off all rows where none is given (``merge_profile``): every block is linked to its end, and of
all merges of groups of some size it is noted whether both sides carry the same prevailing label. The threshold is the
similarity that parts merges within labels from merges across labels with the least mass on the wrong side.

Defined cases: vectors that are null, of another length, all zero or hold nulls, NaN or infinities are in no group;
null labels do not vote; of labels with equal votes the smallest prevails; a group without labels has a null label;
without any labels the threshold is THRESHOLD; repeated rows all count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.session import discard, materialize

#: Threshold where no labels tell one.
THRESHOLD = 0.70
#: Rows or groups that are linked with one another at a time.
BLOCK = 1024
PATIENCE = 3
#: The first pass links single rows before it has seen their neighbours in other blocks, so it merges only what is this
#: far above the threshold; the passes over groups, whose means are certain, go down to the threshold itself.
MARGIN = 0.04
#: Merges of smaller groups say nothing about the threshold: the mean of a few vectors is uncertain.
LEAST = 8
#: Steps of similarity that merges are counted in.
BINS = 400


def average_linkage(sums: np.ndarray, sizes: np.ndarray, threshold: float, seen: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, sizes, member): the merged groups, and for each input group the place of its merged group. Every round's
    merges go to ``seen`` (similarities, places of both sides, places kept)."""
    sums, sizes = sums.astype(np.float64), sizes.astype(np.float64)
    member = np.arange(len(sums))
    while len(sums) > 1:
        mean = (sums / sizes[:, None]).astype(np.float32)
        sim = mean @ mean.T
        sim = (sim + sim.T) / 2  # equal for both sides, else three groups could each prefer the next
        np.fill_diagonal(sim, -2)
        best, i = sim.argmax(1), np.arange(len(sim))
        pair = (best[best] == i) & (i < best) & (sim[i, best] >= threshold)
        if not pair.any():
            break
        a, b = i[pair], best[pair]
        keep = np.ones(len(i), bool)
        keep[b] = False
        if seen:
            seen(sim[a, b], a, b, keep)
        to = i.copy()
        to[b] = a
        sums[a] += sums[b]
        sizes[a] += sizes[b]
        member = (np.cumsum(keep) - 1)[to][member]
        sums, sizes = sums[keep], sizes[keep]
    return sums, sizes, member


def _order(x: np.ndarray, seed: int, bits: int = 32) -> np.ndarray:
    """Place of each vector in the order of its sides of ``bits`` random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bits)).astype(np.float32)
    return ((x.astype(np.float32) @ planes) > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _valid(vec: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of valid vectors, their unit vectors)."""
    right = pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    x = vec.filter(right).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    length = np.sqrt((x * x).sum(1))
    ok = np.isfinite(length) & (length > 0)
    return at[ok], (x[ok] / length[ok, None]).astype(np.float32)


def _stretches(x: np.ndarray, sizes: np.ndarray, seed: int):
    """Places of every stretch of BLOCK neighbours in the hyperplane order."""
    order = np.argsort(_order(x / sizes[:, None], seed), kind="stable")
    for s in range(0, len(order), BLOCK):
        yield order[s : s + BLOCK]


def _merges_by_label(x: np.ndarray, code: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mass of merges per step of similarity, (within a label, across labels): one block linked to its end. ``code`` is
    the rows' label from 0, -1 where it is unknown; a merge weighs as its smaller side."""
    votes, n = np.zeros((len(x), kinds)), np.ones(len(x))
    votes[code >= 0, code[code >= 0]] = 1
    same, other = np.zeros(BINS), np.zeros(BINS)

    def seen(sim, a, b, keep):
        nonlocal votes, n
        least = np.minimum(n[a], n[b])
        ok = (least >= LEAST) & (votes[a].max(1, initial=0) > 0) & (votes[b].max(1, initial=0) > 0)
        at = np.clip(((sim[ok] + 1) / 2 * BINS).astype(int), 0, BINS - 1)
        alike = votes[a[ok]].argmax(1) == votes[b[ok]].argmax(1) if kinds else np.zeros(0, bool)
        np.add.at(same, at[alike], least[ok][alike])
        np.add.at(other, at[~alike], least[ok][~alike])
        votes[a] += votes[b]
        n[a] += n[b]
        votes, n = votes[keep], n[keep]

    average_linkage(x, np.ones(len(x)), -2.0, seen)
    return same, other


def merge_profile(df: DataFrame, vec: str, label: str, dim: int = 64) -> DataFrame:
    """(similarity, same, other): of all rows' merges within blocks, the mass within a label and across labels per step
    of similarity (its lower end). At most BINS rows."""

    def run(batches):
        for b in batches:
            at, x = _valid(b.column("vec"), dim)
            coded = b.column("label").take(pa.array(at)).dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            same, other = np.zeros(BINS), np.zeros(BINS)
            for part in _stretches(x, np.ones(len(x)), 11):
                own, local = np.unique(code[part][code[part] >= 0], return_inverse=True)  # a block's own labels only
                c = np.full(len(part), -1)
                c[code[part] >= 0] = local
                s, o = _merges_by_label(x[part], c, len(own))
                same, other = same + s, other + o
            some = np.flatnonzero(same + other)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(same[some]), pa.array(other[some])], names=["step", "same", "other"])

    src = df.select(F.col(f"`{vec}`").cast("array<float>").alias("vec"), F.col(f"`{label}`").alias("label"))
    steps = src.mapInArrow(run, "step int, same double, other double").groupBy("step").agg(F.sum("same").alias("same"), F.sum("other").alias("other"))
    return steps.select((F.col("step") * (2 / BINS) - 1).alias("similarity"), "same", "other")


def derived_threshold(profile: DataFrame) -> float:
    """The similarity with the least mass of merges across labels above it and within labels below it (of several, the
    middle); THRESHOLD where nothing was merged within labels or nothing across."""
    same, other = np.zeros(BINS), np.zeros(BINS)
    for r in profile.collect():  # at most BINS rows
        k = round((r.similarity + 1) / 2 * BINS)
        same[k], other[k] = r.same, r.other
    if not same.any() or not other.any():
        return THRESHOLD
    wrong = np.r_[0, np.cumsum(same)] + np.r_[np.cumsum(other[::-1])[::-1], 0]
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float((least[0] + least[-1]) / BINS - 1)


_REP = "cid long, total array<float>, n double"


def _first_pass(df: DataFrame, row_id: str, vec: str, label: str, dim: int, threshold: float) -> DataFrame:
    schema = T.StructType(
        [T.StructField("row", df.schema[row_id].dataType), T.StructField("label", df.schema[label].dataType), T.StructField("cid", T.LongType()),
         T.StructField("total", T.ArrayType(T.FloatType())), T.StructField("n", T.DoubleType())]
    )
    rows_of = pa.list_(pa.float32())

    def run(batches):
        for b in batches:
            at, x = _valid(b.column("vec"), dim)
            if not len(at):
                continue
            uid = b.column("uid").to_numpy()[at]
            cid = np.empty(len(at), np.int64)
            reps = []
            for part in _stretches(x, np.ones(len(x)), 11):
                sums, sizes, member = average_linkage(x[part], np.ones(len(part)), threshold + MARGIN)
                first = np.full(len(sums), np.iinfo(np.int64).max)
                np.minimum.at(first, member, uid[part])
                cid[part] = first[member]
                reps.append((first, sums, sizes))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(take), b.column("label").take(take), pa.array(cid), pa.nulls(len(at), rows_of), pa.nulls(len(at), pa.float64())], names=schema.names
            )
            first, sums, sizes = (np.concatenate(c) for c in zip(*reps, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(first), b.column("row").type), pa.nulls(len(first), b.column("label").type), pa.array(first), pa.array(list(sums.astype(np.float32)), rows_of), pa.array(sizes)],
                names=schema.names,
            )

    src = df.select(F.col(f"`{row_id}`").alias("row"), F.col(f"`{label}`").alias("label"), F.col(f"`{vec}`").cast("array<float>").alias("vec"), F.monotonically_increasing_id().alias("uid"))
    return src.mapInArrow(run, schema)


def _next_pass(reps: DataFrame, threshold: float, seed: int, count: int) -> DataFrame:
    """(old, cid, total, n): every old group with its new one; total and n stand on one row of each new group. Groups
    are range-partitioned by a new hyperplane order; every partition is read in its order, BLOCK groups at a time."""
    rows_of = pa.list_(pa.float32())
    block = BLOCK

    def place(batches):
        for b in batches:
            x = b.column("total").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_order(x, seed))], names=[*b.schema.names, "side"])

    def link(t: pa.Table) -> pa.RecordBatch:
        cid, sizes = t.column("cid").to_numpy(), t.column("n").to_numpy()
        x = t.column("total").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cid), -1)
        sums, n, member = average_linkage(x, sizes, threshold)
        first = np.full(len(sums), np.iinfo(np.int64).max)
        np.minimum.at(first, member, cid)
        new = first[member]
        lead = new == cid
        totals = [s if o else None for s, o in zip(sums.astype(np.float32)[member], lead, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(new), pa.array(totals, rows_of), pa.array(np.where(lead, n[member], np.nan), mask=~lead)], names=["old", "cid", "total", "n"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= block:
                yield link(held.slice(0, block))
                held = held.slice(block)
        if held is not None and len(held):
            yield link(held)

    parts = max(1, count // (8 * block))
    near = reps.mapInArrow(place, _REP + ", side long").repartitionByRange(parts, "side", "cid").sortWithinPartitions("side", "cid").select("cid", "total", "n")
    return near.mapInArrow(run, "old long, cid long, total array<float>, n double")


def cluster_rows(df: DataFrame, row_id: str, vec: str, label: str, dim: int = 64, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (row, label, group, n, prevailing); groups (group, n, total, prevailing), n the number of rows,
    total the sum of their unit vectors, prevailing the most frequent non-null label of the group.
    """
    if threshold is None:
        threshold = derived_threshold(merge_profile(df, vec, label, dim))
    first = materialize(_first_pass(df, row_id, vec, label, dim, threshold), "linkage-rows")
    rows = first.where("n IS NULL").select("row", "label", "cid")
    reps, step = first.where("n IS NOT NULL").select("cid", "total", "n"), None
    mapping = materialize(reps.select(F.col("cid").alias("old"), "cid"), "linkage-map")
    count, idle, k = reps.count(), 0, 0
    while idle < PATIENCE:
        k += 1
        before, past, last = count, step, mapping
        step = materialize(_next_pass(reps, threshold, 11 + k, count), "linkage-pass")
        mapping = materialize(last.select("old", F.col("cid").alias("mid")).join(step.select(F.col("old").alias("mid"), "cid"), "mid").select("old", "cid"), "linkage-map")
        reps = step.where("n IS NOT NULL").select("cid", "total", "n")
        count = reps.count()
        for done in (past, last):
            if done is not None:
                discard(done)
        if before <= BLOCK:  # all have met in one block: nothing is left to merge
            break
        idle = idle + 1 if before - count < before / 1000 else 0
    votes = rows.groupBy("cid", "label").agg(F.count(F.lit(1)).alias("k"))
    own = mapping.select(F.col("old").alias("cid"), F.col("cid").alias("group"))
    votes = votes.join(own, "cid").groupBy("group", "label").agg(F.sum("k").alias("k"))
    won = votes.groupBy("group").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("k", (-F.col("label")).alias("least")))).alias("prevailing"))
    groups = reps.select(F.col("cid").alias("group"), F.col("n").cast("long").alias("n"), "total").join(won, "group", "left")
    # the label travels by first-pass groups of at most BLOCK rows, so the join of the rows has no hot key
    named = materialize(own.join(groups.drop("total"), "group"), "linkage-names")
    return rows.join(named, "cid").select("row", "label", "group", "n", "prevailing"), groups


def relabelled(df: DataFrame, row_id: str, vec: str, label: str, **options) -> DataFrame:
    """(row, prevailing) of the rows in a group whose label is null or differs from the one that prevails there."""
    rows, _ = cluster_rows(df, row_id, vec, label, **options)
    return rows.where(F.col("prevailing").isNotNull() & ~F.col("label").eqNullSafe(F.col("prevailing"))).select("row", "prevailing")


def describe_clusters(df: DataFrame, row_id: str, vec: str, label: str, typical: int = 5, dim: int = 64, **options) -> DataFrame:
    """(group, n, prevailing, cohesion, typical): size, label, mean similarity of all pairs, and the ids of the
    ``typical`` rows nearest to the group's mean (nearest first, ties by id).

    The nearest rows are chosen within salted parts of a group first, so that no task sorts a whole group.
    """
    rows, groups = cluster_rows(df, row_id, vec, label, dim=dim, **options)
    g = groups.select("group", "n", "prevailing", "total", F.aggregate("total", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("sq"))
    v = df.select(F.col(f"`{row_id}`").alias("row"), F.col(f"`{vec}`").alias("vec"))
    parts = F.ceil(F.col("n") / 20_000).cast("int")  # a large group's row meets its rows in as many parts as they need
    mine = rows.select("row", "group", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part")).join(v, "row")
    near = mine.join(g.select("group", "total", "sq", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["group", "part"])
    dot = F.aggregate(F.zip_with("vec", "total", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x) * F.col("sq"))
    near = near.select("group", "row", F.round(dot / norm, 9).alias("sim"), F.pmod(F.xxhash64("row"), F.lit(64)).alias("salt"))
    w = Window.partitionBy("group", "salt").orderBy(F.desc("sim"), "row")
    part = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    top = part.groupBy("group").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "row"))), 1, typical), lambda s: s["row"]).alias("typical"))
    cohesion = F.when(F.col("n") > 1, (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))
    return g.join(top, "group", "left").select("group", "n", "prevailing", cohesion.alias("cohesion"), "typical")
