"""Problem 9: mix sources to target shares of the tokens, by Pareto order sampling.

Every document gets an expected number of copies: in proportion to 1 over the number of documents of its source that
hold exactly the same text, so that copied texts count once, and at most the source's ``max_repeats``. The whole
copies are certain; the rest is an inclusion probability p, and the documents are ranked by u/(1-u) divided by
p/(1-p), u uniform by a hash of id and seed. They are taken in the order of rank.

So that the tokens come out as planned, not only the number of documents, the documents of a source are drawn by size:
in classes of tokens within a factor of two, from the largest class to the smallest, each class to its expected tokens
plus what the class above it left over or overdrew. What the draw is cut at is taken with the probability of the part
that is left, so a document that holds more than its source's whole share still has its inclusion probability; where
the smaller classes cannot make up for such a draw, they are drawn again with the copies that fit what is left of the
plan (``cuts``). What remains is reported as ``gap``; no document is left out because of its size.

Defined cases: documents with null, empty or zero-token texts, with a null source or a source without target are not
used; a target without documents cannot be met and is reported with 0, the others keep their shares relative to one
another; null or repeated target rows: null sources and shares, and shares of 0, are left out, of repeated sources the
first by share counts; documents of equal rank are taken together; no documents or no targets give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.session import materialize

#: Ranks are counted in steps of 1/STEPS of log odds, up to FAR on both sides: at most 2 * FAR * STEPS per class.
STEPS, FAR = 128, 8
#: Share of a source's planned tokens by which it may miss them before its smaller classes are drawn again.
TOLERANCE = 0.002


def size_class(tokens) -> Column:
    """Number of binary digits of the tokens: documents of one class differ by less than a factor of two."""
    return F.length(F.bin(tokens)).cast("int")


def multiplicities(sizes: DataFrame) -> pd.DataFrame:
    """(source, cls, same, documents, tokens): sums over the documents of a size class whose text stands ``same`` times
    in the source. Rows are classes (at most 63) times multiplicities; n documents have at most sqrt(2 n) of these."""
    return sizes.groupBy("source", size_class("tokens").alias("cls"), "same").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")).toPandas()


def plan(counts: pd.DataFrame, targets: DataFrame, total_tokens: int | None = None) -> pd.DataFrame:
    """(source, target_share, max_repeats, documents, available, share, planned) of every target, from multiplicities().

    ``share`` is the target among the sources that have tokens; ``planned`` the source's tokens in the mixture. The
    mixture is as large as it can be with every share met and no document over its repeats, or ``total_tokens`` where
    that is smaller. One row per target.
    """
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    p = t.select("source", "t.target_share", F.greatest(F.coalesce("t.max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats")).orderBy("source").toPandas()
    have = counts.groupby("source")[["documents", "tokens"]].sum().rename(columns={"tokens": "available"})
    p = p.join(have, on="source").fillna({"documents": 0, "available": 0}).astype({"documents": "int64", "available": "int64"})
    p["share"] = np.where(p["available"] > 0, p["target_share"] / p.loc[p["available"] > 0, "target_share"].sum(), 0.0)
    some = p[p["available"] > 0]
    size = float((some["max_repeats"] * some["available"] / some["share"]).min()) if len(some) else 0.0
    p["planned"] = p["share"] * (min(size, total_tokens) if total_tokens else size)
    return p


def expected_copies(rate, same, most):
    """min(most, rate / same), whole where it is within 1e-9 of it."""
    raw = np.minimum(float(most), rate / np.asarray(same, float))
    return np.where(np.abs(raw - np.round(raw)) < 1e-9, np.round(raw), raw)


def copy_rate(counts: pd.DataFrame, most: int, planned: float) -> float:
    """The rate with which documents expected min(most, rate / same) times fill ``planned`` tokens; ``counts`` (same,
    tokens). Texts with fewer copies reach ``most`` first."""
    g = counts.groupby("same")["tokens"].sum().sort_index()
    same, t = g.index.to_numpy(float), g.to_numpy(float)
    if not len(t) or planned <= 0:
        return 0.0
    full = np.r_[0.0, np.cumsum(t)[:-1]] * most
    rest = np.cumsum((t / same)[::-1])[::-1]
    rate = (planned - full) / rest
    fits = np.flatnonzero(rate <= most * same * (1 + 1e-12))
    return float(rate[fits[0]]) if len(fits) else float(most * same[-1])


def _ranked(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """docs of the sources and classes of ``rates`` (source, cls, most, rate) with their certain copies ``sure``, inclusion
    probability ``p`` and step of the Pareto rank ``step``."""
    d = docs.withColumn("cls", size_class("tokens")).join(F.broadcast(rates), ["source", "cls"])  # one row per target and class
    raw = F.least(F.col("most").cast("double"), F.col("rate") / F.col("same"))
    d = d.withColumn("expected", F.when(F.abs(raw - F.round(raw)) < 1e-9, F.round(raw)).otherwise(raw)).withColumn("sure", F.floor("expected").cast("int"))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    p = F.col("p")
    rank = F.ln(u) - F.ln(1 - u) - F.ln(p) + F.ln(1 - p)
    step = F.greatest(F.least(F.floor(rank * STEPS), F.lit(FAR * STEPS - 1)), F.lit(-FAR * STEPS)).cast("int")
    return d.withColumn("p", F.col("expected") - F.col("sure")).withColumn("step", F.when(p > 0, step))


def _uniform(*key) -> float:
    import zlib

    return (zlib.crc32("|".join(map(str, key)).encode()) + 0.5) / 2**32


def draw_classes(f: pd.DataFrame, seed: int) -> list[tuple[int, int, float]]:
    """(class, last step taken, tokens taken) of one source, from its (cls, step, tokens, wanted): ``wanted`` the expected
    tokens of the step's documents. From the largest class down; the step at the cut is taken with the probability of
    its part, and what is over or short goes to the next class."""
    out, carry = [], 0.0
    for cls in sorted(f["cls"].unique(), reverse=True):
        g = f[f["cls"] == cls].sort_values("step")
        want = float(g["wanted"].sum()) + carry
        ends = g["tokens"].to_numpy(float).cumsum()
        k = int(np.searchsorted(ends, want + 1e-9, "right"))  # so many steps fit whole
        got = ends[k - 1] if k else 0.0
        if k < len(ends) and (want - got) / (ends[k] - got) > _uniform(seed, f["source"].iloc[0], cls):
            got, k = ends[k], k + 1
        out.append((int(cls), int(g["step"].iloc[k - 1]) if k else -FAR * STEPS - 1, got))
        carry = want - got
    return out


def _taken(own: pd.DataFrame, cls: int, copies: np.ndarray, drawn: dict, source: str) -> float:
    """Tokens of a class: its certain copies and what was drawn."""
    k = (own["cls"] == cls).to_numpy()
    return float((np.floor(copies[k]) * own["tokens"][k]).sum()) + drawn.get((source, cls), (0, 0.0))[1]


def cuts(docs: DataFrame, counts: pd.DataFrame, planned: pd.DataFrame, seed: int = 20) -> pd.DataFrame:
    """(source, cls, most, rate, last) of every target and class with documents: the rate of expected copies and the last
    step of rank that is taken.

    All classes are drawn at once with one rate per source. Where a source's tokens then miss the plan by more than
    TOLERANCE, its draw is kept down to the first class that strays by so much, and the smaller classes are drawn again
    with the rate that fits what is left; so every round settles a class at least of each source it repeats.
    """
    todo = {r.source: (int(r.max_repeats), r.planned, sorted(counts.loc[counts["source"] == r.source, "cls"].unique(), reverse=True)) for r in planned.itertuples() if r.available > 0}
    left, done = {s: p for s, (_, p, _) in todo.items()}, {}
    spark = docs.sparkSession

    def draw(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in draw_classes(f, seed)], columns=["source", "cls", "last", "got"])

    while todo:
        rates = {}
        for s, (most, _, classes) in todo.items():
            own = counts[(counts["source"] == s) & counts["cls"].isin(classes)]
            rates[s] = copy_rate(own, most, left[s])
        table = spark.createDataFrame([(s, int(c), most, rates[s]) for s, (most, _, classes) in todo.items() for c in classes], "source string, cls int, most int, rate double")
        d = _ranked(docs, table, seed)
        sums = d.where("p > 0").groupBy("source", "cls", "step").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("p") * F.col("tokens")).alias("wanted"))
        drawn = {(r.source, r.cls): (r.last, r.got) for r in sums.groupBy("source").applyInPandas(draw, "source string, cls int, last int, got double").collect()}  # one row per target and class
        again = {}
        for s, (most, p, classes) in todo.items():
            own = counts[counts["source"] == s]
            copies = expected_copies(rates[s], own["same"], most)
            missed = abs(left[s] - sum(_taken(own, c, copies, drawn, s) for c in classes)) > TOLERANCE * p
            stray, kept, remain = 0.0, [], left[s]
            for c in classes:
                k = (own["cls"] == c).to_numpy()
                want = float((copies[k] * own["tokens"][k]).sum())
                got = _taken(own, c, copies, drawn, s)
                stray += want - got
                remain -= got
                kept.append((c, drawn.get((s, c), (-FAR * STEPS - 1, 0.0))[0]))
                if missed and abs(stray) > TOLERANCE * p:
                    break
            rest = classes[len(kept) :]
            # kept as drawn: all classes, or those down to the first that strays
            for c, last in kept:
                done[(s, c)] = (most, rates[s], last)
            if rest:
                again[s], left[s] = (most, p, rest), remain
        todo = again
    return pd.DataFrame([(*k, *v) for k, v in done.items()], columns=["source", "cls", "most", "rate", "last"])


def pareto_sample(docs: DataFrame, cut: pd.DataFrame, seed: int = 20) -> DataFrame:
    """(doc_id, source, tokens, copies) from docs (doc_id, source, tokens, same) and cuts()."""
    table = docs.sparkSession.createDataFrame([tuple(r) for r in cut.itertuples(index=False)], "source string, cls int, most int, rate double, last int")
    taken = _ranked(docs, table, seed).withColumn("copies", F.col("sure") + F.coalesce((F.col("step") <= F.col("last")).cast("int"), F.lit(0)))
    return taken.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def sized(docs: DataFrame, doc_id: str, source: str, text: str, **tokenizer) -> DataFrame:
    """(doc_id, source, tokens, same): tokens of every document with a source, and the number of documents of the
    source that hold the same text (by 128-bit digest)."""
    from annalist.llm.tokenize import token_counts

    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    d = d.where("source IS NOT NULL AND text <> ''").withColumn("h", F.unhex(F.md5(F.col("text"))))
    keyed = materialize(token_counts(d, "doc_id", "text", keep=["source", "h"], **tokenizer), "sized")
    same = keyed.groupBy("source", "h").agg(F.count(F.lit(1)).alias("same"))
    return materialize(keyed.join(same, ["source", "h"]).select("doc_id", "source", "tokens", "same"), "sizes")


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 20) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents in the mixture, each once with its number of copies."""
    counts = multiplicities(sizes)
    return pareto_sample(sizes, cuts(sizes, counts, plan(counts, targets, total_tokens), seed), seed)


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """The shares reached: (source, target_share, max_repeats, documents, available, planned, used_documents,
    most_copies, tokens, gap, actual_share) of every target; ``gap`` is the tokens above or below the plan.
    """
    planned = plan(multiplicities(sizes), targets, total_tokens).drop(columns="share")
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens")).toPandas()
    p = planned.merge(got, "left", "source").fillna({"used_documents": 0, "most_copies": 0, "tokens": 0})  # one row per target
    p["gap"], p["actual_share"] = p["tokens"] - p["planned"], p["tokens"] / max(p["tokens"].sum(), 1)
    schema = "source string, target_share double, max_repeats int, documents long, available long, planned double, used_documents long, most_copies int, tokens long, gap double, actual_share double"
    return sizes.sparkSession.createDataFrame([(r[0], float(r[1]), int(r[2]), int(r[3]), int(r[4]), float(r[5]), int(r[6]), int(r[7]), int(r[8]), float(r[9]), float(r[10])) for r in p.itertuples(index=False)], schema)
