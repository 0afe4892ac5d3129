"""Problem 10: abusive, hateful and sexually explicit text, by multiple-instance learning.

A document is a bag of sentences. Every sentence gets a probability per category from a logistic model over hashed
words and word pairs; the document's score is their noisy-or, 1 - prod(1 - p). Only documents have labels: the model
learns from the documents' labels alone which sentences offend, and the same sentence scores then locate them.

Text is brought into one form first (look-alike characters, case, vowel points), then disguises are undone: letters
spaced or dotted apart are joined, digits and signs standing for letters are read as letters, repeated letters are
squeezed.

Defined cases: null, empty and blank texts have no sentence and score 0 in every category; texts are scored whole,
whatever their length; null labels are left out of the category they are missing in; a category without a positive
label gets a model that scores 0; exact copies get equal scores; a null source is a source of its own.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.unify import unify_text
from annalist.session import materialize

CATEGORIES = ("abusive", "hateful", "sexual")
#: Size of the hashed feature space; also bounds the model that is sent to the executors (3 MB).
BUCKETS = 1 << 18
#: The classifier is fitted on no more labelled documents than this (the first by hash of the id); all are scored.
MAX_LABELLED = 40_000
#: And on no more features of theirs than this (32 MB), whatever the length of the texts.
MAX_FEATURES = 8_000_000
#: Parts of the labelled documents that are held out in turn.
FOLDS = 2

_END = re.compile(r"(?<=[.!?;:׃…])[\"'”’)\]]*\s+|[\r\n\t\x0b\x0c\x85\u2028\u2029]+| {2,}")
_APART = re.compile(r"(?<![\w*])(?:[^\W\d_][ .\-_·]){2,}[^\W\d_](?![\w*])")
_TOKEN = re.compile(r"[\w*$@]+")
_AGAIN = re.compile(r"(.)\1+")
_BETWEEN = re.compile(r"[ .\-_·]")
_PART = "\x00"  # parts the sentences of a text


def _class(category: str, first: int, end: int) -> re.Pattern:
    """Runs of characters of a Unicode category. A class within the first plane is looked up in a table, so the rare
    characters behind it have a pattern of their own."""
    at = [c for c in range(first, end) if unicodedata.category(chr(c)) == category]
    lo = [c for c, d in zip(at, [-2, *at], strict=False) if c != d + 1]
    hi = [c for c, d in zip(at, [*at[1:], -2], strict=True) if d != c + 1]
    return re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(lo, hi, strict=True)) + "]+")


_MARKS, _FAR_MARKS = _class("Mn", 0x300, 0x10000), _class("Mn", 0x10000, 0x110000)

#: Fixed value: signs read as the letters they stand for, in words that hold a letter.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"})


class Bags:
    """Documents as flat arrays: features of all sentences, their sentence, the sentences' document."""

    def __init__(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        """Features of all sentences in a row, number of features of every sentence, of sentences of every document."""
        self.features = features
        self.starts = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        self.doc_starts = np.r_[0, np.cumsum(counts)].astype(np.int64)

    def __len__(self) -> int:
        return len(self.doc_starts) - 1


def split_sentences(text: str | None) -> list[str]:
    """Sentences of a text, in order, none blank."""
    return [s for s in (p.strip() for p in _END.split(text)) if s] if text else []


def _plain(text: str) -> str:
    """One form of a text, without marks, with letters that stand apart joined."""
    s = unify_text(text, fold=True)
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFD", s))
        if max(s, default="") > "\uffff":
            s = _FAR_MARKS.sub("", s)
    return _APART.sub(lambda m: _BETWEEN.sub("", m.group()), s)


@functools.lru_cache(maxsize=200_000)  # words come again and again
def _word(token: str) -> str:
    if not token.isalpha() and any(c.isalpha() for c in token):
        token = token.translate(_SIGNS)
    return _AGAIN.sub(r"\1", token)


@functools.lru_cache(maxsize=200_000)
def _code(token: str) -> int:
    return zlib.crc32(_word(token).encode())


def sentence_words(sentence: str) -> list[str]:
    """The words of a sentence in one form, disguises undone."""
    return [_word(t) for t in _TOKEN.findall(_plain(sentence))]


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def make_bags(texts: list[str | None]) -> tuple[list[list[str]], Bags]:
    """(sentences, bags): hashed words, neighbouring pairs and pairs over one word of every sentence of every text.

    A text is brought into one form as a whole, its sentences parted by NUL characters.
    """
    all_sentences, codes, words, counts = [], [], [], []
    for text in texts:
        sentences = split_sentences(text)
        all_sentences.append(sentences)
        counts.append(len(sentences))
        if sentences:
            for part in _plain(_PART.join(x.replace(_PART, " ") for x in sentences)).split(_PART):
                tokens = _TOKEN.findall(part)
                codes += map(_code, tokens)
                words.append(len(tokens))
    h, words = np.array(codes, np.uint64), np.array(words, np.int64)
    sent = np.repeat(np.arange(len(words)), words)
    mix = lambda x, y, k: (x * np.uint64(0x9E3779B1) + y * np.uint64(0x85EBCA77) + np.uint64(k)) >> np.uint64(7)
    one, two = sent[1:] == sent[:-1], sent[2:] == sent[:-2]
    feature = np.concatenate([h, mix(h[:-1], h[1:], 1)[one], mix(h[:-2], h[2:], 2)[two]]).astype(np.int64) & (BUCKETS - 1)
    pair = _distinct(np.concatenate([sent, sent[1:][one], sent[2:][two]]) * BUCKETS + feature)
    return all_sentences, Bags((pair & (BUCKETS - 1)).astype(np.int32), np.bincount(pair // BUCKETS, minlength=len(words)), np.array(counts, np.int64))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bag_scores(bags: Bags, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of every sentence, noisy-or of every document), a column for each category."""
    p = _sigmoid(_sums(w[bags.features], bags.starts) + bias)
    return p, np.maximum(1 - np.exp(_sums(np.log1p(-np.minimum(p, 1 - 1e-9)), bags.doc_starts)), 0.0)


def _span(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, places) of the stretches ``which`` of a flat array."""
    n = starts[which + 1] - starts[which]
    return n, np.repeat(starts[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def fit_noisy_or(bags: Bags, y: np.ndarray, epochs: int = 15, rate: float = 0.3, penalty: float = 3e-4, least_docs: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of every category (columns of y; NaN: unknown) that maximise the likelihood of the documents'
    labels under noisy-or, by AdaGrad over batches of documents. All categories share the batches. Features in fewer
    than ``least_docs`` documents keep weight 0; a category without a positive label gets scores of 0.
    """
    kinds = y.shape[1]
    full, none = np.zeros((BUCKETS, kinds)), ~(np.where(np.isfinite(y), y, 0) > 0.5).any(0) if len(y) else np.ones(kinds, bool)
    if none.all():
        return full, np.full(kinds, -30.0)
    rng = np.random.default_rng(seed)
    known = rng.permutation(np.flatnonzero(np.isfinite(y).any(1) & (np.diff(bags.doc_starts) > 0)))
    doc_of = np.repeat(np.repeat(np.arange(len(bags)), np.diff(bags.doc_starts)), np.diff(bags.starts))
    held = _distinct(bags.features.astype(np.int64) * len(bags) + doc_of) // len(bags)
    used = np.flatnonzero(np.bincount(held, minlength=BUCKETS) >= least_docs)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    batches = []
    for s in range(0, len(known), 256):
        docs = known[s : s + 256]
        n, sent = _span(bags.doc_starts, docs)
        m, at = _span(bags.starts, sent)
        f = place[bags.features[at]]
        m = np.bincount(np.repeat(np.arange(len(sent)), m)[f >= 0], minlength=len(sent))
        own, f = np.unique(f[f >= 0], return_inverse=True)  # the batch's own features, so a step costs no more than these
        mask = np.isfinite(y[docs])
        batches.append((own, f, m, np.r_[0, np.cumsum(m)], n, np.r_[0, np.cumsum(n)], np.where(mask, y[docs], 0.0), mask))
    w, bias, g2, b2 = np.zeros((len(used), kinds)), np.full(kinds, -5.0), np.full((len(used), kinds), 1e-6), np.full(kinds, 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            own, f, m, starts, n, doc_starts, label, mask = batches[i]
            mine = w[own]
            p = _sigmoid(_sums(mine[f], starts) + bias)
            doc_p = np.clip(1 - np.exp(_sums(np.log1p(-np.minimum(p, 1 - 1e-9)), doc_starts)), 1e-6, 1 - 1e-6)
            grad = p * np.repeat(np.where(mask, (doc_p - label) / doc_p, 0.0), n, axis=0) / len(n)
            flat = np.repeat(grad, m, axis=0)
            gw = np.stack([np.bincount(f, weights=flat[:, c], minlength=len(own)) for c in range(kinds)], 1)
            step = np.where(gw != 0, gw + penalty * mine, 0.0)
            g2[own] += step**2
            w[own] = mine - rate * step / np.sqrt(g2[own])
            gb = grad.sum(0)
            b2 += gb**2
            bias -= 0.1 * gb / np.sqrt(b2)
    full[used] = w
    full[:, none] = 0.0
    return full, np.where(none, -30.0, bias)


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the highest F1; 0.5 where there is no positive label."""
    ok = np.isfinite(y)
    score, y = score[ok], y[ok]
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    if not len(y) or not hit[-1]:
        return 0.5
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + hit[-1])
    k = int(f1.argmax())
    return float((score[order[k]] + (score[order[k + 1]] if k + 1 < len(y) else 0.0)) / 2)


def doubtful(y: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Labels that a model of other documents contradicts strongly."""
    return ((y > 0.5) & (cross < 0.02)) | ((y < 0.5) & (cross > 0.95))


def quality(score: np.ndarray, y: np.ndarray, threshold: float) -> tuple[int, int, int]:
    """(hits, false, missed) of known labels."""
    ok = np.isfinite(y)
    flag, true = score[ok] >= threshold, y[ok] > 0.5
    return int((flag & true).sum()), int((flag & ~true).sum()), int((~flag & true).sum())


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, most: int, most_features: int) -> tuple[Bags, np.ndarray]:
    """Bags and labels of at most ``most`` labelled documents with at most ``most_features`` features together, the first
    by hash of the id. Features are made on the executors; only the chosen documents' come to the driver."""
    lab = labels.select(F.col(doc_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in CATEGORIES]).dropDuplicates(["id"])
    lab = lab.where(" OR ".join(f"{c} IS NOT NULL" for c in CATEGORIES)).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(most)
    joined = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(lab, "id")
    names = ["id", "h", *CATEGORIES]

    def run(batches):
        for b in batches:
            _, bags = make_bags(b.column("text").to_pylist())
            at = bags.starts[bags.doc_starts]
            features = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bags.features))
            lengths = pa.ListArray.from_arrays(pa.array(bags.doc_starts.astype(np.int32)), pa.array(np.diff(bags.starts).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(np.diff(at).astype(np.int64)), features, lengths], names=[*names, "size", "features", "lengths"])

    fields = [*[joined.schema[n] for n in names], T.StructField("size", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("lengths", T.ArrayType(T.IntegerType()))]
    made = materialize(joined.select(*names, "text").mapInArrow(run, T.StructType(fields)), "labelled")
    sizes = made.select("h", "id", "size").toArrow()  # at most ``most`` rows
    sizes = sizes.take(pc.sort_indices(sizes, sort_keys=[("h", "ascending"), ("id", "ascending")]))
    fits = int(np.searchsorted(np.cumsum(sizes.column("size").to_numpy()), most_features, "right"))
    if fits < len(sizes):
        made = made.where(F.col("h") < sizes.column("h")[fits].as_py())
    got = made.toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("h", "ascending"), ("id", "ascending")]))
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy() if len(got) else np.zeros(0, np.int32)
    counts = pc.list_value_length(got.column("lengths")).to_numpy().astype(np.int64) if len(got) else np.zeros(0, np.int64)
    y = np.stack([got.column(c).to_numpy().astype(np.float64) for c in CATEGORIES], axis=1) if len(got) else np.zeros((0, len(CATEGORIES)))
    return Bags(flat("features"), flat("lengths").astype(np.int64), counts), y


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_LABELLED, most_features: int = MAX_FEATURES, folds: int = FOLDS, **options
) -> tuple[list[tuple[np.ndarray, float, float]], list[tuple]]:
    """(model, report). Model: (weights, bias, threshold) of each category.

    Labels may hold mistakes. Each fold of the documents is scored by a model of the other folds; labels that this model
    contradicts strongly are left out of the final fit. The threshold is chosen on the held-out scores of all labels,
    contradicted ones included. All fits run on the executors, folds and categories side by side, on a broadcast of the chosen
    documents' features (bounded by ``most`` and ``most_features``).

    Report: (category, labels, positive, contradicted, threshold, then hits, false and missed of all held-out labels and
    of those not contradicted).
    """
    spark = docs.sparkSession
    bags, y = _labelled(docs, labels, doc_id, text, most, most_features)
    if not len(bags):
        return [(np.zeros(BUCKETS, np.float32), -30.0, 0.5)] * len(CATEGORIES), []
    shared = spark.sparkContext.broadcast((bags.features, np.diff(bags.starts), np.diff(bags.doc_starts), y))
    fold = np.arange(len(bags)) % folds

    kinds = y.shape[1]

    def score(batches):
        features, lengths, counts, y = shared.value
        bags = Bags(features, lengths, counts)
        for b in batches:
            for k, c in (divmod(i, kinds) for i in b.column(0).to_pylist()):
                w, bias = fit_noisy_or(bags, np.where(fold == k, np.nan, y[:, c])[:, None], **options)
                held = np.flatnonzero(fold == k)
                p = bag_scores(bags, w, bias)[1][held, 0]
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), c)), pa.array(p)], names=["place", "c", "p"])

    got = spark.range(0, folds * kinds, 1, folds * kinds).mapInArrow(score, "place long, c long, p double").toArrow()  # a row per labelled document and category
    cross = np.zeros_like(y)
    cross[got.column("place").to_numpy(), got.column("c").to_numpy()] = got.column("p").to_numpy()
    doubt = doubtful(y, cross)

    def last(batches):
        features, lengths, counts, y = shared.value
        bags = Bags(features, lengths, counts)
        for b in batches:
            for c in b.column(0).to_pylist():
                w, bias = fit_noisy_or(bags, np.where(doubt, np.nan, y)[:, c : c + 1], **options)
                at = np.flatnonzero(w[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([bias[0]]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([w[at, 0].astype(np.float32)], pa.list_(pa.float32()))], names=["c", "bias", "at", "w"])

    fitted = {r["c"]: r for r in spark.range(0, kinds, 1, kinds).mapInArrow(last, "c long, bias double, at array<int>, w array<float>").toArrow().to_pylist()}
    model, report = [], []
    for c, name in enumerate(CATEGORIES):
        w = np.zeros(BUCKETS, np.float32)
        w[fitted[c]["at"]] = fitted[c]["w"]
        t = best_threshold(cross[:, c], y[:, c])
        model.append((w, fitted[c]["bias"], t))
        known = np.isfinite(y[:, c])
        sure = np.where(doubt[:, c], np.nan, y[:, c])
        report.append((name, int(known.sum()), int((y[known, c] > 0.5).sum()), int(doubt[:, c].sum()), t, *quality(cross[:, c], y[:, c], t), *quality(cross[:, c], sure, t)))
    shared.unpersist()
    return model, report


REPORT = "category string, labels long, positive long, contradicted long, threshold double, hits long, false long, missed long, sure_hits long, sure_false long, sure_missed long"


def score_documents(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., score_c, flag_c, sentence_c for each category c): the noisy-or score, whether it reaches the
    category's threshold, and the sentence that weighs most, null where the document is not flagged.
    """
    packed = [(np.flatnonzero(w).astype(np.int32), w[np.flatnonzero(w)].astype(np.float32), b, t) for w, b, t in model]
    names = [f"k{i}" for i in range(len(keep))]
    fields = [T.StructField(n, docs.schema[k].dataType) for n, k in zip(names, keep, strict=True)]
    for c in CATEGORIES:
        fields += [T.StructField(f"score_{c}", T.DoubleType()), T.StructField(f"flag_{c}", T.BooleanType()), T.StructField(f"sentence_{c}", T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        weights, bias = np.zeros((BUCKETS, len(packed))), np.array([b for _, _, b, _ in packed])
        for c, (at, v, _, _) in enumerate(packed):
            weights[at, c] = v
        for b in batches:
            coded = b.column("text").dictionary_encode()
            made, bags = make_bags(coded.dictionary.to_pylist())
            at = coded.indices
            out = []
            p_all, doc_all = bag_scores(bags, weights, bias)
            for c, (*_, threshold) in enumerate(packed):
                p, doc = p_all[:, c], doc_all[:, c]
                worst = [
                    s[int(p[a:z].argmax())] if d >= threshold and z > a else None
                    for s, d, a, z in zip(made, doc, bags.doc_starts[:-1], bags.doc_starts[1:], strict=True)
                ]
                out += [pc.fill_null(pa.array(doc, pa.float64()).take(at), 0.0), pc.fill_null(pa.array(doc >= threshold, pa.bool_()).take(at), False), pa.array(worst, pa.string()).take(at)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *out], names=schema.names)

    scored = docs.select(*[F.col(f"`{k}`").alias(n) for n, k in zip(names, keep, strict=True)], F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
    return scored.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], *schema.names[len(keep) :])


def source_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, documents, then per category the flagged documents, their share and the mean score)."""
    aggs = [F.count(F.lit(1)).alias("documents")]
    for c in CATEGORIES:
        aggs += [F.count_if(f"flag_{c}").alias(f"{c}_documents"), F.avg(F.col(f"flag_{c}").cast("double")).alias(f"{c}_rate"), F.avg(f"score_{c}").alias(f"{c}_mean")]
    return scored.groupBy(F.col(f"`{source}`").alias(source)).agg(*aggs)
