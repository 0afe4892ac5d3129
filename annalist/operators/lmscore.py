"""The relational part of word-level language-model analytics; the model itself is a function the caller supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import clean_word


def predictions(df: DataFrame, most: int = 50) -> Column:
    """array<struct<word, prob>> from columns pred_k and prob_k, as many as there are, nulls left out."""
    have = [k for k in range(1, most + 1) if f"pred_{k}" in df.columns and f"prob_{k}" in df.columns]
    return F.filter(F.array(*[F.struct(F.col(f"pred_{k}").alias("word"), F.col(f"prob_{k}").alias("prob")) for k in have]), lambda s: s["word"].isNotNull() & s["prob"].isNotNull())


def nucleus(preds: Column, threshold: float = 0.65, least: int = 5, most: int = 50) -> Column:
    """The first predictions until their probability reaches ``threshold`` (at least ``least``, at most ``most``)."""

    def upto(i: Column) -> Column:
        return F.aggregate(F.slice(preds, F.lit(1), i), F.lit(0.0), lambda s, x: s + x["prob"])

    return F.filter(preds, lambda x, i: (i < most) & ((i < least) | (upto(i) < threshold)))


def lemma_groups(long: DataFrame, row: str, lemma: str, word: str, prob: str) -> DataFrame:
    """(row, lemma, word, prob): predictions of one lemma merged, their probabilities added, the most probable form
    kept (ties to the form that comes first by name)."""
    return long.groupBy(row, lemma).agg(F.min_by(word, F.struct((-F.col(prob)).alias("p"), word)).alias("word"), F.sum(prob).alias("prob"))


def passes_filter(surprisal: str = "surprisal_bits", cosine: str = "cos_dist_centroid", position: str = "word_position", word: str = "actual_word", stop: list[str] | None = None) -> Column:
    """Letters left after cleaning, no stop word, past position 3, surprisal in [0, 300], distance in [0, 2]."""
    clean = clean_word(F.coalesce(F.col(word), F.lit("")))
    ok = (clean != "") & (F.col(position) > 3) & F.col(surprisal).between(0, 300) & F.col(cosine).between(0, 2)
    if stop:
        ok = ok & ~clean.isin(stop)
    return F.coalesce(ok, F.lit(False))


def zero_based(tags: DataFrame, position: str = "word_position") -> DataFrame:
    """Tags with positions from 0: positions that start at 1 are shifted, any other start is an error."""
    first = tags.agg(F.min(position)).head()[0]
    if first not in (None, 0, 1):
        raise ValueError(f"positions start at {first}, not at 0 or 1")
    return tags.withColumn(position, F.col(position) - 1) if first == 1 else tags


def join_tags(words: DataFrame, tags: DataFrame) -> DataFrame:
    return words.join(zero_based(tags), ["text_id", "word_position"], "left")


def token_windows(lengths: DataFrame, key: str, n: str, size: int = 512, stride: int = 256) -> DataFrame:
    """(key, start, end, score_from): overlapping windows of a token stream; each scores what the one before did not."""
    starts = F.when(F.col(n) > size, F.sequence(F.lit(0), F.ceil((F.col(n) - size) / stride).cast("long") * stride, F.lit(stride).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    w = lengths.where(F.col(n) > 0).select(key, n, F.explode(starts).alias("start"))
    end = F.least(F.col("start") + size, F.col(n).cast("long"))
    return w.select(key, "start", end.alias("end"), F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(F.col("start") + size - stride).alias("score_from"))


def score_with(df: DataFrame, model, schema: str) -> DataFrame:
    """Run ``model(iterator of pandas frames)`` over df, for language models, lemmatisers and taggers: it is called
    once per partition, so it loads its weights once."""
    return df.mapInPandas(model, schema)
