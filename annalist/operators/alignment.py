"""Words against a tagger's tokens, trees of titles, and labels for people."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align_tokens(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(text_id, word_position, pos, has_prefix) of words (text_id, word_position, word) from tokens (text_id,
    token_position, token, pos, has_prefix) that split them further.

    Both are laid on one line of letters and digits. A word's tag is that of its first token that is no punctuation;
    words without letters get ``X``. Texts in which a word does not end where a token ends, or whose letters differ,
    are left out whole. A text is short, as tagged texts are. Words and tokens meet in one grouping, not in a join.
    """
    w = F.struct("word_position", "word").alias("w")
    t = F.struct("token_position", "token", "pos", "has_prefix").alias("t")
    both = words.select("text_id", w).unionByName(tokens.select("text_id", t), allowMissingColumns=True).where("text_id IS NOT NULL")
    d = both.groupBy("text_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.array_sort(F.collect_list("t")).alias("tokens"))
    return align_lists(d.select("text_id", F.col("w.word_position").alias("places"), F.col("w.word").alias("words"), "tokens"))


def align_lists(texts: DataFrame) -> DataFrame:
    """align_tokens for texts (text_id, places, words, tokens) whose words, with their places, and tokens (token, pos,
    has_prefix, ...) are lists in their order. Nothing is shuffled; every row is a text of its own."""
    bare = lambda c: F.coalesce(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), F.lit(""))
    d = texts.select("text_id", "places", F.transform("words", bare).alias("ws"), F.transform("tokens", lambda t: bare(t["token"])).alias("ts"), F.col("tokens.pos").alias("pos"), F.col("tokens.has_prefix").alias("prefix"))
    same = F.array_join("ws", "") == F.array_join("ts", "")
    d = d.select("text_id", "places", F.transform("ws", F.length).alias("w"), F.transform("ts", F.length).alias("t"), "pos", "prefix", same.alias("same"))
    place = d.schema["places"].dataType.elementType
    schema = T.StructType([d.schema["text_id"], T.StructField("word_position", place), T.StructField("pos", T.StringType()), T.StructField("has_prefix", T.BooleanType())])

    def run(batches):
        for b in batches:
            b = b.filter(b.column("same"))
            count = lambda c: pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            flat = lambda c: pc.list_flatten(b.column(c))  # noqa: B023, E731
            w, t = flat("w").to_numpy(zero_copy_only=False), flat("t").to_numpy(zero_copy_only=False)
            # words and tokens have the same letters, so the texts of a batch lie on one line
            w_hi, t_hi = np.cumsum(w, dtype=np.int64), np.cumsum(t, dtype=np.int64)
            ends = np.zeros((t_hi[-1] if len(t) else 0) + 1, bool)
            ends[t_hi[t > 0]] = True
            of, left = np.repeat(np.arange(b.num_rows), count("w")), count("t") == 0
            left[of[(w > 0) & ~ends[w_hi]]] = True
            use = np.flatnonzero(~left[of])
            tags = np.flatnonzero((t > 0) & ~pc.fill_null(pc.equal(flat("pos"), "PUNCT"), False).to_numpy(zero_copy_only=False).astype(bool))
            hi, full, lo = w_hi[use], w[use] > 0, np.r_[t_hi[tags] - t[tags], np.iinfo(np.int64).max]
            first = np.searchsorted(lo, hi - w[use])
            at = pa.array(tags[np.minimum(first, max(len(tags) - 1, 0))] if len(tags) else np.zeros(len(use), np.int64), mask=~(full & (lo[first] < hi)))
            pos = pc.if_else(pa.array(full), pc.fill_null(flat("pos").take(at), "PUNCT"), "X")
            yield pa.RecordBatch.from_arrays([b.column("text_id").take(pa.array(of[use])), flat("places").take(pa.array(use)), pos, pc.fill_null(flat("prefix").take(at), False)], names=schema.names)

    return d.mapInArrow(run, schema)


def flatten_titles(tree) -> list[tuple[str, str, list[str]]]:
    """(title, Hebrew title, Hebrew categories above it) of every titled entry of a tree of contents; the first entry
    of a title counts. A table of contents is a small document; it is walked without recursion."""
    out: dict[str, tuple[str, list[str]]] = {}
    todo = [(tree, [])]
    while todo:
        node, above = todo.pop()
        if isinstance(node, list):
            todo.extend((x, above) for x in reversed(node))
        elif isinstance(node, dict):
            category = str(node.get("heCategory") or "").strip()
            here = above if not category or category in above else [*above, category]
            title, hebrew = str(node.get("title") or "").strip(), str(node.get("heTitle") or "").strip()
            if title and hebrew and title not in out:
                out[title] = (hebrew, here)
            todo.extend((node[k], here) for k in ("nodes", "contents") if k in node)
    return [(t, h, c) for t, (h, c) in out.items()]


def duration_label(seconds: str) -> Column:
    """``7.3 s`` below ten seconds, ``42 s`` below a minute, else ``m:ss min``; null for null."""
    s = F.col(seconds).cast("double")
    long = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.floor(s % 60).cast("string"), 2, "0"), F.lit(" min"))
    return F.when(s.isNull(), None).when(s < 10, F.concat(F.round(s, 1).cast("decimal(4,1)").cast("string"), F.lit(" s"))).when(s < 60, F.concat(F.round(s).cast("int").cast("string"), F.lit(" s"))).otherwise(long)
