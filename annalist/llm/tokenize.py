"""Problem 8: token ids of a whole corpus under a public tokenizer, by a table of distinct words.

Text is split into words by the tokenizer's own pattern in Spark. Documents are gathered in parcels, in which words
are numbers; every distinct word of the corpus is encoded once, and the ids are joined back to the parcels and put in
the order of the words' places. Only numbers of words and each parcel's own words are shuffled, not every word of every
document. Decoding joins ids with a table of their pieces.

Defined ids: a null text and an empty text both give the empty list of ids. Texts of any length are encoded whole.
Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.session import materialize

#: Where the vocabulary files lie; never copied into the repository.
TOKENIZERS = os.environ.get("ANNALIST_TOKENIZERS", "/opt/tokenizers")

# White space as the vocabulary's splitting pattern understands it, and the pattern itself.
_S = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: A parcel of documents shares one list of its words; it closes at so many documents or words.
PARCEL_DOCS, PARCEL_WORDS = 2_000, 1_000_000


def _width(words: int):
    """Type of the numbers of a parcel's words."""
    return np.uint16 if words <= 1 << 16 else np.uint32


def split_words(df: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """Parcels of documents, as two kinds of rows of one table.

    Documents: (parcel, key, k0..., codes), ``codes`` the numbers of the document's words in their order, null and empty
    texts with none. Words: (parcel, code, word), one row for each distinct word of a parcel, so that a word that stands
    in every document makes one row a parcel.
    """
    keep = keep or []
    names = [f"k{i}" for i in range(len(keep))]
    w = df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD_PATTERN), F.lit(0)).alias("w"))
    kinds = [w.schema[c] for c in ("key", *names)]
    schema = T.StructType([T.StructField("parcel", T.LongType()), *kinds, T.StructField("codes", T.BinaryType()), T.StructField("code", T.IntegerType()), T.StructField("word", T.StringType())])

    def cut(sizes: np.ndarray):
        """(from, to) of the parcels of a batch."""
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            used = ends[at - 1] if at else 0
            z = max(at + 1, min(at + PARCEL_DOCS, int(np.searchsorted(ends, used + PARCEL_WORDS, "right"))))
            yield at, min(z, len(sizes))
            at = z

    def run(batches):
        from pyspark import TaskContext

        parcel = TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column("w")), 0).to_numpy(zero_copy_only=False)
            for x, z in cut(sizes):
                part = b.slice(x, z - x)
                coded = pc.list_flatten(part.column("w")).dictionary_encode()
                n, kind = len(coded.dictionary), _width(len(coded.dictionary))
                off = np.r_[0, np.cumsum(sizes[x:z])] * np.dtype(kind).itemsize
                data = coded.indices.to_numpy().astype(kind).tobytes()
                codes = pa.Array.from_buffers(pa.binary(), z - x, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(parcel, pa.int64()), z - x), *[part.column(c) for c in ("key", *names)], codes, pa.nulls(z - x, pa.int32()), pa.nulls(z - x, pa.string())], names=schema.names)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(parcel, pa.int64()), n), *[pa.nulls(n, part.column(c).type) for c in ("key", *names)], pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), coded.dictionary.cast(pa.string())],
                        names=schema.names,
                    )
                parcel += 1

    return w.mapInArrow(run, schema)


def encode_words(words: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(parcel, code, ids) from (parcel, code, word): rows meet by word, and every distinct word is encoded once."""
    path = vocabulary_path(name, folder)

    def run(batches):
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
        last, last_ids = None, None
        for b in batches:  # in the order of words, so equal words are neighbours, across batches too
            coded = b.column("word").dictionary_encode()
            table = []
            for w in coded.dictionary.to_pylist():
                if w != last:
                    last, last_ids = w, enc.encode_ordinary(w)
                table.append(last_ids)
            ids = pa.array(table, pa.list_(pa.int32())).take(coded.indices)
            yield pa.RecordBatch.from_arrays([b.column("parcel"), b.column("code"), ids], names=["parcel", "code", "ids"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "parcel long, code int, ids array<int>")


def _joined(df: DataFrame, key: str, text: str, keep: list[str], name: str, folder: str | None, result: T.StructField, make) -> DataFrame:
    """(key, keep..., result): documents of a parcel with the ids of its words; ``make(codes, offsets, id values, id
    offsets)`` gives the result of all documents of a parcel."""
    parcels = materialize(split_words(df, key, text, keep), "parcels")
    docs = parcels.where("codes IS NOT NULL").drop("code", "word")
    ids = encode_words(parcels.where("word IS NOT NULL").select("parcel", "code", "word"), name, folder)
    names = ["key", *[f"k{i}" for i in range(len(keep))]]
    schema = T.StructType([*[docs.schema[n] for n in names], result])

    def run(d: pa.Table, w: pa.Table) -> pa.Table:
        w = w.take(pc.sort_indices(w.column("code")))
        codes = d.column("codes").combine_chunks() if d.num_rows else pa.array([], pa.binary())
        kind = _width(w.num_rows)
        off = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1] if len(codes) else np.zeros(1, np.int32)
        data = codes.buffers()[2] if len(codes) else None
        at = np.frombuffer(data, kind, (off[-1] - off[0]) // np.dtype(kind).itemsize, off[0]) if data and off[-1] > off[0] else np.zeros(0, kind)
        lists = w.column("ids").combine_chunks() if w.num_rows else pa.array([], pa.list_(pa.int32()))
        out = make(at.astype(np.int64), (off - off[0]).astype(np.int64) // np.dtype(kind).itemsize, lists.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].astype(np.int64))
        return pa.table([*[d.column(n) for n in names], out], names=schema.names)

    found = docs.groupBy("parcel").cogroup(ids.groupBy("parcel")).applyInArrow(run, schema)
    return found.select(F.col("key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], result.name)


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): one row for every row of df.

    Texts are cut into words once and written as numbers; the words of parcels are joined with the ids of distinct
    words and go back to their parcel, where the ids are placed in the order of the words.
    """

    def make(codes, offsets, values, starts):
        n = starts[codes + 1] - starts[codes]
        ends = np.r_[0, np.cumsum(n)]
        ids = values[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _joined(df, key, text, [], name, folder, T.StructField("ids", T.ArrayType(T.IntegerType())), make)


def token_counts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., tokens): number of tokens of every row, 0 for null and empty texts."""

    def make(codes, offsets, values, starts):
        return pa.array(np.r_[0, np.cumsum(starts[codes + 1] - starts[codes])][offsets[1:]] - np.r_[0, np.cumsum(starts[codes + 1] - starts[codes])][offsets[:-1]])

    return _joined(df, key, text, keep or [], name, folder, T.StructField("tokens", T.LongType()), make)


def decode(encoded: DataFrame, key: str, spark, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text): texts of lists of ids, by joining ids with their pieces; an empty list gives an empty text.

    The table of pieces has as many rows as the vocabulary has ids (50,256), which bounds the broadcast to 1 MB.
    """
    ranks = read_ranks(vocabulary_path(name, folder))
    pieces = F.broadcast(spark.createDataFrame([(i, bytearray(p)) for p, i in ranks.items()], "id int, piece binary"))
    e = encoded.select(F.col(f"`{key}`").alias("key"), F.posexplode_outer("ids").alias("place", "id")).join(pieces, "id", "left")
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("piece").alias("h")))), lambda s: s["h"]))
    return e.groupBy("key").agg(F.decode(F.unhex(text), "UTF-8").alias("text")).withColumnRenamed("key", key)
