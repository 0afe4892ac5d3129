"""Problem 1: bring text that looks the same into one form, and find rows that differ only in unseen ways.

The form: default-ignorable characters go, compatibility normalisation in composed form (NFKC), look-alike letters
become the letter they look like, every run of white space becomes one blank, blanks at the ends go; with
``fold=True`` full case folding is applied and the text composed again. Vowel points are visible and stay.

Look-alike letters are those of the scripts that stand in such collections: Cyrillic and Greek letters like Latin ones,
dotless and script Latin letters, Hebrew digraphs, quotation marks, primes, hyphens and the minus sign. Letters of other
scripts (Armenian, Cherokee, Lisu ...) are left as they are, but for their compatibility forms.

Defined cases: null stays null; empty or blank text becomes the empty string; texts of any length are processed
whole; equal inputs always give equal outputs (the form of a form is itself).
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.session import materialize

# Letters of other scripts and signs that look like a letter (Unicode's confusable characters).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "κ": "k", "ϲ": "c", "ϳ": "j", "ı": "i", "ɡ": "g", "ɑ": "a",
    "װ": "וו", "ױ": "וי", "ײ": "יי",
    "״": '"', "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "׳": "'", "‘": "'", "’": "'", "‛": "'", "′": "'", "ʼ": "'", "ʹ": "'",
    "‐": "-", "‑": "-", "−": "-", "‒": "-",
}

# Ranges of Unicode's Default_Ignorable_Code_Point.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

_DROP = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]+")
_ALIKE = re.compile("[" + "".join(LOOKALIKES) + "]")
#: Text of these characters only is in the form already, but for white space and case.
_PLAIN = re.compile(r"[\x00-\x7fא-ת]*")


def _one(text: str) -> str:
    """Compatibility form without ignorable characters and look-alikes."""
    text = unicodedata.normalize("NFKC", _DROP.sub("", text))
    return unicodedata.normalize("NFC", _DROP.sub("", _ALIKE.sub(lambda m: LOOKALIKES[m.group()], text)))


def unify_text(text: str | None, fold: bool = False) -> str | None:
    """The one form of a text; see the module's docstring."""
    if text is None:
        return None
    plain = _PLAIN.fullmatch(text)
    text = " ".join((text if plain else _one(text)).split())
    if fold:
        text = text.casefold()
        if not plain:
            text = " ".join(_one(text).split())
    return text


_remembered = functools.lru_cache(maxsize=200_000)(unify_text)


def _form(text: str | None, fold: bool = False) -> str | None:
    """unify_text, remembered from batch to batch for short texts, which come again and again."""
    return _remembered(text, fold) if text is not None and len(text) <= 40 else unify_text(text, fold)


def unify_values(values: pa.Array, fold: bool = False) -> pa.Array:
    """unify_text over an Arrow array, once per distinct value of it."""
    coded = values.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    forms = pa.array([_form(t, fold) for t in coded.dictionary.to_pylist()], pa.string())
    return forms.take(coded.indices)


def unify(df: DataFrame, column: str, out: str, fold: bool = True) -> DataFrame:
    """df with the column ``out``: the form of ``column``. Replaces a column that is called ``out`` already."""

    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        return pd.Series(unify_values(pa.Array.from_pandas(s, type=pa.string()), fold).to_pylist(), index=s.index, dtype=object)

    return df.withColumn(out, form(F.col(f"`{column}`")))


def digests(df: DataFrame, column: str, row_id: str, scope: str | None = None, fold: bool = False) -> DataFrame:
    """(row, scope, k1, k2, r1, r2): 128-bit digests, as two numbers each, of the form of ``column`` and of the text as it
    stands; rows with null or blank text or a null scope are left out. The texts themselves are not shuffled.
    """
    src = df.select(F.col(f"`{row_id}`").alias("row"), (F.col(f"`{scope}`") if scope else F.lit("")).alias("scope"), F.col(f"`{column}`").alias("text"))
    numbers = ["k1", "k2", "r1", "r2"]
    schema = T.StructType([src.schema["row"], src.schema["scope"], *[T.StructField(n, T.LongType()) for n in numbers]])

    def run(batches):
        def two(texts):
            d = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
            return d[:, 0], d[:, 1]

        for b in batches:
            coded = b.column("text").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            forms = [_form(t, fold) for t in texts]
            blank = pa.array([not f for f in forms], pa.bool_()).take(coded.indices)
            parts = [pa.array(x).take(coded.indices) for x in (*two(forms), *two(texts))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("scope"), *parts], names=schema.names).filter(pc.invert(pc.fill_null(blank, True)))

    return src.where("text IS NOT NULL AND scope IS NOT NULL").mapInArrow(run, schema)


_FORM, _RAW = ["scope", "k1", "k2"], ["r1", "r2"]


def _mixed(df: DataFrame) -> DataFrame:
    """Forms that are written in more than one way. Both sides of every comparison are combined before a shuffle."""
    ends = [g(c).alias(f"{n}_{c}") for c in _RAW for n, g in (("lo", F.min), ("hi", F.max))]
    return df.groupBy(*_FORM).agg(*ends).where("lo_r1 <> hi_r1 OR lo_r2 <> hi_r2").select(*_FORM)


def lookalike_pairs(df: DataFrame, column: str, row_id: str, scope: str | None = None, salts: int = 32) -> DataFrame:
    """Pairs (row_a, row_b), row_a < row_b, of rows whose texts have one form but different characters.

    With ``scope`` only rows of one scope are paired (a null scope pairs with nothing). Forms that all rows write
    alike leave before any join. Rows of one way of writing are gathered in up to ``salts`` units; units of different
    ways are paired, and only these pairs are expanded into rows, so no step makes more rows than the result has, and
    the rows of a hot form are spread over its units. Null and blank texts are no case; an empty table gives no pairs.
    """
    d = digests(df, column, row_id, scope).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    some = materialize(d.join(_mixed(d), _FORM, "left_semi"), "lookalikes")
    units = some.select(*_FORM, *_RAW, "salt").distinct()
    a, b = (units.select(*_FORM, *[F.col(c).alias(f"{c}_{side}") for c in (*_RAW, "salt")]) for side in "ab")
    pairs = a.join(b, _FORM).where("r1_a < r1_b OR (r1_a = r1_b AND r2_a < r2_b)")
    for side in "ab":
        rows = some.select(*_FORM, *[F.col(c).alias(f"{c}_{side}") for c in (*_RAW, "salt")], F.col("row").alias(side))
        pairs = pairs.join(rows, [*_FORM, *[f"{c}_{side}" for c in (*_RAW, "salt")]])
    return pairs.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))


def lookalike_classes(df: DataFrame, column: str, row_id: str, scope: str | None = None, fold: bool = False) -> DataFrame:
    """(row, class, ways, links) of the rows whose form is written in more than one way: the class is its smallest row,
    ``ways`` the number of ways of writing, ``links`` the rows that write it otherwise. As long as the table at most,
    where the pairs grow with the square of a form's rows. ``fold`` adds full case folding to the form.
    """
    d = digests(df, column, row_id, scope, fold)
    ways = d.groupBy(*_FORM, *_RAW).agg(F.count(F.lit(1)).alias("own"), F.min("row").alias("least"))
    forms = ways.groupBy(*_FORM).agg(F.count(F.lit(1)).alias("ways"), F.sum("own").alias("all"), F.min("least").alias("class")).where("ways > 1")
    info = ways.join(forms, _FORM).select(*_FORM, *_RAW, "class", "ways", (F.col("all") - F.col("own")).alias("links"))
    return d.join(info, [*_FORM, *_RAW]).select("row", "class", "ways", "links")
