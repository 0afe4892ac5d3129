"""Text expressions. All regular expressions live here, so every operator cuts words alike.

White space is Unicode's (no-break and ideographic spaces included, zero-width characters not), plus the four
information separators, which is exactly what Python's ``str.split`` and Arrow's ``utf8_split_whitespace`` use.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white-space characters, written so that Java and RE2 read them alike.
SPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: word tokens of the n-gram operators.
TOKEN = r"[\p{L}\p{N}_]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Words between white space; null text gives null, blank text an empty array."""
    return F.filter(F.split(_c(text), SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def tokens(text) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))


def ngrams(array, n: int) -> Column:
    """All n-grams of an array of tokens, joined by a blank; empty where it is shorter than n."""
    if n == 1:
        return _c(array)

    def of(a: Column) -> Column:
        starts = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(a, i, F.lit(n)), " "))

    # binds the array to a variable, so that an expression that makes it runs once and not once per n-gram
    return F.element_at(F.transform(F.array(_c(array)), of), 1)


def snippet(text, n: int = 120) -> Column:
    return F.substring(_c(text), 1, n)


def strip_extension(filename) -> Column:
    return F.regexp_replace(_c(filename), r"-?\.jsonl?$", "")


def clean_word(word) -> Column:
    """Hebrew and Latin letters only."""
    return F.regexp_replace(_c(word), r"[^א-תa-zA-Z]", "")


def hyphen_words(text) -> Column:
    """Split on white space, then on hyphens, without empty parts."""
    return F.filter(F.flatten(F.transform(words(text), lambda w: F.split(w, "-"))), lambda w: w != "")


def strip_marks(text) -> Column:
    """Remove Hebrew points and accents and all other non-spacing marks."""
    return F.regexp_replace(_c(text), r"\p{Mn}+", "")


def strip_points(text) -> Column:
    """Compatibility decomposition, no combining marks, compatibility composition: precomposed letters lose theirs too."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", bare(t)))

    return plain(_c(text))


def safe_name(name, n: int = 120) -> Column:
    return F.substring(F.regexp_replace(_c(name), r"[^A-Za-z0-9._-]+", "_"), 1, n)


def sentences(text) -> Column:
    """Cut after . ! ? ; or at line ends."""
    return F.filter(F.split(_c(text), r"(?<=[.!?;])\s+|[\r\n]+"), lambda s: F.trim(s) != "")
