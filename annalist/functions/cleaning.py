"""Cleaning chains for raw text, references and identifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Ordered steps of the corpus cleaning: (pattern, replacement). Works in Java and RE2 alike.
CORPUS_STEPS = [
    (r"<[^>]*>", " "), (r"&[a-zA-Z]+;", " "), (r"\[[^\]]*\]", " "), (r"[\x{0591}-\x{05bd}\x{05bf}\x{05c1}\x{05c2}\x{05c4}\x{05c5}\x{05c7}]", ""),
    (r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]", ""), (r"[.,:;!?]", " "), (r"[\x{2010}-\x{2015}\x{05be}-]", " "), (r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "),
]


def clean_corpus_text(text) -> Column:
    """Mark-up, entities, bracketed notes, vowel points, direction marks and punctuation go; spaces are squeezed."""
    c = _c(text)
    for pattern, to in CORPUS_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


# The presentation forms of Hebrew letters and the letters they stand for, by their decomposition.
_FORMS = [chr(c) for c in range(0xFB1D, 0xFB4F) if unicodedata.normalize("NFKD", chr(c)) != chr(c)]
PRESENTATION = ("".join(_FORMS), "".join(unicodedata.normalize("NFKD", c)[0] for c in _FORMS))

# The ordered steps of the corpus' cleaning; $1 and $2 are groups.
_HYPHEN = (r"([א-ת])[-\x{05be}]([א-ת])", "$1 $2")
_BEFORE = [(r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}]", "")]
_TAGS = [(r"</?[a-zA-Z][^<>]*>", "")]
_ROUND = [(r"\([^()]*\)", "")]
_AFTER = [
    (r"[\x{0591}-\x{05bd}\x{05bf}-\x{05c2}\x{05c4}-\x{05c7}]", ""), (r"[\x{05f3}\x{05f4}]", ""), (r"[\x{2018}-\x{201f}\x{2032}\x{2033}\x{ab}\x{bb}\x{2039}\x{203a}]", ""),
    (r"[.,:;?!\x22']", ""), (r"[\x{2013}\x{2014}]|--+", " "), _HYPHEN, _HYPHEN, (r"[-\x{05be}]", ""), (r"[*+/@~\x{2022}\x{2026}|^=#$%&_{}\x5c]", ""), (r"[A-Za-z\x{c0}-\x{24f}]+", " "),
    (r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "),
]


def cleaning_steps(square_notes: bool = False) -> list[tuple[str, str] | None]:
    """The fourteen steps as (pattern, replacement), None for the step of presentation forms. Angle brackets go with what
    they hold and square brackets alone; with ``square_notes`` the other way round."""
    angle, square = (r"<[^<>]*>", r"\[[^\[\]]*\]"), (r"[<>]", r"[\[\]]")
    return [*_BEFORE, None, *_TAGS, ((square if square_notes else angle)[0], ""), *_ROUND, ((angle if square_notes else square)[1], ""), *_AFTER]


def clean_standard(text, square_notes: bool = False) -> Column:
    """A text after all steps, trimmed; null stays null."""
    c = _c(text)
    for step in cleaning_steps(square_notes):
        c = F.regexp_replace(c, *step) if step else F.translate(c, *PRESENTATION)
    return F.trim(c)


# What the citation cleaner removes besides the citations.
UNIT_STEPS = [(r"[\x{0591}-\x{05c7}]", ""), (r"[\x{200e}\x{200f}\x{202a}-\x{202e}]", ""), (r"^\s*פסקא\s+\S+\s+אות\s+\S+\s*", ""), (r"\s+", " ")]


def clean_unit(text) -> tuple[Column, Column]:
    """(text of a unit, number of citations removed): parentheses of 1 to 60 characters, points, direction marks and the
    heading of a unit go, spaces are squeezed."""
    c, cited = _c(text), r"\([^)]{1,60}\)"
    out = F.regexp_replace(c, cited, " ")
    for pattern, to in UNIT_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out), F.regexp_count(c, F.lit(cited))


def clean_citations(text) -> tuple[Column, Column]:
    """(text without parentheses of at most 60 characters, number of them)."""
    c = _c(text)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\([^()]{0,60}\)", " "), " +", " "), "^ | $", ""), F.regexp_count(c, F.lit(r"\([^()]{0,60}\)"))


def unit_id(text, n: int = 60) -> Column:
    """Letters, digits and underscores, the last ``n`` characters, no leading underscore."""
    return F.regexp_replace(F.right(F.regexp_replace(_c(text), r"[^\p{L}\p{N}]+", "_"), F.lit(n)), "^_+", "")


def distinct_ids(df, group: str, location: str, order: str, out: str = "unit"):
    """df with ``out``: the location as an identifier, unique within its group: the second and later ones, in the order of
    ``order``, end in their number. The window holds the units of one group that share an identifier."""
    base = F.regexp_replace(_c(location), r"[^A-Za-z0-9_]+", "_")
    base = F.regexp_replace(F.right(F.regexp_replace(base, "^_+|_+$", ""), F.lit(60)), "^_+", "")
    d = df.withColumn(out, F.when(base == "", "unit").otherwise(base))
    n = F.row_number().over(Window.partitionBy(group, out).orderBy(order))
    return d.withColumn(out, F.when(n > 1, F.concat(F.col(out), F.lit("__"), n.cast("string"))).otherwise(F.col(out)))


def isolate_reference(text) -> Column:
    """A trailing reference such as ``12:3`` wrapped in direction isolates."""
    return F.regexp_replace(_c(text), r"([0-9]+(?:[:_][0-9]+)*)$", "\u2066$1\u2069")


def percent(x) -> Column:
    """Whole per cent, half to even."""
    return F.concat(F.bround(_c(x)).cast("long").cast("string"), F.lit("%"))


def chance_level(m: Column, tolerance: Column, length: Column) -> Column:
    """Chance that one of m random points lies within the tolerance of a place."""
    return 1 - F.pow(1 - 2 * tolerance / length, m)


def predicted_megabytes(chunks: Column, words: Column) -> Column:
    # Fitted memory model.
    return 315 + 3.08 * chunks / 1000 + 20.3 * words / 1e6


def predicted_seconds(chunks: Column, k: Column) -> Column:
    # Stage costs per chunk, and their constant.
    per_chunk = 0.00045 + 0.00004 + 0.00018 + 0.00012 + 0.00004 + 0.00030
    return chunks * k / 8 * per_chunk + 0.5
