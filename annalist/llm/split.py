"""Problem 6: cut items above a limit of words into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces is computed, their ends are placed at equal distances, every end is
moved to the strongest boundary near it (line break, then sentence end, then clause end, then any gap between words;
the nearest of equals, the earlier of equally near ones), and a piece is added where a limit would be broken.

Defined cases: a null text makes no piece; a text within the limit, blank and empty ones included, is one piece; a
text of any length is processed whole; words are never cut. Pieces are slices of the text as it stands, so dropping
each piece's overlap gives the text back, white space included.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\S+")
#: Fixed value: characters that end a sentence or a clause, closing quotes and brackets aside.
_SENTENCE, _CLAUSE, _CLOSE = ".!?׃。؟…", ",;:،؛–—", "\"'”’״׳)]}"


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the gap after each word: 3 line break, 2 sentence end, 1 clause end, 0 none."""
    out = []
    for k, (a, b) in enumerate(spans):
        gap = text[b : spans[k + 1][0]] if k + 1 < len(spans) else ""
        if any(c in "\n\r\u2028\u2029\x0b\x0c\x85" for c in gap):
            out.append(3)
            continue
        last = text[a:b].rstrip(_CLOSE)[-1:]
        out.append(2 if last and last in _SENTENCE else 1 if last and last in _CLAUSE else 0)
    return out


def cut_points(strengths: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open word ranges of the pieces: each at most ``limit`` words, consecutive ones sharing ``overlap``."""
    n = len(strengths)
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if n <= limit:
        return [(0, n)]
    least = -(-(n - overlap) // (limit - overlap))
    for count in range(least, 2 * least + 2):
        step = (n - overlap) / count
        slack = max(1, int(step // 3))
        pieces, start = [], 0
        for k in range(1, count):
            target = min(round(overlap + k * step), start + limit)
            low, high = max(target - slack, start + overlap + 1), min(target + slack, start + limit, n - 1)
            if low > high:
                break
            end = max(range(low, high + 1), key=lambda e: (strengths[e - 1], -abs(e - target), -e))
            pieces.append((start, end))
            start = end - overlap
        else:
            if overlap < n - start <= limit:
                return [*pieces, (start, n)]
    pieces, start = [], 0  # no boundary helps: full pieces
    while n - start > limit:
        pieces.append((start, start + limit))
        start += limit - overlap
    return [*pieces, (start, n)]


def split_oversized(df: DataFrame, column: str, keys: list[str], limit: int, overlap: int, whole: bool = True) -> DataFrame:
    """(keys..., piece_no, pieces, from_word, to_word, piece): the pieces of every row's text.

    ``from_word`` and ``to_word`` are 1-based and inclusive, 1 and 0 for a text without words. With ``whole=False``
    rows that are within the limit are left out. ``keys`` are carried as they are, whatever they are called.
    """
    names = [f"k{i}" for i in range(len(keys))]
    fields = [T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys, strict=True)]
    schema = T.StructType(
        [*fields, T.StructField("piece_no", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("from_word", T.IntegerType()), T.StructField("to_word", T.IntegerType()), T.StructField("piece", T.StringType())]
    )

    def run(batches):
        for b in batches:
            rows, out = [], ([], [], [], [], [])
            for i, text in enumerate(b.column("text").to_pylist()):
                if text is None or (not whole and len(text) <= 2 * limit):
                    continue
                spans = [m.span() for m in _WORD.finditer(text)]
                if len(spans) <= limit:
                    ranges = [(0, len(spans))] if whole else []
                else:
                    ranges = cut_points(boundary_strengths(text, spans), limit, overlap)
                for k, (s, e) in enumerate(ranges):
                    a = 0 if k == 0 else spans[s][0]
                    z = len(text) if k == len(ranges) - 1 else spans[e][0]
                    rows.append(i)
                    for column_out, v in zip(out, (k + 1, len(ranges), s + 1, e, text[a:z]), strict=True):
                        column_out.append(v)
            kept = [b.column(n).take(pa.array(rows, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int32()) for c in out[:4]], pa.array(out[4], pa.string())], names=schema.names)

    pieces = df.select(*[F.col(f"`{k}`").alias(n) for n, k in zip(names, keys, strict=True)], F.col(f"`{column}`").alias("text")).mapInArrow(run, schema)
    return pieces.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "piece_no", "pieces", "from_word", "to_word", "piece")
