"""Fixed-size word chunks with word-exact provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import words
from annalist.operators.order import carry_forward, running_total


def segment_units(segments: DataFrame) -> DataFrame:
    """(filename, segment, w, n, from_word, unit, unit_from): rows with words, their unit and word offset in it.

    A row's reference is its location without the file's prefix; a row whose from_word is above 1 continues the unit
    of the row before, except for the first row of a file. Rows without words neither start nor continue a unit.
    """
    prefix = F.concat(F.regexp_replace(F.regexp_replace("filename", r"\.jsonl?$", ""), "-", "_"), F.lit("_"))
    ref = F.when(F.startswith("location", prefix), F.substr("location", F.length(prefix) + 1)).otherwise(F.col("location"))
    d = segments.select("filename", "segment", words("sentence").alias("w"), F.greatest(F.coalesce("from_word", F.lit(1)), F.lit(1)).alias("from_word"), ref.alias("ref"))
    d = d.where("size(w) > 0").withColumn("n", F.size("w"))
    start = d.groupBy(F.col("filename").alias("__f")).agg(F.min("segment").alias("__first"))
    d = d.join(start, F.col("filename").eqNullSafe(F.col("__f")))
    starts = F.when((F.col("segment") == F.col("__first")) | (F.col("from_word") <= 1), F.col("ref"))
    return carry_forward(d, ["filename"], "segment", starts, "unit").drop("ref", "__f", "__first")


def unit_starts(segments: DataFrame) -> DataFrame:
    """segment_units with ``new``: whether the row begins another unit than the row before."""
    u = carry_forward(segment_units(segments), ["filename"], "segment", F.col("unit"), "__before", strict=True)
    return u.withColumn("new", ~F.col("__before").eqNullSafe(F.col("unit"))).drop("__before")


def chunk_words(segments: DataFrame, size: int) -> DataFrame:
    """(filename, chunk_number, p, word, segment, segment_word, unit, unit_word): every word with its chunk.

    ``p`` counts the words of a file from 0; chunk numbers and words count from 1.
    """
    u = running_total(segment_units(segments), ["filename"], "segment", F.col("n").cast("long"), "start")
    e = u.select("filename", "segment", "unit", "from_word", "start", F.posexplode("w").alias("k", "word"))
    p = F.col("start") + F.col("k")
    return e.select("filename", (F.floor(p / size) + 1).cast("int").alias("chunk_number"), p.alias("p"), "word", "segment", (F.col("k") + 1).alias("segment_word"), "unit", (F.col("from_word") + F.col("k")).cast("int").alias("unit_word"))


def chunk_pieces(segments: DataFrame, size: int) -> DataFrame:
    """(filename, chunk_number, lo, hi, words, segment, w_lo, w_hi, unit, u_lo, u_hi): overlaps of rows and chunks.

    ``lo`` and ``hi`` count the words of the chunk from 1, ``w_*`` those of the row, ``u_*`` those of the unit. A row
    makes as many pieces as chunks it touches; single words are never made rows.
    """
    u = running_total(segment_units(segments), ["filename"], "segment", F.col("n").cast("long"), "start")
    last = F.floor((F.col("start") + F.col("n") - 1) / size)
    e = u.withColumn("c", F.explode(F.sequence(F.floor(F.col("start") / size), last)))
    a = F.greatest(F.col("c") * size, F.col("start"))
    z = F.least((F.col("c") + 1) * size, F.col("start") + F.col("n")) - 1
    e = e.withColumn("a", a).withColumn("z", z).withColumn("w_lo", (F.col("a") - F.col("start") + 1).cast("int")).withColumn("w_hi", (F.col("z") - F.col("start") + 1).cast("int"))
    return e.select(
        "filename", (F.col("c") + 1).cast("int").alias("chunk_number"), (F.col("a") - F.col("c") * size + 1).cast("int").alias("lo"), (F.col("z") - F.col("c") * size + 1).cast("int").alias("hi"),
        F.array_join(F.slice("w", F.col("w_lo"), F.col("w_hi") - F.col("w_lo") + 1), " ").alias("words"), "segment", "w_lo", "w_hi", "unit",
        (F.col("from_word") + F.col("w_lo") - 1).cast("int").alias("u_lo"), (F.col("from_word") + F.col("w_hi") - 1).cast("int").alias("u_hi"),
    )


def chunk_table(segments: DataFrame, size: int = 50) -> DataFrame:
    """One row per chunk: text, spans of units, and where it starts and ends.

    Consecutive pieces of one unit make a span; spans are rendered ``lo–hi: unit [from–to]``, joined by `` | ``. All
    work is within a chunk, so a file that holds a third of the words spreads over its chunks.
    """
    fields = ["lo", "hi", "words", "segment", "w_lo", "w_hi", "unit", "u_lo", "u_hi"]
    c = chunk_pieces(segments, size).groupBy("filename", "chunk_number").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))

    def merge(done, x):
        """Piece x widens the last span where it has its unit, else begins a new one."""
        span = lambda lo, u_lo: F.struct(lo.alias("lo"), x["hi"].alias("hi"), x["unit"].alias("unit"), u_lo.alias("u_lo"), x["u_hi"].alias("u_hi"))
        last = F.get(done, F.size(done) - 1)
        same = (F.size(done) > 0) & last["unit"].eqNullSafe(x["unit"])
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(same, F.concat(kept, F.array(span(last["lo"], last["u_lo"])))).otherwise(F.concat(done, F.array(span(x["lo"], x["u_lo"]))))

    empty = F.array().cast("array<struct<lo:int,hi:int,unit:string,u_lo:int,u_hi:int>>")
    c = c.withColumn("spans", F.aggregate("p", empty, merge))
    text = lambda s: F.concat(s["lo"].cast("string"), F.lit("–"), s["hi"].cast("string"), F.lit(": "), F.coalesce(s["unit"], F.lit("")), F.lit(" ["), s["u_lo"].cast("string"), F.lit("–"), s["u_hi"].cast("string"), F.lit("]"))
    first, last = F.get("p", F.lit(0)), F.get("p", F.size("p") - 1)
    return c.select(
        "filename", "chunk_number", F.array_join(F.transform("p", lambda x: x["words"]), " ").alias("chunk"), F.array_join(F.transform("spans", text), " | ").alias("ref_spans"),
        first["segment"].alias("start_segment"), first["w_lo"].alias("start_segment_word"), last["segment"].alias("end_segment"), last["w_hi"].alias("end_segment_word"),
        first["unit"].alias("start_unit"), first["u_lo"].alias("start_unit_word"), last["unit"].alias("end_unit"), last["u_hi"].alias("end_unit_word"),
    )


def unit_at(segments: DataFrame, lookups: DataFrame) -> DataFrame:
    """As-of lookup: (filename, p, segment, unit) - the row and unit that hold word ``p`` of a file.

    Offsets and positions are merged into one ordered sequence per file and the last offset is carried forward.
    """
    u = running_total(segment_units(segments), ["filename"], "segment", F.col("n").cast("long"), "p")
    both = u.select("filename", "p", F.lit(0).alias("kind"), F.struct("segment", "unit").alias("r")).unionByName(lookups.select("filename", F.col("p").cast("long").alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("struct<segment:bigint,unit:string>").alias("r")))
    both = carry_forward(both.withColumn("at", F.col("p") * 2 + F.col("kind")), ["filename"], "at", F.col("r"), "found")
    return both.where("kind = 1").select("filename", "p", "found.segment", "found.unit")
