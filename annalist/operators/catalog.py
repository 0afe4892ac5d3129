"""The catalog of works: selection, reconciliation with an older list, quality checks."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.session import materialize

FLAG = "1"


def parse_categories(categories: str) -> dict[str, Column]:
    """Columns of the category list: path before the first Hebrew item, that item, the rest, and the book before the
    last "Sefaria". Without that word the last item counts as its place."""
    c = F.coalesce(F.col(categories), F.array().cast("array<string>"))
    back = F.array_position(F.reverse(c), "Sefaria")
    src = F.when(back > 0, F.size(c) - back).otherwise(F.size(c) - 1)  # 0-based
    head = F.slice(c, F.lit(1), F.greatest(src - 1, F.lit(0)).cast("int"))
    heb = F.filter(F.transform(head, lambda x, i: F.when(F.rlike(x, F.lit("[א-ת]")), i)), lambda i: i.isNotNull())
    first = F.get(heb, F.lit(0))
    path = F.when(first.isNotNull(), F.slice(head, F.lit(1), F.coalesce(first, F.lit(0)))).otherwise(head)
    return {
        "sefaria_path": F.array_join(path, " > "),
        "scholarly_category": F.coalesce(F.get(head, first), F.lit("")),
        "composition_id": F.when(first.isNotNull(), F.array_join(F.slice(head, F.coalesce(first, F.lit(0)) + 2, F.greatest(F.size(head), F.lit(1))), " ")).otherwise(""),
        "book": F.when(src >= 1, F.coalesce(F.get(c, (src - 1).cast("int")), F.lit(""))).otherwise(""),
    }


def edition_of(filename: str) -> Column:
    """The edition in a filename, empty for files without one."""
    return F.regexp_extract(F.col(filename), r"-([^-]+)_Sefaria\.jsonl$", 1)


def normal_name(name) -> Column:
    """Lower case, only letters and digits, one blank between words."""
    c = F.col(name) if isinstance(name, str) else name
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def experiment_files(catalog: DataFrame, flag: str) -> DataFrame:
    """Files of an experiment: flag set and a hierarchy given."""
    return catalog.where((F.col(flag) == FLAG) & F.col("hierarchy").isNotNull()).select("filename")


def hierarchy_key(hierarchy: str) -> Column:
    """``12.1.1-5`` as an array of ints, of a range the first; parts that are no numbers are left out."""
    return F.filter(F.transform(F.split(F.col(hierarchy), r"\."), lambda x: F.try_to_number(F.split(x, "-")[0], F.lit("999999999")).cast("int")), lambda x: x.isNotNull())


def available(wanted: DataFrame, present: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of the wanted keys."""
    return wanted.join(present, key, "left_semi"), wanted.join(present, key, "left_anti")


def carry_over(old: DataFrame, key: str, order: str, flags: list[str], note: str) -> DataFrame:
    """One row per key of an old table with several: the first row's columns, the last set flag, all notes joined."""
    first = [F.min_by(c, order).alias(c) for c in old.columns if c not in {key, order, note, *flags}]
    union = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in flags]
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(note).isNotNull() & (F.col(note) != ""), F.struct(order, note)))), lambda s: s[note]), "; ").alias(note)
    return old.where(F.col(key).isNotNull()).groupBy(key).agg(*first, *union, notes)


def reconcile(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status): same, no new, no old - a full outer join of two lists of names (nulls are left out)."""
    a = old.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().withColumn("in_old", F.lit(True))
    b = new.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().withColumn("in_new", F.lit(True))
    status = F.when(F.col("in_old") & F.col("in_new"), "same").when(F.col("in_old"), "no new").otherwise("no old")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), status.alias("status"))


def title_cascade(names: DataFrame, titles: DataFrame, name: str, title: str, least_words: int = 1) -> DataFrame:
    """(name, title, dropped): every name with the title it equals after normalisation, dropping as few of its last
    words as needed; ties to the title that comes first."""
    n = names.select(name, F.split(normal_name(name), " ").alias("w")).where(F.size("w") > 0)
    cut = n.select(name, F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - least_words, F.lit(0))), lambda d: F.array_join(F.slice(F.col("w"), F.lit(1), F.size("w") - d), " "))).alias("dropped", "k"))
    t = titles.select(title, normal_name(title).alias("k")).where("k <> ''")
    w = Window.partitionBy(name).orderBy("dropped", title)
    return cut.join(t, "k").withColumn("r", F.row_number().over(w)).where("r = 1").select(name, title, "dropped")


def best_ratios(left: list[str], right: list[str]) -> list[tuple[float, int]]:
    """(ratio, index in ``right``) of the best difflib ratio of every left name over all right ones; of equal ratios the
    last index, and (0, -1) where ``right`` is empty.

    Matching blocks of difflib are a common subsequence, so 2 * longest common subsequence / (la + lb) is never below
    the ratio. It is computed for all right names at once (one bit per letter of the left name); difflib compares names
    from the greatest bound on, until none is left that could be as good. Names above 64 letters are bounded by length.
    """
    size = np.array([len(y) for y in right])
    code = {c: i + 1 for i, c in enumerate(sorted(set("".join(right))))}
    letters = np.zeros((int(size.max(initial=0)), len(right)), np.int32)  # 0 behind the end
    for j, y in enumerate(right):
        letters[: len(y), j] = [code[c] for c in y]
    matchers: dict[int, difflib.SequenceMatcher] = {}
    out = []
    for x in left:
        if len(x) <= 64:
            mask = np.zeros(len(code) + 1, np.uint64)
            for i, c in enumerate(x):
                if c in code:
                    mask[code[c]] |= np.uint64(1 << i)
            v = np.full(len(right), ~np.uint64(0))
            for row in letters:
                u = v & mask[row]
                v = (v + u) | (v - u)
            common = np.bitwise_count(~v & np.uint64((1 << len(x)) - 1)).astype(np.int64)
        else:
            common = np.minimum(size, len(x))
        bound = 2.0 * common / np.maximum(size + len(x), 1)
        best = (0.0, -1)
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] < best[0]:
                break
            j = int(j)
            if j not in matchers:
                matchers[j] = difflib.SequenceMatcher(None, "", right[j])
            matchers[j].set_seq1(x)
            if bound[j] > 0:
                best = max(best, (matchers[j].ratio(), j))
        out.append(best)
    return out


def fuzzy_names(left: DataFrame, right: DataFrame, name: str, left_block: int = 256, right_block: int = 4096, manual: DataFrame | None = None) -> DataFrame:
    """(name, match, score, status): exact by normalised name, else by the hand-made table ``manual`` (name, match), else
    the best difflib ratio over all names; exact, manual, likely from 0.85, check from 0.6, else none (with the best score,
    but no match). Of equal ratios the last name.

    Every name without an exact match meets every other one: names go into blocks of about ``left_block`` and
    ``right_block``, and each pair of blocks is one group (``best_ratios``), so no task holds more than two blocks.
    """
    a = left.select(F.col(name).alias("a")).where("a IS NOT NULL").distinct().withColumn("na", normal_name("a"))
    b = right.select(F.col(name).alias("b")).where("b IS NOT NULL").distinct().withColumn("nb", normal_name("b"))
    exact = a.join(b, F.col("na") == F.col("nb")).groupBy("a").agg(F.min("b").alias("match")).select("a", "match", F.lit(1.0).alias("score"))
    open_ = a.join(exact, "a", "left_anti")
    if manual is not None:
        told = open_.join(manual.select(F.col(name).alias("a"), "match").where("match IS NOT NULL").dropDuplicates(["a"]), "a").select("a", "match", F.lit(None).cast("double").alias("score"))
        open_ = open_.join(told, "a", "left_anti")
    rest = materialize(open_, "unmatched")
    names = materialize(b.groupBy("nb").agg(F.max("b").alias("b")), "names")
    rows, cols = max(-(-rest.count() // left_block), 1), max(-(-names.count() // right_block), 1)
    tasks = min(rows * cols, 4 * rest.sparkSession.sparkContext.defaultParallelism)  # by number, else a few KB a block become one task

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "score": [], "b": []})
        y = y.sort_values("b")
        found, there = best_ratios(list(x["na"]), list(y["nb"])), list(y["b"])
        return pd.DataFrame({"a": list(x["a"]), "score": [s for s, _ in found], "b": [there[j] if j >= 0 else None for _, j in found]})

    x = rest.withColumn("i", block("na", rows)).withColumn("j", every(cols)).repartition(tasks, "i", "j").groupBy("i", "j")
    y = names.withColumn("j", block("nb", cols)).withColumn("i", every(rows)).repartition(tasks, "i", "j").groupBy("i", "j")
    pairs = x.cogroup(y).applyInPandas(compare, "a string, score double, b string")
    best = pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("m"))
    near = rest.join(best, "a", "left").select("a", F.when(F.col("m.score") >= 0.6, F.col("m.b")).alias("match"), F.coalesce("m.score", F.lit(0.0)).alias("score"))
    status = F.when(F.col("score") == 1.0, "exact").when(F.col("score") >= 0.85, "likely").when(F.col("score") >= 0.6, "check").otherwise("none")
    out = exact.unionByName(near)
    out = out if manual is None else out.unionByName(told)
    return out.select(F.col("a").alias(name), "match", F.round("score", 3).alias("score"), F.when(F.col("score").isNull(), "manual").otherwise(status).alias("status"))


def title_cascade_full(names: DataFrame, titles: DataFrame, name: str, title: str, cutoff: float = 0.86, manual: DataFrame | None = None) -> DataFrame:
    """(name, title, how): every name with a title - equal after dropping last words (``equal`` or ``shortened``), else the
    most similar title from ``cutoff`` on (``fuzzy``), else by the hand-made table (``manual``), else null (``none``)."""
    names = names.select(name).where(F.col(name).isNotNull()).distinct()
    first = materialize(title_cascade(names, titles, name, title), "cascade").select(name, title, F.when(F.col("dropped") == 0, "equal").otherwise("shortened").alias("how"))
    rest = names.join(first, name, "left_anti")
    near = fuzzy_names(rest, titles.select(F.col(title).alias(name)), name).where(F.col("score") >= cutoff).select(name, F.col("match").alias(title), F.lit("fuzzy").alias("how"))
    near = materialize(near, "fuzzy")
    out, rest = first.unionByName(near), rest.join(near, name, "left_anti")
    if manual is not None:
        told = rest.join(manual.select(name, title).where(F.col(title).isNotNull()).dropDuplicates([name]), name).select(name, title, F.lit("manual").alias("how"))
        out, rest = out.unionByName(told), rest.join(told, name, "left_anti")
    return out.unionByName(rest.select(name, F.lit(None).cast("string").alias(title), F.lit("none").alias("how")))


def quality_checks(segments: DataFrame) -> DataFrame:
    """(check, violations) of a corpus table."""
    from annalist.functions.text import word_count

    n = word_count(F.coalesce("sentence", F.lit("")))
    checks = {
        "filename missing": F.col("filename").isNull(), "location missing": F.col("location").isNull(), "sentence missing": F.col("sentence").isNull() | (F.trim("sentence") == ""),
        "title missing": F.col("title").isNull(), "he_title missing": F.col("he_title").isNull(), "text_length missing": F.col("text_length").isNull(),
        "text_length wrong": F.col("text_length") != n, "from_word below 1": F.col("from_word") < 1, "to_word wrong": F.col("to_word") != F.col("from_word") + F.col("text_length") - 1,
        "print_type unknown": ~F.coalesce(F.col("print_type").isin("print edition", "born digital"), F.lit(False)),
    }
    counts = segments.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())], (F.count("segment") - F.count_distinct("segment")).alias("dup"))
    pairs = [F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("violations")) for i, name in enumerate(checks)]
    pairs.append(F.struct(F.lit("segment repeated").alias("check"), F.col("dup").alias("violations")))
    return counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


#: Fields of a corpus record and their types.
FIELDS = {
    "location": "string", "segment": "bigint", "sentence": "string", "orig_sentence": "string", "from_word": "int", "to_word": "int", "text_length": "int", "title": "string",
    "he_title": "string", "categories": "array<string>", "ref_links": "array<string>", "versions": "string", "version_source": "string",
}


def validation_checks(segments: DataFrame, known: set[str] = frozenset()) -> DataFrame:
    """(check, violations) of the twelve checks of a corpus, but for a second copy of the text, which the table lacks.
    ``known`` are columns besides FIELDS that are expected. Fields are counted, other checks count rows (or places)."""
    from annalist.functions.text import word_count

    kinds = dict(segments.dtypes)
    n = word_count(F.coalesce("sentence", F.lit("")))
    base = F.regexp_replace("location", "_part_[0-9]+$", "")
    part = F.regexp_extract("location", "_part_([0-9]+)$", 1)
    w = Window.partitionBy("filename", "__base").orderBy("from_word", "segment", "row_id")  # the parts of one place
    s = segments.withColumn("__base", base).withColumn("__part", part).withColumn("__before", F.lag("to_word").over(w))
    rows = {
        "text_length is the number of words": F.col("text_length") != n, "from_word is 1 or more": F.col("from_word") < 1,
        "to_word follows from from_word": F.col("to_word") != F.col("from_word") + F.col("text_length") - 1,
        "parts follow one another": (F.col("__part") != "") & (F.col("__part") != "1") & ((F.col("__before") + 1).eqNullSafe(F.col("from_word")) == F.lit(False)),
        "no empty text": F.coalesce(F.trim("sentence"), F.lit("")) == "", "no empty original": F.coalesce(F.trim("orig_sentence"), F.lit("")) == "",
        "categories are given": F.coalesce(F.size("categories"), F.lit(0)) <= 0, "at most 250 words": n > 250, "at least 5 words": n < 5,
        "location is given": F.coalesce(F.col("location"), F.lit("")) == "",
    }
    counts = s.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rows.values())], (F.count("segment") - F.count_distinct("segment")).alias("repeated"))
    per = segments.where("segment IS NOT NULL").groupBy("filename").agg((F.max("segment") - F.min("segment") + 1 - F.count_distinct("segment")).alias("gaps"))
    gaps = per.agg(F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"))
    fixed = {"fields are there": sum(c not in kinds for c in FIELDS), "no other fields": sum(c not in FIELDS and c not in known for c in kinds), "types are right": sum(kinds.get(c, t) != t for c, t in FIELDS.items())}
    pairs = [F.struct(F.lit(k).alias("check"), F.lit(v).cast("long").alias("violations")) for k, v in fixed.items()]
    pairs += [F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("violations")) for i, k in enumerate(rows)]
    pairs += [F.struct(F.lit("segments follow one another in a file").alias("check"), F.col("gaps").alias("violations")), F.struct(F.lit("segments are unique").alias("check"), F.col("repeated").alias("violations"))]
    return counts.join(F.broadcast(gaps)).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")  # one row each
