"""Cluster labels, group labels and selections of the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensure_columns(df: DataFrame, required: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """df with the default of every optional column that it lacks; an error names missing required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: d for c, d in (defaults or {}).items() if c not in df.columns})


def numeric_clusters(df: DataFrame, column: str = "scluster") -> DataFrame:
    """Rows whose cluster is a number, as int; others are dropped."""
    return df.withColumn(column, F.expr(f"cast(try_cast(`{column}` AS double) AS int)")).where(F.col(column).isNotNull())


def grouping_label(filename: str, level: int) -> Column:
    """First ``level`` parts of a filename, in either of the two conventions."""
    f = F.col(filename)
    new = F.split(F.regexp_replace(F.regexp_replace(f, r"\.jsonl$", ""), "_", " "), "-")
    new = F.when(F.endswith(F.element_at(new, -1), F.lit("Sefaria")), F.slice(new, F.lit(1), F.size(new) - 1)).otherwise(new)
    old = F.split(F.regexp_replace(f, r"-?\.json$", ""), "-")
    parts = F.when(F.endswith(f, F.lit(".jsonl")), new).otherwise(old)
    return F.array_join(F.slice(parts, 1, level), "-")


def merge_small_groups(df: DataFrame, label: str, index: str, least: float = 0.025) -> DataFrame:
    """df with labels of groups that span less than ``least`` of the axis replaced by their first part."""
    spans = df.groupBy(label).agg((F.max(index) - F.min(index)).alias("__span"))
    total = df.agg((F.max(index) - F.min(index)).alias("__total"))
    j = df.join(spans, label).join(F.broadcast(total))
    small = F.col("__span") < F.col("__total") * least
    return j.withColumn(label, F.when(small, F.split(label, "-")[0]).otherwise(F.col(label))).drop("__span", "__total")


def boundaries(df: DataFrame, label: str, index: str, least: float = 0.025, width: int = 30) -> DataFrame:
    """(label, lo, hi, shade, shown): intervals of the groups by start, shaded in turn; wide ones show their label."""
    b = df.groupBy(F.col(label).alias("label")).agg(F.min(index).alias("lo"), F.max(index).alias("hi"))
    total = df.agg((F.max(index) - F.min(index)).alias("total"))
    w = Window.orderBy("lo", "label")  # one row per group of the level
    short = F.when(F.length("label") > width, F.concat(F.substring("label", 1, width - 3), F.lit("..."))).otherwise(F.col("label"))
    out = b.withColumn("shade", ((F.row_number().over(w) - 1) % 2).cast("int")).join(F.broadcast(total))
    return out.select("label", "lo", "hi", "shade", F.when(F.col("hi") - F.col("lo") >= F.col("total") * least, short).alias("shown"))


def search(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds every word of the query, regardless of case."""
    cond = F.lit(True)
    for w in query.lower().split():
        cond = cond & F.contains(F.lower(text), F.lit(w))
    return df.where(cond)


def assign_genres(df: DataFrame, title: str, category: str, rules: DataFrame) -> DataFrame:
    """df with ``genre`` by rules (genre, kind, value). A row has the genre whose rule of kind ``title`` names its title,
    else the genre whose ``category`` is its own unless an ``except`` of that genre names its title, else null; of several
    the first by name. Rules are a short, hand-made list; they are broadcast."""
    r = lambda kind, value: F.broadcast(rules.where(F.col("kind") == kind).groupBy(F.col("value").alias(value)).agg(F.array_sort(F.collect_set("genre")).alias(f"__{kind}")))
    d = df.join(r("title", title), title, "left").join(r("category", category), category, "left").join(r("except", title), title, "left")
    none = F.array().cast("array<string>")
    by_category = F.array_except(F.coalesce("__category", none), F.coalesce("__except", none))
    return d.withColumn("genre", F.coalesce(F.get("__title", F.lit(0)), F.get(by_category, F.lit(0)))).drop("__title", "__category", "__except")


def require_counts(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """df, unless the number of rows of some value of ``column`` is not the expected one: then an error names them."""
    got = {r[0]: r[1] for r in df.where(F.col(column).isin(list(expected))).groupBy(column).agg(F.count(F.lit(1))).collect()}
    wrong = [f"{k}: {got.get(k, 0)} instead of {n}" for k, n in sorted(expected.items()) if got.get(k, 0) != n]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
