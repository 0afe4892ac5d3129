"""Comparison of runs, digests of a corpus, and drivers that run many configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_runs(a: DataFrame, b: DataFrame, clusters_a: DataFrame | None = None, clusters_b: DataFrame | None = None) -> DataFrame:
    """(part, name, a, b, differs) of two runs, each one row (params map, files array, results map).

    Parts: ``param`` and ``result`` by name; ``files``: numbers of common files and of those only one has; ``verdict``:
    the reasons for which the clusterings cannot be compared (files, chunk_size, model), or ``comparable``. Where they can
    be and both cluster tables (chronological_index, scluster) are given, ``agreement`` has the adjusted Rand index.
    A run's lists are as long as one selection.
    """
    x, y = (d.select(*[F.col(c).alias(f"{c}_{side}") for c in ("params", "files", "results")]) for d, side in ((a, "a"), (b, "b")))
    j = x.join(F.broadcast(y))  # one row each

    def named(part: str, column: str) -> DataFrame:
        keys = F.array_union(F.map_keys(f"{column}_a"), F.map_keys(f"{column}_b"))
        e = j.select(F.explode(keys).alias("name"), f"{column}_a", f"{column}_b")
        one, two = F.try_element_at(f"{column}_a", F.col("name")), F.try_element_at(f"{column}_b", F.col("name"))
        return e.select(F.lit(part).alias("part"), "name", one.cast("string").alias("a"), two.cast("string").alias("b"), (~one.eqNullSafe(two)).alias("differs"))

    def count(name: str, left, right, differs) -> DataFrame:
        return j.select(F.lit("files").alias("part"), F.lit(name).alias("name"), left.cast("string").alias("a"), right.cast("string").alias("b"), differs.alias("differs"))

    zero = F.lit(0)
    common = F.size(F.array_intersect("files_a", "files_b"))
    only_a, only_b = F.size(F.array_except("files_a", "files_b")), F.size(F.array_except("files_b", "files_a"))
    other = lambda k: ~F.try_element_at("params_a", F.lit(k)).eqNullSafe(F.try_element_at("params_b", F.lit(k)))
    why = F.array_compact(F.array(F.when(only_a + only_b > 0, "files differ"), F.when(other("chunk_size"), "chunk size differs"), F.when(other("model"), "model differs")))
    text = F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise("comparable")
    verdict = j.select(F.lit("verdict").alias("part"), F.lit("clusterings").alias("name"), text.alias("a"), F.lit(None).cast("string").alias("b"), (text != "comparable").alias("differs"))
    out = named("param", "params").unionByName(named("result", "results")).unionByName(count("common", common, common, F.lit(False)))
    out = out.unionByName(count("only_a", only_a, zero, only_a > 0)).unionByName(count("only_b", zero, only_b, only_b > 0)).unionByName(verdict)
    if clusters_a is not None and clusters_b is not None:
        from annalist.operators.stats import adjusted_rand

        both = clusters_a.select("chronological_index", F.col("scluster").alias("a")).join(clusters_b.select("chronological_index", F.col("scluster").alias("b")), "chronological_index")
        ari = adjusted_rand(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
        ari = ari.toDF(*["ari", *ari.columns[1:]]).select(F.round("ari", 6).cast("string").alias("v"))
        ok = verdict.where("a = 'comparable'").select("part")
        out = out.unionByName(ok.join(F.broadcast(ari)).select(F.lit("agreement").alias("part"), F.lit("adjusted_rand").alias("name"), F.col("v").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(False).alias("differs")))
    return out


def corpus_digest(df: DataFrame, group: str, order: list[str], text: str, block: int = 10_000) -> DataFrame:
    """(group, rows, digest): SHA-256 of every group's texts in their order, null texts left out.

    A group's digest is that of the digests of its blocks of ``block`` rows, a block's that of its rows' digests, so no
    task holds more than a block's digests or a group's blocks.
    """
    from annalist.operators.order import global_index

    d = global_index(df.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(group, *order, F.sha2(F.col(text), 256).alias("__h")), group, *order, out="__i")
    first = d.groupBy(F.col(group).alias("__g")).agg(F.min("__i").alias("__f"))
    d = d.join(first, F.col(group) == F.col("__g")).withColumn("__b", F.floor((F.col("__i") - F.col("__f")) / block))
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), ""), 256)
    per = d.groupBy(group, "__b").agg(joined("__i", "__h").alias("__h"), F.count(F.lit(1)).alias("__n"))
    return per.groupBy(group).agg(F.sum("__n").alias("rows"), joined("__b", "__h").alias("digest"))


def write_corpus(df: DataFrame, path: str, keep, group: str, order: list[str], text: str) -> dict:
    """Write the rows for which ``keep`` holds as a training corpus, and {rows, dropped, digest}: the digest is over the
    groups' digests by name. The counters and the digest belong to what was written."""
    df.where(keep).select(group, *order, text).write.mode("overwrite").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    per = corpus_digest(kept, group, order, text)
    total = per.agg(F.sum("rows").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(group, "digest"))), lambda s: s["digest"]), ""), 256).alias("digest")).head()  # one row per group
    rows = kept.count()
    return {"rows": rows, "dropped": df.count() - rows, "digest": total.digest}


def run_grid(configs: list[dict], run: Callable[[dict], dict], done: dict[str, dict] | None = None) -> dict[str, dict]:
    """Results of every configuration by its key; those in ``done`` are not run again. A configuration that fails is
    recorded with its error, and the others go on."""
    import json

    out = dict(done or {})
    for c in configs:
        key = json.dumps(c, sort_keys=True)
        if key not in out:
            try:
                out[key] = {**c, **run(c)}
            except Exception as e:  # noqa: BLE001 - told in the result
                out[key] = {**c, "error": f"{type(e).__name__}: {e}"[:500]}
    return out


def panel_dots(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, share, size): the dots of a panel of groups and labels, 8 + 14 * sqrt(share of the group)."""
    c = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))  # one row per label
    return c.withColumn("share", share).withColumn("size", 8 + 14 * F.sqrt("share"))
