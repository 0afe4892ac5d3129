"""Events as they arrive: session windows with late data, and an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.sources.files import append_missing


def session_totals(events: DataFrame, session: str, ts: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(session, started, ended, events, seconds) of sessions that a gap ends; works on streams and on tables.

    On a stream, events later than ``late`` behind the newest are dropped, which bounds the state.
    """
    e = events.select(F.col(session).alias("session"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    g = e.groupBy(F.session_window("ts", gap), "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return g.select("session", "started", "ended", "events", (F.unix_timestamp("ended") - F.unix_timestamp("started")).alias("seconds"))


def append_stream(stream: DataFrame, path: str, key: list[str], checkpoint: str):
    """Start a query that appends every batch's new keys to a Parquet table; a repeated batch adds nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: append_missing(df.dropDuplicates(key), path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
