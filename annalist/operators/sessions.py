"""Time spent, from gaps between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_by_pattern(text: str, patterns: list[tuple[str, str]]) -> Column:
    """First label, in the given order, whose pattern is found in the text; null where none is."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(F.rlike(F.col(text), F.lit(pattern)), name).otherwise(out)
    return out


def filled_labels(events: DataFrame, session: str, ts: str, label: str, tie: str) -> DataFrame:
    """events with ``filled``: the last label so far, before the first label that one, without any ``other``."""
    w = Window.partitionBy(session).orderBy(ts, tie)
    so_far = F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return events.withColumn("filled", F.coalesce(so_far, first, F.lit("other")))


def worked_gaps(events: DataFrame, session: str, ts: str, label: str, tie: str, gap_seconds: int, shift_hours: int = 3) -> DataFrame:
    """(session, filled, day, seconds): gaps to the next event of the session that are no longer than the limit.

    They belong to the label and the local day of the earlier event.
    """
    w = Window.partitionBy(session).orderBy(ts, tie)
    e = filled_labels(events, session, ts, label, tie)
    e = e.withColumn("seconds", (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)
    day = F.to_date(F.col(ts) + F.make_interval(hours=F.lit(shift_hours)))
    return e.where(F.col("seconds") <= gap_seconds).select(session, "filled", day.alias("day"), "seconds")
