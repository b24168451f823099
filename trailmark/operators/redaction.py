"""What a deletion changes in derived tables, without deriving the whole log again.

The derivation's state ends with an epoch, so what a deleted event has contributed lies within its epoch, and for a
deleted start also within the epoch before, which then runs on. The days that such epochs have events on are *dirty*:
their rollups are derived anew, from every epoch that has an event on one of them, and take the place of the stored
ones; other days stay as they are. Sessions of those epochs are derived anew too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import utc_day
from ..sources.folders import settled
from . import derive, rollup


def dirty_days(seq: DataFrame, kept: DataFrame) -> DataFrame:
    """(date): the days of the epochs of ``seq`` that ``kept`` (id) changes by what it lacks."""
    gone = seq.join(kept.select("id"), "id", "left_anti")
    touched = F.when(F.col("kind") == "start", F.array(F.col("epoch") - 1, F.col("epoch"))).otherwise(F.array("epoch"))
    epochs = gone.select(F.explode(touched).alias("epoch")).distinct()
    return seq.join(epochs, "epoch", "left_semi").select(utc_day(F.col("ts")).alias("date")).distinct()


def epochs_on(seq: DataFrame, days: DataFrame) -> DataFrame:
    """The epochs that have an event on one of ``days``."""
    return seq.select("epoch", utc_day(F.col("ts")).alias("date")).join(days, "date", "left_semi").select("epoch").distinct()


def redacted(before: DataFrame, after: DataFrame, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The derived tables of ``after``, from those of ``before`` and the logs; ``after`` lacks rows of ``before`` only."""
    old, new = settled(derive.sequenced(before)), settled(derive.sequenced(after))
    days = settled(dirty_days(old, after))
    epochs = epochs_on(new, days)
    starts = new.where("kind = 'start'").join(epochs.select((F.col("epoch") + 1).alias("epoch")), "epoch", "left_semi")
    # An epoch ends with the next one's start, which stands for itself if that epoch isn't derived.
    ends = starts.join(epochs, "epoch", "left_anti")
    rows = settled(new.join(epochs, "epoch", "left_semi").unionByName(ends))
    on = lambda df: df.join(days, "date", "left_semi")
    visits, fg = settled(on(derive.visits(rows).where("not provisional"))), settled(on(derive.foreground(rows)))
    dated = rows.where(utc_day(F.col("ts")).isNotNull()).withColumn("date", utc_day(F.col("ts")))
    fresh = {
        "nodes": rollup.node_days(visits, fg), "edges": rollup.edge_days(visits), "days": rollup.day_rows(visits, fg, on(dated)),
    }
    out = {n: stored[n].join(days, "date", "left_anti").unionByName(df.select(stored[n].columns)) for n, df in fresh.items()}
    heads = old.join(epochs_on(old, days), "epoch", "left_semi").select("id")
    sessions = derive.sessions(rows).where("not open").select(stored["sessions"].columns)
    out["sessions"] = stored["sessions"].join(heads, "id", "left_anti").unionByName(sessions)
    return out
