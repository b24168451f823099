"""Raw capture events to records of the log: what is recorded, in which store, in which shape and order.

A raw row has a trigger, its place in firing order (``seq``), the time it carries (``time_stamp``, if any) and the clock
when it fired (``now``). Navigations of frames other than the top one, of the extension's own pages and, like all but a
browser's start, those fired while capture is paused are not recorded. The pause state as of each row is that of the last
``pause`` row before it. In-page navigations go to a store of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import with_idna
from ..operators.derive import carried
from .numbering import numbered

#: Trigger -> (store, kind). Fixed values of the capture's contract.
TRIGGERS = {
    "committed": ("events", "nav"), "history": ("spa", "nav"), "fragment": ("spa", "nav"), "created_target": ("events", "link"),
    "removed": ("events", "close"), "activated": ("events", "focus"), "focus_changed": ("events", "wfocus"), "startup": ("events", "start"),
}


def recorded(raw: DataFrame, own_prefix: str = "chrome-extension://") -> DataFrame:
    """The raw rows that are recorded, with their store and kind."""
    names = F.create_map(*[x for t, (s, k) in TRIGGERS.items() for x in (F.lit(t), F.struct(F.lit(s).alias("store"), F.lit(k).alias("kind")))])
    paused = F.when(F.col("trigger") == "pause", F.col("paused"))
    rows = carried(raw.withColumn("id", F.col("seq")), paused, [], ["id"], "is_paused").drop("id")
    rows = rows.withColumn("told", names[F.col("trigger")]).where("told IS NOT NULL").select("*", "told.store", "told.kind")
    off = F.coalesce("is_paused", F.lit(False)) & (F.col("kind") != "start")
    hidden = (F.col("kind") == "nav") & ((F.coalesce("frame_id", F.lit(0)) != 0) | F.coalesce(F.col("url").startswith(own_prefix), F.lit(False)))
    return rows.where(~off & ~hidden).drop("told", "is_paused")


def shaped(rows: DataFrame) -> DataFrame:
    """Recorded rows in the log's columns, but for their ids: fields that a kind lacks are null."""
    of = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), c)
    window: Column = F.coalesce(F.col("window_id").cast("long"), F.lit(0))  # a tab that is gone has no window
    marks = F.coalesce("qualifiers", F.array().cast("array<string>"))
    at = F.when(F.col("kind").isin("nav", "link"), F.coalesce("time_stamp", "now")).otherwise(F.col("now"))
    return rows.select(
        "store", "seq", at.cast("long").alias("ts"), "kind", of(F.col("tab_id").cast("long"), "nav", "close", "focus").alias("tab"),
        of(F.when((F.col("kind") == "wfocus") & (window < 0), -1).otherwise(window), "nav", "focus", "wfocus").alias("win"),
        of(F.col("tab_id").cast("long"), "link").alias("new_tab"), of(F.col("source_tab_id").cast("long"), "link").alias("src_tab"),
        of(F.col("transition_type"), "nav").alias("transition"), F.array_contains(marks, "client_redirect").alias("redirect"),
        F.array_contains(marks, "forward_back").alias("back"), of(F.col("url"), "nav").alias("url"),
    )


def captured(raw: DataFrame, own_prefix: str = "chrome-extension://") -> dict[str, DataFrame]:
    """Both stores' logs, each with ids 1, 2, ... in firing order and hosts in IDNA form."""
    rows = shaped(recorded(raw, own_prefix))
    return {s: with_idna(numbered(rows.where(F.col("store") == s).drop("store"), "seq").drop("seq")) for s in ("events", "spa")}
