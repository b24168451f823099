"""Constants, schemas and taxonomies of the navigation log."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the log's semantics.
IDLE_GAP_MS = 1_800_000
REDIRECT_WINDOW_MS = 1_000
DAY_MS = 86_400_000
SESSION_HOST_CAP = 64
TOP_HOSTS = 5
SCHEMA_VERSION = 2
KINDS = ("nav", "link", "close", "focus", "wfocus", "start")
RANGE_DAYS = {"session": 1, "day": 1, "week": 7, "month": 30, "year": 365}
#: Provenances and edge kinds in the order that breaks ties.
PROVENANCES = ("link", "form", "typed_url", "search_origin", "bookmark", "start", "reload", "other")
EDGE_KINDS = ("link", "search_link", "form")
#: Transition type -> provenance; anything else is "other".
TRANSITIONS = {
    "link": "link", "form_submit": "form", "typed": "typed_url", "generated": "search_origin", "keyword": "search_origin",
    "keyword_generated": "search_origin", "auto_bookmark": "bookmark", "start_page": "start", "reload": "reload",
}

LOG = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("tab", T.LongType()), T.StructField("win", T.LongType()), T.StructField("new_tab", T.LongType()), T.StructField("src_tab", T.LongType()),
    T.StructField("transition", T.StringType()), T.StructField("redirect", T.BooleanType()), T.StructField("back", T.BooleanType()), T.StructField("url", T.StringType()),
])
#: The wire format of one event; fields that a kind lacks are null.
WIRE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("id", T.DoubleType()), T.StructField("ts", T.DoubleType()),
    T.StructField("tabId", T.DoubleType()), T.StructField("windowId", T.DoubleType()), T.StructField("toUrl", T.StringType()),
    T.StructField("transitionType", T.StringType()), T.StructField("qualifiers", T.ArrayType(T.StringType())),
    T.StructField("newTabId", T.DoubleType()), T.StructField("sourceTabId", T.DoubleType()),
])
