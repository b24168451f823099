"""UTC-day rollups: building, merging, keeping and rebuilding them."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import histogram, utc_day
from ..schema import EDGE_KINDS, PROVENANCES, SCHEMA_VERSION
from ..sources.folders import settled
from ..sources.manifest import Manifest
from . import derive

PROV = [f"prov_{p}" for p in PROVENANCES]
KIND = [f"kind_{k}" for k in EDGE_KINDS]


def node_days(visits: DataFrame, fg: DataFrame | None = None) -> DataFrame:
    """date, host, visits, dwell_ms, fg_dwell_ms, prov_*: foreground credit may make a node without visits."""
    zero = F.lit(0).cast("long")
    rows = visits.select("date", "host", "prov", "dwell_ms", zero.alias("fg_ms"))
    if fg is not None:
        rows = rows.unionByName(fg.select("date", "host", F.lit(None).cast("string").alias("prov"), zero.alias("dwell_ms"), "fg_ms"))
    return rows.groupBy("date", "host").agg(F.count("prov").alias("visits"), F.sum("dwell_ms").alias("dwell_ms"), F.sum("fg_ms").alias("fg_dwell_ms"), *histogram("prov", "prov_", PROVENANCES))


def edge_days(visits: DataFrame) -> DataFrame:
    rows = visits.where("edge_kind is not null")
    return rows.groupBy("date", "src", F.col("host").alias("dst")).agg(F.count("*").alias("weight"), *histogram("edge_kind", "kind_", EDGE_KINDS))


def day_rows(visits: DataFrame, fg: DataFrame, seq: DataFrame) -> DataFrame:
    """date, max_id, has_focus_signal, visits_by_hour."""
    signal = seq.where(F.col("kind").isin("focus", "wfocus")).select(utc_day(F.col("ts")).alias("date"), F.col("id").alias("trigger_id"), F.lit(None).cast("int").alias("hour"), F.lit(True).alias("signal"))
    rows = visits.select("date", "trigger_id", "hour", F.lit(False).alias("signal")).unionByName(fg.select("date", "trigger_id", F.lit(None).cast("int").alias("hour"), F.lit(False).alias("signal"))).unionByName(signal)
    hours = F.array(*[F.count_if(F.col("hour") == h) for h in range(24)])
    return rows.groupBy("date").agg(F.max("trigger_id").alias("max_id"), F.bool_or("signal").alias("has_focus_signal"), hours.alias("visits_by_hour"))


def build(log: DataFrame, provisional: bool = False) -> dict[str, DataFrame]:
    """All derived tables of a log; with ``provisional`` pages and sessions that are still open count too.

    The ordered log, visits and foreground credits are written once each, as several tables are made of them.
    """
    seq = settled(derive.sequenced(log))
    v, fg, s = settled(derive.visits(seq)), settled(derive.foreground(seq)), derive.sessions(seq)
    v = v if provisional else v.where("not provisional")
    return {"nodes": node_days(v, fg), "edges": edge_days(v), "days": day_rows(v, fg, seq), "sessions": (s if provisional else s.where("not open")).drop("open")}


def merge(name: str, *parts: DataFrame) -> DataFrame:
    """Sums of nodes or edges, sums and maxima of days: merging deltas gives what a full build gives."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if name == "days":
        return rows.groupBy("date").agg(F.max("max_id").alias("max_id"), F.bool_or("has_focus_signal").alias("has_focus_signal"), F.array(*[F.sum(F.col("visits_by_hour")[h]) for h in range(24)]).alias("visits_by_hour"))
    keys = {"nodes": ["date", "host"], "edges": ["date", "src", "dst"]}[name]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


#: Tables whose rows replace those of the same key, and the key.
KEYED = {"sessions": "id", "meta": "key", "positions": "key"}
SUMMED = ("nodes", "edges", "days")
#: A table of more parts than this is merged into one by the commit that adds the next.
PARTS = 16


class Store:
    """A log and its derived tables in one folder, changed by commits that readers see whole or not at all.

    ``events`` and ``spa`` are appended to; nodes, edges and days add up; sessions, meta and positions hold the last put
    of each key. ``upsert`` with a batch's number counts each batch once, also when it runs again after a failure.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifest = spark, folder, Manifest(spark, folder)

    def _merged(self, name: str, parts: list) -> DataFrame:
        frames = self.manifest.frames(parts)
        if len(frames) == 1:
            return frames[0]
        if name in KEYED:  # the last put of a key holds
            key = KEYED[name]
            every = [f.withColumn("__part", F.lit(k)) for k, f in enumerate(frames)]
            rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
            last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "__part").alias("row"))
            return last.select("row.*").drop("__part")
        if name in SUMMED:
            return merge(name, *frames).select(frames[0].columns)
        return functools.reduce(lambda a, b: a.unionByName(b), frames)

    def has(self, name: str) -> bool:
        return bool(self.manifest.read()["tables"].get(name))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table with all that was added to it, of the newest commit or of a version."""
        parts = self.manifest.read(version)["tables"].get(name)
        if not parts:
            raise KeyError(f"the store has no table {name}")
        return self._merged(name, parts)

    def commit(self, put: dict[str, DataFrame], add: dict[str, DataFrame] | None = None, batch: int | None = None, drop=(), marks: dict | None = None) -> int:
        """One commit: tables of ``put`` are replaced, those of ``drop`` removed, rows of ``add`` added.

        Rows of a batch that was added before replace those it added then; a batch whose rows were merged into the
        table since is not added again. Files are written first, so a failure on the way changes nothing.
        """
        state = self.manifest.read()
        tables = {n: list(p) for n, p in state["tables"].items() if n not in drop}
        told = {**state["marks"], **(marks or {})}
        merged = dict(told.get("merged", {}))
        for name, df in put.items():
            tables[name] = [[self.manifest.put(df, name), None]]
            merged.pop(name, None)
        for name, df in (add or {}).items():
            if batch is not None and batch <= merged.get(name, -1):
                continue
            parts = [p for p in tables.get(name, []) if batch is None or p[1] != batch]
            if len(parts) >= PARTS:
                merged[name] = max([merged.get(name, -1), *(p[1] for p in parts if p[1] is not None)])
                parts = [[self.manifest.put(self._merged(name, parts), name), None]]
            tables[name] = [*parts, [self.manifest.put(df, name), batch]]
        return self.manifest.publish(state, tables, {**told, "merged": merged})

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Replaces every table given, with what was added to it."""
        self.commit(tables, marks={"schema": SCHEMA_VERSION})

    def upsert(self, deltas: dict[str, DataFrame], batch: int | None = None) -> None:
        """Adds deltas, under their batch's number if they have one."""
        self.commit({}, deltas, batch)

    def reconcile(self, log: DataFrame) -> bool:
        """Rebuilds from the log where the stored version is another or missing; says whether it did."""
        current = self.manifest.read()["marks"].get("schema") == SCHEMA_VERSION
        if not current:
            self.write(build(log))
        return not current

    def reset_derivation(self) -> None:
        """Drops what is derived, and gives the fold a new checkpoint, so that the next run folds all events anew."""
        self.commit({}, drop=(*SUMMED, "sessions"), marks={"schema": None, "fold": uuid.uuid4().hex, "merged": {}})

    def clear_all(self) -> None:
        """Drops every table, meta and positions with them."""
        self.commit({}, drop=tuple(self.manifest.read()["tables"]), marks={"schema": None, "fold": uuid.uuid4().hex, "merged": {}})

    def checkpoint(self) -> str:
        """The folder of the streaming fold's checkpoint, another one after each reset."""
        if "fold" not in self.manifest.read()["marks"]:
            self.commit({}, marks={"fold": uuid.uuid4().hex})
        return f"{self.folder}/_fold/{self.manifest.read()['marks']['fold']}"

    def rebuild(self, rebuilt: Callable[[DataFrame], dict[str, DataFrame]] = build) -> None:
        """Derives all tables from the stored events."""
        self.write(rebuilt(self.read("events")))

    # --- meta: one row for each key, its value as JSON; the last put holds

    def put_meta(self, **values) -> None:
        rows = [(k, json.dumps(v)) for k, v in values.items()]
        self.commit({}, {"meta": self.spark.createDataFrame(rows, "key string, value string")})

    def meta(self, key: str, default=None):
        """A key's value; ``default`` where there is none, or one of another kind than the default's."""
        row = self.read("meta").where(F.col("key") == key).select("value").first() if self.has("meta") else None
        if row is None:
            return default
        try:
            value = json.loads(row.value)
        except ValueError:
            return default
        alike = default is None or isinstance(value, bool) == isinstance(default, bool) and isinstance(value, (int, float) if isinstance(default, (int, float)) else type(default))
        return value if alike else default

    # --- layout positions

    def put_positions(self, positions: DataFrame) -> None:
        """Replaces the stored positions (key and coordinates)."""
        self.commit({"positions": positions})

    def positions(self) -> DataFrame | None:
        return self.read("positions") if self.has("positions") else None

    # --- redaction

    def forget(self, domain: str) -> None:
        """Takes a host's or registrable domain's navs out of both logs, and their share out of all that is derived."""
        from ..sources.log import forget

        self._redact(lambda log: forget(log, domain))

    def delete_range(self, first_ts: int, last_ts: int) -> None:
        """Takes events between two times, both included, out of both logs and out of all that is derived."""
        from ..sources.log import delete_range

        self._redact(lambda log: delete_range(log, first_ts, last_ts))

    def _redact(self, kept: Callable[[DataFrame], DataFrame]) -> None:
        from . import redaction

        put, before = {}, self.read("events")
        put["events"] = after = settled(kept(before))
        if self.has("spa"):
            put["spa"] = kept(self.read("spa"))
        if all(self.has(n) for n in (*SUMMED, "sessions")):
            put |= redaction.redacted(before, after, {n: self.read(n) for n in (*SUMMED, "sessions")})
        # The fold's state knows pages that are gone, so it begins anew; what it adds up is in the tables already.
        self.commit(put, marks={"fold": uuid.uuid4().hex})

    # --- documents

    def replace_from(self, path: str) -> None:
        """Replaces all stores by an export document's, missing arrays by nothing, and derives from its events."""
        from ..sources.log import read_document

        doc = read_document(self.spark, path)
        meta = doc["meta"].select(F.from_json("json", "key string, value string").alias("m")).select("m.*").where("key IS NOT NULL")
        events = settled(doc["events"])
        put = {"events": events, "spa": doc["spa"], "meta": meta, **build(events)}
        self.commit(put, drop=tuple(self.manifest.read()["tables"]), marks={"schema": SCHEMA_VERSION, "fold": uuid.uuid4().hex, "merged": {}})

    def counts(self) -> DataFrame:
        """One row: events, spa, rollup_days, sessions. Of tables of one part only footers are read."""
        out = self.spark.range(1).select()
        for name, table in (("events", "events"), ("spa", "spa"), ("rollup_days", "days"), ("sessions", "sessions")):
            n = self.read(table).agg(F.count("*").alias(name)) if self.has(table) else self.spark.range(1).select(F.lit(0).cast("long").alias(name))
            out = out.crossJoin(n)  # one row each
        return out
