"""Incremental derivation: the state of one log between batches, and a streaming query that keeps it.

The state cannot be keyed by tab (links cross tabs, a start clears all), so it is keyed by log (profile);
logs are independent and run in parallel. A batch of a log, in order of id, is folded into contributions
that have the columns of the batch derivation's visits, foreground and sessions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import AUTHORITY, CODED, idna
from ..schema import IDLE_GAP_MS, KINDS, REDIRECT_WINDOW_MS, SESSION_HOST_CAP, TOP_HOSTS, TRANSITIONS

_HOST, _CODED, _BAD = re.compile(AUTHORITY), re.compile(CODED), re.compile(r"[\s<>^|%/?#@]")
FIELDS = ("id", "ts", "kind", "tab", "win", "new_tab", "src_tab", "transition", "redirect", "back", "url")


def host_of(url: str | None) -> str | None:
    m = _HOST.search(url or "")
    if m is None and (m := _CODED.search(url or "")):
        name = idna(unquote(m.group(1)).lower())
        return None if name is None or _BAD.search(name) else name.strip()
    return idna(m.group(1).lower()) if m else None


class Fold:
    """The checkpoint of a log's derivation; ``feed`` moves it over events and returns what they contribute."""

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.pages: dict[int, list] = {int(k): v for k, v in s.get("pages", {}).items()}  # tab -> last [url, prov]
        self.held: dict[int, dict] = {int(k): v for k, v in s.get("held", {}).items()}  # tab -> page not yet stable
        self.origins: dict[int, list] = {int(k): v for k, v in s.get("origins", {}).items()}  # new tab -> opener's page
        self.runs: dict[int, dict] = {int(k): v for k, v in s.get("runs", {}).items()}  # window -> open session
        self.active: dict[int, int] = {int(k): v for k, v in s.get("active", {}).items()}  # window -> tab
        self.focused, self.last_ts, self.watermark = s.get("focused"), s.get("last_ts"), s.get("watermark", 0)

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("pages", "held", "origins", "runs", "active", "focused", "last_ts", "watermark")}

    def _page(self, tab: int) -> list | None:
        h = self.held.get(tab)
        return [h["url"], h["prov"]] if h else self.pages.get(tab)

    def _visit(self, h: dict, gone: dict | None) -> list[dict]:
        """A held page's contribution; without ``gone`` it is provisional."""
        host = host_of(h["url"])
        if host is None:
            return []
        src = host_of(h["from"][0]) if h["from"] else None
        kind = None
        if h["prov"] in ("link", "form") and src is not None and src != host:
            kind = "search_link" if h["from"][1] == "search_origin" else h["prov"]
        dwell = max(0, min(IDLE_GAP_MS, gone["ts"] - h["ts"])) if gone else 0
        return [{"what": "visit", "host": host, "prov": h["prov"], "ts": h["ts"], "id": h["id"], "ms": dwell, "trigger_id": gone["id"] if gone else h["id"], "src": src if kind else None, "edge_kind": kind}]

    def _settle(self, tab: int, gone: dict) -> list[dict]:
        h = self.held.pop(tab, None)
        if h is None:
            return []
        self.pages[tab] = [h["url"], h["prov"]]
        return self._visit(h, gone)

    def _session(self, run: dict) -> dict:
        top = sorted(run["hosts"].items(), key=lambda x: (-x[1], x[0]))[:TOP_HOSTS]
        return {"what": "session", "id": run["start_id"], "ts": run["start_ts"], "json": json.dumps({**{k: run[k] for k in ("win", "start_ts", "end_ts", "start_id", "end_id", "nav_count")}, "top_hosts": top})}

    def _in_session(self, e: dict) -> list[dict]:
        run, out = self.runs.get(e["win"]), []
        if run is not None and max(0, e["ts"] - run["end_ts"]) > IDLE_GAP_MS:
            out, run = [self._session(run)], None
        if run is None:
            run = self.runs[e["win"]] = {"win": e["win"], "start_ts": e["ts"], "start_id": e["id"], "nav_count": 0, "hosts": {}}
        run["end_ts"], run["end_id"], run["nav_count"] = e["ts"], e["id"], run["nav_count"] + 1
        host = host_of(e["url"])
        if host is not None and (host in run["hosts"] or len(run["hosts"]) < SESSION_HOST_CAP):
            run["hosts"][host] = run["hosts"].get(host, 0) + 1
        return out

    def feed(self, events: Iterable[dict]) -> list[dict]:
        out: list[dict] = []
        for e in events:
            if e["kind"] not in KINDS or e["id"] <= self.watermark:
                continue
            if self.last_ts is not None and self.focused is not None and self.focused >= 0 and self.focused in self.active:
                ms, page = max(0, min(IDLE_GAP_MS, e["ts"] - self.last_ts)), self._page(self.active[self.focused])
                if ms and page and (host := host_of(page[0])):
                    out.append({"what": "fg", "host": host, "ts": self.last_ts, "ms": ms, "trigger_id": e["id"]})
            out += getattr(self, "_" + e["kind"])(e)
            self.last_ts, self.watermark = e["ts"], e["id"]
        return out

    def _start(self, e: dict) -> list[dict]:
        out = [x for tab in sorted(self.held) for x in self._settle(tab, e)] + [self._session(self.runs[w]) for w in sorted(self.runs)]
        self.pages, self.held, self.origins, self.runs, self.active, self.focused = {}, {}, {}, {}, {}, None
        return out

    def _close(self, e: dict) -> list[dict]:
        out = self._settle(e["tab"], e)
        self.pages.pop(e["tab"], None)
        self.origins.pop(e["tab"], None)
        self.active = {w: t for w, t in self.active.items() if t != e["tab"]}
        return out

    def _link(self, e: dict) -> list[dict]:
        page = self._page(e["src_tab"])
        for d in (self.held, self.pages, self.origins):  # a page held there is dropped
            d.pop(e["new_tab"], None)
        if page:
            self.origins[e["new_tab"]] = page
        return []

    def _focus(self, e: dict) -> list[dict]:
        self.active[e["win"]] = e["tab"]
        return [{"what": "signal", "ts": e["ts"], "trigger_id": e["id"]}]

    def _wfocus(self, e: dict) -> list[dict]:
        self.focused = e["win"]
        return [{"what": "signal", "ts": e["ts"], "trigger_id": e["id"]}]

    def _nav(self, e: dict) -> list[dict]:
        out, tab, prov = self._in_session(e), e["tab"], TRANSITIONS.get(e["transition"], "other")
        if prov in ("reload", "other"):
            return out
        held = self.held.get(tab)
        if e["redirect"] and held and e["ts"] - held["ts"] < REDIRECT_WINDOW_MS:
            held.update(url=e["url"], prov=prov, ts=e["ts"], id=e["id"])
            return out
        out += self._settle(tab, e)
        if e["back"]:
            self.pages[tab] = [e["url"], prov]
            return out
        self.held[tab] = {"url": e["url"], "prov": prov, "ts": e["ts"], "id": e["id"], "from": self.origins.pop(tab, None) or self.pages.get(tab)}
        return out

    def provisional(self) -> list[dict]:
        """What is still open: pages without dwell, and sessions."""
        return [x for tab in sorted(self.held) for x in self._visit(self.held[tab], None)] + [self._session(self.runs[w]) for w in sorted(self.runs)]


OUT = "profile string, what string, host string, prov string, ts bigint, id bigint, ms bigint, trigger_id bigint, src string, edge_kind string, json string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


#: Rows of a batch that are Python objects at one time.
STEP = 20_000


def _advance(key, frames, state):
    """One profile's micro-batch: its rows come in several unordered frames, so they are put in order first."""
    pdf = pd.concat(list(frames), ignore_index=True)[list(FIELDS)].sort_values("id")
    fold = Fold(json.loads(state.get[0]) if state.exists else None)
    for at in range(0, len(pdf), STEP):
        part = pdf.iloc[at : at + STEP].astype(object).to_dict("records")
        rows = ({k: (None if v is None or v != v else int(v) if k in ("id", "ts", "tab", "win", "new_tab", "src_tab") else v) for k, v in r.items()} for r in part)
        got = fold.feed(rows)
        if at + STEP >= len(pdf):
            state.update((json.dumps(fold.state()),))
        # Plain objects: a column of Arrow strings in several chunks can't be sent back.
        yield pd.DataFrame({c: pd.Series([key[0] if c == "profile" else g.get(c) for g in got], dtype=object) for c in COLUMNS})


def contributions(stream: DataFrame, profile: str | None = None) -> DataFrame:
    """A streaming table of contributions of a stream with the log's columns; ``profile`` names the log's column."""
    rows = stream.withColumn("profile", F.col(profile).cast("string") if profile else F.lit("default")).select("profile", *FIELDS)
    return rows.groupBy("profile").applyInPandasWithState(_advance, OUT, "state string", "append", "NoTimeout")


SESSION = "win bigint, start_ts bigint, end_ts bigint, start_id bigint, end_id bigint, nav_count bigint, top_hosts array<array<string>>"


def batches(out: DataFrame) -> dict[str, DataFrame]:
    """Contributions as visits, foreground, signal and session rows of the batch derivation."""
    from ..functions.scalars import utc_day, utc_hour

    day = utc_day(F.col("ts"))
    visits = out.where("what = 'visit'").select(day.alias("date"), utc_hour(F.col("ts")).alias("hour"), "host", "prov", "ts", "id", F.col("ms").alias("dwell_ms"), "trigger_id", F.lit(False).alias("provisional"), "src", "edge_kind")
    return {
        "visits": visits, "fg": out.where("what = 'fg'").select(day.alias("date"), "host", F.col("ms").alias("fg_ms"), "trigger_id"),
        "signals": out.where("what = 'signal'").select(F.lit("focus").alias("kind"), "ts", F.col("trigger_id").alias("id")),
        "sessions": out.where("what = 'session'").select("id", "json"),
    }


def deltas(out: DataFrame) -> dict[str, DataFrame]:
    """Contributions as rows of the store's tables."""
    from ..operators import rollup

    parts = batches(out)
    told = parts["sessions"].select("id", F.from_json("json", SESSION).alias("s")).select("id", "s.*")
    top = F.transform("top_hosts", lambda t: F.struct(t[0].alias("host"), t[1].cast("long").alias("n")))
    return {
        "nodes": rollup.node_days(parts["visits"], parts["fg"]), "edges": rollup.edge_days(parts["visits"]),
        "days": rollup.day_rows(parts["visits"], parts["fg"], parts["signals"]), "sessions": told.withColumn("top_hosts", top),
    }


def into(store, stream: DataFrame, trigger: dict | None = None):
    """Starts a query that folds a stream of one log into a store's tables, one commit for each micro-batch.

    A batch's tables are committed together under its number. One that runs again, after it was lost on the way or
    after its commit, counts once.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            store.upsert(deltas(df), batch)
        finally:
            df.unpersist()

    writer = contributions(stream).writeStream.foreachBatch(write).option("checkpointLocation", store.checkpoint())
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def into_by_blocks(store, log: DataFrame, folder: str, rows: int = 1 << 19) -> None:
    """Folds a log that is there as a whole into a store as a stream of blocks of ``rows`` ids, in their order.

    A micro-batch of a log is one task's rows, so the log is written in order and handed to the stream block by block.
    """
    from ..sources.folders import settled

    block = F.floor(F.col("id") / rows)
    written = settled(log.repartitionByRange("id").sortWithinPartitions("id"))
    for b in sorted(r.b for r in written.select(block.alias("b")).distinct().collect()):  # a number for each block
        part = written.where(F.col("id").between(b * rows, (b + 1) * rows - 1))
        part.coalesce(1).write.mode("append").parquet(folder)
        running = into(store, store.spark.readStream.schema(written.schema).parquet(folder))
        running.awaitTermination()


def still_open(spark, checkpoint: str) -> DataFrame:
    """The contributions of pages and sessions that are open as of a stream's last batch, from its state."""
    state = spark.read.format("statestore").load(checkpoint).selectExpr("key.profile AS profile", "value.*")
    kept = state.select("profile", F.col(f"`{state.columns[1]}`.state").alias("state") if "state" not in state.columns else "state")

    def told(frames):
        for pdf in frames:
            for profile, text in zip(pdf["profile"], pdf["state"]):
                got = Fold(json.loads(text)).provisional()
                rows = {c: pd.Series([profile if c == "profile" else g.get(c) for g in got], dtype=object) for c in COLUMNS}
                yield pd.DataFrame(rows)

    return kept.mapInPandas(told, OUT)


def live(store) -> dict[str, DataFrame]:
    """The store's tables with what is still open counted in; nothing of it is kept."""
    from ..operators import rollup

    more = deltas(still_open(store.spark, store.checkpoint()))
    out = {n: rollup.merge(n, store.read(n), more[n].select(store.read(n).columns)) for n in rollup.SUMMED}
    kept = store.read("sessions")
    return {**out, "sessions": kept.withColumn("open", F.lit(False)).unionByName(more["sessions"].select(kept.columns).withColumn("open", F.lit(True)))}


def keep(stream: DataFrame, folder: str, checkpoint: str, profile: str | None = None):
    """Starts a query that appends contributions under their batch number: a batch that runs again replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return contributions(stream, profile).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
