"""Views of sessions and of one session: ranges, lists, searches, session-scoped rollups and steps in time."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RANGE_DAYS
from ..sources.numbering import numbered
from . import project, rollup

DAY_MS = 86_400_000


def day_window(first: date, last: date) -> tuple[int, int]:
    """[begin, end) in milliseconds of the UTC days from first to last."""
    at = lambda d: (d - date(1970, 1, 1)).days * DAY_MS
    return at(first), at(last + timedelta(days=1))


def in_range(sessions: DataFrame, range_: str, window: tuple[int, int] | None = None) -> DataFrame:
    """The sessions that a window meets; without one, those that ended within the range before the latest end.

    A range that isn't one of days, as of a session, is one day.
    """
    if window is not None:
        return sessions.where((F.col("end_ts") >= window[0]) & (F.col("start_ts") < window[1]))
    latest = sessions.agg(F.max("end_ts").alias("__latest"))  # one row
    return sessions.crossJoin(F.broadcast(latest)).where(F.col("end_ts") >= F.col("__latest") - RANGE_DAYS.get(range_, 1) * DAY_MS).drop("__latest")


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ts), tz))


def listed(sessions: DataFrame, day: date | None = None, tz: str = "UTC", hide_trivial: bool = False, search: str = "") -> DataFrame:
    """The session list: of one local day, without sessions of a single nav, with a top host that contains the search."""
    rows = sessions
    if day is not None:
        rows = rows.where(local_day(F.col("start_ts"), tz) == F.lit(day))
    if hide_trivial:
        rows = rows.where("nav_count > 1")
    if search:
        rows = rows.where(F.exists("top_hosts", lambda h: F.contains(F.lower(h["host"]), F.lit(search.lower()))))
    return rows


def find_host(nodes: DataFrame, search: str) -> DataFrame:
    """The busiest node whose key contains the search, ties by key; no row without one."""
    return nodes.where(F.contains(F.lower("key"), F.lit(search.strip().lower()))).orderBy(F.desc("visits"), "key").limit(1)


def relative(ranked: DataFrame, score: str, least: float = 0.0) -> DataFrame:
    """Adds rel: the score in hundredths of the largest, which counts as ``least`` at least."""
    top = ranked.agg(F.greatest(F.max(score), F.lit(least)).alias("__top"))  # one row
    return ranked.crossJoin(F.broadcast(top)).withColumn("rel", F.round(F.col(score) / F.col("__top") * 100).cast("int")).drop("__top")


def focus_signal(nodes: DataFrame, days: DataFrame, first: date, last: date) -> DataFrame:
    """One row, signal: whether a day of the window has a focus event or foreground time."""
    within = F.col("date").between(F.lit(first), F.lit(last))
    both = days.where(within).select(F.col("has_focus_signal").alias("s")).unionByName(nodes.where(within).select((F.col("fg_dwell_ms") > 0).alias("s")))
    return both.agg(F.coalesce(F.bool_or("s"), F.lit(False)).alias("signal"))


def counts(g: project.Graph) -> DataFrame:
    """One row: nodes, edges."""
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


def session_rollup(log: DataFrame, start_id: int, end_id: int) -> dict[str, DataFrame]:
    """The derived tables of one session's events alone, from an empty state, with what is still open.

    This is no filter of the whole log's tables: what happened before the session is unknown here.
    """
    return rollup.build(log.where(F.col("id").between(start_id, end_id)), provisional=True)


def source_log(events: DataFrame, spa: DataFrame, with_spa: bool) -> DataFrame:
    """The log that is derived from: the events, or both streams in one order with new ids, 1 and up."""
    if not with_spa:
        return events
    from ..sources.log import merged

    return numbered(merged(events, spa).drop("id"), "seq").select(*events.columns)


def top_pages(log: DataFrame, key: str, by_domain: bool = False, n: int = 25) -> DataFrame:
    """page, visits: the most visited pages of a node, which is a host, or with ``by_domain`` a registrable domain."""
    from ..functions import urls

    navs = log.where("kind = 'nav'").select(urls.host(F.col("url")).alias("host"), urls.path_query(F.col("url")).alias("page"))
    if by_domain:
        hosts = urls.registrable(navs.select("host").where("host IS NOT NULL").distinct()).where(F.col("registrable") == key)
        navs = navs.join(hosts.select("host"), "host", "left_semi")
    else:
        navs = navs.where(F.col("host") == key)
    return navs.groupBy("page").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "page").limit(n)


@dataclass(frozen=True)
class View:
    """What is shown: a range, and an anchor, which is a day, a session's id, or None for live."""

    range_: str = "week"
    day: date | None = None
    session: int | None = None


def end_day(view: View, sessions: DataFrame) -> date | None:
    """The last day of an anchored view: its day, or the UTC day on which its session began; None when live or gone."""
    if view.day is not None or view.session is None:
        return view.day
    row = sessions.where(F.col("id") == view.session).select("start_ts").first()
    return datetime.fromtimestamp(row.start_ts / 1000, timezone.utc).date() if row else None


def step(view: View, back: bool, sessions: DataFrame, earliest: date | None, latest: date | None) -> View:
    """The view one step back or forward; it stays where there is no further step, and goes live at the end.

    In the session range steps lead from session to session in order of start; an anchor that is gone starts
    again from the newest session. In ranges of days they move by the range.
    """
    if view.range_ == "session":
        order = (F.col("start_ts"), F.col("id"))
        at = sessions.where(F.col("id") == view.session).select("start_ts", "id").first() if view.session is not None else None
        if at is None:
            if not back:
                return live(view)
            newest = sessions.orderBy(*[c.desc() for c in order]).select("start_ts", "id").limit(2).collect()
            return replace(view, session=newest[-1].id) if newest else view
        key, here = F.struct(*order), F.struct(F.lit(at.start_ts).alias("start_ts"), F.lit(at.id).alias("id"))
        near = sessions.where(key < here).agg(F.max(key).alias("k")) if back else sessions.where(key > here).agg(F.min(key).alias("k"))
        found = near.first().k
        if found is None:
            return view if back else live(view)
        return replace(view, session=found.id)
    end = end_day(view, sessions) or latest
    if back:
        return replace(view, day=project.back_end(view.range_, end), session=None) if project.can_step_back(view.range_, end, earliest) else view
    if not project.can_step_forward(end_day(view, sessions), latest):
        return live(view)
    return replace(view, day=project.forward_end(view.range_, end, latest), session=None)


def live(view: View) -> View:
    return View(view.range_)


def displayed(view: View, tables: dict[str, DataFrame], log: DataFrame) -> dict[str, DataFrame]:
    """The day rollups (nodes, edges, days) that a view shows.

    In the session range those of its session alone, or of the newest one, derived from its events from an empty state;
    without any session, and in all other ranges, those of the days of its window.
    """
    if view.range_ == "session":
        sessions = tables["sessions"]
        chosen = sessions if view.session is None else sessions.where(F.col("id") == view.session)
        row = chosen.orderBy(F.desc("start_ts"), F.desc("id")).select("start_id", "end_id").first()
        if row is not None:
            return session_rollup(log, row.start_id, row.end_id)
    end = end_day(view, tables["sessions"])
    anchor = end.isoformat() if end else None
    return {n: project.select_window(tables[n], view.range_, anchor, tables["nodes"]) for n in ("nodes", "edges", "days")}
