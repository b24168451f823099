"""Range, filter and granularity queries over the day rollups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dominant, percent_change, rhythm_level
from ..functions.urls import registrable
from ..sources.numbering import numbered
from ..schema import EDGE_KINDS, PROVENANCES, RANGE_DAYS
from .rollup import KIND, PROV


@dataclass(frozen=True)
class Filters:
    """A view's filters; provenance None lets all pass, an empty tuple none."""

    min_visits: int = 0
    hide_search_hubs: bool = False
    provenance: tuple[str, ...] | None = None
    hide_isolated: bool = False


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame  # key, visits, dwell_ms, fg_dwell_ms, prov_*, dominant
    edges: DataFrame  # src, dst, weight, kind_*


def bounds(days: DataFrame, range_: str, anchor: str | None, back: int = 0) -> DataFrame:
    """One row (lo, hi): the window of the range that ends at the anchor or the latest day, ``back`` windows earlier."""
    n = RANGE_DAYS[range_]
    end = F.lit(anchor).cast("date") if anchor else F.max("date")
    return days.agg(end.alias("end")).select(F.date_sub("end", n * (back + 1) - 1).alias("lo"), F.date_sub("end", n * back).alias("hi"))


def select_window(days: DataFrame, range_: str, anchor: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """Rows of ``days`` in the window; rows without a date pass, and all do where no end is known."""
    w = bounds(of if of is not None else days, range_, anchor)
    return days.crossJoin(F.broadcast(w)).where("date is null or hi is null or date between lo and hi").drop("lo", "hi")  # one row


def project(nodes: DataFrame, edges: DataFrame, filters: Filters = Filters(), by_domain: bool = False) -> Graph:
    """Nodes and edges of a window, merged over its days, filtered; by registrable domain where asked."""
    n = nodes.groupBy(F.col("host").alias("key")).agg(*[F.sum(c).alias(c) for c in ("visits", "dwell_ms", "fg_dwell_ms", *PROV)])
    e = edges.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("weight", *KIND)])
    if by_domain:
        names = registrable(n.select(F.col("key").alias("host")).union(e.select("src")).union(e.select("dst")).distinct())
        n = n.join(names, n["key"] == names["host"]).groupBy(F.col("registrable").alias("key")).agg(*[F.sum(c).alias(c) for c in ("visits", "dwell_ms", "fg_dwell_ms", *PROV)])
        a, b = names.select(F.col("host").alias("src"), F.col("registrable").alias("s")), names.select(F.col("host").alias("dst"), F.col("registrable").alias("d"))
        e = e.join(a, "src").join(b, "dst").where("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(*[F.sum(c).alias(c) for c in ("weight", *KIND)])
    n = n.withColumn("dominant", dominant("prov_")).where(F.col("visits") >= filters.min_visits)
    if filters.hide_search_hubs:
        n = n.where("dominant <> 'search_origin'")
    if filters.provenance is not None:
        n = n.where(F.col("dominant").isin(*filters.provenance) if filters.provenance else F.lit(False))
    e = e.join(n.select(F.col("key").alias("src")), "src", "left_semi").join(n.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst", "weight", *KIND)
    if filters.hide_isolated:
        n = n.join(e.select(F.col("src").alias("key")).union(e.select("dst")).distinct(), "key", "left_semi")
    return Graph(n, e)


def ranked_nodes(g: Graph) -> DataFrame:
    return g.nodes.orderBy(F.desc("visits"), "key")


def top_edges(g: Graph, n: int) -> DataFrame:
    return g.edges.orderBy(F.desc("weight"), "src", "dst").limit(n)


def range_stats(nodes: DataFrame, range_: str, anchor: str | None = None) -> DataFrame:
    """hosts, visits, new_hosts (first seen ever in the window), revisit_rate; never below zero."""
    w = bounds(nodes, range_, anchor)
    inside = F.col("date").isNull() | F.col("date").between(F.col("lo"), F.col("hi"))
    by = nodes.crossJoin(F.broadcast(w)).groupBy("host").agg(F.sum(F.when(inside, F.col("visits")).otherwise(0)).alias("v"), F.bool_or(inside).alias("here"), F.min("date").alias("first"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    out = by.agg(F.count_if("here").alias("hosts"), F.coalesce(F.sum("v"), F.lit(0)).alias("visits"), F.count_if(F.col("first").between(F.col("lo"), F.col("hi"))).alias("new_hosts"))
    return out.withColumn("revisit_rate", F.when(F.col("visits") > 0, F.greatest(F.col("visits") - F.col("hosts"), F.lit(0)) / F.col("visits")).otherwise(0.0))


def daily_series(nodes: DataFrame, range_: str, anchor: str | None = None) -> DataFrame:
    return select_window(nodes.where("date is not null"), range_, anchor).groupBy("date").agg(F.sum("visits").alias("visits")).orderBy("date")


def rhythm(days: DataFrame, offset_hours: int = 0) -> DataFrame:
    """weekday (0 = Monday), hour, visits, level of all 168 cells, shifted by whole hours."""
    cells = days.select(F.unix_date("date").alias("d"), F.posexplode("visits_by_hour").alias("h", "v"))
    shifted = F.col("h") + offset_hours
    cells = cells.select(F.pmod(F.col("d") + F.floor(shifted / 24) + 3, F.lit(7)).alias("weekday"), F.pmod(shifted, F.lit(24)).alias("hour"), "v").groupBy("weekday", "hour").agg(F.sum("v").alias("visits"))
    grid = days.sparkSession.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    out = grid.join(cells, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("visits", F.lit(0)).alias("visits"))
    return out.withColumn("level", rhythm_level(F.col("visits"), F.max("visits").over(Window.partitionBy())))  # 168 rows


def _two_windows(nodes: DataFrame, range_: str, anchor: str | None) -> DataFrame:
    now, prev = bounds(nodes, range_, anchor), bounds(nodes, range_, anchor, 1).toDF("plo", "phi")
    both = nodes.crossJoin(F.broadcast(now)).crossJoin(F.broadcast(prev))  # one row each
    v = lambda lo, hi: F.sum(F.when(F.col("date").between(F.col(lo), F.col(hi)), F.col("visits")))
    return both.groupBy("host").agg(v("lo", "hi").alias("now"), v("plo", "phi").alias("prev"), F.min("date").alias("first"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("plo").alias("plo"), F.first("phi").alias("phi"))


def period_delta(nodes: DataFrame, range_: str, anchor: str | None = None) -> DataFrame:
    by = _two_windows(nodes, range_, anchor)
    out = by.agg(
        *[F.coalesce(F.sum(w), F.lit(0)).alias(f"{w}_visits") for w in ("now", "prev")], *[F.count(w).alias(f"{w}_hosts") for w in ("now", "prev")],
        F.count_if(F.col("first").between(F.col("lo"), F.col("hi"))).alias("now_new"), F.count_if(F.col("first").between(F.col("plo"), F.col("phi"))).alias("prev_new"),
    )
    return out.select("*", *[percent_change(F.col(f"now_{c}"), F.col(f"prev_{c}")).alias(f"{c}_pct") for c in ("visits", "hosts", "new")], (F.col("prev_visits") == 0).alias("no_baseline"))


def surging(nodes: DataFrame, range_: str, anchor: str | None = None, min_now: int = 3, top: int = 6) -> DataFrame:
    by = _two_windows(nodes, range_, anchor).select("host", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("prev", F.lit(0)).alias("prev"))
    return by.where((F.col("now") >= min_now) & (F.col("now") > F.col("prev"))).orderBy(F.desc(F.col("now") / F.greatest(F.col("prev"), F.lit(1))), F.desc("now"), "host").limit(top)


def origination(nodes: DataFrame) -> DataFrame:
    """provenance, n over all history."""
    total = nodes.agg(*[F.coalesce(F.sum(f"prov_{p}"), F.lit(0)).alias(p) for p in PROVENANCES])
    return total.select(F.expr("stack(8, " + ", ".join(f"'{p}', {p}" for p in PROVENANCES) + ") as (provenance, n)"))


def percentages(counts: DataFrame, n: str = "n", order: Column | None = None) -> DataFrame:
    """Adds pct: whole percents that sum to 100 by largest remainders, ties in order. For a handful of rows."""
    every = Window.partitionBy()
    rows = counts.withColumn("__t", F.sum(n).over(every)).withColumn("__x", F.when(F.col("__t") > 0, F.col(n) * 100 / F.col("__t")).otherwise(0.0))
    rows = rows.withColumn("__left", 100 - F.sum(F.floor("__x")).over(every)).withColumn("__r", F.row_number().over(Window.orderBy(F.desc(F.col("__x") - F.floor("__x")), order if order is not None else F.lit(0))))
    return rows.withColumn("pct", F.when(F.col("__t") == 0, 0).otherwise(F.floor("__x") + (F.col("__r") <= F.col("__left")).cast("int"))).drop("__t", "__x", "__left", "__r")


def legend(g: Graph) -> DataFrame:
    """provenance, n of the visible nodes, reload folded into other, zero rows dropped."""
    o = origination(g.nodes).select(F.when(F.col("provenance") == "reload", "other").otherwise(F.col("provenance")).alias("provenance"), "n")
    return o.groupBy("provenance").agg(F.sum("n").alias("n")).where("n > 0")


def edge_legend(g: Graph) -> DataFrame:
    total = g.edges.agg(*[F.coalesce(F.sum(f"kind_{k}"), F.lit(0)).alias(k) for k in EDGE_KINDS])
    return total.select(F.expr("stack(3, " + ", ".join(f"'{k}', {k}" for k in EDGE_KINDS) + ") as (kind, n)")).where("n > 0")


def visit_thresholds(most: int) -> list[int]:
    """1 and the 1-2-5 steps up to the most; of more than six, 1 and the five largest."""
    steps = [b * 10**k for k in range(19) for b in (1, 2, 5) if 1 < b * 10**k <= most]
    return [1, *steps[-5:]]


def host_detail(nodes: DataFrame, range_: str, anchor: str | None = None) -> DataFrame:
    """Each host's visits in the window, share of the window's visits, first and last day seen ever."""
    w = bounds(nodes, range_, anchor)
    inside = F.col("date").between(F.col("lo"), F.col("hi"))
    by = nodes.crossJoin(F.broadcast(w)).groupBy("host").agg(F.sum(F.when(inside, F.col("visits")).otherwise(0)).alias("visits"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    total = by.agg(F.sum("visits").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("host", "visits", F.when(F.col("total") > 0, F.col("visits") / F.col("total")).otherwise(0.0).alias("share"), "first_seen", "last_seen")


def host_days(nodes: DataFrame, host: str, range_: str, anchor: str | None = None) -> DataFrame:
    """A host's visits on every day that the window has, zeros included."""
    w = select_window(nodes, range_, anchor)
    return w.groupBy("date").agg(F.sum(F.when(F.col("host") == host, F.col("visits")).otherwise(0)).alias("visits")).orderBy("date")


# --- time navigation: plain dates, no data


def day_of(iso: str | None) -> date | None:
    try:
        return date.fromisoformat(iso) if iso else None
    except ValueError:
        return None


def can_step_back(range_: str, end: date | None, earliest: date | None) -> bool:
    """The window before must begin on the earliest day or later."""
    if end is None or earliest is None:
        return False
    return end - timedelta(days=2 * RANGE_DAYS[range_] - 1) >= earliest


def can_step_forward(anchor: date | None, latest: date | None) -> bool:
    return anchor is not None and latest is not None and anchor < latest


def back_end(range_: str, end: date) -> date:
    return end - timedelta(days=RANGE_DAYS[range_])


def forward_end(range_: str, end: date, latest: date | None) -> date | None:
    """None is live: the next window would reach the latest day."""
    nxt = end + timedelta(days=RANGE_DAYS[range_])
    return None if latest is None or nxt >= latest else nxt


def session_steps(sessions: DataFrame) -> DataFrame:
    """id with the ids of the sessions before and after it in order of start."""
    at = numbered(sessions.select("id", "start_ts"), "start_ts", "id", name="n").select("id", "n")
    back, forward = (at.select((F.col("n") + d).alias("n"), F.col("id").alias(c)) for d, c in ((1, "back"), (-1, "forward")))
    return at.join(back, "n", "left").join(forward, "n", "left").select("id", "back", "forward")


# --- sessions


def session_activity(sessions: DataFrame) -> DataFrame:
    """n, median navs (the upper of two), busiest hour and weekday (the later of ties), longest run."""
    hour, weekday = F.floor(F.pmod("start_ts", F.lit(86_400_000)) / 3_600_000), F.pmod(F.floor(F.col("start_ts") / 86_400_000) + 3, F.lit(7))
    s = sessions.select("nav_count", hour.alias("hour"), weekday.alias("weekday"), (F.col("end_ts") - F.col("start_ts")).alias("run"))
    most = lambda c: s.groupBy(c).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", c))[c].alias(f"busiest_{c}"))
    counts = s.groupBy("nav_count").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("nav_count"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    median = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("nav_count").alias("median_navs"))
    return s.agg(F.count("*").alias("n"), F.max("run").alias("longest_ms")).crossJoin(median).crossJoin(most("hour")).crossJoin(most("weekday"))  # one row each


def calendar(sessions: DataFrame, tz: str = "UTC") -> DataFrame:
    """day, sessions, navs of each local day that has a session."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("start_ts"), tz))
    return sessions.groupBy(day.alias("day")).agg(F.count("*").alias("sessions"), F.sum("nav_count").alias("navs"))


def hosts_of(nodes: DataFrame, domain: str, range_: str, anchor: str | None = None) -> DataFrame:
    """host, visits: the hosts that a registrable domain's node stands for in the window, busiest first."""
    by = select_window(nodes, range_, anchor).groupBy("host").agg(F.sum("visits").alias("visits"))
    told = registrable(by.select("host"))
    return by.join(told.where(F.col("registrable") == domain), "host").select("host", "visits").orderBy(F.desc("visits"), "host")


def calendar_grid(sessions: DataFrame, today: date, tz: str = "UTC", weeks: int = 53) -> DataFrame:
    """Every local day of the ``weeks`` weeks, from Sunday on, that end with today's: day, week, weekday, sessions, navs, level.

    Days without a session have zeros; days after today are in the grid too. Levels are quarters of the busiest day's
    navs, of all days that have sessions. Local days follow the zone's clock changes.
    """
    sunday = today - timedelta(days=(today.weekday() + 1) % 7)
    n = sessions.sparkSession.range(7 * weeks).select(F.col("id").cast("int").alias("n"))
    grid = n.select(F.date_add(F.lit(sunday - timedelta(weeks=weeks - 1)), F.col("n")).alias("day"), F.floor(F.col("n") / 7).cast("int").alias("week"), (F.col("n") % 7).alias("weekday"))
    days = calendar(sessions, tz)
    most = days.agg(F.greatest(F.coalesce(F.max("navs"), F.lit(1)), F.lit(1)).alias("most"))  # one row
    told = grid.join(days, "day", "left").fillna(0, ["sessions", "navs"]).crossJoin(F.broadcast(most))
    return told.select("day", "week", "weekday", "sessions", "navs", rhythm_level(F.col("navs"), F.col("most")).alias("level"))


def local_activity(sessions: DataFrame, tz: str = "UTC") -> DataFrame:
    """n, median_navs (the upper of two), busiest_hour, busiest_weekday (0 is Sunday), longest_navs, longest_host.

    Hours and days are local. Of equal counts the later hour or day is the busiest, of equal runs the later session the
    longest. No row without sessions.
    """
    at = F.from_utc_timestamp(F.timestamp_millis("start_ts"), tz)
    s = sessions.select("id", "nav_count", F.hour(at).alias("hour"), (F.dayofweek(at) - 1).alias("weekday"), F.try_element_at("top_hosts", F.lit(1))["host"].alias("host"))
    most = lambda c: s.groupBy(c).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", c))[c].alias(f"busiest_{c}"))
    counts = s.groupBy("nav_count").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("nav_count"))).withColumn("all", F.sum("n").over(Window.partitionBy()))  # a row for each count
    median = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("nav_count").alias("median_navs"))
    longest = F.max(F.struct("nav_count", "id", "host"))
    one = s.agg(F.count("*").alias("n"), longest["nav_count"].alias("longest_navs"), longest["host"].alias("longest_host")).where("n > 0")
    return one.crossJoin(median).crossJoin(most("hour")).crossJoin(most("weekday"))  # one row each


def signature(g: Graph) -> DataFrame:
    """One row, signature: equal for equal sets of nodes and edges, whatever their order and visits."""
    n = g.nodes.agg(F.count("*").alias("a"), F.coalesce(F.bit_xor(F.xxhash64("key")), F.lit(0)).alias("b"))
    e = g.edges.agg(F.count("*").alias("c"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0)).alias("d"))
    return n.crossJoin(e).select(F.xxhash64("a", "b", "c", "d").alias("signature"))  # one row each
