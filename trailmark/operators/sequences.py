"""Per-tab host chains of sessions, frequent sequences and journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_edge, is_ignored, provenance
from ..functions.urls import host, registrable
from ..schema import REDIRECT_WINDOW_MS
from ..sources.folders import settled

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def session_events(sessions: DataFrame, log: DataFrame, bits: int = 10) -> DataFrame:
    """Events of all windows between each session's first and last id: an equi join on blocks of ids.

    A session meets only the blocks that its range covers; the residual range is checked after.
    """
    s = sessions.select(F.col("id").alias("session"), F.col("start_id").alias("lo"), F.col("end_id").alias("hi"))
    s = s.withColumn("block", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))))
    e = log.withColumn("block", F.shiftright("id", bits))
    return e.join(s, "block").where("id between lo and hi").drop("block", "lo", "hi")


def tab_rows(events: DataFrame, by_domain: bool = False) -> DataFrame:
    """What happens to each tab of a session: session, tab, id, place, step, ts, key, prov, redirect, back, cuts, restart.

    step is nav (with a key, not ignored), close, or an end of a link: source (of the opener, which comes
    first) and spawn (of the new tab). key is the host, or its registrable domain. cuts counts the starts
    before the row, restart is the id of the next one.
    """
    rows = events.withColumn("key", F.col("host") if "host" in events.columns else host(F.col("url")))
    if by_domain:
        rows = registrable(rows, "key").withColumn("key", F.col("registrable")).drop("registrable")
    whole, start = Window.partitionBy("session").orderBy("id"), F.col("kind") == "start"
    back = Window.partitionBy("session").orderBy(F.desc("id"))
    rows = rows.withColumn("prov", provenance(F.col("transition"))).withColumn("cuts", F.count(F.when(start, 1)).over(whole.rowsBetween(*SO_FAR))).withColumn("restart", F.last(F.when(start, F.col("id")), True).over(back.rowsBetween(*BEFORE)))
    end = lambda tab, step, place: F.struct(F.col(tab).alias("tab"), F.lit(step).alias("step"), F.lit(place).alias("place"))
    kind = F.col("kind")
    told = F.when(kind == "link", F.array(end("src_tab", "source", 0), end("new_tab", "spawn", 1))).when(kind == "close", F.array(end("tab", "close", 1)))
    told = told.when((kind == "nav") & F.col("key").isNotNull() & ~is_ignored(F.col("prov")), F.array(end("tab", "nav", 1)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.select("session", "id", "ts", "key", "prov", flag("redirect"), flag("back"), "cuts", "restart", F.inline(told))


def tab_window() -> tuple:
    """Windows over a tab's rows: those before, those so far, and those after, from the last one on.

    A frame that reaches from a row to the end would be summed up anew for every row, so the time would grow with the
    square of a session; backwards it is carried.
    """
    w, back = Window.partitionBy("session", "tab").orderBy("id", "place"), Window.partitionBy("session", "tab").orderBy(F.desc("id"), F.desc("place"))
    return w.rowsBetween(*BEFORE), w.rowsBetween(*SO_FAR), back.rowsBetween(*BEFORE)


def with_opener(rows: DataFrame, page: Column, taken: str) -> DataFrame:
    """Adds opener: the opening tab's page when this tab was opened, until a row that counts in ``taken`` has used it."""
    before, _, _ = tab_window()
    rows = settled(rows)  # read twice: its windows aren't made anew for the few rows that open tabs
    sources = rows.where("step = 'source'").select("session", "id", page.alias("opened_by")).where("opened_by is not null")
    rows = rows.join(sources, ["session", "id"], "left").withColumn("opened_by", F.when(F.col("step") == "spawn", F.col("opened_by")))
    last = F.last(F.when(F.col("opened_by").isNotNull(), F.struct("opened_by", F.col(taken).alias("at"))), True).over(before)
    return rows.withColumn("opener", last).withColumn("opener", F.when(F.col("opener.at") == F.col(taken) - 1, F.col("opener.opened_by"))).drop("opened_by")


def chains(events: DataFrame, by_domain: bool = False) -> DataFrame:
    """(session, chain): each tab's chains of two keys or more.

    A link or form landing on another key lengthens the tab's chain, any other landing begins one, and a quick
    redirect replaces the last key. A chain that begins with a link in a tab that was opened from a page begins
    with that page's key. Closing a tab or starting the browser ends a chain; going back changes none.
    """
    before, so_far, _ = tab_window()
    nav = F.col("step") == "nav"
    rows = tab_rows(events, by_domain).withColumn("life", F.col("cuts") + F.count(F.when(F.col("step") == "close", 1)).over(so_far))
    soon = F.col("ts") - F.last(F.when(nav, F.col("ts")), True).over(before) < REDIRECT_WINDOW_MS
    rows = rows.withColumn("moved", nav & F.col("redirect") & F.coalesce(soon, F.lit(False))).withColumn("landing", nav & ~F.col("moved") & ~F.col("back"))
    life = Window.partitionBy("session", "tab", "life").orderBy("id", "place")
    rows = rows.withColumn("shown", F.col("landing") | (F.col("moved") & F.coalesce(F.max("landing").over(life.rowsBetween(*SO_FAR)), F.lit(False))))
    rows = rows.withColumn("end", F.last(F.when(F.col("shown"), F.col("key")), True).over(life.rowsBetween(*BEFORE)))
    rows = rows.withColumn("new", F.col("landing") & (F.col("end").isNull() | (F.col("end") != F.col("key"))))
    rows = rows.withColumn("part", F.count(F.when(F.col("new"), 1)).over(so_far)).withColumn("number", F.count(F.when(F.col("new") & (F.col("end").isNull() | ~is_edge(F.col("prov"))), 1)).over(so_far))
    rows = with_opener(rows, F.col("end"), "part").where("shown")
    first = F.when(is_edge(F.col("prov")) & F.col("end").isNull(), F.col("opener"))
    parts = rows.withColumn("first", first).groupBy("session", "tab", "number", "part").agg(F.max_by("key", "id").alias("key"), F.min_by("first", "id").alias("first"))
    whole = parts.groupBy("session", "tab", "number").agg(F.array_sort(F.collect_list(F.struct("part", "key")))["key"].alias("keys"), F.min_by("first", "part").alias("first"))
    chain = F.when(F.col("first").isNotNull(), F.concat(F.array("first"), "keys")).otherwise(F.col("keys"))
    return whole.select("session", chain.alias("chain")).where("size(chain) >= 2")


def frequent(chains_: DataFrame, min_support: int = 2, max_len: int = 5) -> DataFrame:
    """(pattern, support) of sequences of 2 to ``max_len`` hosts that at least ``min_support`` chains contain."""
    from pyspark.ml.fpm import PrefixSpan

    n = chains_.count()
    if not n:
        return chains_.select(F.col("chain").alias("pattern"), F.lit(0).cast("long").alias("support"))
    rows = chains_.select(F.transform("chain", lambda h: F.array(h)).alias("sequence"))
    found = PrefixSpan(minSupport=max(1e-12, (min_support - 0.5) / n), maxPatternLength=max_len).findFrequentSequentialPatterns(rows)
    single = F.forall("sequence", lambda s: F.size(s) == 1)
    return found.where(single & (F.size("sequence") >= 2) & (F.col("freq") >= min_support)).select(F.flatten("sequence").alias("pattern"), F.col("freq").alias("support"))


def closed(patterns: DataFrame) -> DataFrame:
    """Without patterns that begin a longer one of equal support: every prefix is looked up by an equi join."""
    p = patterns.withColumn("n", F.size("pattern"))
    prefixes = p.where("n > 2").select("support", F.explode(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda k: F.slice(F.col("pattern"), F.lit(1), k))).alias("pattern")).distinct()
    return patterns.join(prefixes, ["support", "pattern"], "left_anti").select("pattern", "support")


def journey_scope(sessions: DataFrame, newest: int = 150) -> DataFrame:
    """One row: total sessions, and whether journeys look at the newest of them only."""
    return sessions.agg(F.count("*").alias("total")).withColumn("capped", F.col("total") > newest)


def journeys(sessions: DataFrame, log: DataFrame, newest: int = 150, min_support: int = 2, max_len: int = 5, top: int = 15, by_domain: bool = False) -> DataFrame:
    recent = sessions.orderBy(F.desc("start_ts"), "id").limit(newest)
    found = closed(frequent(chains(session_events(recent, log), by_domain), min_support, max_len))
    return found.orderBy(F.desc("support"), F.desc(F.size("pattern")), "pattern").limit(top)
