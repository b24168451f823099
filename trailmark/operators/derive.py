"""The derivation: visits, edges, foreground time and sessions from the ordered log.

A sequential fold over the log would need one task for all of it. Its state is determined by boundaries
and the row before, so it is written as windows over (epoch, tab) and (epoch, window); the two global
running values, the epoch and the time of the event before, are made in two levels: within blocks of ids,
and over one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_edge, is_ignored, provenance, utc_day, utc_hour
from ..functions.urls import host
from ..schema import IDLE_GAP_MS, KINDS, REDIRECT_WINDOW_MS, SESSION_HOST_CAP, TOP_HOSTS
from ..sources.folders import settled

BLOCK_BITS = 17
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def in_blocks(log: DataFrame) -> DataFrame:
    """Known kinds only, with prov, host, block (of ids), and starts, prev_ts, prev_id, next_ts and next_id within the block."""
    rows = log.where(F.col("kind").isin(*KINDS)).withColumn("block", F.shiftright("id", BLOCK_BITS))
    nav, own = F.col("kind") == "nav", Window.partitionBy("block").orderBy("id")
    near = [f(c).over(own).alias(f"{n}_{c}") for n, f in (("prev", F.lag), ("next", F.lead)) for c in ("ts", "id")]
    starts = F.sum(F.when(F.col("kind") == "start", 1).otherwise(0)).over(own.rowsBetween(*SO_FAR))
    rows = rows.select("*", starts.alias("starts"), *near)
    return rows.withColumns({"prov": F.when(nav, provenance(F.col("transition"))), "host": F.when(nav, host(F.col("url")))})


def blocks_of(rows: DataFrame) -> DataFrame:
    """What a block of ``in_blocks`` takes over from those before and after it: a row for each block."""
    ends = [f("ts", "id").alias(n) for f, n in ((F.max_by, "ts"), (F.min_by, "ts1"))] + [F.max("id").alias("id"), F.min("id").alias("id1")]
    blocks = rows.groupBy("block").agg(F.max("starts").alias("starts"), *ends)
    w = Window.orderBy("block")  # a row for each block of ids
    return blocks.select("block", F.coalesce(F.sum("starts").over(w.rowsBetween(*BEFORE)), F.lit(0)).alias("epoch0"), F.lag("ts").over(w).alias("ts0"), F.lag("id").over(w).alias("id0"), F.lead("ts1").over(w).alias("ts1"), F.lead("id1").over(w).alias("id1"))


def across(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The log of ``in_blocks`` with epoch (starts so far), prev_ts, prev_id, next_ts and next_id (of any known kind)."""
    near = {f"{n}_{c}": F.coalesce(f"{n}_{c}", f"{c}{k}") for n, k in (("prev", 0), ("next", 1)) for c in ("ts", "id")}
    out = rows.join(F.broadcast(blocks), "block").withColumns({"epoch": F.col("epoch0") + F.col("starts"), **near})
    return out.drop("block", "starts", *[c for c in blocks.columns if c != "block"])


def sequenced(log: DataFrame) -> DataFrame:
    """Known kinds only, with prov, host, epoch (starts so far), prev_ts, prev_id, next_ts and next_id (of any known kind).

    The log is read once: its blocks are written, and what crosses them is added from a row for each.
    """
    rows = settled(in_blocks(log))
    return across(rows, settled(blocks_of(rows)))


def tab_rows(seq: DataFrame) -> DataFrame:
    """Rows that matter to a tab: effective navs, closes, and a link's two ends (the source end first)."""
    row = lambda tab, step, place: F.struct(F.col(tab).alias("t"), F.lit(step).alias("step"), F.lit(place).alias("place"))
    kind = F.col("kind")
    ends = F.when(kind == "link", F.array(row("src_tab", "source", 0), row("new_tab", "link", 1))).when(kind == "close", F.array(row("tab", "close", 1))).when((kind == "nav") & ~is_ignored(F.col("prov")), F.array(row("tab", "nav", 1)))
    return seq.where(kind.isin("nav", "close", "link")).select("epoch", "id", "ts", "host", "prov", "redirect", "back", F.inline(ends)).withColumnRenamed("t", "tab")


def visits(seq: DataFrame) -> DataFrame:
    """One row for each landing that was stable: date, hour, host, prov, ts, id, dwell_ms, trigger_id, provisional, src, edge_kind.

    src and edge_kind are set where the landing is a traversal from another host. provisional rows are
    pages still open at the log's end, with no dwell.
    """
    by_tab = Window.partitionBy("epoch", "tab")
    forward, backward = by_tab.orderBy("id", "place"), by_tab.orderBy(F.desc("id"), F.desc("place"))
    bound = F.col("step").isin("close", "link")
    rows = tab_rows(seq).select(
        "*", F.sum(F.when(bound, 1).otherwise(0)).over(forward.rowsBetween(*SO_FAR)).alias("inc"),
        F.last(F.when(bound, F.struct("step", "id")), True).over(forward.rowsBetween(*SO_FAR)).alias("opened"),
        F.last(F.when(bound, F.struct("step", "ts", "id")), True).over(backward.rowsBetween(*BEFORE)).alias("closed"),
    )
    page = F.last(F.when(F.col("step") == "nav", F.struct("inc", "host", "prov")), True).over(forward.rowsBetween(*BEFORE))
    pending = rows.withColumn("page", page).where((F.col("step") == "source") & (F.col("page.inc") == F.col("inc"))).select(F.col("id").alias("link_id"), F.col("page.host").alias("pending_host"), F.col("page.prov").alias("pending_prov"))
    own = Window.partitionBy("epoch", "tab", "inc").orderBy("id")
    navs = rows.where("step = 'nav'").select(
        "*", F.coalesce(F.col("redirect") & (F.col("ts") - F.lag("ts").over(own) < REDIRECT_WINDOW_MS), F.lit(False)).alias("near"),
        (~F.coalesce("back", F.lit(False))).alias("fresh"), F.lag("host").over(own).alias("prev_host"), F.lag("prov").over(own).alias("prev_prov"),
        F.lead("ts").over(own).alias("next_ts"), F.lead("id").over(own).alias("next_id"),
    ).withColumn("g", F.sum(F.col("fresh").cast("int")).over(own.rowsBetween(*SO_FAR)))
    unbroken = F.min(F.col("fresh") | F.col("near")).over(Window.partitionBy("epoch", "tab", "inc", "g").orderBy("id").rowsBetween(*SO_FAR))
    navs = navs.withColumn("buffered", (F.col("g") > 0) & unbroken)
    navs = navs.withColumn("collapsed", F.col("near") & F.coalesce(F.lag("buffered").over(own), F.lit(False)))
    navs = navs.withColumn("burst", F.sum((~F.col("collapsed")).cast("int")).over(own.rowsBetween(*SO_FAR)))
    bursts = navs.groupBy("epoch", "tab", "inc", "burst").agg(
        F.min_by(F.struct("buffered", "prev_host", "prev_prov", "fresh", "g"), "id").alias("head"),
        F.max_by(F.struct("id", "ts", "host", "prov", "next_ts", "next_id", "opened", "closed"), "id").alias("last"),
    ).where("head.buffered")
    bursts = bursts.select(
        "epoch", "last.id", "last.ts", "last.prov", "last.host", F.col("last.next_ts").alias("next_ts"), F.col("last.next_id").alias("next_id"), "last.closed",
        F.col("head.prev_host").alias("prev_host"), F.col("head.prev_prov").alias("prev_prov"),
        F.when((F.col("last.opened.step") == "link") & F.col("head.fresh") & (F.col("head.g") == 1), F.col("last.opened.id")).alias("link_id"),
    ).where("host is not null")
    starts = seq.where("kind = 'start'").select((F.col("epoch") - 1).alias("epoch"), F.col("ts").alias("start_ts"), F.col("id").alias("start_id"))
    all_ = bursts.join(starts, "epoch", "left").join(pending, "link_id", "left")
    departed = F.when(F.col("next_id").isNotNull(), F.struct(F.col("next_ts").alias("ts"), F.col("next_id").alias("id"))).when(F.col("closed").isNotNull(), F.struct(F.col("closed.ts").alias("ts"), F.col("closed.id").alias("id"))).when(F.col("start_id").isNotNull(), F.struct(F.col("start_ts").alias("ts"), F.col("start_id").alias("id")))
    dropped = F.col("next_id").isNull() & F.coalesce(F.col("closed.step") == "link", F.lit(False))
    spawned = F.col("pending_prov").isNotNull()
    src, src_prov = F.when(spawned, F.col("pending_host")).otherwise(F.col("prev_host")), F.when(spawned, F.col("pending_prov")).otherwise(F.col("prev_prov"))
    kind = F.when(is_edge(F.col("prov")) & src.isNotNull() & (src != F.col("host")), F.when(src_prov == "search_origin", "search_link").when(F.col("prov") == "form", "form").otherwise("link"))
    out = all_.where(~dropped).withColumn("gone", departed).select(
        utc_day(F.col("ts")).alias("date"), utc_hour(F.col("ts")).alias("hour"), "host", "prov", "ts", "id",
        F.when(F.col("gone").isNull(), 0).otherwise(F.greatest(F.least(F.col("gone.ts") - F.col("ts"), F.lit(IDLE_GAP_MS)), F.lit(0))).cast("long").alias("dwell_ms"),
        F.coalesce(F.col("gone.id"), F.col("id")).alias("trigger_id"), F.col("gone").isNull().alias("provisional"), src.alias("src"), kind.alias("edge_kind"),
    )
    return out.withColumn("src", F.when(F.col("edge_kind").isNotNull(), F.col("src")))


def carried(rows: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that isn't null among the rows of ``keys`` up to each, by ``order``.

    In two levels, as an epoch or a window may have any number of rows: the last value of each block of ids, carried
    over a row for each block, and then from row to row within a block.
    """
    keyed = [*keys, "__block"]
    rows = rows.withColumns({"__value": value, "__block": F.shiftright("id", BLOCK_BITS)})
    at = F.struct(*order)
    blocks = rows.groupBy(*keyed).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), at)).alias("__last"))
    before = F.last("__last", True).over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(*BEFORE))
    blocks = blocks.select(*keyed, before.alias("__before"))
    own = F.last("__value", True).over(Window.partitionBy(*keyed).orderBy(*order).rowsBetween(*SO_FAR))
    return rows.join(blocks, keyed).withColumn(name, F.coalesce(own, "__before")).drop("__value", "__block", "__before")


def foreground(seq: DataFrame) -> DataFrame:
    """Credits of the time between events to the page in sight: date, host, fg_ms, trigger_id.

    In sight is the page of the active tab of the focused window, as of the event before; three steps
    carry the window, its tab and that tab's page forward.
    """
    # The state after each event holds until the next one, whatever its epoch.
    focused = carried(seq, F.when(F.col("kind") == "wfocus", F.col("win")), ["epoch"], ["id"], "w")
    ms = F.greatest(F.least(F.col("next_ts") - F.col("ts"), F.lit(IDLE_GAP_MS)), F.lit(0)).cast("long")
    spans = focused.where("w >= 0 and next_id is not null").withColumn("ms", ms).where("ms > 0")
    focus = seq.where("kind = 'focus'").select("epoch", "id", "ts", F.col("win").alias("w"), F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("long").alias("ms"), "tab", F.lit(0).alias("place"))
    both = spans.select("epoch", "id", "ts", "w", "next_id", "ms", F.lit(None).cast("long").alias("tab"), F.lit(1).alias("place")).unionByName(focus)
    active = carried(both, F.when(F.col("place") == 0, F.struct("tab", "id")), ["epoch", "w"], ["id", "place"], "f")
    spans = active.where("place = 1 and f is not null").select("epoch", "id", "ts", "next_id", "ms", F.col("f.tab").alias("tab"), F.col("f.id").alias("focus_id"), F.lit(2).alias("place"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("host"))
    null = lambda kind: F.lit(None).cast(kind)
    tabs = tab_rows(seq).where("step <> 'source'").select("epoch", "id", "ts", null("long").alias("next_id"), null("long").alias("ms"), "tab", null("long").alias("focus_id"), "place", "step", "host")
    by_tab = Window.partitionBy("epoch", "tab").orderBy("id", "place").rowsBetween(*SO_FAR)
    at = spans.unionByName(tabs).select(
        "*", F.last(F.when(F.col("step") == "close", F.col("id")), True).over(by_tab).alias("closed"), F.last(F.when(F.col("step").isin("close", "link"), F.col("id")), True).over(by_tab).alias("bound"),
        F.last(F.when(F.col("step") == "nav", F.struct("id", "host")), True).over(by_tab).alias("page"),
    )
    seen = at.where("place = 2 and page is not null and page.id > coalesce(bound, -1) and focus_id > coalesce(closed, -1)")
    return seen.select(utc_day(F.col("ts")).alias("date"), F.col("page.host").alias("host"), F.col("ms").alias("fg_ms"), F.col("next_id").alias("trigger_id")).where("host is not null")


def sessions(seq: DataFrame) -> DataFrame:
    """Runs of navs of a window with no gap over 30 minutes: id, win, start_ts, end_ts, start_id, end_id, nav_count, top_hosts, open."""
    own = Window.partitionBy("epoch", "win").orderBy("id")
    last_epoch = seq.agg(F.max("epoch").alias("last_epoch"))
    navs = seq.where("kind = 'nav'").select("epoch", "win", "id", "ts", "host", F.coalesce(F.greatest(F.col("ts") - F.lag("ts").over(own), F.lit(0)) > IDLE_GAP_MS, F.lit(False)).alias("gap"))
    navs = navs.withColumn("run", F.sum(F.col("gap").cast("int")).over(own.rowsBetween(*SO_FAR)))
    hosts = navs.where("host is not null").groupBy("epoch", "win", "run", "host").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    place = F.row_number().over(Window.partitionBy("epoch", "win", "run").orderBy("first"))
    hosts = hosts.withColumn("place", place).where(f"place <= {SESSION_HOST_CAP}").groupBy("epoch", "win", "run").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "host"))), 1, TOP_HOSTS).alias("top"))
    runs = navs.groupBy("epoch", "win", "run").agg(F.min_by("ts", "id").alias("start_ts"), F.max_by("ts", "id").alias("end_ts"), F.min("id").alias("start_id"), F.max("id").alias("end_id"), F.count("*").alias("nav_count"))
    runs = runs.withColumn("later", F.lead("run").over(Window.partitionBy("epoch", "win").orderBy("run")).isNotNull())
    out = runs.join(hosts, ["epoch", "win", "run"], "left").crossJoin(F.broadcast(last_epoch))  # one row
    top = F.coalesce(F.transform("top", lambda t: F.struct(t["host"].alias("host"), (-t["m"]).alias("n"))), F.expr("cast(array() as array<struct<host:string,n:bigint>>)"))
    return out.select(F.col("start_id").alias("id"), "win", "start_ts", "end_ts", "start_id", "end_id", "nav_count", top.alias("top_hosts"), (~F.col("later") & (F.col("epoch") == F.col("last_epoch"))).alias("open"))
