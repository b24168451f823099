"""The registered queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, urls
from ..operators import derive, flow, graph, layout, project, rollup, sequences, session_views
from ..schema import EDGE_KINDS, PROVENANCES
from ..sources import log as source
from ..sources.folders import settled, shared_folder
from ..sources.numbering import numbered
from .oracle import HOST, sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}
N = 25  # of top-k reports


def query(body: str | None = None, *parts: str):
    """Registers a function under its name, with the SQL of its result."""

    def put(f):
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLE_SQL[f.__name__] = sql(body, *parts)
        return f

    return put


_FOLDERS: dict[tuple[str, str], str] = {}
_KEPT: dict[str, set[str]] = {}


def _tables(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table of the driver's log. Each is derived once for each application, when a query asks for it, and kept as Parquet.

    Range queries read the day rollups, never the log; the folder is on storage that executors share.
    """
    folder = _FOLDERS.setdefault((spark.sparkContext.applicationId, sf), shared_folder(spark))
    kept = _KEPT.setdefault(folder, set())

    def table(n: str) -> DataFrame:
        if n == "seq":
            return derive.across(table("blocked"), table("blocks"))
        if n not in kept:
            made[n]().write.mode("overwrite").parquet(f"{folder}/{n}")
            kept.add(n)
        return spark.read.parquet(f"{folder}/{n}")

    stable = lambda: table("visits").where("not provisional")
    made = {
        "blocked": lambda: derive.in_blocks(source.driver_log(spark, sf)), "blocks": lambda: derive.blocks_of(table("blocked")),
        "visits": lambda: derive.visits(table("seq")), "fg": lambda: derive.foreground(table("seq")), "sessions": lambda: derive.sessions(table("seq")),
        "nodes": lambda: rollup.node_days(stable(), table("fg")), "edges": lambda: rollup.edge_days(stable()), "days": lambda: rollup.day_rows(stable(), table("fg"), table("seq")),
    }
    return table(name)


def _nodes(spark, sf) -> DataFrame:
    return _tables(spark, sf, "nodes")


def _edges(spark, sf) -> DataFrame:
    return _tables(spark, sf, "edges")


def _graph(spark, sf) -> project.Graph:
    return project.project(_nodes(spark, sf), _edges(spark, sf))


def _text(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


LATEST = "(SELECT max(date) FROM rn)"
WEEK = f"date BETWEEN {LATEST} - 6 AND {LATEST}"
DOM = "CASE greatest(" + ", ".join(f"prov_{p}" for p in PROVENANCES) + ") " + " ".join(f"WHEN prov_{p} THEN '{p}'" for p in PROVENANCES) + " END"


@query(f"SELECT key, visits, dwell_ms, fg_dwell_ms, {DOM} AS dominant FROM gn", "g")
def top_hosts(spark, sf):
    return project.project(_nodes(spark, sf), _edges(spark, sf)).nodes.select("key", "visits", "dwell_ms", "fg_dwell_ms", "dominant")


@query(f"SELECT * FROM ge ORDER BY weight DESC, src, dst LIMIT {N}", "g")
def top_edges(spark, sf):
    return project.top_edges(_graph(spark, sf), N)


@query("SELECT CAST(date AS VARCHAR) AS date, hour, host, prov, ts, id, dwell_ms, trigger_id, provisional, src, edge_kind FROM v", "v")
def visits(spark, sf):
    return _text(_tables(spark, sf, "visits"), "date")


@query("SELECT host, prov, src, edge_kind FROM v WHERE provisional", "v")
def provisional_pages(spark, sf):
    return _tables(spark, sf, "visits").where("provisional").select("host", "prov", "src", "edge_kind")


@query("SELECT CAST(date AS VARCHAR) AS date, host, CAST(sum(fg_ms) AS BIGINT) AS fg_ms FROM fg GROUP BY date, host", "fg")
def foreground_time(spark, sf):
    return _text(_tables(spark, sf, "fg").groupBy("date", "host").agg(F.sum("fg_ms").alias("fg_ms")), "date")


@query("SELECT id, win, start_ts, end_ts, start_id, end_id, nav_count, open FROM s", "s")
def sessions(spark, sf):
    return _tables(spark, sf, "sessions").drop("top_hosts")


SESSION_HOSTS = """SELECT id, CAST(place AS INT) AS place, host, n FROM (SELECT min(first) OVER (PARTITION BY epoch, win, run) AS fid, row_number() OVER (PARTITION BY epoch, win, run ORDER BY n DESC, host) AS place, host, n, sid AS id FROM
    (SELECT epoch, win, run, host, count(*) AS n, min(id) AS first, any_value(sid) AS sid, row_number() OVER (PARTITION BY epoch, win, run ORDER BY min(id)) AS seen FROM (SELECT *, min(id) OVER (PARTITION BY epoch, win, run) AS sid FROM s1) WHERE host IS NOT NULL GROUP BY epoch, win, run, host) WHERE seen <= 64) WHERE place <= 5"""


@query(SESSION_HOSTS, "s")
def session_top_hosts(spark, sf):
    rows = _tables(spark, sf, "sessions").select("id", F.posexplode("top_hosts").alias("place", "t"))
    return rows.select("id", (F.col("place") + 1).alias("place"), "t.host", "t.n")


@query("SELECT CAST(date AS VARCHAR) AS date, host, visits, dwell_ms, fg_dwell_ms, " + ", ".join(f"prov_{p}" for p in PROVENANCES) + " FROM rn", "rn")
def rollup_nodes(spark, sf):
    return _text(_nodes(spark, sf), "date")


@query("SELECT CAST(date AS VARCHAR) AS date, src, dst, weight, kind_link, kind_search_link, kind_form FROM re", "re")
def rollup_edges(spark, sf):
    return _text(_edges(spark, sf), "date")


@query(
    """SELECT CAST(date AS VARCHAR) AS date, max(trigger_id) AS max_id, bool_or(signal) AS has_focus_signal, count(hour) AS visits FROM
    (SELECT date, trigger_id, hour, false AS signal FROM v WHERE NOT provisional UNION ALL SELECT date, trigger_id, NULL, false FROM fg
     UNION ALL SELECT CAST(make_timestamp(ts * 1000) AS DATE), id, NULL, true FROM q WHERE kind IN ('focus', 'wfocus')) GROUP BY date""",
    "v", "fg",
)
def rollup_days(spark, sf):
    days = _tables(spark, sf, "days")
    return _text(days.select("date", "max_id", "has_focus_signal", F.aggregate("visits_by_hour", F.lit(0).cast("long"), lambda a, x: a + x).alias("visits")), "date")


@query(f"SELECT CAST(date AS VARCHAR) AS date, CAST(sum(visits) AS BIGINT) AS visits FROM rn WHERE date BETWEEN {LATEST} - 29 AND {LATEST} GROUP BY date", "rn")
def daily_visits(spark, sf):
    return _text(project.daily_series(_nodes(spark, sf), "month"), "date")


@query(
    """SELECT weekday, hour, visits, CASE WHEN visits <= 0 THEN 0 WHEN visits / m > 0.75 THEN 4 WHEN visits / m > 0.5 THEN 3 WHEN visits / m > 0.25 THEN 2 ELSE 1 END AS level FROM
    (SELECT *, max(visits) OVER () AS m FROM (SELECT g // 24 AS weekday, g % 24 AS hour, count(v.hour) AS visits FROM range(168) r(g)
     LEFT JOIN (SELECT (date_diff('day', DATE '1970-01-01', date) + 3 + (hour + 2) // 24) % 7 AS wd, (hour + 2) % 24 AS hour FROM v WHERE NOT provisional) v ON v.wd = g // 24 AND v.hour = g % 24 GROUP BY g))""",
    "v",
)
def rhythm(spark, sf):
    return project.rhythm(_tables(spark, sf, "days"), 2)


@query(
    f"""SELECT count(*) FILTER (here) AS hosts, CAST(sum(w) AS BIGINT) AS visits, count(*) FILTER (first BETWEEN {LATEST} - 6 AND {LATEST}) AS new_hosts,
    round(greatest(sum(w) - count(*) FILTER (here), 0) / sum(w), 6) AS revisit_rate FROM (SELECT host, bool_or({WEEK}) AS here, sum(CASE WHEN {WEEK} THEN visits ELSE 0 END) AS w, min(date) AS first FROM rn GROUP BY host)""",
    "rn",
)
def range_stats(spark, sf):
    return project.range_stats(_nodes(spark, sf), "week").withColumn("revisit_rate", F.round("revisit_rate", 6))


TWO = f"(SELECT host, sum(visits) FILTER ({WEEK}) AS now, sum(visits) FILTER (date BETWEEN {LATEST} - 13 AND {LATEST} - 7) AS prev, min(date) AS first FROM rn GROUP BY host)"


@query(
    f"""SELECT CAST(nv AS BIGINT) AS now_visits, CAST(pv AS BIGINT) AS prev_visits, now_hosts, prev_hosts, now_new, prev_new,
    CASE WHEN pv <> 0 THEN CAST(round((nv - pv) * 100.0 / pv) AS BIGINT) END AS visits_pct, CASE WHEN prev_hosts <> 0 THEN CAST(round((now_hosts - prev_hosts) * 100.0 / prev_hosts) AS BIGINT) END AS hosts_pct,
    CASE WHEN prev_new <> 0 THEN CAST(round((now_new - prev_new) * 100.0 / prev_new) AS BIGINT) END AS new_pct, pv = 0 AS no_baseline FROM
    (SELECT coalesce(sum(now), 0) AS nv, coalesce(sum(prev), 0) AS pv, count(now) AS now_hosts, count(prev) AS prev_hosts, count(*) FILTER (first BETWEEN {LATEST} - 6 AND {LATEST}) AS now_new,
     count(*) FILTER (first BETWEEN {LATEST} - 13 AND {LATEST} - 7) AS prev_new FROM {TWO})""",
    "rn",
)
def period_delta(spark, sf):
    return project.period_delta(_nodes(spark, sf), "week")


@query(f"SELECT host, CAST(coalesce(now, 0) AS BIGINT) AS now, CAST(coalesce(prev, 0) AS BIGINT) AS prev FROM {TWO} WHERE coalesce(now, 0) >= 3 AND coalesce(now, 0) > coalesce(prev, 0) ORDER BY coalesce(now, 0) / greatest(coalesce(prev, 0), 1) DESC, now DESC, host LIMIT 6", "rn")
def surging_hosts(spark, sf):
    return project.surging(_nodes(spark, sf), "week")


STACK = " UNION ALL ".join(f"SELECT '{p}' AS provenance, CAST(coalesce(sum(prov_{p}), 0) AS BIGINT) AS n FROM rn" for p in PROVENANCES)


@query(STACK, "rn")
def origination(spark, sf):
    return project.origination(_nodes(spark, sf))


@query(
    f"""SELECT provenance, n, CAST(f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, provenance) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS pct
    FROM (SELECT *, floor(x) AS f FROM (SELECT *, n * 100 / sum(n) OVER () AS x FROM ({STACK})))""",
    "rn",
)
def provenance_pct(spark, sf):
    return project.percentages(project.origination(_nodes(spark, sf)), order=F.col("provenance"))


ENDS = "(SELECT src AS key, weight FROM ge UNION ALL SELECT dst, weight FROM ge)"


@query(f"SELECT gn.key, CAST(coalesce(sum(e.weight), 0) AS BIGINT) AS weight FROM gn LEFT JOIN {ENDS} e USING (key) GROUP BY gn.key ORDER BY weight DESC, gn.key LIMIT {N}", "g")
def hubs(spark, sf):
    return graph.hubs(_graph(spark, sf), N)


@query(f"SELECT src AS key, CAST(sum(weight) AS BIGINT) AS weight FROM ge GROUP BY src ORDER BY weight DESC, key LIMIT {N}", "g")
def launch_pads(spark, sf):
    return graph.launch_pads(_graph(spark, sf), N)


@query(f"SELECT dst AS key, CAST(sum(weight) AS BIGINT) AS weight FROM ge GROUP BY dst ORDER BY weight DESC, key LIMIT {N}", "g")
def destinations(spark, sf):
    return graph.destinations(_graph(spark, sf), N)


@query(f"SELECT dst AS key, CAST(sum(kind_search_link) AS BIGINT) AS weight FROM ge WHERE kind_search_link > 0 GROUP BY dst ORDER BY weight DESC, key LIMIT {N}", "g")
def search_destinations(spark, sf):
    return graph.search_destinations(_graph(spark, sf), N)


@query(f"SELECT src, dst, weight, round(share, 6) AS share FROM (SELECT src, dst, weight, weight / sum(weight) OVER (PARTITION BY src) AS share, sum(weight) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM ge) WHERE place = 1 AND total >= 4 ORDER BY share DESC, weight DESC, src, dst LIMIT {N}", "g")
def next_hops(spark, sf):
    return graph.next_hops(_graph(spark, sf), 4, N).withColumn("share", F.round("share", 6))


@query(f"SELECT x.src AS a, x.dst AS b, x.weight AS ab, y.weight AS ba FROM ge x JOIN ge y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst ORDER BY least(ab, ba) DESC, a, b LIMIT {N}", "g")
def reciprocal_pairs(spark, sf):
    return graph.reciprocal_pairs(_graph(spark, sf), N)


FOCUS = "(SELECT key FROM gn ORDER BY visits DESC, key LIMIT 1)"


def _focus(g: project.Graph) -> str:
    row = project.ranked_nodes(g).select("key").first()
    return row.key if row else ""


@query(f"SELECT src, dst, weight FROM ge WHERE src IN (SELECT src FROM ge WHERE dst = {FOCUS} UNION SELECT dst FROM ge WHERE src = {FOCUS} UNION SELECT * FROM {FOCUS}) AND dst IN (SELECT src FROM ge WHERE dst = {FOCUS} UNION SELECT dst FROM ge WHERE src = {FOCUS} UNION SELECT * FROM {FOCUS})", "g")
def ego(spark, sf):
    g = _graph(spark, sf)
    return graph.ego(g, _focus(g)).edges.select("src", "dst", "weight")


ORACLE_COMPONENT = sql("", "g").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f",\nc(key) AS (SELECT key FROM {FOCUS} UNION SELECT CASE WHEN e.src = c.key THEN e.dst ELSE e.src END FROM c JOIN ge e ON e.src = c.key OR e.dst = c.key)\nSELECT key FROM c"


@query()
def component(spark, sf):
    g = _graph(spark, sf)
    return graph.component(g, _focus(g)).nodes.select("key")


ORACLE_SQL["component"] = ORACLE_COMPONENT


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY weight DESC, host) AS INT) AS place FROM (SELECT 'in' AS direction, src AS host, weight FROM ge WHERE dst = {FOCUS} UNION ALL SELECT 'out', dst, weight FROM ge WHERE src = {FOCUS})) WHERE place <= 10", "g")
def node_connections(spark, sf):
    g = _graph(spark, sf)
    return graph.node_connections(g, _focus(g), 10)


@query("SELECT kind, count(*) AS n FROM log GROUP BY kind", "log")
def event_kind_counts(spark, sf):
    return source.driver_log(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT host, page, count(*) AS visits FROM (SELECT {HOST.format('url')} AS host, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS s, CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN s = '' THEN '' WHEN length(s) > 48 THEN '?' || s[:48] || '…' ELSE '?' || s END AS page FROM log WHERE kind = 'nav') WHERE host IS NOT NULL GROUP BY host, page ORDER BY visits DESC, host, page LIMIT {N}", "log")
def top_pages(spark, sf):
    rows = source.driver_log(spark, sf).where("kind = 'nav'").select(urls.host(F.col("url")).alias("host"), urls.path_query(F.col("url")).alias("page"))
    return rows.where("host is not null").groupBy("host", "page").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "host", "page").limit(N)


def searches(urls_: DataFrame, top: int) -> DataFrame:
    """engine, terms (as first typed), n of a log's search result URLs.

    Equal URLs are counted first, in a hash table, and written, as the filter would else move below: each is taken apart
    once, and only they are sorted for their terms.
    """
    each = settled(urls_.groupBy("url").agg(F.count("*").alias("n"), F.min("id").alias("id")))
    q = urls.with_search(each).where("engine is not null")
    by = q.groupBy("engine", F.lower("terms").alias("folded")).agg(F.sum("n").alias("n"), F.min_by("terms", "id").alias("terms"))
    return by.select("engine", "terms", "n").orderBy(F.desc("n"), "terms", "engine").limit(top)


SEARCH = "CASE id % 3 WHEN 0 THEN 'https://www.google.co.uk/search?hl=en&q=' || prov || '+' || (id % 7) WHEN 1 THEN 'https://duckduckgo.com/?q=' || upper(prov) || '%20' || (id % 5) ELSE 'https://maps.example.com/?q=x' END"


@query(f"SELECT engine, arg_min(terms, id) AS terms, count(*) AS n FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'Google' WHEN 1 THEN 'DuckDuckGo' END AS engine, CASE id % 3 WHEN 0 THEN prov || ' ' || (id % 7) WHEN 1 THEN upper(prov) || ' ' || (id % 5) END AS terms FROM log WHERE kind = 'nav') WHERE engine IS NOT NULL GROUP BY engine, lower(terms) ORDER BY n DESC, terms, engine LIMIT {N}", "log")
def top_searches(spark, sf):
    navs = _tables(spark, sf, "seq").where("kind = 'nav'")
    return searches(navs.select("id", F.expr(SEARCH).alias("url")), N)


@query(f"SELECT host, CAST(visits AS BIGINT) AS visits, round(visits / sum(visits) OVER (), 6) AS share, CAST(f AS VARCHAR) AS first_seen, CAST(l AS VARCHAR) AS last_seen FROM (SELECT host, sum(CASE WHEN {WEEK} THEN visits ELSE 0 END) AS visits, min(date) AS f, max(date) AS l FROM rn GROUP BY host)", "rn")
def host_first_last_seen(spark, sf):
    return _text(project.host_detail(_nodes(spark, sf), "week").withColumn("share", F.round("share", 6)), "first_seen", "last_seen")


@query("SELECT id, source, CAST(row_number() OVER (ORDER BY place, source, id) AS INT) AS seq FROM (SELECT id, id % 2 AS source, max(ts - (id % 13) * 1000) OVER (PARTITION BY id % 2 ORDER BY id) AS place FROM log)", "log")
def merged_stream(spark, sf):
    log = source.driver_log(spark, sf).withColumn("ts", F.col("ts") - (F.col("id") % 13) * 1000)  # clocks that go back
    m = source.merged(log.where("id % 2 = 0"), log.where("id % 2 = 1")).withColumnRenamed("seq", "order")
    told = numbered(m, "order", name="seq")
    return told.select("id", F.col("source").cast("long").alias("source"), F.col("seq").cast("int").alias("seq"))


#: The log in two streams: in-page navigations, whose clock may go back, and all else; and both in one order.
SPA = "kind = 'nav' AND id % 6 = 2"
BOTH = f"""log AS (SELECT row_number() OVER (ORDER BY place, source, id0) AS id, * EXCLUDE (place, source, id0) FROM
  (SELECT id AS id0, * EXCLUDE (id), max(ts) OVER (PARTITION BY source ORDER BY id) AS place FROM
  (SELECT * REPLACE (ts - CASE WHEN {SPA} THEN (id % 13) * 1000 ELSE 0 END AS ts), CASE WHEN {SPA} THEN 1 ELSE 0 END AS source FROM log0)))"""


def _with_spa(spark, sf) -> DataFrame:
    log = source.driver_log(spark, sf)
    spa = log.where(SPA).withColumn("ts", F.col("ts") - (F.col("id") % 13) * 1000)
    return session_views.source_log(log.where(f"NOT ({SPA})"), spa, with_spa=True)


def _spa_sql(body: str, *parts: str) -> str:
    """SQL over the derivation of both streams."""
    return sql(body, *parts).replace("WITH log AS (", "WITH log0 AS (", 1).replace(",\nq AS (", f",\n{BOTH},\nq AS (", 1)


@query()
def spa_source(spark, sf):
    return _with_spa(spark, sf).select("id", "ts", "kind", "tab", "url")


ORACLE_SQL["spa_source"] = _spa_sql("SELECT id, ts, kind, tab, url FROM log", "log")


@query()
def spa_rollup_nodes(spark, sf):
    """Day rollups of both streams, derived from nothing."""
    nodes = rollup.build(settled(_with_spa(spark, sf)))["nodes"]
    return _text(nodes.select("date", "host", "visits", "dwell_ms", "fg_dwell_ms"), "date")


ORACLE_SQL["spa_rollup_nodes"] = _spa_sql("SELECT CAST(date AS VARCHAR) AS date, host, visits, dwell_ms, fg_dwell_ms FROM rn", "rn")


@query("SELECT id, ts, url, n >= 2000 AND NOT reached AS capped FROM (SELECT *, sum(CASE WHEN ts < lo THEN 1 ELSE 0 END) OVER (ORDER BY id DESC) AS older, count(*) OVER () AS n, bool_or(ts < lo) OVER () AS reached FROM (SELECT *, (SELECT max(ts) - 86400000 FROM log) AS lo FROM log ORDER BY id DESC LIMIT 2000)) WHERE older = 0 AND kind = 'nav'", "log")
def recent_navs_bounded(spark, sf):
    log = source.driver_log(spark, sf)
    last = log.agg(F.max("ts")).first()[0] or 0
    return source.recent_navs(log, last - 86_400_000, last + 1, 2000).select("id", "ts", "url", "capped")


@query(f"SELECT id, kind FROM (SELECT id, kind, CASE WHEN kind = 'nav' THEN h END AS h, min(CASE WHEN kind = 'nav' THEN h END) OVER () AS first FROM (SELECT id, kind, {HOST.format('url')} AS h FROM log)) WHERE h IS DISTINCT FROM first OR h IS NULL", "log")
def forget_domain(spark, sf):
    log = source.driver_log(spark, sf)
    first = log.where("kind = 'nav'").agg(F.min(urls.host(F.col("url")))).first()[0]
    return source.forget(log, first or "").select("id", "kind")


@query("SELECT id, ts FROM log WHERE NOT ts BETWEEN (SELECT max(ts) - 3 * 86400000 FROM log) AND (SELECT max(ts) - 86400000 FROM log)", "log")
def delete_range(spark, sf):
    log = source.driver_log(spark, sf)
    last = log.agg(F.max("ts")).first()[0] or 0
    return source.delete_range(log, last - 3 * 86_400_000, last - 86_400_000).select("id", "ts")


@query("SELECT n AS threshold FROM (SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000]) AS n) WHERE n = 1 OR n IN (SELECT unnest(list_reverse_sort(list(k))[:5]) FROM (SELECT unnest([2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000]) AS k) WHERE k <= (SELECT max(visits) FROM gn))", "g")
def min_visit_thresholds(spark, sf):
    most = _graph(spark, sf).nodes.agg(F.max("visits")).first()[0] or 0
    return spark.createDataFrame([(n,) for n in project.visit_thresholds(most)], "threshold int")


@query("SELECT CAST(CAST(make_timestamp(start_ts * 1000) AS DATE) AS VARCHAR) AS day, count(*) AS sessions, CAST(sum(nav_count) AS BIGINT) AS navs FROM s WHERE NOT open GROUP BY 1", "s")
def calendar_heatmap(spark, sf):
    return _text(project.calendar(_tables(spark, sf, "sessions").where("not open")), "day")


@query(
    """SELECT (SELECT count(*) FROM s WHERE NOT open) AS n, (SELECT max(end_ts - start_ts) FROM s WHERE NOT open) AS longest_ms, (SELECT list_sort(list(nav_count))[(count(*) // 2) + 1] FROM s WHERE NOT open) AS median_navs,
    (SELECT arg_max(h, n * 100 + h) FROM (SELECT (start_ts // 3600000) % 24 AS h, count(*) AS n FROM s WHERE NOT open GROUP BY 1)) AS busiest_hour,
    (SELECT arg_max(w, n * 100 + w) FROM (SELECT (start_ts // 86400000 + 3) % 7 AS w, count(*) AS n FROM s WHERE NOT open GROUP BY 1)) AS busiest_weekday""",
    "s",
)
def session_activity(spark, sf):
    return project.session_activity(_tables(spark, sf, "sessions").where("not open"))


@query("SELECT id, lag(id) OVER (ORDER BY start_ts, id) AS back, lead(id) OVER (ORDER BY start_ts, id) AS forward FROM s", "s")
def session_steps(spark, sf):
    return project.session_steps(_tables(spark, sf, "sessions"))


@query("SELECT s.id AS session, l.kind, count(*) AS n FROM s JOIN log l ON l.id BETWEEN s.start_id AND s.end_id GROUP BY ALL", "s")
def session_event_join(spark, sf):
    log = source.driver_log(spark, sf)
    return sequences.session_events(_tables(spark, sf, "sessions"), log).groupBy("session", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT key, visits FROM (SELECT *, {DOM} AS dominant FROM gn) WHERE visits >= 5 AND dominant IN ('link', 'bookmark') AND key IN (SELECT src FROM ge WHERE dst IN (SELECT key FROM (SELECT *, {DOM} AS d FROM gn) WHERE visits >= 5 AND d IN ('link', 'bookmark')) UNION SELECT dst FROM ge WHERE src IN (SELECT key FROM (SELECT *, {DOM} AS d FROM gn) WHERE visits >= 5 AND d IN ('link', 'bookmark')))", "g")
def filtered_nodes(spark, sf):
    f = project.Filters(min_visits=5, provenance=("link", "bookmark"), hide_isolated=True)
    return project.project(_nodes(spark, sf), _edges(spark, sf), f).nodes.select("key", "visits")


@query("SELECT CASE WHEN provenance = 'reload' THEN 'other' ELSE provenance END AS provenance, CAST(sum(n) AS BIGINT) AS n FROM (" + STACK + ") GROUP BY 1 HAVING sum(n) > 0", "rn")
def legend(spark, sf):
    return project.legend(_graph(spark, sf))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(coalesce(sum(kind_{k}), 0) AS BIGINT) AS n FROM ge" for k in EDGE_KINDS) + ") WHERE n > 0", "g")
def edge_legend(spark, sf):
    return project.edge_legend(_graph(spark, sf))


@query("SELECT id, ts, kind FROM log WHERE id > (SELECT max(id) // 2 FROM log)", "log")
def incremental_scan(spark, sf):
    log = source.driver_log(spark, sf)
    return source.after(log, (log.agg(F.max("id")).first()[0] or 0) // 2).select("id", "ts", "kind")


def _rank_sql(rounds: int) -> str:
    head = sql("", "g").rstrip()
    ctes = [
        "pe AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM ge)", "pn AS MATERIALIZED (SELECT key, key IN (SELECT src FROM ge) AS has, (SELECT count(*) FROM gn) AS n FROM gn)",
        "r0 AS MATERIALIZED (SELECT key, 1.0::DOUBLE / n AS rank FROM pn)",
    ]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT pn.key, 0.15 / n + 0.85 * (coalesce(got, 0) + coalesce((SELECT sum(rank) FROM r{k} JOIN pn USING (key) WHERE NOT has), 0) / n) AS rank FROM pn LEFT JOIN (SELECT dst AS key, sum(rank * p) AS got FROM pe JOIN r{k} ON r{k}.key = pe.src GROUP BY dst) USING (key))")
    return head.replace("g AS", "g AS") + ",\n" + ",\n".join(ctes) + f"\nSELECT key, round(rank, 4) AS rank FROM r{rounds}"


@query()
def pagerank(spark, sf):
    return graph.pagerank(_graph(spark, sf), rounds=40).withColumn("rank", F.round("rank", 4))


ORACLE_SQL["pagerank"] = _rank_sql(40)


DOMAIN = "regexp_extract({}, '[^.]+\\.[^.]+$')"  # the driver's hosts all end in a suffix of one label


@query(f"SELECT {DOMAIN.format('src')} AS src, {DOMAIN.format('dst')} AS dst, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(kind_link) AS BIGINT) AS kind_link, CAST(sum(kind_search_link) AS BIGINT) AS kind_search_link, CAST(sum(kind_form) AS BIGINT) AS kind_form FROM ge WHERE {DOMAIN.format('src')} <> {DOMAIN.format('dst')} GROUP BY 1, 2", "g")
def edges_registrable(spark, sf):
    return project.project(_nodes(spark, sf), _edges(spark, sf), by_domain=True).edges


@query(f"SELECT {DOMAIN.format('key')} AS key, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms FROM gn GROUP BY 1", "g")
def nodes_registrable(spark, sf):
    return project.project(_nodes(spark, sf), _edges(spark, sf), by_domain=True).nodes.select("key", "visits", "dwell_ms")


@query(f"SELECT CAST(date AS VARCHAR) AS date, CAST(sum(CASE WHEN host = {FOCUS} THEN visits ELSE 0 END) AS BIGINT) AS visits FROM rn WHERE {WEEK} GROUP BY date", "g")
def host_days(spark, sf):
    return _text(project.host_days(_nodes(spark, sf), _focus(_graph(spark, sf)), "week"), "date")


@query(f"SELECT key, visits, {DOM} AS dominant FROM gn WHERE {DOM} <> 'search_origin'", "g")
def without_search_hubs(spark, sf):
    return project.project(_nodes(spark, sf), _edges(spark, sf), project.Filters(hide_search_hubs=True)).nodes.select("key", "visits", "dominant")


@query("SELECT (SELECT count(*) FROM log) AS events, (SELECT count(DISTINCT date) FROM v WHERE NOT provisional) AS visit_days, (SELECT count(*) FROM s WHERE NOT open) AS sessions", "v", "s")
def stored_counts(spark, sf):
    days = _tables(spark, sf, "visits").where("not provisional").agg(F.count_distinct("date").alias("visit_days"))
    done = _tables(spark, sf, "sessions").where("not open").agg(F.count("*").alias("sessions"))
    return source.driver_log(spark, sf).agg(F.count("*").alias("events")).crossJoin(days).crossJoin(done)  # one row each


@query(
    """SELECT id, CASE kind WHEN 'link' THEN 'tab ' || src_tab || ' → new tab ' || new_tab WHEN 'close' THEN 'tab ' || tab WHEN 'focus' THEN 'tab ' || tab || ' active in window ' || win
    WHEN 'wfocus' THEN CASE WHEN win < 0 THEN 'browser blurred' ELSE 'window ' || win || ' focused' END WHEN 'start' THEN 'browser start' END AS line FROM log WHERE kind <> 'nav' ORDER BY id LIMIT 1000""",
    "log",
)
def described_events(spark, sf):
    """The first page of the raw log, as lines."""
    log = source.driver_log(spark, sf).where("kind <> 'nav'")
    return source.head(log, 1000).select("id", scalars.described().alias("line"))


@query()
def community_table(spark, sf):
    return graph.community_table(_graph(spark, sf))


@query()
def layout_2d(spark, sf):
    return layout.layout(_graph(spark, sf), rounds=60).select("key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _session_events(spark, sf) -> DataFrame:
    return sequences.session_events(_tables(spark, sf, "sessions"), _tables(spark, sf, "seq"))


@query("SELECT session, chain FROM chains", "ch")
def session_chains(spark, sf):
    found = sequences.chains(_session_events(spark, sf))
    return found.select("session", F.array_join("chain", ">").alias("chain"))


@query(
    """SELECT array_to_string(p.ks, '>') AS pattern, p.n AS support FROM (SELECT ks, count(DISTINCT who) AS n FROM pats GROUP BY ks HAVING count(DISTINCT who) >= 2) p
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT ks, count(DISTINCT who) AS n FROM pats GROUP BY ks) q WHERE q.n = p.n AND len(q.ks) > len(p.ks) AND q.ks[1:len(p.ks)] = p.ks)
    ORDER BY support DESC, len(p.ks) DESC, p.ks LIMIT 15""",
    "ch",
    "jo",
)
def journeys(spark, sf):
    log = source.driver_log(spark, sf)
    found = sequences.journeys(_tables(spark, sf, "sessions"), log)
    return found.select(F.array_join("pattern", ">").alias("pattern"), "support")


@query()
def communities(spark, sf):
    return graph.communities(_graph(spark, sf))


@query()
def bridges(spark, sf):
    return graph.bridges(_graph(spark, sf), N).withColumn("score", F.round("score", 6))


@query()
def session_flow(spark, sf):
    return flow.flows(_session_events(spark, sf))


@query()
def session_flow_nodes(spark, sf):
    return flow.flow_nodes(_session_events(spark, sf))


@query("SELECT id, start_ts, end_ts FROM s WHERE end_ts >= (SELECT max(end_ts) FROM s) - 7 * 86400000", "s")
def sessions_of_week(spark, sf):
    return session_views.in_range(_tables(spark, sf, "sessions"), "week").select("id", "start_ts", "end_ts")


def _latest(spark, sf):
    return _nodes(spark, sf).agg(F.max("date")).first()[0]  # one row


@query(f"SELECT id FROM s WHERE end_ts >= epoch_ms(CAST({LATEST} - 13 AS TIMESTAMP)) AND start_ts < epoch_ms(CAST({LATEST} - 6 AS TIMESTAMP))", "s", "rn")
def sessions_of_week_before(spark, sf):
    end = project.back_end("week", _latest(spark, sf))
    window = session_views.day_window(project.back_end("week", end) + timedelta(days=1), end)
    return session_views.in_range(_tables(spark, sf, "sessions"), "week", window).select("id")


@query(f"SELECT id, nav_count FROM s WHERE nav_count > 1 AND CAST(make_timestamp(start_ts * 1000) AS DATE) = {LATEST} AND id IN (SELECT id FROM ({SESSION_HOSTS}) WHERE host LIKE '%e%')", "s", "rn")
def session_list(spark, sf):
    return session_views.listed(_tables(spark, sf, "sessions"), _latest(spark, sf), hide_trivial=True, search="e").select("id", "nav_count")


@query("SELECT key, visits FROM gn WHERE key LIKE '%e%' ORDER BY visits DESC, key LIMIT 1", "g")
def host_search(spark, sf):
    return session_views.find_host(_graph(spark, sf).nodes, "e").select("key", "visits")


@query("SELECT count(*) AS nodes, (SELECT count(*) FROM ge) AS edges FROM gn", "g")
def graph_counts(spark, sf):
    return session_views.counts(_graph(spark, sf))


@query("SELECT key, weight, CAST(round(weight / max(weight) OVER () * 100) AS INT) AS rel FROM (SELECT src AS key, CAST(sum(weight) AS BIGINT) AS weight FROM ge GROUP BY src ORDER BY weight DESC, key LIMIT 25)", "g")
def relative_launch_pads(spark, sf):
    return session_views.relative(graph.launch_pads(_graph(spark, sf), N), "weight")


@query(f"SELECT coalesce(bool_or(kind IN ('focus', 'wfocus')), false) OR (SELECT coalesce(bool_or(fg_ms > 0), false) FROM fg WHERE {WEEK}) AS signal FROM log WHERE CAST(make_timestamp(ts * 1000) AS DATE) BETWEEN {LATEST} - 6 AND {LATEST}", "log", "fg", "rn")
def focus_signal(spark, sf):
    end = _latest(spark, sf)
    return session_views.focus_signal(_nodes(spark, sf), _tables(spark, sf, "days"), end - timedelta(days=6), end)
