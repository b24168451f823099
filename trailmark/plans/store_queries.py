"""Registered queries of intake, the store, redaction, streaming and local calendars, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..functions import urls
from ..operators import project, rollup, sequences, session_views
from ..schema import PROVENANCES
from ..sources import capture, tables_csv
from ..sources import log as source
from ..sources.folders import shared_folder
from ..streaming import fold
from .oracle import HOST, PROVS, sql
from .queries import LATEST, ORACLE_SQL, TWO, WEEK, _focus, _graph, _nodes, _tables, _text, query

NODE_COLUMNS = ["date", "host", "visits", "dwell_ms", "fg_dwell_ms", *(f"prov_{p}" for p in PROVENANCES)]
NODES = "SELECT CAST(date AS VARCHAR) AS date, host, visits, dwell_ms, fg_dwell_ms, " + ", ".join(NODE_COLUMNS[5:]) + " FROM rn"
#: Day rollups that count pages which are still open.
OPEN_NODES = f"""SELECT CAST(date AS VARCHAR) AS date, host, count(prov) AS visits, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms, CAST(sum(fg_ms) AS BIGINT) AS fg_dwell_ms, {PROVS}
  FROM (SELECT date, host, prov, dwell_ms, 0 AS fg_ms FROM v UNION ALL SELECT date, host, NULL, 0, fg_ms FROM fg) GROUP BY date, host"""


def over(log: str, body: str, *parts: str) -> str:
    """SQL over the derivation of ``log``, CTEs that end with one of that name, made from log0, the driver's log."""
    return sql(body, *parts).replace("WITH log AS (", "WITH log0 AS (", 1).replace(",\nq AS (", f",\n{log},\nq AS (", 1)


def _dated(nodes: DataFrame) -> DataFrame:
    return _text(nodes.select(*NODE_COLUMNS), "date")


# --- intake

#: The driver's events as raw capture rows, in SQL that both engines read.
RAW = [
    "event_id AS seq",
    "CASE WHEN event_id % 61 = 7 THEN 'pause' WHEN event_id % 997 = 996 THEN 'startup' WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'focus_changed' WHEN 1 THEN 'removed' ELSE 'icon_changed' END "
    "WHEN event_type = 'signup' THEN 'created_target' WHEN event_type = 'purchase' THEN 'activated' WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'history' ELSE 'fragment' END ELSE 'committed' END AS trigger",
    "CASE WHEN event_id % 61 = 7 THEN event_id % 122 = 7 END AS paused", "CASE WHEN event_id % 19 = 3 THEN 5 ELSE 0 END AS frame_id",
    "CASE WHEN event_id % 23 = 4 THEN 'chrome-extension://own/page' ELSE 'https://h' || (user_id % 40) || '.example.org/' END AS url", "user_id % 8 AS tab_id",
    "CASE WHEN event_id % 17 = 5 THEN NULL WHEN event_id % 13 = 5 THEN -2 ELSE user_id % 3 END AS window_id", "(user_id + 3) % 8 AS source_tab_id",
    "CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_id * 1000 + 7 END AS time_stamp", "event_id * 1000 + 9 AS now", "'link' AS transition_type",
]
KINDS = " ".join(f"WHEN '{t}' THEN '{k}'" for t, (_, k) in capture.TRIGGERS.items())


@query(
    f"""WITH raw AS (SELECT {', '.join(RAW)} FROM events), r AS (SELECT *, CASE trigger {KINDS} END AS kind, CASE WHEN trigger IN ('history', 'fragment') THEN 'spa' ELSE 'events' END AS store,
    coalesce(last_value(CASE WHEN trigger = 'pause' THEN paused END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS off FROM raw)
    SELECT store, row_number() OVER (PARTITION BY store ORDER BY seq) AS id, kind, CAST(CASE WHEN kind IN ('nav', 'link') THEN coalesce(time_stamp, now) ELSE now END AS BIGINT) AS ts,
    CASE WHEN kind IN ('nav', 'close', 'focus') THEN tab_id END AS tab, CAST(CASE WHEN kind = 'wfocus' AND window_id < 0 THEN -1 WHEN kind IN ('nav', 'focus', 'wfocus') THEN coalesce(window_id, 0) END AS BIGINT) AS win,
    CASE WHEN kind = 'link' THEN tab_id END AS new_tab, CASE WHEN kind = 'link' THEN source_tab_id END AS src_tab, CASE WHEN kind = 'nav' THEN url END AS url
    FROM r WHERE kind IS NOT NULL AND (kind = 'start' OR NOT off) AND NOT (kind = 'nav' AND (frame_id <> 0 OR url LIKE 'chrome-extension://%'))"""
)
def captured_log(spark, sf):
    """Raw capture events to both stores' records."""
    raw = source.table(spark, sf, "events").selectExpr(*RAW).withColumn("qualifiers", F.lit(None).cast("array<string>"))
    stores = capture.captured(raw)
    both = [df.select(F.lit(s).alias("store"), "id", "kind", "ts", "tab", "win", "new_tab", "src_tab", "url") for s, df in stores.items()]
    return both[0].unionByName(both[1])


# --- the store


def _store(spark, sf) -> rollup.Store:
    """A store of the driver's log and its derived tables."""
    store, log = rollup.Store(spark, shared_folder(spark)), source.driver_log(spark, sf)
    tables = {n: _tables(spark, sf, n) for n in rollup.SUMMED}
    store.write({"events": log, **tables, "sessions": _tables(spark, sf, "sessions").where("not open").drop("open")})
    return store


@query("SELECT (SELECT count(*) FROM log) AS events, 0 AS spa, (SELECT count(DISTINCT date) FROM (SELECT date FROM v WHERE NOT provisional UNION ALL SELECT date FROM fg UNION ALL SELECT CAST(make_timestamp(ts * 1000) AS DATE) FROM log WHERE kind IN ('focus', 'wfocus'))) AS rollup_days, (SELECT count(*) FROM s WHERE NOT open) AS sessions", "v", "fg", "s")
def store_counts(spark, sf):
    """Rows of each store, from the files' footers."""
    return _store(spark, sf).counts()


FIRST_HOST = f"(SELECT min({HOST.format('url')}) FROM log0 WHERE kind = 'nav')"


@query()
def nodes_after_forgetting(spark, sf):
    """Day rollups after a host was forgotten: its days derived anew, the others as they were."""
    store = _store(spark, sf)
    first = store.read("events").where("kind = 'nav'").agg(F.min(urls.host(F.col("url")))).first()[0]
    store.forget(first or "")
    return _dated(store.read("nodes"))


ORACLE_SQL["nodes_after_forgetting"] = over(f"log AS (SELECT * FROM log0 WHERE kind <> 'nav' OR coalesce({HOST.format('url')} <> {FIRST_HOST}, true))", NODES, "rn")
RANGE = "(SELECT max(ts) - {} * 86400000 FROM log0)"
IN_RANGE = f"log AS (SELECT * FROM log0 WHERE NOT ts BETWEEN {RANGE.format(6)} AND {RANGE.format(4)})"


def _without_range(spark, sf) -> rollup.Store:
    store = _store(spark, sf)
    last = store.read("events").agg(F.max("ts")).first()[0] or 0
    store.delete_range(last - 6 * 86_400_000, last - 4 * 86_400_000)
    return store


@query()
def nodes_after_range_deletion(spark, sf):
    return _dated(_without_range(spark, sf).read("nodes"))


ORACLE_SQL["nodes_after_range_deletion"] = over(IN_RANGE, NODES, "rn")


@query()
def sessions_after_range_deletion(spark, sf):
    return _without_range(spark, sf).read("sessions").select("id", "win", "start_ts", "end_ts", "end_id", "nav_count")


ORACLE_SQL["sessions_after_range_deletion"] = over(IN_RANGE, "SELECT id, win, start_ts, end_ts, end_id, nav_count FROM s WHERE NOT open", "s")


# --- streaming


@query(OPEN_NODES, "rn")
def live_nodes(spark, sf):
    """Day rollups as a stream has left them in the store, with the pages that its state holds open."""
    store = rollup.Store(spark, shared_folder(spark))
    fold.into_by_blocks(store, source.driver_log(spark, sf), f"{shared_folder(spark)}/stream")
    return _dated(fold.live(store)["nodes"])


# --- views


def _newest(column: str) -> str:
    return f"(SELECT {column} FROM ({sql('SELECT start_id, end_id FROM s ORDER BY start_ts DESC, id DESC LIMIT 1', 's')}))"


@query()
def session_nodes(spark, sf):
    """The session range of the view: the newest session's own day rollups."""
    tables = {n: _tables(spark, sf, n) for n in ("nodes", "edges", "days", "sessions")}
    shown = session_views.displayed(session_views.View("session"), tables, source.driver_log(spark, sf))
    return _dated(shown["nodes"])


ORACLE_SQL["session_nodes"] = over(f"log AS (SELECT * FROM log0 WHERE id BETWEEN {_newest('start_id')} AND {_newest('end_id')})", OPEN_NODES, "rn")

PAGE = "CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN s = '' THEN '' WHEN length(s) > 48 THEN '?' || s[:48] || '…' ELSE '?' || s END"
PAGES = f"""(SELECT h, {PAGE} AS page FROM (SELECT {HOST.format('url')} AS h, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS s FROM log WHERE kind = 'nav'))"""
BUSIEST = "(SELECT key FROM gn ORDER BY visits DESC, key LIMIT 1)"


@query(f"SELECT page, count(*) AS visits FROM {PAGES} WHERE h = {BUSIEST} GROUP BY page ORDER BY visits DESC, page LIMIT 25", "g")
def top_pages_of_host(spark, sf):
    return session_views.top_pages(source.driver_log(spark, sf), _focus(_graph(spark, sf)))


@query(f"SELECT page, count(*) AS visits FROM {PAGES} WHERE regexp_extract(h, '[^.]+\\.[^.]+$') = regexp_extract({BUSIEST}, '[^.]+\\.[^.]+$') GROUP BY page ORDER BY visits DESC, page LIMIT 25", "g")
def top_pages_of_domain(spark, sf):
    key = spark.createDataFrame([(_focus(_graph(spark, sf)),)], "host string")
    return session_views.top_pages(source.driver_log(spark, sf), urls.registrable(key).first().registrable, by_domain=True)


LINES = """CASE kind WHEN 'nav' THEN 'tab ' || tab || ' → ' || url || ' [' || CASE prov WHEN 'form' THEN 'form_submit' WHEN 'search_origin' THEN 'generated' WHEN 'bookmark' THEN 'auto_bookmark' WHEN 'typed_url' THEN 'typed' ELSE prov END
    || CASE WHEN redirect AND back THEN ' client_redirect,forward_back' WHEN redirect THEN ' client_redirect' WHEN back THEN ' forward_back' ELSE '' END || ']'
    WHEN 'link' THEN 'tab ' || src_tab || ' → new tab ' || new_tab WHEN 'close' THEN 'tab ' || tab WHEN 'focus' THEN 'tab ' || tab || ' active in window ' || win
    WHEN 'wfocus' THEN CASE WHEN win < 0 THEN 'browser blurred' ELSE 'window ' || win || ' focused' END WHEN 'start' THEN 'browser start' END"""


@query(f"SELECT id, ts, kind, {LINES} AS line, (SELECT count(*) FROM log) AS total FROM log WHERE id > 1000 ORDER BY id LIMIT 1000", "log")
def raw_log_page(spark, sf):
    """The second page of the raw log as lines, navs among them, with the number of all events."""
    return source.raw_page(source.driver_log(spark, sf), after_id=1000)


# --- local calendars


def _zone_sql(tz: str, body: str) -> str:
    local = f"timezone('{tz}', make_timestamptz(start_ts * 1000))"
    return sql(body.replace("{local}", local), "s")


GRID = """SELECT CAST(day AS VARCHAR) AS day, CAST(n // 7 AS INT) AS week, CAST(n % 7 AS INT) AS weekday, sessions, navs,
    CASE WHEN navs <= 0 THEN 0 WHEN navs / m > 0.75 THEN 4 WHEN navs / m > 0.5 THEN 3 WHEN navs / m > 0.25 THEN 2 ELSE 1 END AS level
    FROM (SELECT n, day, count(l.day2) AS sessions, CAST(coalesce(sum(nav_count), 0) AS BIGINT) AS navs, (SELECT max(x) FROM (SELECT sum(nav_count) AS x FROM s WHERE NOT open GROUP BY CAST({local} AS DATE))) AS m
    FROM (SELECT n, t + CAST(n - dayofweek(t) - 52 * 7 AS INT) AS day FROM (SELECT max(CAST({local} AS DATE)) AS t FROM s WHERE NOT open), range(371) r(n)) g
    LEFT JOIN (SELECT CAST({local} AS DATE) AS day2, nav_count FROM s WHERE NOT open) l ON l.day2 = g.day GROUP BY n, day)"""


def _grid(spark, sf, tz: str) -> DataFrame:
    done = _tables(spark, sf, "sessions").where("not open")
    today = project.calendar(done, tz).agg(F.max("day")).first()[0]  # one row
    return _text(project.calendar_grid(done, today, tz), "day")


@query()
def calendar_berlin(spark, sf):
    """53 weeks of local days, empty ones too."""
    return _grid(spark, sf, "Europe/Berlin")


@query()
def calendar_los_angeles(spark, sf):
    return _grid(spark, sf, "America/Los_Angeles")


ORACLE_SQL["calendar_berlin"] = _zone_sql("Europe/Berlin", GRID)
ORACLE_SQL["calendar_los_angeles"] = _zone_sql("America/Los_Angeles", GRID)
ACTIVITY = f"""SELECT (SELECT count(*) FROM s WHERE NOT open) AS n, (SELECT list_sort(list(nav_count))[(count(*) // 2) + 1] FROM s WHERE NOT open) AS median_navs,
    (SELECT CAST(arg_max(h, n * 100 + h) AS INT) FROM (SELECT hour({{local}}) AS h, count(*) AS n FROM s WHERE NOT open GROUP BY 1)) AS busiest_hour,
    (SELECT CAST(arg_max(w, n * 100 + w) AS INT) FROM (SELECT dayofweek({{local}}) AS w, count(*) AS n FROM s WHERE NOT open GROUP BY 1)) AS busiest_weekday, nav_count AS longest_navs,
    (SELECT {{first_host}}) AS longest_host FROM (SELECT id, nav_count FROM s WHERE NOT open ORDER BY nav_count DESC, id DESC LIMIT 1) b"""
FIRST = "arg_min(host, -n * 1000000000 + hash_order) FROM (SELECT host, n, row_number() OVER (ORDER BY host) AS hash_order FROM (SELECT host, count(*) AS n FROM (SELECT host, min(id) OVER (PARTITION BY epoch, win, run) AS sid FROM s1) WHERE sid = b.id AND host IS NOT NULL GROUP BY host))"


@query()
def local_activity(spark, sf):
    return project.local_activity(_tables(spark, sf, "sessions").where("not open"), "America/Los_Angeles")


ORACLE_SQL["local_activity"] = _zone_sql("America/Los_Angeles", ACTIVITY.replace("{first_host}", FIRST))


# --- reports


@query("SELECT count(*) AS total, count(*) > 150 AS capped FROM s", "s")
def journey_scope(spark, sf):
    return sequences.journey_scope(_tables(spark, sf, "sessions"))


@query(f"SELECT host, CAST(sum(visits) AS BIGINT) AS visits FROM rn WHERE {WEEK} AND regexp_extract(host, '[^.]+\\.[^.]+$') = regexp_extract({BUSIEST}, '[^.]+\\.[^.]+$') GROUP BY host", "g")
def hosts_of_domain(spark, sf):
    key = spark.createDataFrame([(_focus(_graph(spark, sf)),)], "host string")
    return project.hosts_of(_nodes(spark, sf), urls.registrable(key).first().registrable, "week")


def _csv_sql() -> str:
    """The document's sections as SQL: (section, row, line) of each, then titles and headers."""
    kind = "CASE greatest(kind_link, kind_search_link, kind_form) WHEN kind_link THEN 'Link' WHEN kind_search_link THEN 'SearchLink' ELSE 'Form' END"
    ends = "(SELECT src AS key, weight FROM ge UNION ALL SELECT dst, weight FROM ge)"
    stats = f"(SELECT host, bool_or({WEEK}) AS here, sum(CASE WHEN {WEEK} THEN visits ELSE 0 END) AS w, min(date) AS first FROM rn GROUP BY host)"
    days = " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(tables_csv.WEEKDAYS))
    hops = "(SELECT src, dst, weight, weight / sum(weight) OVER (PARTITION BY src) AS share, sum(weight) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM ge)"
    parts = [
        ("Range summary", "Metric,Value", True, f"""SELECT unnest(['Range,This week', 'Sites,' || h, 'Visits,' || v, 'Newly discovered,' || f, 'Revisit rate,' || CAST(round(greatest(v - h, 0) * 100 / v) AS INT) || '%']) AS line, unnest(range(5)) AS o
          FROM (SELECT count(*) FILTER (here) AS h, CAST(sum(w) AS BIGINT) AS v, count(*) FILTER (first BETWEEN {LATEST} - 6 AND {LATEST}) AS f FROM {stats})""", "o"),
        ("Top hubs", "Host,Degree,Dwell est (ms),Foreground (ms)", True, f"SELECT concat_ws(',', gn.key, w, dwell_ms, fg_dwell_ms) AS line, w, gn.key FROM gn JOIN (SELECT n.key, CAST(coalesce(sum(e.weight), 0) AS BIGINT) AS w FROM gn n LEFT JOIN {ends} e USING (key) GROUP BY n.key) h USING (key)", "w DESC, key"),
        ("Launch pads", "Host,Outbound", True, "SELECT src || ',' || CAST(sum(weight) AS BIGINT) AS line, sum(weight) AS w, src AS key FROM ge GROUP BY src", "w DESC, key"),
        ("Destinations", "Host,Inbound", True, "SELECT dst || ',' || CAST(sum(weight) AS BIGINT) AS line, sum(weight) AS w, dst AS key FROM ge GROUP BY dst", "w DESC, key"),
        ("Surging this period", "Host,Now,Before", False, f"SELECT concat_ws(',', host, CAST(now AS BIGINT), CAST(coalesce(prev, 0) AS BIGINT)) AS line, now / greatest(coalesce(prev, 0), 1) AS r, now, host FROM {TWO} WHERE now >= 3 AND now > coalesce(prev, 0)", "r DESC, now DESC, host"),
        ("Where you usually go next", "From,To,Share %", False, f"SELECT concat_ws(',', src, dst, CAST(round(share * 100) AS BIGINT)) AS line, share, weight, src, dst FROM {hops} WHERE place = 1 AND total >= 4", "share DESC, weight DESC, src, dst"),
        ("Back-and-forth", "A,B,A→B,B→A", False, "SELECT concat_ws(',', x.src, x.dst, x.weight, y.weight) AS line, least(x.weight, y.weight) AS m, x.src, x.dst FROM ge x JOIN ge y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst", "m DESC, src, dst"),
        ("Where your searches went", "Destination,From searches", False, "SELECT dst || ',' || CAST(sum(kind_search_link) AS BIGINT) AS line, sum(kind_search_link) AS w, dst AS key FROM ge WHERE kind_search_link > 0 GROUP BY dst", "w DESC, key"),
        ("Top edges", "From,To,Weight,Kind", True, f"SELECT concat_ws(',', src, dst, weight, {kind}) AS line, weight, src, dst FROM ge", "weight DESC, src, dst"),
        ("Origination", "Provenance,Count", True, " UNION ALL ".join(f"SELECT '{label},' || CAST(coalesce(sum(prov_{p}), 0) AS BIGINT) AS line, {k} AS o FROM rn" for k, (p, label) in enumerate(tables_csv.ORIGINS.items())), "o"),
        ("Rhythm (local time)", "Weekday,Hour,Visits", False, f"""SELECT CASE wd {days} END || ',' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':00,' || count(*) AS line, wd, hour
          FROM (SELECT (date_diff('day', DATE '1970-01-01', date) + 3 + (hour + 2) // 24) % 7 AS wd, (hour + 2) % 24 AS hour FROM v WHERE NOT provisional) GROUP BY wd, hour""", "wd, hour"),
    ]
    rows = " UNION ALL ".join(f"SELECT {k} AS section, CAST(row_number() OVER (ORDER BY {o}) AS INT) AS row, line FROM ({q})" for k, (_, _, _, q, o) in enumerate(parts))
    heads = " UNION ALL ".join(
        f"SELECT {k}, unnest([{'' if not k else '-2, '}-1, 0]), unnest([{'' if not k else chr(39) * 2 + ', '}'{t}', '{h}'])" + ("" if always else f" WHERE EXISTS (SELECT 1 FROM docs WHERE section = {k})")
        for k, (t, h, always, _, _) in enumerate(parts)
    )
    return sql("", "g").rstrip() + f",\ndocs AS MATERIALIZED ({rows})\nSELECT section, row, line FROM docs WHERE row <= 10000 UNION ALL {heads}"


@query()
def csv_document(spark, sf):
    """Every section that SQL can express of the document of all tables, line by line."""
    tables = tables_csv.sections(_nodes(spark, sf), _tables(spark, sf, "days"), _graph(spark, sf), "week", offset_hours=2, iterative=False)
    return tables_csv.lines(tables)


ORACLE_SQL["csv_document"] = _csv_sql()


# --- SQL functions


@query(f"SELECT h AS host, regexp_extract(h, '[^.]+\\.[^.]+$') AS domain, page, count(*) AS n FROM {PAGES} WHERE h IS NOT NULL GROUP BY ALL", "log")
def pages_by_sql(spark, sf):
    """A user's own SQL over the URL functions."""
    sql_functions.register(spark)
    log = source.driver_log(spark, sf).where("kind = 'nav'")
    told = log.selectExpr("url_host(url) AS host", "url_page(url) AS page").where("host IS NOT NULL")
    return told.selectExpr("host", "url_domain(host) AS domain", "page").groupBy("host", "domain", "page").agg(F.count("*").alias("n"))
