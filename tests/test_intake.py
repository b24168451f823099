"""Intake of raw events, hosts outside ASCII, local calendars, warm layouts and SQL functions."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_operators import graph_of, nodes_of
from trailmark.functions import sql as sql_functions
from trailmark.functions import urls
from trailmark.operators import layout, project, session_views
from trailmark.sources import capture
from trailmark.sources import log as source

RAW = "seq long, trigger string, paused boolean, frame_id int, url string, tab_id long, window_id long, source_tab_id long, time_stamp double, now double, transition_type string, qualifiers array<string>"


def raw(seq, trigger, paused=None, frame=0, url=None, tab=1, win=2, src=None, ts=None, now=100.0, marks=None):
    return (seq, trigger, paused, frame, url, tab, win, src, ts, now, "link", marks)


def test_capture(spark):
    rows = [
        raw(1, "committed", url="https://münchen.de/", ts=7.5, marks=["forward_back"]), raw(2, "committed", frame=3, url="https://a.co/"),
        raw(3, "history", url="https://a.co/x", win=None), raw(4, "pause", paused=True), raw(5, "removed"), raw(6, "startup"), raw(7, "pause", paused=False),
        raw(8, "focus_changed", win=-2), raw(9, "created_target", tab=5, src=1), raw(10, "activated"), raw(11, "committed", url="chrome-extension://me/x"), raw(12, "moved"),
    ]
    stores = capture.captured(spark.createDataFrame(rows, RAW).repartition(3), "chrome-extension://me/")
    got = [(r.id, r.kind, r.ts, r.tab, r.win, r.new_tab, r.src_tab, r.url, r.back) for r in stores["events"].orderBy("id").collect()]
    assert got == [
        (1, "nav", 7, 1, 2, None, None, "https://xn--mnchen-3ya.de/", True), (2, "start", 100, None, None, None, None, None, False),
        (3, "wfocus", 100, None, -1, None, None, None, False), (4, "link", 100, None, None, 5, 1, None, False), (5, "focus", 100, 1, 2, None, None, None, False),
    ]
    assert [(r.id, r.win, r.url) for r in stores["spa"].collect()] == [(1, 0, "https://a.co/x")]
    assert all(df.count() == 0 for df in capture.captured(spark.createDataFrame([], RAW)).values())


def test_hosts_outside_ascii_where_a_log_is_taken_in(spark, tmp_path):
    doc = tmp_path / "doc.json"
    doc.write_text('{"version": 1, "events": [{"kind": "nav", "id": 1, "ts": 5, "tabId": 1, "windowId": 1, "toUrl": "https://Bücher.example/x"}]}')
    row = source.read_document(spark, str(doc))["events"].select(urls.host(F.col("url")).alias("h")).first()
    assert row.h == "xn--bcher-kva.example"


def test_calendar_follows_clock_changes(spark):
    ms = lambda *at: int(dt.datetime(*at, tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = [(ms(2024, 3, 30, 23, 30), 4), (ms(2024, 3, 31, 22, 30), 2), (ms(2023, 3, 29, 12), 1), (ms(2020, 1, 1), 9)]
    s = spark.createDataFrame(rows, "start_ts long, nav_count long")
    grid = project.calendar_grid(s, dt.date(2024, 4, 3), "Europe/Berlin")
    got = {r.day: (r.week, r.weekday, r.sessions, r.navs, r.level) for r in grid.collect()}
    assert len(got) == 371 and min(got) == dt.date(2023, 4, 2) and max(got) == dt.date(2024, 4, 6)
    assert got[dt.date(2024, 3, 31)] == (52, 0, 1, 4, 2) and got[dt.date(2024, 4, 1)] == (52, 1, 1, 2, 1) and got[dt.date(2024, 4, 2)] == (52, 2, 0, 0, 0)


def test_local_activity(spark):
    rows = [(k, h * 3_600_000, n, [("a.co", 1)]) for k, h, n in [(1, 1, 3), (2, 1, 5), (3, 5, 5), (4, 30, 1)]]
    s = spark.createDataFrame(rows, "id long, start_ts long, nav_count long, top_hosts array<struct<host:string,n:long>>")
    r = project.local_activity(s, "America/Los_Angeles").first()
    assert (r.n, r.median_navs, r.busiest_hour, r.busiest_weekday, r.longest_navs, r.longest_host) == (4, 5, 17, 3, 5, "a.co")
    assert project.local_activity(s.limit(0)).count() == 0


def test_a_layout_begins_where_one_was_left(spark):
    g = graph_of(spark, [("a", "b", 3), ("b", "c", 1)])
    start = spark.createDataFrame([("a", 5.0, 6.0), ("c", -7.0, 8.0), ("gone", 1.0, 1.0)], "key string, x double, y double")
    at = {r.key: (r.x, r.y) for r in layout.layout(g, rounds=0, start=start).collect()}
    assert at["a"] == (5.0, 6.0) and at["c"] == (-7.0, 8.0) and set(at) == {"a", "b", "c"}


def test_the_session_range_shows_its_session_only(spark):
    nodes = nodes_of(spark, [("2021-01-03", "a.co", 4)])
    none = spark.createDataFrame([], "id long, start_ts long, start_id long, end_id long")
    shown = session_views.displayed(session_views.View("session"), {"nodes": nodes, "edges": nodes, "days": nodes, "sessions": none}, None)
    assert shown["nodes"].count() == 1  # without any session the days of the range


def test_sql_functions(spark):
    sql_functions.register(spark)
    q = lambda x: spark.sql(f"SELECT {x}").first()[0]
    hosts = ["www.a.co.uk", "x.github.io", "co.uk", "10.1.2.3", "[::1]", "a.b.ck", "www.ck", "one", "y.x.kawasaki.jp", "city.kawasaki.jp", "a.com."]
    told = {r.host: r.registrable for r in urls.registrable(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert {h: q(f"url_domain('{h}')") for h in hosts} == told
    assert q("url_page('https://a.co')") == "/" and q("url_page('https://a.co/x?q=1#y')") == "/x?q=1"
    assert q("url_terms('https://www.google.de/search?hl=en&q=two+words')") == "two words" and q("url_engine('https://www.google.de/search?q=x')") == "Google"
    assert q("url_engine('https://a.co/search?q=x')") is None and q("url_host('https://A.co:8/x')") == "a.co" and q("utc_hour(3600000)") == 1


def test_one_csv_document_of_all_sections(spark, tmp_path):
    from tests.test_operators import edges_of
    from trailmark.sources import tables_csv

    nodes = nodes_of(spark, [("2021-01-03", "a,x.co", 4), ("2021-01-03", "b.co", 6), ("2021-01-02", "c.co", 1)])
    edges = edges_of(spark, [("a,x.co", "b.co", 5, 1), ("b.co", "a,x.co", 2), ("b.co", "c.co", 1)]).withColumn("date", F.lit("2021-01-03").cast("date"))
    hours = F.array(*[F.lit(7 if h == 23 else 0).cast("long") for h in range(24)])
    days = spark.range(1).select(F.lit("2021-01-03").cast("date").alias("date"), hours.alias("visits_by_hour"))
    tables = tables_csv.sections(nodes, days, project.project(nodes, edges), "week", offset_hours=2)
    tables_csv.write_document(tables, str(tmp_path / "doc"))
    parts = list((tmp_path / "doc").glob("part-*"))
    text = parts[0].read_text()
    assert len(parts) == 1 and text.startswith("Range summary\nMetric,Value\nRange,This week\nSites,3\nVisits,11\nNewly discovered,3\nRevisit rate,73%\n\nTop hubs\n")
    blocks = dict(b.split("\n", 1) for b in text.strip("\n").split("\n\n"))
    # One community has no bridge sites, so that section is left out.
    assert list(blocks)[4:] == ["Authorities (PageRank)", "Surging this period", "Where you usually go next", "Back-and-forth", "Where your searches went", "Top edges", "Origination", "Rhythm (local time)"]
    assert blocks["Top edges"] == 'From,To,Weight,Kind\n"a,x.co",b.co,5,Link\nb.co,"a,x.co",2,Link\nb.co,c.co,1,Link'
    assert blocks["Rhythm (local time)"] == "Weekday,Hour,Visits\nMon,01:00,7" and blocks["Back-and-forth"].endswith('"a,x.co",b.co,5,2')
    tables_csv.write(tables, str(tmp_path / "parts"))
    assert spark.read.option("header", True).csv(str(tmp_path / "parts" / "top_hubs")).count() == 3


def test_hosts_of_a_domain(spark):
    nodes = nodes_of(spark, [("2021-01-03", "x.a.co.uk", 4), ("2021-01-02", "a.co.uk", 6), ("2021-01-03", "b.co.uk", 1)])
    assert [tuple(r) for r in project.hosts_of(nodes, "a.co.uk", "week").collect()] == [("a.co.uk", 6), ("x.a.co.uk", 4)]
