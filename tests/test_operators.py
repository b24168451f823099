"""Projection, graph, sequence, flow, URL and document operators on literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import scalars, urls
from trailmark.operators import flow, graph, layout, project, rollup, sequences, session_views
from trailmark.operators.rollup import KIND, PROV
from trailmark.schema import LOG
from trailmark.sources import log as source
from trailmark.sources import views
from trailmark.streaming.fold import host_of


def nodes_of(spark, rows):
    """(date, host, visits) rows as day rollups of links."""
    cols = T.StructType([T.StructField("date", T.DateType()), T.StructField("host", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("visits", "dwell_ms", "fg_dwell_ms", *PROV)]])
    return spark.createDataFrame([(dt.date.fromisoformat(d), h, n, 0, 0, n, *[0] * 7) for d, h, n in rows], cols)


def edges_of(spark, rows):
    cols = "src string, dst string, " + ", ".join(f"{c} long" for c in ("weight", *KIND))
    return spark.createDataFrame([(a, b, w, w - s, s, 0) for a, b, w, s in [(*r, 0)[:4] for r in rows]], cols)


def graph_of(spark, edges, visits=None):
    e = edges_of(spark, edges)
    keys = sorted({k for r in edges for k in r[:2]})
    return project.Graph(spark.createDataFrame([(k, (visits or {}).get(k, 1)) for k in keys], "key string, visits long"), e)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_windows_and_periods(spark):
    n = nodes_of(spark, [("2021-01-03", "old", 4), ("2021-01-10", "old", 6), ("2021-01-12", "new", 2), ("2021-01-15", "old", 2)])
    d = project.period_delta(n, "week").first()
    assert (d.now_visits, d.now_hosts, d.now_new, d.prev_visits, d.prev_hosts, d.visits_pct, d.no_baseline) == (10, 2, 1, 4, 1, 150, False)
    s = project.range_stats(nodes_of(spark, [("2021-01-01", "old", 1), ("2021-01-11", "old", 3), ("2021-01-11", "new", 1)]), "day").first()
    assert (s.hosts, s.visits, s.new_hosts, s.revisit_rate) == (2, 4, 1, 0.5)
    n = nodes_of(spark, [("2021-01-01", "a", 9), ("2021-01-08", "a", 2), ("2021-01-10", "b", 5), ("2021-01-11", "a", 3)])
    assert [(r.date.day, r.visits) for r in project.daily_series(n, "week").collect()] == [(8, 2), (10, 5), (11, 3)]
    n = nodes_of(spark, [("2021-01-04", "boom", 2), ("2021-01-11", "boom", 20), ("2021-01-04", "flat", 5), ("2021-01-11", "flat", 5), ("2021-01-11", "fresh", 6), ("2021-01-11", "tiny", 1)])
    assert [r.host for r in project.surging(n, "week").collect()] == ["boom", "fresh"]


def test_filters_and_domains(spark):
    n = nodes_of(spark, [("2021-01-01", "gist.github.com", 2), ("2021-01-01", "raw.github.com", 1), ("2021-01-01", "other.org", 1)])
    e = edges_of(spark, [("gist.github.com", "raw.github.com", 3), ("raw.github.com", "other.org", 2)])
    g = project.project(n, e.withColumn("date", F.lit("2021-01-01").cast("date")), by_domain=True)
    assert rows(g.nodes.select("key", "visits").orderBy("key")) == [("github.com", 3), ("other.org", 1)]
    assert rows(g.edges.select("src", "dst", "weight")) == [("github.com", "other.org", 2)]
    g = project.project(n, e, project.Filters(min_visits=2, hide_isolated=True))
    assert g.nodes.count() == g.edges.count() == 0
    assert project.project(n, e, project.Filters(provenance=())).nodes.count() == 0


@pytest.mark.parametrize(("most", "want"), [(0, [1]), (1, [1]), (3, [1, 2]), (8, [1, 2, 5]), (50, [1, 2, 5, 10, 20, 50]), (200, [1, 10, 20, 50, 100, 200])])
def test_thresholds(most, want):
    assert project.visit_thresholds(most) == want


def test_percentages_and_levels(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate((1, 1, 1))], "k int, n long")
    assert [r.pct for r in project.percentages(df, order=F.col("k")).orderBy("k").collect()] == [34, 33, 33]
    got = spark.createDataFrame([(v,) for v in (0, 25, 26, 50, 51, 75, 76, 100)], "v long").select(scalars.rhythm_level(F.col("v"), F.lit(100))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 2, 3, 3, 4, 4]


def test_stepping():
    d = dt.date.fromisoformat
    assert project.can_step_back("week", d("2021-01-21"), d("2021-01-08")) and not project.can_step_back("week", d("2021-01-21"), d("2021-01-09"))
    assert project.can_step_forward(d("2021-01-01"), d("2021-01-02")) and not project.can_step_forward(None, d("2021-01-02"))
    assert project.forward_end("week", d("2021-01-01"), d("2021-01-08")) is None and project.forward_end("day", d("2021-01-01"), d("2021-01-08")) == d("2021-01-02")


def test_relational_graph(spark):
    g = graph_of(spark, [("hub", "a", 5), ("hub", "b", 5), ("a", "b", 1)])
    assert rows(graph.hubs(g, 1)) == [("hub", 10)]
    g = graph_of(spark, [("google", "wiki", 12, 2), ("google", "docs", 5, 5)])
    assert rows(graph.search_destinations(g, 9)) == [("docs", 5), ("wiki", 2)]
    g = graph_of(spark, [("a", "b", 5), ("b", "a", 3), ("c", "d", 9)])
    assert rows(graph.reciprocal_pairs(g, 9)) == [("a", "b", 5, 3)]
    g = graph_of(spark, [("gh", "site", 9), ("gh", "other", 1), ("hub", "a", 6), ("hub", "b", 6), ("lonely", "x", 1)])
    assert [(r.src, r.dst, r.share) for r in graph.next_hops(g, 4).collect()] == [("gh", "site", 0.9), ("hub", "a", 0.5)]
    assert {r.key for r in graph.component(g, "a").nodes.collect()} == {"hub", "a", "b"}
    assert {r.key for r in graph.ego(g, "gh").nodes.collect()} == {"gh", "site", "other"} and graph.ego(g, "none").nodes.count() == 0


def test_iterative_graph(spark):
    two = [("a", "b", 10), ("b", "c", 10), ("c", "a", 10), ("x", "y", 10), ("y", "z", 10), ("z", "x", 10), ("c", "x", 1)]
    g = graph_of(spark, two)
    com = {r.key: r.community for r in graph.communities(g).collect()}
    assert com == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert {(r.key, r.score) for r in graph.bridges(g, 9).collect()} == {("c", 6.0), ("x", 6.0)}
    ranks = {r.key: r["rank"] for r in graph.pagerank(graph_of(spark, [("a", "hub", 1), ("b", "hub", 1), ("c", "hub", 1)]), rounds=12).collect()}
    assert max(ranks, key=ranks.get) == "hub" and abs(sum(ranks.values()) - 1) < 1e-6
    p = {r.key: (r.x, r.y) for r in layout.layout(g, rounds=60).collect()}
    far = lambda a, b: ((p[a][0] - p[b][0]) ** 2 + (p[a][1] - p[b][1]) ** 2) ** 0.5
    assert len(p) == 6 and far("a", "b") < far("a", "y")


def test_sequences(spark):
    chains = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "d"],), (["a", "b", "c"],)], "chain array<string>")
    got = {tuple(r.pattern): r.support for r in sequences.frequent(chains, 2, 4).collect()}
    assert got[("a", "b")] == 3 and got[("a", "b", "c")] == 2 and ("a", "b", "d") not in got
    found = spark.createDataFrame([(["a", "b"], 6), (["a", "b", "c"], 4), (["a", "b", "c", "d"], 4), (["a", "b", "c", "d", "e"], 2)], "pattern array<string>, support long")
    assert {"".join(r.pattern) for r in sequences.closed(found).collect()} == {"ab", "abcd", "abcde"}


def events(*steps):
    out = []
    for k, (ts, host, transition, *marks) in enumerate(steps):
        out.append({**dict.fromkeys(LOG.names), "id": k + 1, "ts": ts, "kind": "nav", "tab": 1, "win": 1, "url": f"https://{host}/", "transition": transition, "redirect": "R" in marks, "back": "B" in marks})
    return out


def in_sessions(spark, *sessions):
    """The events of several sessions, as DataFrame."""
    rows = [{**e, "session": k} for k, own in enumerate(sessions) for e in own]
    return spark.createDataFrame([tuple(e.get(n) for n in ("session", *LOG.names)) for e in rows], "session long, " + LOG.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


def test_chains(spark):
    typed = events((0, "a.co", "typed"), (9000, "b.co", "link"), (18000, "c.co", "link"), (27000, "d.co", "typed"), (36000, "e.co", "link"))
    moved = events((100, "a.co", "typed"), (9000, "b.co", "link"), (9300, "c.co", "link", "R"), (9400, "a.co", "link", "B"), (20000, "c.co", "link"), (30000, "d.co", "form_submit"))
    opened = events((0, "a.co", "typed"), (1, "x", "x"), (9000, "b.co", "link"), (18000, "c.co", "link"), (18001, "x", "x"), (27000, "d.co", "link"))
    opened[1].update(kind="link", src_tab=1, new_tab=2, url=None)
    opened[2]["tab"] = opened[3]["tab"] = opened[5]["tab"] = 2
    opened[4].update(kind="close", tab=2, url=None)
    got = {(r.session, *r.chain) for r in sequences.chains(in_sessions(spark, typed, moved, opened)).collect()}
    assert got == {(0, "a.co", "b.co", "c.co"), (0, "d.co", "e.co"), (1, "a.co", "c.co", "d.co"), (2, "a.co", "b.co", "c.co")}
    domains = in_sessions(spark, events((0, "gist.github.com", "typed"), (9000, "raw.github.com", "link"), (18000, "www.other.org", "link")))
    assert [r.chain for r in sequences.chains(domains, by_domain=True).collect()] == [["github.com", "other.org"]]


def test_flow(spark):
    back = events((0, "a.co", "typed"), (9000, "b.co", "link"), (18000, "c.co", "link"), (27000, "b.co", "auto_bookmark"))
    round_trip = events((0, "gh.co", "start_page"), (9000, "site.co", "link"), (18000, "gh.co", "link"))
    moved = events((100, "a.co", "typed"), (200, "b.co", "link"), (300, "c.co", "link", "R"), (5000, "d.co", "link"))
    all_ = in_sessions(spark, back, round_trip, moved)
    links = flow.flows(all_).collect()
    nodes = flow.flow_nodes(all_).collect()
    assert len([x for x in links if x.session == 0]) == 2 and sorted(n.layer for n in nodes if n.session == 0 and n.key == "b.co") == [0, 1]
    assert [n.layer for n in nodes if n.session == 0 and n.key == "c.co"] == [2]
    assert sorted((n.key, n.layer) for n in nodes if n.session == 1) == [("gh.co", 0), ("site.co", 1)] and len([x for x in links if x.session == 1]) == 2
    assert {(x.src, x.dst) for x in links if x.session == 2} == {("a.co", "c.co"), ("c.co", "d.co")}
    assert {n.key: n.prov for n in nodes if n.session == 2} == {"a.co": "typed_url", "c.co": "link", "d.co": "link"}
    assert flow.flows(all_.limit(0)).count() == 0


def test_layers():
    main, loose = flow.split_orphans(flow.layered([("a", "b")], ["c"], []))
    assert [n[0] for n in main.nodes] == ["a", "b"] and loose == [("c", 1)]
    assert [n[0] for n in flow.focused(flow.layered([("a", "b"), ("b", "c"), ("x", "b")], ["a"], []), 0, 1).nodes] == ["a", "b", "c"]


def test_urls(spark):
    cases = {"https://A.Example.com:8080/x": "a.example.com", "http://127.0.0.1/": "127.0.0.1", "http://[::1]:9/": "[::1]", "chrome://newtab": None, "file:///x": None, "about:blank": None, "no url": None, None: None, "https://u:p@h.com?q": "h.com"}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.h for r in df.select("url", urls.host(F.col("url")).alias("h")).collect()} == cases
    hosts = {"user.github.io": "github.io", "gist.github.com": "github.com", "a.b.example.co.uk": "example.co.uk", "example.com.": "example.com", "localhost": "localhost", "10.0.0.1": "10.0.0.1", "co.uk": "co.uk", "www.ck": "www.ck"}
    got = urls.registrable(spark.createDataFrame([(h,) for h in hosts], "host string"))
    assert {r.host: r.registrable for r in got.collect()} == hosts
    search = {"https://www.google.co.uk/search?hl=en&q=rust+lang": ("Google", "rust lang"), "https://duckduckgo.com/?q=a%20b": ("DuckDuckGo", "a b"), "https://www.google.com/maps?q=x": (None, None), "https://bing.com/search?q=": (None, None), "https://m.youtube.com/results?search_query=z": ("YouTube", "z")}
    got = urls.with_search(spark.createDataFrame([(u,) for u in search], "url string"))
    assert {r.url: (r.engine, r.terms) for r in got.collect()} == search
    page = spark.createDataFrame([("https://e.com",), ("https://e.com/a?b=1#f",), ("https://e.com/a?" + "x" * 50,)], "url string").select(urls.path_query(F.col("url")))
    assert [r[0] for r in page.collect()] == ["/", "/a?b=1", "/a?" + "x" * 48 + "…"]
    odd = {"https://Bücher.de/x": "xn--bcher-kva.de", "http://ex%61mple.com:80/": "example.com", "http://a%20b.com/": None, "https://пример.рф": "xn--e1afmkfd.xn--p1ai", "http://%zz.com/": None}
    df = spark.createDataFrame([(u,) for u in odd], "url string")
    told = urls.with_idna(df.withColumn("id", F.monotonically_increasing_id())).join(df.withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("url", "was"), "id")
    assert {r.was: r.h for r in told.select("was", urls.host(F.col("url")).alias("h")).collect()} == odd
    assert {u: host_of(u) for u in odd} == odd


def test_suffixes_without_a_list(spark, tmp_path, monkeypatch):
    hosts = {"a.b.example.co.uk": "example.co.uk", "www.example.com": "example.com", "localhost": "localhost", "10.0.0.1": "10.0.0.1", "x.example.io": "example.io"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    monkeypatch.setattr(urls, "_RULES", {})
    monkeypatch.setattr(urls, "suffix_text", lambda spark: None)
    assert {r.host: r.registrable for r in urls.registrable(df).collect()} == hosts
    monkeypatch.undo()
    (tmp_path / "list.dat").write_text("// ===BEGIN ICANN DOMAINS===\nio\nexample.io\n*.uk\n// ===END ICANN DOMAINS===\nignored.com\n")
    spark.conf.set("spark.trailmark.suffixList", str(tmp_path / "list.dat"))
    try:
        assert {r.host: r.registrable for r in urls.registrable(df).collect()} == hosts | {"a.b.example.co.uk": "example.co.uk", "www.example.com": "www.example.com", "x.example.io": "x.example.io"}
    finally:
        spark.conf.unset("spark.trailmark.suffixList")


def test_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(scalars.human_bytes(F.lit(n))) for n in (512, 1024, 50_541_363)] == ["512 B", "1.0 KB", "48.2 MB"]
    assert [one(scalars.dwell_label(F.lit(n))) for n in (59_000, 61_000, 3_660_000, 90_000_000)] == ["59s", "1m", "1h 1m", "1d 1h"]
    day = lambda s: F.lit(s).cast("date")
    assert one(scalars.window_label("week", day("2026-06-23"), day("2026-06-29"))) == "Jun 23 – 29" and one(scalars.window_label("day", day("2026-07-01"), day("2026-07-01"))) == "Wed, Jul 1"
    nudge = lambda n, e, s: one(scalars.backup_nudge(F.lit(n), F.lit(e).cast("long"), F.lit(s).cast("long"), F.lit(10**12)))
    assert [nudge(5000, None, None), nudge(5001, None, None), nudge(5001, 10**12 - 1, None), nudge(5001, None, 10**12)] == ["hidden", "show", "hidden", "snoozed"]


def test_documents_and_redaction(spark, tmp_path):
    wire = [{"kind": "nav", "id": 1, "ts": 10.5, "tabId": 1, "windowId": -7, "toUrl": "https://a.github.com/", "transitionType": "link", "qualifiers": ["forward_back"]}, {"kind": "odd", "id": 2, "ts": 1}, {"kind": "start", "id": 3, "ts": 30}]
    path = tmp_path / "doc.json"
    path.write_text(__import__("json").dumps({"version": 1, "events": wire, "spa": []}))
    doc = source.read_document(spark, str(path))
    log = doc["events"]
    assert [(r.id, r.ts, r.win, r.back) for r in log.orderBy("id").collect()] == [(1, 10, -1, True), (3, 30, 0, False)]
    assert source.forget(log, "github.com").count() == 1 and source.delete_range(log, 30, 30).count() == 1
    assert '"version":1' in source.export_document(log, doc["spa"]).first().json
    a = spark.createDataFrame([(1, 100), (2, 300)], "id long, ts long")
    b = spark.createDataFrame([(1, 200)], "id long, ts long")
    assert [r.ts for r in source.merged(a, b).orderBy("seq").collect()] == [100, 200, 300]
    a = spark.createDataFrame([(1, 500), (2, 100)], "id long, ts long")
    assert [r.ts for r in source.merged(a, spark.createDataFrame([(1, 300)], "id long, ts long")).orderBy("seq").collect()] == [300, 500, 100]


def test_views():
    v = views.upsert(views.upsert([], views.View(" Work ")), views.View("work", "day"))
    assert [(x.name, x.range) for x in v] == [("work", "day")] and views.load_views(views.dump(v)) == v
    assert views.load_views("{bad") == [] and views.load_preferences('{"range": "raw"}') == views.Preferences() and views.load_preferences('{"min_visits": 3}').min_visits == 3
    assert views.remove(v, "WORK ") == [] and views.find(v, "Work") is v[0]


def test_session_views(spark):
    day = session_views.DAY_MS
    rows = [(k, s, e, n, [(h, 1)]) for k, s, e, n, h in [(1, 0, 10, 1, "a.co"), (2, 3 * day, 3 * day + 5, 4, "B.co"), (3, 3 * day + 10, 4 * day + 10, 2, "a.co"), (4, 9 * day, 9 * day, 3, "c.co")]]
    s = spark.createDataFrame(rows, "id long, start_ts long, end_ts long, nav_count long, top_hosts array<struct<host:string,n:long>>")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(session_views.in_range(s, "week")) == [2, 3, 4] and ids(session_views.in_range(s, "session")) == [4]
    window = session_views.day_window(dt.date(1970, 1, 5), dt.date(1970, 1, 9))
    assert window == (4 * day, 9 * day) and ids(session_views.in_range(s, "week", window)) == [3]
    assert ids(session_views.in_range(s.limit(0), "week")) == []
    assert ids(session_views.listed(s, dt.date(1970, 1, 4), search="b.C")) == [2] and ids(session_views.listed(s, hide_trivial=True)) == [2, 3, 4]
    V = session_views.View
    assert session_views.end_day(V("week", session=3), s) == dt.date(1970, 1, 4) and session_views.end_day(V("week", session=99), s) is None
    step = lambda v, back: session_views.step(v, back, s, dt.date(1970, 1, 1), dt.date(1970, 1, 10))
    assert step(V("session", session=3), True) == V("session", session=2) and step(V("session", session=4), False) == V("session") and step(V("session", session=1), True) == V("session", session=1)
    assert step(V("session"), True) == V("session", session=3) and step(V("session", session=99), False) == V("session")
    assert step(V("day"), True) == V("day", dt.date(1970, 1, 9)) and step(V("day", dt.date(1970, 1, 9)), False) == V("day")
    ranked = spark.createDataFrame([("a", 4), ("b", 1)], "key string, score long")
    assert [(r.key, r.rel) for r in session_views.relative(ranked, "score").orderBy("key").collect()] == [("a", 100), ("b", 25)]
    nodes = spark.createDataFrame([("x.co", 3), ("y.co", 5), ("z.org", 9)], "key string, visits long")
    assert [r.key for r in session_views.find_host(nodes, " CO ").collect()] == ["y.co"] and session_views.find_host(nodes, "q").count() == 0


def test_session_rollup_starts_from_nothing(spark):
    """Against the sequential fold over the session's events alone: the opener's page is unknown."""
    own = events((0, "a.co", "typed"), (1000, "b.co", "link"), (60000, "c.co", "link"), (90000, "d.co", "typed"))
    log = spark.createDataFrame([tuple(e.get(n) for n in LOG.names) for e in own], LOG)
    got = {r.host: r.visits for r in session_views.session_rollup(log, 2, 3)["nodes"].collect()}
    assert got == {"b.co": 1, "c.co": 1}
    edges = {(r.src, r.dst) for r in session_views.session_rollup(log, 2, 3)["edges"].collect()}
    assert edges == {("b.co", "c.co")}
    spa = spark.createDataFrame([tuple({**own[0], "id": 1, "ts": 30000, "url": "https://b.co/x"}.get(n) for n in LOG.names)], LOG)
    assert session_views.source_log(log, spa, False) is log
    both = [(r.id, r.ts) for r in session_views.source_log(log, spa, True).orderBy("id").collect()]
    assert both == [(1, 0), (2, 1000), (3, 30000), (4, 60000), (5, 90000)]


def test_louvain_ties_and_modularity():
    """Equal gains go to the smaller community; no single move from the result raises modularity."""
    assert graph.louvain_labels(3, [(0, 1, 1.0), (1, 2, 1.0)])[1] == 0 and graph.louvain_labels(2, []) == [0, 1] and graph.louvain_labels(0, []) == []
    import random

    r = random.Random(1)
    edges = [(a, b, float(r.randrange(1, 5))) for a in range(24) for b in range(a + 1, 24) if r.random() < (0.6 if a // 8 == b // 8 else 0.05)]

    def modularity(com):
        m = sum(w for *_, w in edges)
        k = [sum(w for a, b, w in edges if i in (a, b)) for i in range(24)]
        return sum(w for a, b, w in edges if com[a] == com[b]) / m - sum((sum(k[i] for i in range(24) if com[i] == c) / (2 * m)) ** 2 for c in set(com))

    com = graph.louvain_labels(24, edges)
    best = modularity(com)
    assert best >= modularity([i // 8 for i in range(24)]) - 1e-9
    assert all(modularity([c if j == i else x for j, x in enumerate(com)]) <= best + 1e-9 for i in range(24) for c in set(com))


def test_communities_of_heavy_edges(spark):
    """Weights of a large log, where a gain's last digit is above any fixed tolerance, give what small ones give."""
    import random

    r = random.Random(2)
    edges = [(a, b, float(r.randrange(1, 5))) for a in range(24) for b in range(a + 1, 24) if r.random() < (0.6 if a // 8 == b // 8 else 0.05)]
    assert graph.louvain_labels(24, [(a, b, 100_003 * w) for a, b, w in edges]) == graph.louvain_labels(24, edges)
    two = [("a", "b", 10), ("b", "c", 10), ("c", "a", 10), ("x", "y", 10), ("y", "z", 10), ("z", "x", 10), ("c", "x", 1)]
    g = graph_of(spark, [(a, b, 1_000_003 * n) for a, b, n in two])
    assert {r.key: r.community for r in graph.communities(g).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert {(r.key, r.score) for r in graph.bridges(g, 9).collect()} == {("c", 6.0), ("x", 6.0)}
    assert {(r.community, r["size"]) for r in graph.community_table(g).collect()} == {("a", 3), ("x", 3)}
    assert layout.layout(g, rounds=5).count() == 6


def test_searches_sort_distinct_urls_only(spark):
    """Equal URLs are one row before their terms are told apart; terms stay those first typed."""
    from trailmark.plans import queries

    u = ["https://www.google.com/search?q=Big+cat", "https://www.google.com/search?q=big+cat", "https://a.com/"]
    found = queries.searches(spark.createDataFrame([(k, u[0 if k == 3 else 1 + k % 2]) for k in range(3, 200)], "id long, url string"), 9)
    assert rows(found) == [("Google", "Big cat", 99)]
    assert "FileScan parquet" in found._jdf.queryExecution().executedPlan().toString()  # counted and written before


def test_windows_of_a_session_have_no_end_at_its_end(spark):
    """A frame from a row to the end is summed up anew for each row: quadratic in a session."""
    from trailmark.schema import LOG

    events = spark.createDataFrame([], LOG).selectExpr("*", "0L AS session")
    for df in (sequences.chains(events), sequences.tab_rows(events), flow.landings(events)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().analyzed().toString().lower()


def test_store_counts_a_batch_once(spark, tmp_path):
    store = rollup.Store(spark, str(tmp_path / "store"))
    day, other = "2024-01-01", "2024-01-02"
    s = lambda *rows: spark.createDataFrame(rows, "id long, nav_count long")
    store.write({"nodes": nodes_of(spark, [(day, "a.co", 2)]), "sessions": s((1, 1))})
    for _ in range(2):
        store.upsert({"nodes": nodes_of(spark, [(day, "a.co", 3), (other, "b.co", 1)]), "sessions": s((1, 5), (2, 1))}, batch=7)
    store.upsert({"nodes": nodes_of(spark, [(other, "b.co", 1)])}, batch=8)
    assert {(str(r.date), r.host): r.visits for r in store.read("nodes").collect()} == {(day, "a.co"): 5, (other, "b.co"): 2}
    assert {r.id: r.nav_count for r in store.read("sessions").collect()} == {1: 5, 2: 1}
    store.write({"nodes": nodes_of(spark, [(day, "a.co", 1)])})
    assert [r.visits for r in store.read("nodes").collect()] == [1]
