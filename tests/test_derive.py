"""The window derivation against the sequential fold, on random streams and on hand-written traces."""

import random

from pyspark.sql import functions as F

from trailmark.operators import derive, rollup
from trailmark.schema import LOG
from trailmark.streaming.fold import Fold

URLS = ["https://a.com/", "https://b.org/x", "https://c.net/?q=1", "https://a.com/page2", "https://sub.b.org/", "chrome://newtab"]
KINDS = ["link", "typed", "generated", "form_submit", "reload", "start_page"]


def stream(seed: int) -> list[dict]:
    r, ts, out = random.Random(seed), 10**12, []
    for k in range(r.randrange(40)):
        ts = max(10**12, ts + (r.randrange(0, 1500) if r.random() < 0.4 else r.randrange(-200_000, 4_000_000)))
        kind = r.choices(["nav", "link", "close", "start", "focus", "wfocus"], [6, 2, 2, 1, 3, 2])[0]
        e = dict.fromkeys(LOG.names)
        e.update(id=k + 1, ts=ts, kind=kind, tab=r.randrange(1, 5), win=r.randrange(1, 3), redirect=False, back=False)
        if kind == "nav":
            e.update(url=r.choice(URLS), transition=r.choice(KINDS), redirect=r.random() < 0.25, back=r.random() < 0.15)
        if kind == "link":
            e.update(new_tab=r.randrange(1, 5), src_tab=r.randrange(1, 5))
        if kind == "wfocus" and r.random() < 0.34:
            e["win"] = -1
        out.append(e)
    return out


def folded(events, split=None):
    fold = Fold()
    if split is None:
        return fold, fold.feed(events)
    first = fold.feed(events[:split])
    second = Fold(__import__("json").loads(__import__("json").dumps(fold.state())))
    return second, first + second.feed(events[split:])


def test_every_split_gives_the_same():
    for seed in range(60):
        events = stream(seed)
        whole, out = folded(events)
        for k in range(len(events) + 1):
            again, parts = folded(events, k)
            assert parts == out and again.state() == whole.state()


def test_windows_equal_the_fold(spark):
    """Many streams run as one log, an epoch apart: a start between them and ids of their own blocks."""
    every, at = [], 0
    for seed in range(200, 420):
        events = stream(seed)
        for e in events:
            every.append({**e, "id": at + e["id"]})
        at += len(events) + 1
        every.append({**dict.fromkeys(LOG.names), "id": at, "ts": 10**12, "kind": "start", "redirect": False, "back": False})
    every = every[:-1]
    fold, want = folded(every)
    want = want + [{**x, "open": True} for x in fold.provisional()]
    log = spark.createDataFrame([tuple(e[n] for n in LOG.names) for e in every], LOG)
    old, derive.BLOCK_BITS = derive.BLOCK_BITS, 5
    try:
        seq = derive.sequenced(log).cache()
        got = {(r.host, r.prov, r.ts, r.id, r.dwell_ms, r.trigger_id, r.src, r.edge_kind, r.provisional) for r in derive.visits(seq).collect()}
        fg = sorted((r.host, r.fg_ms, r.trigger_id) for r in derive.foreground(seq).collect())
        sess = {(r.id, r.win, r.start_ts, r.end_ts, r.end_id, r.nav_count, tuple((t.host, t.n) for t in r.top_hosts), r.open) for r in derive.sessions(seq).collect()}
        days = {str(r.date): r.max_id for r in rollup.build(log)["days"].collect()}
    finally:
        derive.BLOCK_BITS = old
    v = {(x["host"], x["prov"], x["ts"], x["id"], x["ms"], x["trigger_id"], x["src"], x["edge_kind"], x.get("open", False)) for x in want if x["what"] == "visit"}
    assert got == v and len(v) > 500
    assert fg == sorted((x["host"], x["ms"], x["trigger_id"]) for x in want if x["what"] == "fg") and len(fg) > 100
    load = __import__("json").loads
    ws = {(x["id"], j["win"], j["start_ts"], j["end_ts"], j["end_id"], j["nav_count"], tuple(map(tuple, j["top_hosts"])), x.get("open", False)) for x in want if x["what"] == "session" for j in [load(x["json"])]}
    assert sess == ws
    assert days and max(days.values()) <= at


def events_of(spark, *rows):
    """Rows (ts, kind, values)."""
    out = []
    for k, (ts, kind, values) in enumerate(rows):
        out.append({**dict.fromkeys(LOG.names), "redirect": False, "back": False, "win": 1, "tab": 1, **values, "id": k + 1, "ts": ts, "kind": kind})
    return spark.createDataFrame([tuple(e[n] for n in LOG.names) for e in out], LOG)


def nav(ts, host, transition="link", **more):
    return ts, "nav", {"url": f"https://{host}/", "transition": transition, **more}


def test_redirects_collapse_and_respawned_tabs_drop(spark):
    log = events_of(spark, nav(100, "p.com", "typed"), nav(200, "r1.com"), nav(500, "r2.com", redirect=True), nav(900, "r3.com", redirect=True), (1000, "close", {}))
    got = {(r.src, r.host) for r in derive.visits(derive.sequenced(log)).collect()}
    assert got == {(None, "p.com"), ("p.com", "r3.com")}
    log = events_of(spark, nav(100, "a.com", "typed"), (200, "link", {"new_tab": 1, "src_tab": 2}), nav(300, "b.com"), (400, "close", {}))
    assert [r.host for r in derive.visits(derive.sequenced(log)).collect()] == ["b.com"]


def test_session_gap_is_exclusive_and_hosts_are_capped(spark):
    log = events_of(spark, nav(0, "a.com"), nav(1_800_000, "b.com"), nav(3_600_001, "c.com"))
    assert sorted(r.nav_count for r in derive.sessions(derive.sequenced(log)).collect()) == [1, 2]
    hosts = [f"h{k:03}.com" for k in range(72)] + ["h000.com", "h071.com"]
    log = events_of(spark, *[nav(k, h) for k, h in enumerate(hosts)])
    top = derive.sessions(derive.sequenced(log)).first().top_hosts
    assert [(t.host, t.n) for t in top[:2]] == [("h000.com", 2), ("h001.com", 1)]


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert all(df.count() == 0 for df in rollup.build(log).values())


def test_merging_deltas_equals_a_full_build(spark):
    log = events_of(spark, *[nav(k * 40_000_000, f"h{k % 3}.com") for k in range(9)])
    full = rollup.build(log)
    for name in ("nodes", "edges", "days"):
        halves = [full[name].where(F.hash("date") % 2 == k) for k in (0, 1, -1)]
        assert sorted(map(str, rollup.merge(name, *halves).collect())) == sorted(map(str, full[name].select(rollup.merge(name, *halves).columns).collect()))


def test_only_what_a_query_asks_for_is_derived(spark):
    """Searches need the log in order alone, pairs of hosts no sessions and no days."""
    from trailmark import registry
    from trailmark.plans import queries

    sf = "/root/testdata/sf0.001"
    key = (spark.sparkContext.applicationId, sf)
    before = queries._FOLDERS.pop(key, None)
    try:
        assert registry.QUERIES["top_searches"](spark, sf).count() > 0
        assert queries._KEPT[queries._FOLDERS[key]] == {"blocked", "blocks"}
        registry.QUERIES["reciprocal_pairs"](spark, sf).collect()
        assert queries._KEPT[queries._FOLDERS[key]] == {"blocked", "blocks", "visits", "fg", "nodes", "edges"}
    finally:
        if before is not None:
            queries._FOLDERS[key] = before


def test_the_log_is_read_once_for_its_order(spark):
    """What crosses blocks comes from the written rows, so the log itself isn't computed again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    log = spark.createDataFrame([tuple(e[n] for n in LOG.names) for e in stream(11) or stream(12)], LOG)
    n = log.count()
    assert derive.sequenced(log.mapInArrow(counted, LOG)).count() and read.value == n
