"""The store: commits of several tables, streaming into it, open pages, redaction, meta; numbers for rows without ids."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_derive import stream
from trailmark.operators import derive, rollup, session_views
from trailmark.schema import LOG
from trailmark.sources import numbering
from trailmark.streaming import fold

TABLES = ("nodes", "edges", "days", "sessions")


def long_log(first: int, n: int, shift: int = 40_000_000) -> list[dict]:
    """Many streams as one log, some days apart."""
    out = []
    for seed in range(first, first + n):
        for e in stream(seed):
            out.append({**e, "id": len(out) + 1, "ts": e["ts"] + (seed - first) * shift})
    return out


def log_of(spark, events):
    return spark.createDataFrame([tuple(e[n] for n in LOG.names) for e in events], LOG)


def told(df) -> list[str]:
    return sorted(str(r.asDict(recursive=True)) for r in df.select(sorted(df.columns)).collect())


def same(tables, want) -> None:
    for n in TABLES:
        assert told(tables[n].select(want[n].columns)) == told(want[n]), n


def test_numbers_have_no_gap_and_no_repeat(spark):
    rows = spark.range(1_000_000).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    got = numbering.numbered(rows, "at", "id", name="n")
    low, high, count, distinct = got.agg(F.min("n"), F.max("n"), F.count("*"), F.count_distinct("n")).first()
    assert (low, high, count, distinct) == (1, 1_000_000, 1_000_000, 1_000_000)
    first = [r.id for r in got.orderBy("n").select("id").limit(50).collect()]
    assert first == [r.id for r in rows.orderBy("at", "id").select("id").limit(50).collect()]
    assert numbering.numbered(rows.limit(0), "id", name="n").count() == 0


def test_both_streams_get_ids_of_their_own(spark):
    events = spark.range(200_000).selectExpr("id * 2 AS id", "id * 10 AS ts", "'nav' AS kind", "'e' AS url")
    spa = spark.range(200_000).selectExpr("id * 2 + 1 AS id", "id * 10 - id % 40 AS ts", "'nav' AS kind", "'s' AS url")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        both = session_views.source_log(events, spa, True)
        assert both.agg(F.count_distinct("id"), F.min("id"), F.max("id"), F.count("*")).first()[:] == (400_000, 1, 400_000, 400_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_files_without_ids(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"file": k, "row": j}) for j in range(40)))
    rows = numbering.ingested(spark, str(tmp_path / "in"), schema="file int, row int").orderBy("id").collect()
    assert [(r.id, r.file, r.row) for r in rows] == [(40 * k + j + 1, k, j) for k in range(3) for j in range(40)]


def streamed(spark, store, folder, parts):
    for part in parts:
        log_of(spark, part).coalesce(1).write.mode("append").parquet(folder)
        query = fold.into(store, spark.readStream.schema(LOG).parquet(folder))
        query.awaitTermination(180)
        assert query.exception() is None


def test_a_log_is_folded_block_by_block(spark, tmp_path, monkeypatch):
    events, sizes, real = long_log(700, 6), [], rollup.Store.upsert
    monkeypatch.setattr(rollup.Store, "upsert", lambda self, deltas, batch=None: (sizes.append(batch), real(self, deltas, batch))[1])
    monkeypatch.setattr(fold, "STEP", 7)
    store, log = rollup.Store(spark, str(tmp_path / "store")), log_of(spark, events)
    fold.into_by_blocks(store, log.repartition(3), str(tmp_path / "in"), rows=-(-(len(events) + 1) // 3))
    assert sizes == [0, 1, 2]
    same({n: df.drop("open") for n, df in fold.live(store).items()}, rollup.build(log, provisional=True))


def test_a_stream_killed_between_tables_counts_once(spark, tmp_path, monkeypatch):
    events = long_log(500, 6)
    cuts = [0, len(events) // 3, 2 * len(events) // 3, len(events)]
    parts = [events[a:b] for a, b in zip(cuts, cuts[1:])]
    store, folder = rollup.Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    streamed(spark, store, folder, parts[:1])
    seen = {n: told(store.read(n)) for n in TABLES}
    whole, put, calls = store.manifest.put, store.manifest.put, []

    def dying(df, name):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("killed between tables")
        return put(df, name)

    monkeypatch.setattr(store.manifest, "put", dying)
    with pytest.raises(Exception, match="killed between tables"):
        streamed(spark, store, folder, parts[1:2])
    assert {n: told(store.read(n)) for n in TABLES} == seen  # nothing of the batch is visible
    monkeypatch.setattr(store.manifest, "put", whole)
    streamed(spark, store, folder, parts[2:])
    log = log_of(spark, events)
    same({n: store.read(n) for n in TABLES}, rollup.build(log))
    same({n: df.drop("open") for n, df in fold.live(store).items()}, rollup.build(log, provisional=True))
    store.upsert({"nodes": store.read("nodes")}, batch=0)  # a batch that comes again replaces itself
    assert store.manifest.vacuum() > 0 and store.read("nodes").count() > 0


def test_parts_are_merged_and_counted_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollup, "PARTS", 3)
    nodes = rollup.build(log_of(spark, long_log(520, 2)))["nodes"].cache()
    store = rollup.Store(spark, str(tmp_path / "store"))
    for k in range(6):
        store.upsert({"nodes": nodes}, batch=k)
        store.upsert({"nodes": nodes}, batch=max(0, k - 4))
    assert len(store.manifest.read()["tables"]["nodes"]) <= 4
    one = {(r.date, r.host): r.visits for r in nodes.collect()}
    assert {(r.date, r.host): r.visits for r in store.read("nodes").collect()} == {k: 6 * v for k, v in one.items()}


def test_redaction_equals_a_build_of_the_redacted_log(spark, tmp_path):
    events = long_log(540, 12)
    log, store = log_of(spark, events), rollup.Store(spark, str(tmp_path / "store"))
    store.write({"events": log, **rollup.build(log)})
    store.forget("b.org")
    kept = [e for e in events if "b.org" not in (e["url"] or "")]
    assert told(store.read("events")) == told(log_of(spark, kept))
    assert not any("b.org" in x for n in TABLES for x in told(store.read(n)))
    times = sorted(e["ts"] for e in kept)
    low, high = times[len(times) // 3], times[len(times) // 2]
    store.delete_range(low, high)
    kept = [e for e in kept if not low <= e["ts"] <= high]
    same({n: store.read(n) for n in TABLES}, rollup.build(log_of(spark, kept)))


def test_clean_days_are_not_derived_again(spark):
    from trailmark.operators import redaction

    events = [e for e in long_log(580, 8)]
    old = derive.sequenced(log_of(spark, events))
    gone = next(e for e in events if e["kind"] == "nav")
    days = redaction.dirty_days(old, log_of(spark, [e for e in events if e["id"] != gone["id"]]))
    assert 0 < days.count() < old.selectExpr("ts DIV 86400000").distinct().count()
    assert redaction.dirty_days(old, old).count() == 0


def test_meta_positions_reset_and_documents(spark, tmp_path):
    log = log_of(spark, long_log(600, 3))
    store = rollup.Store(spark, str(tmp_path / "store"))
    assert store.meta("lastExportTs", 0.0) == 0.0 and store.positions() is None
    store.write({"events": log, **rollup.build(log)})
    store.put_meta(lastExportTs=5.0, spaOn=True, text="x")
    store.put_meta(lastExportTs=7.0)
    assert (store.meta("lastExportTs", 0.0), store.meta("spaOn", False), store.meta("none", 3)) == (7.0, True, 3)
    assert store.meta("text", 1.0) == 1.0 and store.meta("spaOn", 0) == 0
    store.put_positions(spark.createDataFrame([("a.com", 1.0, 2.0)], "key string, x double, y double"))
    store.put_positions(spark.createDataFrame([("b.org", 3.0, 4.0)], "key string, x double, y double"))
    assert [tuple(r) for r in store.positions().collect()] == [("b.org", 3.0, 4.0)]
    assert store.counts().first()[:] == (log.count(), 0, store.read("days").count(), store.read("sessions").count())
    before = store.checkpoint()
    store.reset_derivation()
    assert not store.has("nodes") and store.has("events") and store.meta("text") == "x" and store.checkpoint() != before
    store.rebuild()
    same({n: store.read(n) for n in TABLES}, rollup.build(log))
    wire = {"kind": "nav", "id": 1, "ts": 5, "tabId": 1, "windowId": 2, "toUrl": "https://b.org/", "transitionType": "link"}
    doc = {"version": 1, "events": [wire, {**wire, "id": 2, "ts": 900_000}], "meta": [{"key": "text", "value": '"y"'}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    store.replace_from(str(tmp_path / "doc.json"))
    assert store.read("events").count() == 2 and store.read("spa").count() == 0 and store.meta("text") == "y"
    assert [(r.host, r.visits) for r in store.read("nodes").collect()] == [("b.org", 1)] and store.positions() is None
    store.clear_all()
    assert not any(store.has(n) for n in ("events", "meta", *TABLES))


def test_only_one_of_two_commits_wins(spark, tmp_path):
    store = rollup.Store(spark, str(tmp_path / "store"))
    store.put_meta(a=1)
    state = store.manifest.read()
    store.put_meta(a=2)
    with pytest.raises(Exception, match="(?i)exist"):
        store.manifest.publish(state, state["tables"], {})
    assert store.meta("a") == 2
