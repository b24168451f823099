"""The streaming fold: batches of files give what one batch derivation gives."""

from pyspark.sql import functions as F

from tests.test_derive import stream
from trailmark.operators import derive
from trailmark.schema import LOG
from trailmark.streaming import fold


def test_batches_equal_the_batch_derivation(spark, tmp_path):
    events = stream(11) or stream(12)
    while len(events) < 25:
        events = stream(len(events) + 100)
    for k, part in enumerate((events[:9], events[9:17], events[17:])):
        spark.createDataFrame([tuple(e[n] for n in LOG.names) for e in part], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = fold.keep(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert k < 3 and query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    parts = fold.batches(out)
    log = spark.createDataFrame([tuple(e[n] for n in LOG.names) for e in events], LOG)
    seq = derive.sequenced(log)
    cols = ["host", "prov", "ts", "id", "dwell_ms", "trigger_id", "src", "edge_kind", "date", "hour"]
    assert sorted(map(str, parts["visits"].select(cols).collect())) == sorted(map(str, derive.visits(seq).where("not provisional").select(cols).collect()))
    cols = ["date", "host", "fg_ms", "trigger_id"]
    assert sorted(map(str, parts["fg"].select(cols).collect())) == sorted(map(str, derive.foreground(seq).select(cols).collect()))
    assert sorted(r.id for r in parts["sessions"].collect()) == sorted(r.id for r in derive.sessions(seq).where(~F.col("open")).collect())


def test_store_upserts_and_rebuilds(spark, tmp_path):
    from trailmark.operators import rollup

    events = [e for s in (31, 32, 33) for e in stream(s)]
    events = [{**e, "id": k + 1} for k, e in enumerate(events)]
    log = spark.createDataFrame([tuple(e[n] for n in LOG.names) for e in events], LOG)
    full, store = rollup.build(log), rollup.Store(spark, str(tmp_path / "store"))
    assert store.reconcile(log) and not store.reconcile(log)
    nodes = sorted(map(str, full["nodes"].collect()))
    assert sorted(map(str, store.read("nodes").select(full["nodes"].columns).collect())) == nodes
    store.upsert({"nodes": full["nodes"], "days": full["days"], "sessions": full["sessions"]})
    twice = {(r.date, r.host): r.visits for r in store.read("nodes").collect()}
    assert twice == {(r.date, r.host): 2 * r.visits for r in full["nodes"].collect()}
    assert store.read("sessions").count() == full["sessions"].count()
