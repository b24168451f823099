"""Exact dedup, decontamination and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trailmark.llm import decontaminate, exact_dedup, sharding

ITEMS = [("1", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("2", "Short ITEM here"), ("10", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "null id item"), ("3", None), ("4", "..."), ("5", "été straße")]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_dedup(docs, rows, bits):
    """With four hash bits nearly all chunks collide, and the verified ranks tell them apart."""
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    got = exact_dedup.exact_dedup(docs, mean_words=8, max_words=16, hash_bits=bits).collect()
    assert len(got) == len(rows)
    want = {i: (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    assert all(want[g.doc_id] == (g.keep_id, g.group_size, g.text_sha256) for g in got)
    assert sum(g.kept for g in got) == len(groups) and all(g.doc_id == g.keep_id for g in got if g.kept)


def test_exact_dedup_of_nothing_and_null_ids(spark, none, docs):
    assert exact_dedup.exact_dedup(none).collect() == []
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((g.doc_id is None, g.keep_id is None, g.kept) for g in got) == [(False, False, True), (True, False, False), (True, True, True)]


@pytest.mark.parametrize("block", [40_000, 2])
def test_decontaminate(spark, docs, rows, block):
    more = [(1000, "x Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu y short-item here ÉTÉ été straße"), (1001, "alpha beta gamma"), (1002, "short item here short item here")]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    grams = defaultdict(set)
    for i, t in ITEMS:
        w = tokens(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            grams[tuple(w[k : k + n])].add(i)
    got = {g.doc_id: g for g in decontaminate.decontaminate(every, items, block=block).collect()}
    for i, t in [*[(r[0], r[1]) for r in rows], *more]:
        w, hit, found = tokens(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= {x for x in grams[tuple(w[k : k + n])] if x is not None}
        g = got[i]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert sum(s.end - s.start for s in g.spans) == len(hit)


def test_decontaminate_with_empty_tables(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).where("contaminated").count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame(ITEMS, "item_id string, text string")).count() == 0


def test_decontaminate_at_piece_borders_and_with_clashing_names(spark):
    """A window across two pieces of a text counts once; kept columns that bear a result's name keep their values."""
    gram = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [(k, "x " * k + gram + " y" * 9, 70 + k) for k in range(30)] + [(3, "x " * 3 + gram + " y" * 9, 70), (99, None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_words long")
    items = spark.createDataFrame([("a", gram), ("b", "kappa y"), ("b", "kappa y")], "item_id string, text string")
    for limits in ({}, {"block_bytes": 1}):
        got = decontaminate.decontaminate(docs, items, piece=8, keep=("n_words", "doc_id"), **limits)
        rows = got.collect()
        assert len(rows) == 32 and [r for r in rows if r.doc_id == 99][0].n_words == 0
        for r in (r for r in rows if r.doc_id != 99):
            assert (r.n_words, r.n_hit, r.n_items, r.kept_doc_id) == (r.doc_id + 19, 11, 2, r.doc_id)
            assert [(s.start, s.end) for s in r.spans] == [(r.doc_id, r.doc_id + 11)]
        assert sorted(r.kept_n_words for r in rows if r.doc_id == 3) == [70, 73]


def test_ring(docs, rows, none):
    got = sharding.ring_shards(docs, shards=5, vnodes=8, cells=64).collect()
    sizes = Counter(g.shard for g in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(g.slot for g in got if g.shard == s) == list(range(n))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((g.size, g.text_crc32) == (len(texts[g.doc_id]) + 8, zlib.crc32(texts[g.doc_id])) for g in got)
    assert sharding.ring_shards(none).count() == 0


def test_a_full_shard_overflows_clockwise():
    nodes, counts = [(0, 0), (4, 1), (8, 2)], {0: 5, 4: 1, 9: 3}
    plan = sharding.plan_ring(counts, nodes, [3, 3, 3])
    assert plan == [(0, 0, 3, 0, 0), (0, 3, 5, 1, 0), (4, 0, 1, 1, 2), (9, 0, 3, 2, 0)]


def test_few_keys_move_when_a_shard_comes(docs):
    a = {(r.doc_id, r.text_crc32): r.shard for r in sharding.ring_shards(docs, shards=6, vnodes=32, cells=512).collect()}
    b = {(r.doc_id, r.text_crc32): r.shard for r in sharding.ring_shards(docs, shards=7, vnodes=32, cells=512).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)


def test_native_plans_have_no_python(docs, spark):
    for df in (exact_dedup.exact_dedup(docs), sharding.ring_shards(docs), decontaminate.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id string, text string"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_attach_keeps_every_row(docs):
    from trailmark.llm.common import attach

    groups = docs.groupBy("lang").agg(F.count("*").alias("n"))
    assert attach(docs, groups, ["lang"]).where("n = 77").count() == docs.count() == 77
