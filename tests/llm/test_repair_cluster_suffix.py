"""Conversation repair, centroid clustering and suffix dedup against brute force, and their awkward rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm import centroids, suffix_dedup
from trailmark.llm import conversation_repair as repair

TURNS = "conv_id bigint, turn bigint, role string, text string, gone boolean, pos string, segment string, code string"
BLANKS = " \t\n\x0b\x0c\r"


def conversations(n: int = 160, seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Go on. \n", "é!", "a ", "Stop!"]
    rows = []
    for k in range(n):
        for t in range(r.randrange(1, 9)):
            role = r.choice(roles[: r.choice([2, 3, 7])]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            text = f"{k} {t}." if r.random() < 0.5 else r.choice(texts)
            rows.append((k, None if r.random() < 0.05 else t * r.choice([1, 1, 1, 2]), role, text))
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (None, 2, "assistant", "Me.")]
    return rows


def brute_rows(rows: list[tuple]) -> dict:
    """Damage and report by the definition: the cheapest, then least, of all edits, turn by turn."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = []
        for conv, turn, role, text in rows:
            if conv != c:
                continue
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            k = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            role = "user" if k == 4 else role
            turns += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        out[c] = brute(turns)
    return out


def brute(turns: list[tuple]) -> tuple:
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, faults = set(), []
    for _, role, text in turns:
        shown = text.strip(BLANKS)
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    # state -> (cost, audit, lines), with insertions
    go = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for s, (c, w, lines) in list(best.items()):
                for x in go[s]:
                    if x != "s" and (new := (c + 3, w + "I", [*lines, f"{name[x]}:"])) < best.get(x, (math.inf,)):
                        best[x] = new
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(turns, faults):
        new = {}
        for s, (c, w, lines) in best.items():
            ways = [(s, (c + 4, w + "D", lines))]
            if fault not in ("b", "d"):
                late = 3 * (fault == "t")
                if role[:1] in go[s]:
                    ways.append((role[:1], (c + late, w + "K", [*lines, f"{role}:{text}"])))
                ways += [(x, (c + 3 + late, w + "R", [*lines, f"{name[x]}:{text}"])) for x in go[s] if x != "s"]
            for x, way in ways:
                new[x] = min(new.get(x, (math.inf,)), way)
        best = inserted(new)
    cost, audit, lines = min(v for s, v in best.items() if s in ("", "a"))
    numbers = [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [t[1][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def told(df) -> dict:
    return {r.conv_id: tuple(r[c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}


def turns_of(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, None, "p", "s", "c") for r in rows], TURNS).drop("gone").repartition(5)


def test_repair_is_the_brute_force_one(spark):
    rows = conversations()
    found = repair.repair_report(repair.damaged(turns_of(spark, rows)))
    assert found.count() == 161 and told(found) == brute_rows(rows)


@pytest.mark.parametrize("bits", [0, 2])
def test_conversations_over_many_segments(spark, monkeypatch, bits):
    """With segments of one and of four turns nearly every conversation is chained over pieces."""
    monkeypatch.setattr(repair, "SEGMENT", bits)
    rows = conversations(40, 8)
    rows += [(77, k, ("user", "assistant", "system")[k * k % 3], "Same." if k % 7 == 0 else f"{k}.") for k in range(150)]
    assert told(repair.repair_report(repair.damaged(turns_of(spark, rows)))) == brute_rows(rows)


def test_dropped_conversations_empty_tables_and_equal_rows(spark):
    schema = "conv_id string, turn bigint, role string, text string"
    none = repair.repair_report(repair.damaged(spark.createDataFrame([], schema)))
    assert none.count() == 0 and [f.name for f in none.schema] == ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]
    gone = next(k for k in range(99) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = repair.repair_report(repair.damaged(turns_of(spark, [(gone, 0, "user", "Hi.")])))
    assert told(one) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    same = spark.range(3000).selectExpr("1L AS conv_id", "7L AS turn", "'user' AS role", "'Hi.' AS text")
    report = told(repair.repair_report(same))[1]
    assert report[:6] == (0, 0, 2999, 0, 2999, 4 * 2999 + 3) and Counter(report[6]) == {"D": 2999, "I": 1, "K": 1}


def test_repaired_turns_are_those_that_are_hashed(spark):
    rows = turns_of(spark, conversations(30, 3))
    reports = told(repair.repair_report(rows))
    turns = sorted((r for r in repair.repaired_turns(rows).collect() if r.conv_id is not None), key=lambda r: (r.conv_id, r.pos, r.step))
    for c, group in itertools.groupby(turns, key=lambda r: r.conv_id):
        lines = "\n".join(f"{r.role}:{r.text}" for r in group)
        assert hashlib.sha256(lines.encode()).hexdigest() == reports[c][7]


def test_ways_agree_with_whole_walks():
    r = random.Random(2)
    for _ in range(200):
        codes = [r.choice([0, 1, 2, 3]) + r.choice([0, 0, 4, 8, 16]) for _ in range(r.randrange(2, 9))]
        whole, end = repair.walked(codes, repair.costs_to_go(codes, repair.END), 0)
        at = r.randrange(1, len(codes))
        parts = [codes[:at], codes[at:]]
        joined = []
        for part, (s, goal) in zip(parts, repair.chained([repair.ways(p) for p in parts])):
            joined += [e[1:] for e in repair.walked(part, repair.costs_to_go(part, goal), s)[0]]
        assert joined == [e[1:] for e in whole]


def brute_clusters(rows: list[tuple], k: int = 16, dim: int = 64, rounds: int = 3) -> dict:
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(64 * v) for v in x]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min((dist(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), o in zip(kept, own) if o[1] == j]
                if mine:
                    centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, own))


def vectors(n: int = 400) -> list[tuple]:
    g = np.random.default_rng(3)
    middle = g.normal(size=(9, 64))
    rows = [(k, [float(np.float32(x)) for x in middle[k % 9] + g.normal(size=64) * 0.2]) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(40)] + [rows[5], (1000, [700.0] * 64), (1001, [-3e5] * 64)]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [1.0] * 63 + [math.inf]]
    return rows + [(2000 + k, x) for k, x in enumerate(odd)]


VECTORS = "vec_id bigint, embedding array<double>, cluster string, vec string, id string, scans string"
CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_are_the_brute_force_ones(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "c", "v", "i", "s") for r in rows], VECTORS).repartition(4)
    found = centroids.clustered(df)
    assert sorted(tuple(r[c] for c in CLUSTERED) for r in found.collect()) == brute_clusters(rows)
    scans = found.agg(F.sum("scans"), F.count("*")).first()
    assert scans[0] < 4 * scans[1] * 0.9  # bounds spare full scans


def test_few_equal_and_no_vectors(spark):
    few = [(k, [0.5 * (k % 2)] * 64) for k in range(5)]
    df = spark.createDataFrame([(*r, "c", "v", "i", "s") for r in few], VECTORS)
    assert sorted(tuple(r[c] for c in CLUSTERED) for r in centroids.clustered(df).collect()) == brute_clusters(few)
    none = centroids.clustered(df.limit(0))
    assert none.count() == 0 and none.columns == [*CLUSTERED, "scans"]
    ids = df.where("vec_id < 2").unionByName(df.selectExpr("CAST(NULL AS bigint) AS vec_id", "* EXCEPT (vec_id)").limit(1))
    assert centroids.clustered(ids).where("vec_id IS NULL").count() == 1
    with pytest.raises(Exception, match="may not fit a long"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")).collect()


def test_bounds_never_miss_a_change():
    g = np.random.default_rng(1)
    for _ in range(60):
        v, old = g.integers(-9, 9, (80, 6)), g.integers(-9, 9, (5, 6))
        new = old + g.integers(-3, 4, old.shape)
        own, upper, lower = centroids.scanned(v, old)
        found, upper, lower, _ = centroids.reassigned(v, own, upper, lower, new, centroids.drifts(old, new))
        d = centroids.squared(v, new)
        assert (found == d.argmin(axis=1)).all()
        at = np.arange(len(v))
        assert (upper >= np.sqrt(d[at, found])).all()
        d[at, found] = 1 << 40
        assert (lower <= np.sqrt(d.min(axis=1))).all()


def brute_repeats(texts: list[bytes], size: int) -> list[tuple[int, int, int, str]]:
    count = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - size + 1):
            if count[t[k : k + size]] > 1:
                gone[k : k + size] = True
        left = bytes(b for b, x in zip(t, gone.tolist()) if not x)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def removed(df) -> list[tuple]:
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text_left", 256)).collect()
    return sorted(map(tuple, rows), key=repr)


def awkward_texts(r: random.Random, size: int) -> list[str | None]:
    letters = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    line, shared = letters(size - 5), letters(3 * size)
    texts = [letters(r.randrange(0, 9 * size)) for _ in range(30)]
    texts += [letters(r.randrange(30)) + line + letters(r.randrange(30)) for _ in range(25)]  # nearly a string, often
    texts += [letters(9) + shared[r.randrange(size) :][: size + r.randrange(size)] + letters(9) for _ in range(20)]
    edited = list(shared)
    for k in range(7, len(edited), size + 11):
        edited[k] = "X"
    texts += ["".join(edited), shared, shared, "a" * (4 * size), "a" * (size - 1), "ab" * (2 * size), letters(2 * size) * 3]
    return [*texts, "", None, "   ", texts[3], letters(size), "é" * size]


@pytest.mark.parametrize("crowd", [3, 2048])
def test_repeats_are_the_brute_force_ones(spark, crowd):
    size, texts = 24, awkward_texts(random.Random(11), 24)
    rows = [(k, t, "e", "k", "h") for k, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], "e", "k", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key string, h string").repartition(6)
    want = brute_repeats([(r[1] or "").encode() for r in rows], size)
    found = suffix_dedup.without_repeats(df, size=size, grams=(6, 15), crowd=crowd, bucket_bytes=4000)
    assert removed(found) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)


def test_repeats_of_the_given_documents(spark):
    """The query itself, with its production parameters, on whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = suffix_dedup.op13_suffix_dedup(spark, "/root/testdata/sf0.001")
    want = brute_repeats([(r.text or "").encode() for r in docs], 200)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r[c] for c in cols) for r in found.collect()) == sorted((r.doc_id, *w) for r, w in zip(docs, want))


def test_long_texts_in_blocks(spark):
    """Texts over several blocks, with a repeat across a block's end."""
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh") for _ in range(1_100_000))
    texts = [base, "x" + base[1_048_300:1_048_900] + "y", base[5:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {x[0]: x[2] for x in removed(suffix_dedup.without_repeats(df))}
    assert found == {0: 600 + 295, 1: 600, 2: 295}


def test_no_documents(spark):
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())])
    assert removed(suffix_dedup.without_repeats(spark.createDataFrame([], schema))) == []
    assert removed(suffix_dedup.without_repeats(spark.createDataFrame([("a", None)], schema)))[0][:4] == ("a", 0, 0, 0)


def test_column_wise_is_exact():
    r = random.Random(6)
    for _ in range(80):
        size = r.randrange(2, 7)
        strings = ["".join(r.choice("ab") for _ in range(r.randrange(size, 14))).encode() for _ in range(r.randrange(1, 30))]
        left = np.array([r.randrange(0, 4) for _ in strings])
        seen = Counter((k - a, s[k : k + size]) for s, a in zip(strings, left.tolist()) for k in range(len(s) - size + 1))
        want = [[k for k in range(len(s) - size + 1) if seen[k - a, s[k : k + size]] > 1] for s, a in zip(strings, left.tolist())]
        assert [x.tolist() for x in suffix_dedup.column_wise(strings, left, size)] == want
