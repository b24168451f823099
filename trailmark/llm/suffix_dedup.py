"""Removal of repeated byte strings, by suffixes that are ordered column by column.

A byte goes if a string of ``size`` bytes that covers it also starts anywhere else. Such strings are suffixes of the
collection with a common prefix of ``size`` bytes or more, so they are neighbours in the order of suffixes. That order is
built as the multi-document Burrows-Wheeler transform is built column by column: each round inserts one symbol in
front of the current suffix of every string; the symbols that precede the ordered suffixes are the transform's column,
a stable sort by them is the next order, and the common prefix of two neighbours is one more than the least on the
way between them in the order before (``column_wise``).

Documents have very unlike lengths and an order of all suffixes would be one sequence, so the collection is dealt into
parts that can't share a string, and into columns that line up:

* The least hash of the ``gram``-byte strings within a string of ``size`` bytes is its anchor. Equal strings have equal
  anchors at equal offsets. Consecutive strings with one anchor are a *stretch*, on average about 85 of them.
* Stretches are counted by their anchor's hash and their content. An anchor with one stretch that stands once is
  unique. Contents that stand several times are repeated as a whole. Only where an anchor has several contents are
  their bytes fetched, each content once, lined up at the anchor, and ordered column by column in buckets of bounded size.
* An anchor with very many contents (a common line in as many surroundings) is dealt out anew, by the same steps with a
  longer ``gram``: its contents are texts whose strings have anchors of their own. With the last, as long as the strings,
  a stretch is one string and nothing is left to compare. Equal contents are added up before they are moved, so no
  group grows with the number of copies.

Suffixes of one column only are kept: equal strings stand in one column. What an external file would hold of the
transform, a bucket's columns, is bounded and stays in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, release, stored, table, tidy
from .langid import slices

BASE, INVERSE, MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xBF58476D1CE4E5B9))
PLACES = 20  # a block has under 2^20 places, so a hash and a place are one 64-bit number
BLOCK = (1 << PLACES) - 1


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS, BACK = powers(BASE, BLOCK + 1), powers(INVERSE, BLOCK + 1)


def gram_hashes(line: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k bytes in a row of at most BLOCK bytes."""
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((line.astype(np.uint64) + np.uint64(1)) * POWERS[: len(line)], out=sums[1:])
    g = (sums[k:] - sums[:-k]) * BACK[: len(line) - k + 1]
    g = (g ^ (g >> np.uint64(32))) * MIX
    return g ^ (g >> np.uint64(29))


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive numbers."""
    wide = 1
    while wide < w:
        step = min(wide, w - wide)
        x = np.minimum(x[:-step], x[step:])
        wide += step
    return x


def stretches(line: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, the anchor's hash) of the stretches of a line of texts, which end at ``ends``."""
    g = gram_hashes(line, gram)
    mask = np.uint64(BLOCK)
    least = window_least((g & ~mask) | np.arange(len(g), dtype=np.uint64), size - gram + 1)
    anchor = (least & mask).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, "right")
    whole = starts + size <= ends[text]  # no string of two texts
    begin = np.concatenate([[True], anchor[1:] != anchor[:-1]]) | ~whole
    begin[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(begin)
    last = np.append(at[1:], len(anchor)) - 1
    keep = whole[at]
    at, last = at[keep], last[keep]
    return at, last, anchor[at], g[anchor[at]]


def blocks(texts: list[bytes], size: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, texts, offsets in them, ends) of blocks that hold every string of ``size`` bytes once."""
    piece, which, offset, held = [], [], [], 0

    def block():
        return b"".join(piece), np.array(which), np.array(offset), np.cumsum([len(p) for p in piece])

    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= size:
            room = BLOCK - held
            if room < size:
                yield block()
                piece, which, offset, held = [], [], [], 0
                continue
            part = t[at : at + room]
            piece.append(part)
            which.append(i)
            offset.append(at)
            held += len(part)
            at += len(part) - size + 1
            if at + size - 1 == len(t):
                break
    if piece:
        yield block()


def column_wise(strings: list[bytes], left: np.ndarray, size: int) -> list[np.ndarray]:
    """For each string the offsets where ``size`` bytes start that also start in another one, in the same column.

    ``left`` is how many bytes a string has before its anchor, where the strings are lined up.
    """
    n, lengths = len(strings), np.fromiter(map(len, strings), np.int64, len(strings))
    begin = int(left.max()) - left
    end, width = begin + lengths, int((begin + lengths).max())
    columns = np.zeros((width, n), np.uint8)
    line = np.frombuffer(b"".join(strings), np.uint8)
    of = np.repeat(np.arange(n), lengths)
    columns[np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + begin[of], of] = line
    by_end, by_begin = np.argsort(end, kind="stable"), np.sort(begin)
    ends = end[by_end]
    order, common = np.empty(0, np.int64), np.empty(0, np.int64)  # common[i] is that of order[i - 1] and order[i]
    hits = np.zeros((width, n), bool)
    for c in range(width - 1, -1, -1):
        a, b = np.searchsorted(ends, [c + 1, c + 2])
        if b > a:  # empty suffixes come before all others and have nothing in common
            order, common = np.concatenate([by_end[a:b], order]), np.concatenate([np.zeros(b - a, np.int64), common])
        if np.searchsorted(by_begin, c + 1) < np.searchsorted(by_begin, c + 2):  # strings that have no more symbols
            stay = np.flatnonzero(begin[order] <= c)
            if len(stay):
                common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
            order, common = order[stay], common[: len(stay)]
        if not len(order):
            continue
        symbols = columns[c, order]  # the transform's column
        moved = np.argsort(symbols, kind="stable")
        symbols, between = symbols[moved], np.full(len(moved), -1, np.int64)
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        beside = same[moved[same] == moved[same - 1] + 1]
        between[beside] = common[moved[beside]]
        far = same[moved[same] != moved[same - 1] + 1]
        if len(far):  # each symbol's places in the order before, up to the last: what lies between them
            firsts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            stops = np.append(firsts[1:], len(moved))
            some = np.unique(np.searchsorted(firsts, far, "right") - 1)
            for f, e in zip(firsts[some].tolist(), stops[some].tolist()):
                places = moved[f:e]
                between[f + 1 : e] = np.minimum.reduceat(common[: places[-1] + 1], places[:-1] + 1)
        order, common = order[moved], between + 1
        alike = np.flatnonzero(common >= size)
        hits[c, order[alike]] = True
        hits[c, order[alike - 1]] = True
    string, column = np.nonzero(hits.T)
    return np.split(column - begin[string], np.searchsorted(string, np.arange(1, n)))


def runs(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Byte ranges that strings of ``size`` bytes from ``starts`` (sorted) cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), (starts[np.append(cuts, len(starts) - 1)] + size).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def located(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(key, h, content, at, len, lead) of every stretch of ``docs`` (key, text)."""
    from xxhash import xxh3_64_intdigest as digest

    names = ["key", "h", "content", "at", "len", "lead"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 1, size=BLOCK):
                for line, which, offset, ends in blocks(part.column(1).to_pylist(), size):
                    first, last, anchor, h = stretches(np.frombuffer(line, np.uint8), ends, size, gram)
                    piece = np.searchsorted(ends, first, "right")
                    length = last + size - first
                    content = [digest(line[a : a + n]) for a, n in zip(first.tolist(), length.tolist())]
                    place = first - (ends - np.diff(ends, prepend=0))[piece] + offset[piece]
                    cols = [h.view(np.int64), np.array(content, np.uint64).view(np.int64), place, length.astype(np.int32)]
                    cols.append((anchor - first).astype(np.int32))
                    key = part.column(0).take(pa.array(which[piece]))
                    yield pa.RecordBatch.from_arrays([key, *map(pa.array, cols)], names=names)

    return docs.mapInArrow(tidy(run), "key binary, h bigint, content bigint, at bigint, len int, lead int")


def repeated_ranges(
    docs: DataFrame, size: int = 200, grams: tuple[int, ...] = (32, 128), crowd: int = 2048, bucket_bytes: int = 4 << 20
) -> DataFrame:
    """(key, spans: array of (a, b)) for every text of ``docs`` (key, text: binary) that has repeated strings.

    Equal texts have equal keys and one row. An anchor with over ``crowd`` contents is dealt out by the next of ``grams``,
    after the last of them by whole strings.
    """
    gram, later = (grams[0], grams[1:]) if grams else (size, ())
    spark = docs.sparkSession
    places, discard = stored(located(docs, size, gram))
    anchors = places.groupBy("h").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("mixed"))
    near = cut(attach(places, anchors.where("n > 1").drop("n"), ["h"], "inner"))
    discard()
    release(spark)
    one = F.min(F.struct("key", "at")).alias("one")
    told = cut(near.groupBy("h", "content", "len", "lead", "mixed").agg(F.count("*").alias("n"), one))
    # Contents whose bytes must be seen, each at one of its places.
    many = told.where("mixed").groupBy("h").agg((F.count("*") > (crowd if gram < size else 1 << 62)).alias("crowded"))
    mixed = attach(told.where("mixed"), many, ["h"], "inner")
    asked = mixed.select("h", "content", "len", "lead", "crowded", "one.key", "one.at")
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("h", "content", "len", "lead", "crowded", "at")).alias("asked"))
    pick = attach(docs, asked, ["key"], "inner").select("text", "asked")
    fields = "h bigint, content bigint, lead int, crowded boolean, string binary"

    def fetch(batches: Iterator[pa.RecordBatch]):
        seen: set[tuple] = set()  # of this task: copies of one text ask for the same
        for batch in batches:
            for part in slices(batch, 0, rows=64):
                out = []
                for text, each in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for x in each:
                        if (x["h"], x["content"]) not in seen:
                            seen.add((x["h"], x["content"]))
                            out.append((x["h"], x["content"], x["lead"], x["crowded"], text[x["at"] : x["at"] + x["len"]]))
                    if len(out) > 10_000:
                        yield as_batch(out)
                        out = []
                if out:
                    yield as_batch(out)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["h", "content", "lead", "crowded", "string"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    fetched = cut(pick.mapInArrow(tidy(fetch), fields))
    release(spark)
    buckets = (fetched.where("NOT crowded").agg(F.sum(F.octet_length("string"))).first()[0] or 0) // bucket_bytes + 1

    def compare(group: pa.Table) -> pa.Table:
        h, content = group.column("h").to_numpy(), group.column("content").to_numpy()
        lead, strings = group.column("lead").to_numpy().astype(np.int64), group.column("string")
        kept = np.unique(np.stack([h, content]), axis=1, return_index=True)[1]  # several tasks may have fetched one
        hits = column_wise([strings[k].as_py() for k in kept.tolist()], lead[kept], size)
        some = [k for k, x in enumerate(hits) if len(x)]
        spans = [[{"a": a, "b": b} for a, b in runs(hits[k], size)] for k in some]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        cols = [pa.array(h[kept[some]]), pa.array(content[kept[some]]), pa.array(spans, kind)]
        return pa.table(cols, names=["h", "content", "spans"])

    alike = fetched.where("NOT crowded").withColumn("bucket", F.pmod("h", F.lit(buckets))).groupBy("bucket")
    alike = alike.applyInArrow(compare, "h bigint, content bigint, spans array<struct<a:int,b:int>>")

    spans = "array<struct<a:int,b:int>>"
    again = fetched.where("crowded").dropDuplicates(["h", "content"]).select("h", "content", "string")
    if not again.isEmpty():
        name = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("h", "content")]))
        named = cut(again.withColumn("key", name))
        deeper = repeated_ranges(named.select("key", F.col("string").alias("text")), size, later, crowd, bucket_bytes)
        told_again = attach(named.select("h", "content", "key"), deeper, ["key"], "inner")
        alike = alike.unionByName(told_again.select("h", "content", F.col("spans").cast(spans).alias("spans")))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("len").alias("b")))
    copies = told.where("n > 1").select("h", "content", whole.alias("spans"))
    single = told.where("n = 1").select("h", "content", F.lit(True).alias("single"))
    parts = attach(alike, single, ["h", "content"], "inner").select("h", "content", "spans")
    repeated = cut(parts.unionByName(copies))
    release(spark)
    found = attach(near.select("key", "h", "content", "at"), repeated, ["h", "content"], "inner")
    span = F.explode("spans").alias("s")
    found = found.select("key", "at", span).select("key", F.struct((F.col("at") + F.col("s.a")).alias("a"), (F.col("at") + F.col("s.b")).alias("b")).alias("s"))
    # A set, so that the spans of a text with very many copies are merged before they are moved.
    spans = cut(found.groupBy("key").agg(F.collect_set("s").alias("spans")))
    release(spark)
    return spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row for each row of ``docs``: its id, ``text_left`` (bytes), n_bytes, n_removed, n_spans.

    A null text is empty. Texts shorter than ``size`` bytes stay whole. Repeated rows and equal texts are copies of each
    other: if they are long enough nothing of them stays. Cuts are between bytes, so what is left need not be UTF-8. Ids
    are carried along, null or not; an empty table gives an empty result; other columns are ignored, and very long texts
    are read whole, a block at a time.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("text"))
    rows = rows.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    ranges = repeated_ranges(rows.select("key", "text"), **more)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    gone = merged([(s["a"], s["b"]) for s in spans or ()])
                    at = [0, *(x for s in gone for x in s), len(t)]
                    left = b"".join(t[a:b] for a, b in zip(at[::2], at[1::2]))
                    out.append((left, len(t), len(t) - len(left), len(gone)))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                cols = [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "text_left", "n_bytes", "n_removed", "n_spans"])

    told = attach(rows, ranges, ["key"]).select("id", "text", "spans")
    told = told.mapInArrow(tidy(run), f"id {kind}, text_left binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    return told.withColumnRenamed("id", id_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text_left", 256).alias("kept_sha256"))
