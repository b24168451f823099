"""SimHash near-dedup by tiled exact comparison.

Each text gets a 64-bit fingerprint: the majority of the bits of its word shingles' XXH64. Distinct
fingerprints are dealt into tiles by the population counts of their four 16-bit quarters. Two
fingerprints differ in at least as many bits as their quarter counts do in sum, so a pair of tiles whose
counts are further apart than the radius is skipped; of the others every pair of fingerprints is compared
with numpy's exclusive-or and bit counts. A task hands on a spanning forest of the links it finds, never
all pairs of a group; the forests' components are the groups.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, components, cut, gathered, release, table, tidy
from .langid import slices
from .substring_dedup import gram_hashes

SEED = 42  # of XXH64, a fixed value of the fingerprint's definition


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Majority bits of the XXH64 of every shingle, repeats included; without words zero."""
    from xxhash import xxh64_intdigest as h

    parts = (text or b"").lower().split()  # bytes: only A-Z are lowered, only \\x09-\\x0D and space split
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths)
    starts, n = ends - lengths, max(1, len(parts) - words + 1)
    last = (ends[min(words, len(parts)) - 1 :] - 1)[:n].tolist()
    hashes = np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed bigint)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp bigint")


def forest(own: np.ndarray, others: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between own fingerprints and own or others: indices in own+others."""
    every = np.concatenate([own, others])
    parent = np.arange(len(every))
    out: list[tuple[int, int]] = []

    def roots(x: np.ndarray) -> np.ndarray:
        r = parent[x]
        while len(moved := np.flatnonzero(parent[r] != r)):
            r[moved] = parent[r[moved]]
        parent[x] = r
        return r

    step = max(1, (1 << 18) // len(every))
    for k in range(0, len(own), step):
        near = np.bitwise_count(own[k : k + step, None] ^ every[None, :]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            found = np.unique(roots(np.flatnonzero(near[i])))
            if len(found) > 1:
                out += [(int(found[0]), int(x)) for x in found[1:]]
                parent[found[1:]] = found[0]
    return out


def links(fps: DataFrame, radius: int, tile: int, bundle: int = 64) -> DataFrame:
    """(u, v): fingerprints of a spanning forest of each pair of tiles, from distinct fps (column fp)."""
    parts = 4 if radius <= 4 else 1
    width, base = 64 // parts, 128
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1 if parts > 1 else -1))).cast("long") for i in range(parts)]
    keyed = fps.select("fp", sum((c * base**i for i, c in enumerate(counts)), F.lit(0)).alias("key"))
    # At most 17**4 keys; a key with more fingerprints than a tile holds has several tiles.
    keys = keyed.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("long").alias("tiles"))
    tiled = attach(keyed, keys, ["key"], "inner").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles")).groupBy("key", "tile").agg(F.collect_list("fp").alias("fps"))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    near = keys.select("key", F.explode(F.array(*[F.array(*map(F.lit, d)) for d in steps])).alias("d"))
    moved = [F.pmod(F.floor(F.col("key") / base**i), F.lit(base)) + F.col("d")[i] for i in range(parts)]
    valid = [(m >= 0) & (m <= width) for m in moved]
    home = sum((m * base**i for i, m in enumerate(moved)), F.lit(0))
    near = near.withColumn("ok", F.forall(F.array(*valid), lambda x: x)).where("ok").select("key", home.alias("home")).where("home <= key")
    # A home tile meets its neighbours in bundles of about ``bundle`` tiles, so that no group grows with the data.
    around = near.join(keys, "key").groupBy("home").agg(F.ceil(F.sum("tiles") / bundle).cast("long").alias("bundles"))
    homes = keys.select(F.col("key").alias("home"), F.col("tiles").alias("home_tiles")).join(around, "home")
    sent = tiled.join(near.join(homes, "home"), "key").withColumn("home_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("home_tiles") - 1)))
    own = (F.col("home") == F.col("key")) & (F.col("home_tile") == F.col("tile"))
    places = F.when(own, F.sequence(F.lit(0).cast("long"), F.col("bundles") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key", "tile"), "bundles")))
    sent = sent.where("home < key or home_tile <= tile").select("home", "home_tile", own.alias("own"), F.explode(places).alias("bundle"), "fps")

    def run(groups: pa.Table) -> pa.Table:
        own, others = [], []
        for mine, fp in zip(groups.column("own").to_pylist(), groups.column("fps")):
            (own if mine else others).append(fp.values.to_numpy(zero_copy_only=False).view(np.uint64))
        a, b = own[0], np.concatenate([np.empty(0, np.uint64), *others])
        every = np.concatenate([a, b]).view(np.int64)
        pairs = np.array(forest(a, b, radius), np.int64).reshape(-1, 2)
        return pa.table({"u": every[pairs[:, 0]], "v": every[pairs[:, 1]]})

    return sent.groupBy("home", "home_tile", "bundle").applyInArrow(run, "u bigint, v bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, tile: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give repeated
    results. The smallest id of a component ignores null ids. An empty table gives an empty result. Other
    columns are ignored; very long texts are read whole.
    """
    rows = cut(fingerprints(docs, id_col, text, words))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(fps.select("fp"), radius, tile)).withColumnsRenamed({"node": "fp", "component": "group"})
    member = attach(fps, groups, ["fp"]).withColumn("group", F.coalesce("group", "fp"))
    least = member.groupBy("group").agg(F.min("least").alias("component_id"))
    named = attach(member.select("fp", "group"), least, ["group"], "inner").select("fp", "component_id")
    return attach(rows, named, ["fp"], "inner").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, sorted; of fewer words the whole sequence is one."""
    from xxhash import xxh64_intdigest as h

    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(np.fromiter(map(h, parts), np.uint64, len(parts)), min(words, len(parts))))


def set_hash(hashes: np.ndarray) -> int:
    """A set's own hash, as a signed bigint."""
    from xxhash import xxh64_intdigest as h

    n = h(hashes.tobytes(), SEED)
    return n - (1 << 64) if n >> 63 else n


def prefix(hashes: np.ndarray, common: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's hashes in one order for all sets: so many that sets of that Jaccard similarity share one.

    Hashes that aren't in ``common`` (sorted) come first, in their own order, the others by their ``place``.
    """
    n = len(hashes)
    most = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    known = common[at] == hashes if len(common) else np.zeros(n, bool)
    rare = hashes[~known][:most]
    if len(rare) == most:
        return rare
    often = hashes[known]
    return np.concatenate([rare, often[np.argsort(place[at[known]])][: most - len(rare)]])


def met(batches, names: list[str]):
    """Of rows (h, node, n, pos) in order of h and node those whose h another row has too, with the first one's node, n and pos.

    A run may span batches: only its first row and the last row seen are held.
    """
    held: list[np.ndarray] = []  # the last row and, beside it, its run's first
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy().astype(np.int64) for c in batch.columns]
        if held:
            cols = [np.concatenate([x, c]) for x, c in zip(held, cols)]
        starts = np.concatenate([[True], cols[0][1:] != cols[0][:-1]])
        run = np.cumsum(starts) - 1
        heads = [c[starts] for c in cols[1:]]
        if held:
            for c, first in zip(heads, held[4:]):
                c[0] = first[0]
        heads = [c[run] for c in heads]
        # All but the last row: it is told when the next is seen.
        out = np.flatnonzero(~starts[1:] | (heads[0][:-1] != cols[1][:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (*cols, *heads)], names=names)
        held = [c[-1:] for c in (*cols, *heads)]
    if held and held[4][0] != held[1][0]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def odd_bits(hashes: np.ndarray, bits: int = 2048) -> np.ndarray:
    """A set's hashes by their last bits: of each value whether an odd number of hashes has it, 64 values in a bigint.

    Two sets' results differ in no more places than there are hashes in one of the sets only. The exclusive-or of
    the two halves is the result for half as many bits.
    """
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def maybe_alike(batches, similarity: float):
    """Of rows (u, v, n, n2, odd, odd2) those pairs whose sizes and odd bits allow the similarity: what only one of them has is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, n2 = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 3))
        odd, odd2 = (batch.column(k).flatten().to_numpy().view(np.uint64).reshape(len(n), -1) for k in (4, 5))
        keep = np.flatnonzero(np.bitwise_count(odd ^ odd2).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (n + n2) + 1e-6)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["u", "v"])


def linked(batches, similarity: float):
    """Links (u, v) of rows (u, part, own, node, set) in order, u's own set first: those of the Jaccard similarity."""
    head, sets = None, np.empty(0, np.uint64)
    for batch in batches:
        u, own, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        lists = batch.column(4)
        stops, values, found = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64), []
        for k in range(len(u)):
            one = values[stops[k] : stops[k + 1]]
            if own[k]:
                head, sets = u[k], one
            elif head == u[k]:
                at = np.minimum(np.searchsorted(sets, one), len(sets) - 1)
                both = int((sets[at] == one).sum())
                if both + 1e-9 >= similarity * (len(sets) + len(one) - both):
                    found.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(u[found]), pa.array(node[found])], names=["u", "v"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, sample: int = 20_000, most_common: int = 500_000, tile: int = 2_000, rounds: int = 2, heads: int = 8, broadcast_rows: int = 200_000, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, component_id, by the exact Jaccard similarity of word shingle sets.

    A unique column of ``docs`` named by ``row`` is carried along; kept is then true for one row of each group, of
    those with the smallest id that with the smallest ``row``.

    Sets of the similarity share one of their first shingles (a fifth of them at 0.8) in any order that all sets
    have in common. So rows of first shingles meet by shingle, and no set is compared with all others. The order
    puts those last that stand in several of a sample of about ``sample`` rows: it decides what meets, and never the result. Each set is
    first compared with one other, the one it meets most often among the first of each shingle, and in shingles of many
    rows with ``heads`` more in each of ``rounds``; then all pairs that share a shingle and aren't in one component yet, as lengths and places allow the similarity. Such
    a pair is made once for shingles that both sets have in a row, and its texts are read only if the sets' odd bits allow the similarity. A set, or a
    shingle, of more than ``tile`` pairs or rows is several groups' work.

    Equal sets, as of texts without words, are one group. Repeated rows give repeated results; rows with a
    null id are grouped with equal sets only. An empty table gives an empty result; other columns are
    ignored and very long texts read whole.
    """
    spark = docs.sparkSession
    kind, row_kind = docs.schema[id_col].dataType.simpleString(), docs.schema[row].dataType.simpleString() if row else "int"
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("text"), (F.col(row) if row else F.lit(0)).alias("row"))

    def every_shingle(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["h"])

    n_rows = docs.count()
    one_in = max(1, n_rows // sample)
    base = gathered(base, n_rows, 5_000)
    some = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("doc_id", "text").mapInArrow(tidy(every_shingle), "h bigint")
    often = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(most_common).toArrow()
    common = often.column("h").to_numpy().view(np.uint64)
    rank = np.lexsort((common, often.column("n").to_numpy()))
    place = np.empty(len(common), np.int64)
    place[rank] = np.arange(len(common))
    order = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[order], place[order]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                firsts = [prefix(x, *shared.value, similarity).view(np.int64) for x in sets]
                arrays = [pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array([odd_bits(x) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *arrays], names=["doc_id", "row", "node", "n", "firsts", "odd"])

    told = cut(base.mapInArrow(tidy(run), f"doc_id {kind}, row {row_kind}, node bigint, n int, firsts array<bigint>, odd array<bigint>"))
    told = gathered(told, n_rows)
    rows = told.select("doc_id", "row", "node")
    sets = cut(gathered(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")), n_rows))
    places = told.where("doc_id is not null").select("node", "n", F.posexplode("firsts").alias("pos", "h")).select("h", "node", "n", "pos")
    names = ["h", "node", "n", "pos", "head", "head_n", "head_pos"]
    meeting = cut(places.repartition("h").sortWithinPartitions("h", "node").mapInArrow(lambda b: met(b, names), ", ".join(f"{x} bigint" for x in names)))
    n_meeting = meeting.count()
    meeting = gathered(meeting, n_meeting, 200_000)
    release(spark)

    def read(batches):
        for batch in batches:
            held, size = [], 0
            for t, node, asks in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingles(t, words)
                if set_hash(own) == node:  # rows with one id can have different texts
                    for x in asks:
                        held.append((x["u"], x["part"], x["own"], node, own.view(np.int64)))
                        size += len(own)
                        if size > 1 << 20:
                            yield packed_sets(held)
                            held, size = [], 0
            if held:
                yield packed_sets(held)

    def packed_sets(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=["u", "part", "own", "node", "set"])

    def listed(rows: DataFrame, groups: DataFrame, on: str, how: str = "left") -> DataFrame:
        """Like ``attach``, where ``groups`` has a few numbers for each of no more rows than ``docs`` has."""
        return rows.join(F.broadcast(groups), on, how) if n_rows <= broadcast_rows else attach(rows, groups, [on], how)

    def bits_of(nodes: DataFrame) -> DataFrame:
        """(node, n, odd) of the nodes, repeats included."""
        return listed(told.select("node", "n", "odd"), cut(gathered(nodes.distinct(), n_rows)), "node", "inner").groupBy("node").agg(F.max("n").alias("n"), F.max("odd").alias("odd"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (u, v) of nodes: v's set is sent to u's, which is sent to every ``tile`` of its pairs.

        Only pairs whose odd bits allow the similarity have their texts read.
        """
        asked = pairs.count()
        bits = cut(gathered(bits_of(pairs.select(F.explode(F.array("u", "v")).alias("node"))), n_rows))
        both = attach(attach(pairs, bits.withColumnRenamed("node", "u"), ["u"], "inner"), bits.select(F.col("node").alias("v"), F.col("n").alias("n2"), F.col("odd").alias("odd2")), ["v"], "inner")
        pairs = cut(gathered(both.select("u", "v", "n", "n2", "odd", "odd2").mapInArrow(lambda b: maybe_alike(b, similarity), "u bigint, v bigint"), asked))
        sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))
        theirs = listed(pairs, sizes, "u", "inner").select(F.col("v").alias("node"), "u", F.pmod(F.xxhash64("v"), "parts").alias("part"), F.lit(False).alias("own"))
        own = sizes.select(F.col("u").alias("node"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"))
        asks = theirs.unionByName(own).groupBy("node").agg(F.collect_list(F.struct("u", "part", "own")).alias("asks"))  # of one set's pairs
        asks = cut(gathered(attach(sets, asks, ["node"], "inner"), n_rows).select(F.col("least.doc_id").alias("__least"), "node", "asks"))
        if asks.count() <= broadcast_rows:
            asks = F.broadcast(asks)
        sent = base.join(asks, F.col("doc_id") == F.col("__least")).select("text", "node", "asks").mapInArrow(tidy(read), "u bigint, part bigint, own boolean, node bigint, set array<bigint>")
        sent = sent.repartition("u", "part").sortWithinPartitions("u", "part", F.desc("own"))
        return cut(gathered(sent.mapInArrow(lambda b: linked(b, similarity), "u bigint, v bigint"), asked))

    def fits(n: str, pos: str, n2: str, pos2: str) -> Column:
        """Whether the sizes allow the similarity, and the places of the first shingle that two sets share: no more than it and those after it are in both."""
        n, pos, n2, pos2 = map(F.col, (n, pos, n2, pos2))
        sizes = F.least(n, n2) + 1e-9 >= similarity * F.greatest(n, n2)
        return sizes & (F.least(n - pos, n2 - pos2) + 1e-9 >= similarity / (1 + similarity) * (n + n2))

    # Of the sets that are the first of one of its shingles, each set's own is the one that it meets most often.
    best = meeting.where(F.col("node") != F.col("head")).where(fits("n", "pos", "head_n", "head_pos")).groupBy("node", "head").agg(F.count("*").alias("c"))
    tried = cut(gathered(best.groupBy("node").agg(F.max_by("head", F.struct("c", "head")).alias("u")).select("u", F.col("node").alias("v")), n_rows))
    links = verified(tried)
    groups = components(links)

    def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
        """``groups`` (node, component) with the components joined that ``links`` (u, v) link: each pair of them is one edge."""
        both = links
        for end in ("u", "v"):
            of = groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            both = listed(both, of, end).withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
        roots = components(both).select(F.col("node").alias("component"), F.col("component").alias("root"))
        old = listed(groups, roots, "component").select("node", F.coalesce("root", "component").alias("component"))
        alone = roots.join(groups.select(F.col("component")).distinct(), "component", "left_anti")
        return cut(gathered(old.unionByName(alone.select(F.col("component").alias("node"), F.col("root").alias("component"))), n_rows))

    def still_open() -> DataFrame:
        """The rows of shingles that stand in several components, with the number of their rows; of two rows, where the sizes allow the similarity."""
        told = listed(meeting.select("h", "node", "n", "pos"), groups, "node").withColumn("group", F.coalesce("component", "node")).drop("component")
        several = told.groupBy("h").agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count("*").alias("rows"), F.min("n").alias("n1"), F.max("n").alias("n2"))
        several = several.where((F.col("g1") < F.col("g2")) & ((F.col("rows") > 2) | (F.col("n1") + 1e-9 >= similarity * F.col("n2")))).select("h", "rows")
        return cut(gathered(attach(told, several, ["h"], "inner"), n_meeting, 200_000))

    def crossing(left: DataFrame, right: DataFrame, on: list[str], more: Column = F.lit(True)) -> DataFrame:
        right = right.select(*on, *[F.col(c).alias(f"{c}2") for c in right.columns if c not in on])
        both = left.join(right, on).where((F.col("group") != F.col("group2")) & fits("n", "pos", "n2", "pos2") & more)
        return both.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"))

    # As arrays: a column for each bigint makes the join's code too long to be compiled.
    differ = F.aggregate(F.zip_with("odd", "odd2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    like_bits = differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("n2")) + 1e-6

    def large(open_: DataFrame) -> DataFrame:
        """The rows of shingles of many rows, with half their sets' odd bits: most of the pairs of these are told there."""
        many = open_.where(F.col("rows") > heads**2)
        bits = bits_of(many.select("node")).select("node", F.zip_with(F.slice("odd", 1, 16), F.slice("odd", 17, 16), lambda x, y: x.bitwiseXOR(y)).alias("odd"))
        return cut(gathered(attach(many, bits, ["node"], "inner"), n_meeting, 50_000))

    # A large group of near copies is joined through a few heads of each shingle, others in each round, before all its pairs are.
    release(spark)
    open_ = still_open()
    for k in range(rounds):
        if (open_.agg(F.max("rows")).first()[0] or 0) <= heads**2:
            break
        many = large(open_)
        top = many.withColumn("at", F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("node", F.lit(k)), "node"))).where(F.col("at") <= heads)
        met_often = crossing(many, top, ["h"], like_bits).groupBy("u", "v").agg(F.count("*").alias("c")).join(tried, ["u", "v"], "left_anti")
        both = met_often.select("u", "v", "c", F.explode(F.array("u", "v")).alias("of"))
        few = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("c"), F.xxhash64("u", "v", F.lit(k)))) <= heads
        asked = cut(gathered(both.withColumn("few", few).where("few").select("u", "v").distinct(), n_meeting, 200_000))
        found = verified(asked)
        tried = tried.unionByName(asked)
        if found.isEmpty():
            break
        groups = merged(groups, found)
        release(spark)
        open_ = still_open()
    release(spark)
    shares = F.ceil(F.col("rows") / tile).cast("long")
    # Sets that have one of each other's shingles before this one too meet there: places before are smaller, so they fit if these do.
    before = F.collect_list("h").over(Window.partitionBy("node").orderBy("pos").rowsBetween(-3, -1))
    open_ = open_.withColumn("before", before)
    first = (F.col("node") < F.col("node2")) & ~F.arrays_overlap("before", "before2")
    many = large(open_)
    left = many.withColumn("part", F.pmod(F.xxhash64("node"), shares))
    right = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    few = open_.where(F.col("rows") <= heads**2)
    made = crossing(few, few, ["h"], first).unionByName(crossing(left, right, ["h", "part"], first & like_bits))
    pairs = cut(gathered(made.distinct().join(tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"), n_meeting, 200_000))
    release(spark)
    if not pairs.isEmpty():
        more = verified(pairs)
        if not more.isEmpty():
            groups = merged(groups, more)
    member = attach(sets, groups, ["node"]).withColumn("group", F.coalesce("component", "node"))
    first = member.groupBy("group").agg(F.min("least").alias("first"))
    named = attach(member.select("node", "group"), first, ["group"], "inner").select("node", "first")
    out = attach(rows, named, ["node"], "inner")
    return out.select("doc_id", F.col("first.doc_id").alias("component_id"), *["row", (F.col("row") == F.col("first.row")).alias("kept")] * bool(row))
