r"""Benchmark decontamination (DataFrame functions only).

Benchmark items become windows of ``n`` normalised words (an item of fewer words is one window), written
once with their hashes. Their measured size says in how many blocks they are broadcast, as hash tables of
bounded bytes; a benchmark that needs several is met in as many scans. Every run of words of a document
is looked up by its hash within the scan's own tasks and a hit is verified word for word, so no text is
shuffled: only hits are grouped by their text's key. Their list meets the documents again by a broadcast
if its measured size allows it, else by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, attach, cut, table

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes runs of digits, letters and everything above ASCII; null has none."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def _mixed(a: Column, b: Column) -> Column:
    """Element by element over the common length of a and a later slice b."""
    return F.zip_with(a, b, lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))


def _tail(a: Column, k: int) -> Column:
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))


def with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds __h{L}: the hash of the L words from each position (null where fewer follow)."""
    df = df.withColumn("__p1", F.transform("__w", lambda w: F.xxhash64(w)))
    powers = [1]
    while powers[-1] * 2 <= max(lengths):
        k = powers[-1]
        df = df.withColumn(f"__p{2 * k}", _mixed(F.col(f"__p{k}"), _tail(F.col(f"__p{k}"), k)))
        powers.append(2 * k)
    for n in lengths:
        bits = [p for p in reversed(powers) if n & p]
        df, at = df.withColumn(f"__h{n}", F.col(f"__p{bits[0]}")), bits[0]
        for p in bits[1:]:
            df, at = df.withColumn(f"__h{n}", _mixed(F.col(f"__h{n}"), _tail(F.col(f"__p{p}"), at))), at + p
    return df.drop(*[f"__p{p}" for p in powers])


def windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """(len, gram, h, items): each distinct window of the benchmark with the ids of the items that have it."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("__w")).where(F.size("__w") > 0)
    w = w.withColumn("len", F.least(F.size("__w"), F.lit(n))).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("__w") - F.col("len") + 1)))
    w = w.select("item", "len", F.slice(F.col("__w"), F.col("i"), F.col("len")).alias("__w"))
    w = w.groupBy("len", "__w").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("gram", F.array_join("__w", " "))
    hashed = with_hashes(w, list(range(1, n + 1)))
    h = F.coalesce(*[F.when(F.col("len") == k, F.element_at(f"__h{k}", 1)) for k in range(1, n + 1)])
    return hashed.select("len", "gram", h.alias("h"), "items")


def _spots(docs: DataFrame, text: str, lengths: list[int], n: int, piece: int) -> DataFrame:
    """(__key, __at, __w, i, len, h): each run of ``len`` words of a text by its hash; its words are __w from i on.

    A text is cut into pieces of ``piece`` words and the n - 1 that follow, so no row grows with its document.
    """
    rows = docs.select(_text_key(text).alias("__key"), words(F.col(text)).alias("__all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__all") - 1, F.lit(0)), F.lit(piece))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("__at"), F.slice("__all", s + 1, piece + n - 1).alias("__w")))
    hashed = with_hashes(rows.select("__key", F.inline(pieces)), lengths)

    def placed(k: int) -> Column:
        return F.transform(F.slice(f"__h{k}", 1, piece), lambda h, i: F.struct(i.alias("i"), F.lit(k).alias("len"), h.alias("h")))

    return hashed.select("__key", "__at", "__w", F.inline(F.concat(*[placed(k) for k in lengths])))


def _text_key(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _hits(docs: DataFrame, text: str, grams: DataFrame, n: int, piece: int, block: int, block_bytes: int) -> DataFrame:
    """(__key, __spots, __ids): where a text has a window (pos, len), and the items that have it; only texts with one."""
    heavy = F.octet_length("gram") + F.octet_length(F.array_join("items", ",")) + 64
    count, size, lengths = grams.agg(F.count("*"), F.sum(heavy), F.array_sort(F.collect_set("len"))).first()
    blocks = max(1, -(-count // block), -(-(size or 0) // block_bytes))
    found = None
    for k in range(blocks):
        part = grams.where(F.pmod("h", F.lit(blocks)) == k).select("gram", F.col("h").alias("__h"), "items")
        spots = _spots(docs, text, lengths or [n], n, piece)
        # Not an equality, which would become a join key: the words are joined only where the hash is found.
        verified = F.array_contains(F.array(part["gram"]), F.array_join(F.slice("__w", F.col("i") + 1, F.col("len")), " "))
        hit = spots.join(F.broadcast(part), (spots["h"] == part["__h"]) & verified).select("__key", (F.col("__at") + F.col("i")).alias("pos"), "len", "items")
        found = hit if found is None else found.unionByName(hit)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return found.groupBy("__key").agg(F.collect_set(F.struct("pos", "len")).alias("__spots"), ids.alias("__ids"))


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name = f"kept_{name}"
    taken.add(name)
    return name


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10,
    block: int = 400_000, block_bytes: int = 64 << 20, piece: int = 256, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans lists maximal runs (start, end) of hit words, for removal. ``keep`` names further columns of
    ``docs`` to carry; one with the name of a result column comes as kept_<name>. Null or empty texts have no
    words and are clean; null items and items without words are ignored; items with equal windows are all
    named; repeated rows give repeated results; very long texts are scanned whole, in pieces. Either table may
    be empty. A broadcast holds ``block`` windows and ``block_bytes`` bytes at most.
    """
    grams = cut(windows(items, item_id, item_text, n))
    found = cut(_hits(docs, text, grams, n, piece, block, block_bytes))
    taken = {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"}
    kept = {c: _free(c, taken) for c in keep}
    n_words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(ANY_CASE)).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"__keep_{c}") for c in keep], n_words.alias("n_words"), _text_key(text).alias("__key"))
    size = found.agg(F.sum(96 + 8 * F.size("__spots") + F.octet_length(F.array_join("__ids", ",")))).first()[0] or 0
    if size <= block_bytes:
        right = F.broadcast(found.withColumnRenamed("__key", "__hit_key"))
        hit = base.join(right, F.col("__key") == F.col("__hit_key"), "left")
    else:
        hit = attach(base, found, ["__key"])
    none = F.expr("cast(array() as array<int>)")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("__spots", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))
    out = hit.withColumn("__places", F.coalesce(places, none)).withColumn("__ids", F.coalesce("__ids", F.expr("cast(array() as array<string>)")))
    starts = F.filter(F.transform("__places", lambda p, i: F.when((i == 0) | (F.try_element_at("__places", i) != p - 1), p)), lambda p: p.isNotNull())
    ends = F.filter(F.transform("__places", lambda p, i: F.when((i == F.size("__places") - 1) | (F.try_element_at("__places", i + 2) != p + 1), p + 1)), lambda p: p.isNotNull())
    return out.select(
        "doc_id", "n_words", F.size("__places").cast("long").alias("n_hit"), F.size("__ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("__ids", ","), "UTF-8"), 256).alias("items_sha256"), (F.size("__places") > 0).alias("contaminated"),
        F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("spans"), *[F.col(f"__keep_{c}").alias(name) for c, name in kept.items()],
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_LOW} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LOW} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)),
pos AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, n, p, item FROM pos JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
