"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut after every word whose hash is divisible by ``mean_words``, or after ``max_words`` words, so
equal passages are cut alike wherever they stand. Every distinct chunk is compared by its characters once
(``chunk_collisions``); that makes its 64-bit hash, with a rank where hashes collide, a verified
identifier. Documents are then equal exactly when their ordered lists of identifiers are, and only those
lists, about a fiftieth of the text, are grouped and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, table

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunked(docs: DataFrame, text: str, mean_words: int, max_words: int, hash_bits: int) -> DataFrame:
    """Adds __norm, and __chunks: array of (h, chunk), which joined by one space give __norm."""
    words = docs.withColumn("__norm", normalised(F.col(text))).withColumn("__words", F.split("__norm", " "))
    ends = F.filter(F.transform("__words", lambda w, i: F.when(F.pmod(F.xxhash64(w), F.lit(mean_words)) == 0, i + 1)), lambda i: i.isNotNull())
    ends = words.withColumn("__ends", F.array_distinct(F.concat(ends, F.array(F.size("__words")))))
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("__ends", 1, F.size("__ends") - 1)), "__ends", lambda a, b: F.sequence(a, b - 1, F.lit(max_words)))
    starts = ends.withColumn("__starts", F.flatten(spans))
    nexts = F.concat(F.slice("__starts", 2, F.size("__starts")), F.array(F.size("__words")))
    chunks = starts.withColumn("__chunks", F.zip_with("__starts", nexts, lambda a, b: F.array_join(F.slice(F.col("__words"), a + 1, b - a), " ")))
    h = lambda c: F.xxhash64(c) if hash_bits >= 64 else F.pmod(F.xxhash64(c), F.lit(1 << hash_bits))
    return chunks.withColumn("__chunks", F.transform("__chunks", lambda c: F.struct(h(c).alias("h"), c.alias("chunk")))).drop("__words", "__ends", "__starts")


def chunk_collisions(chunks: DataFrame) -> DataFrame:
    """(h, chunk, rank) of distinct chunks that share their hash with another; normally none.

    Copies of a chunk are folded on the map side, so a chunk moves at most once from each task.
    """
    distinct = chunks.select(F.inline_outer("__chunks")).distinct()  # outer: no filter is inferred, which would repeat the cutting
    shared = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return distinct.join(shared.select("h"), "h").select("h", "chunk")


def recipes(docs: DataFrame, text: str = "text", mean_words: int = 64, max_words: int = 1024, hash_bits: int = 64) -> DataFrame:
    """``docs`` with recipe (array of verified chunk identifiers) and text_sha256.

    ``hash_bits`` under 64 forces collisions, for tests.
    """
    from pyspark.sql import Window

    chunks = chunked(docs, text, mean_words, max_words, hash_bits)
    collisions = cut(chunk_collisions(chunked(docs.select(text), text, mean_words, max_words, hash_bits)))
    digest = F.sha2(F.encode("__norm", "UTF-8"), 256)
    if collisions.isEmpty():
        plain = F.transform("__chunks", lambda c: F.struct(c["h"].alias("h"), F.lit(1).alias("rank")))
        return chunks.withColumn("recipe", plain).withColumn("text_sha256", digest).drop("__norm", "__chunks")
    ranks = collisions.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    keyed = cut(chunks.withColumn("__row", F.monotonically_increasing_id()).withColumn("text_sha256", digest).drop("__norm"))
    parts = keyed.select("__row", F.posexplode("__chunks").alias("pos", "c")).select("__row", "pos", "c.h", "c.chunk")
    known = attach(parts, ranks, ["h", "chunk"]).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("rank", F.lit(1)).alias("rank")))).alias("l"))
    known = known.select("__row", F.transform("l", lambda x: F.struct(x["h"].alias("h"), x["rank"].alias("rank"))).alias("recipe"))
    return attach(keyed.drop("__chunks"), known, ["__row"]).drop("__row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", row: str | None = None, **cuts: int) -> DataFrame:
    """One row for each row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when they are identical after white space runs become one
    space. The smallest id stays (null ids last); of repeated rows with one id a single row is kept. An
    empty table gives an empty result. Other columns of ``docs`` are ignored, but that a unique column
    named by ``row`` is carried along, to tell repeated rows apart.
    """
    given = [F.col(row).alias("row")] if row else []
    made = recipes(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *given), "text", **cuts).drop("text")
    rows = cut(made if row else made.withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first")
    groups = rows.groupBy("recipe").agg(first, F.count("*").alias("group_size"))
    joined = attach(rows, groups, ["recipe"], "inner")
    return joined.select(F.col("doc_id"), F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", *["row"] * bool(row))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
