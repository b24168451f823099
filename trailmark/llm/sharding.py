"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``cells`` equal arcs; ``vnodes`` virtual nodes of each shard stand at hashed cells and own
the cells clockwise up to the next one. A first pass counts the rows of every cell. The driver walks those
counts (their number is a parameter, not a function of the data) clockwise: a cell's rows go to its
owner until that shard is full and continue with the next virtual node's shard. The walk gives ranges of
ranks in a cell; a second pass gives each row its rank and looks its range up.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def _positions(spark: SparkSession, shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order: a shard's places don't depend on how many shards there are."""
    node = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("s"), F.floor(F.col("id") / shards).alias("v"))
    grid = node.select("s", F.pmod(F.xxhash64(F.lit("vnode"), F.col("s"), F.col("v")), F.lit(cells)).alias("c"))
    return sorted((r.c, r.s) for r in grid.collect())


def plan_ring(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each cell's rows go when shards fill up."""
    import bisect

    starts, load, out = [c for c, _ in nodes], [0] * len(capacity), []
    for cell in sorted(counts):
        at, done = bisect.bisect_right(starts, cell) - 1, 0
        while done < counts[cell]:
            shard = nodes[at % len(nodes)][1]
            if take := min(counts[cell] - done, capacity[shard] - load[shard]):
                out.append((cell, done, done + take, shard, load[shard]))
                load[shard], done = load[shard] + take, done + take
            at += 1
    return out


def ring_shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 24, vnodes: int = 64, cells: int = 8192) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Capacities are the row count over the shards, rounded down or up, so counts are at most one apart.
    Null text has no bytes. Rows with a null id stand on the ring by their text; repeated rows are placed
    one by one. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.col(text)), F.lit("null")))
    at = docs.select(F.pmod(place, F.lit(cells)).alias("cell"))
    counts = {r.cell: r.n for r in at.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most `cells` rows
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    plan = plan_ring(counts, _positions(spark, shards, vnodes, cells), capacity)
    kind = "array<struct<cell:bigint,a:bigint,b:bigint,shard:int,slot0:bigint>>"
    text_plan = json.dumps([dict(zip(("cell", "a", "b", "shard", "slot0"), x)) for x in plan])
    ranges = spark.range(1).select(F.inline(F.from_json(F.lit(text_plan), kind))).withColumnRenamed("cell", "__cell")
    bytes_ = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(bytes_) + 8).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), place.alias("h"), F.pmod(place, F.lit(cells)).alias("cell"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")) - 1)
    # Proven bound: a range for each cell, and one more for each overflow into a next shard.
    joined = ranked.join(F.broadcast(ranges), (F.col("cell") == F.col("__cell")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"))
