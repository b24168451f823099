"""Numbers for rows that have none: 1, 2, ... in a given order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folders import settled


def numbered(rows: DataFrame, *order: str | Column, name: str = "id", first: int = 1) -> DataFrame:
    """``rows`` with ``name``: their number in the order, from ``first``, without gap or repeat.

    Rows are sorted by ranges of the order and written once, each with its range and its place in it; what is read
    from then on is that table, so a range that is sampled anew elsewhere can't shift a number. A range's numbers begin
    where those of the ranges before end: one count for each range. Ties are numbered in any order, but only once.
    """
    part, at = "__range", "__place"
    ordered = rows.orderBy(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()})
    written = settled(ordered)
    ranges = written.groupBy(part).agg(F.count("*").alias("n"), F.min(at).alias("low"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    ranges = ranges.select(part, (F.coalesce(before, F.lit(0)) - F.col("low") + first).alias("shift"))
    out = written.join(F.broadcast(ranges), part)  # as many rows as the sort had partitions
    return out.withColumn(name, F.col(at) + F.col("shift")).drop(part, at, "shift")


def ingested(spark: SparkSession, path: str, kind: str = "json", schema=None, **options) -> DataFrame:
    """The rows of files without ids, with ``id`` in the order of files' names and of rows in them.

    Rows are told apart by file, block and their place in the block, so large files are read in parallel.
    """
    reader = spark.read.format(kind).options(**options)
    rows = (reader.schema(schema) if schema is not None else reader).load(path)
    rows = rows.select("*", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__row"))
    return numbered(rows, "file_path", "file_block_start", "__row").drop("file_path", "file_block_start", "__row")
