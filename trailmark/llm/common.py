"""Helpers shared by the corpus operators: reading, cutting lineage, skew-safe joins, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Arrow batches have ``rows`` rows at most, where the session has Spark's own 10,000: texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark so that any store it knows will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: that of spark.checkpoint.dir, or the one that the session has set.

    A temporary folder serves only where there is none and the executors are this machine's own threads, as in tests.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="trailmark-")
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    Unlike a local checkpoint the files outlive the executors that wrote them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Like ``cut``, but as Parquet, which is smaller for columns that repeat; and a function that removes the files."""
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)

    def discard() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.parquet(folder), discard


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle and checkpoint files of plans that nothing refers to any more.

    Spark removes them when the driver's JVM collects the plans, which may be long after a phase is done.
    """
    gc.collect()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` to ``groups``, which has one row for each value of ``keys``.

    The join key also has a hash of the keys, so both sides are dealt out afresh for the join even
    where ``groups`` comes from an aggregation by the same keys. Adaptive execution can then split a
    key that holds a large part of ``rows`` over many tasks, which it can't for a reused exchange.
    """
    right = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = F.xxhash64(*[rows[k] for k in keys]) == F.xxhash64(*[right[f"__{k}"] for k in keys])
    for k in keys:
        on = on & (rows[k] == right[f"__{k}"])
    return rows.join(right, on, how).drop(*[f"__{k}" for k in keys])


def tidy(run: Callable, forget: Callable[[], None] = lambda: None) -> Callable:
    """A mapInArrow function that calls ``forget`` after a task and gives the memory it used back to the system.

    Idle Python workers stay beside the executor's JVM; else each would hold the largest task it ever ran.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def ascii_lower(text: Column) -> Column:
    """A-Z only: lower() does the same on pure ASCII and is much faster than translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def gathered(df: DataFrame, rows: int, per: int = 20_000) -> DataFrame:
    """``df`` of about ``rows`` rows in no more parts than they need: every task leaves files, however few its rows are."""
    return df.coalesce(max(8, -(-rows // per)))


def components(edges: DataFrame, max_rounds: int = 60, broadcast_rows: int = 200_000) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: bigint); component is the smallest node reachable.

    Alternating large-star and small-star steps. Each step is a map-side-combined minimum for every node
    and a join that adaptive execution can split, so a star with very many leaves isn't one task's work. The minima
    of up to ``broadcast_rows`` edges are broadcast.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def seen(d: DataFrame):
        return tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        if before[0] > broadcast_rows:
            return attach(rows, least, ["u"], "inner")
        return rows.join(F.broadcast(gathered(least, before[0])), "u")

    before = seen(e)
    e = gathered(e, before[0])
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(gathered(large, before[0]))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least)
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        e = cut(gathered(small.where("u <> v").distinct(), before[0]))
        now = seen(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    told = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return gathered(told, before[0])
