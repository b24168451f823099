"""Centroid clustering with Hamerly's bounds, in exact integer arithmetic.

Each vector keeps two numbers from round to round: ``upper``, no less than its distance to its own centroid, and
``lower``, no more than that to any other. When centroids move, the bounds are loosened by their drift; while
``upper`` stays below ``lower``, or below half the way to the next centroid, the vector can't have changed its
cluster and isn't compared at all. Only then is ``upper`` made tight, and only what is still ambiguous gets a full
scan, in 64-bit integers. The bounds are floats and are rounded away from each other at every step, so they decide
nothing that the integers wouldn't; an equal distance is always ambiguous.

A round is one pass over the state, which is written to the shared checkpoint folder with the vectors packed in it,
so that no round shuffles a vector. What reaches the driver is ``k`` centroids: sums for each cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, table, tidy

#: Components up to this size have squared distances that fit a long, for up to 128 of them.
MOST = 1 << 27
#: Bounds are rounded outwards by this part, far above the error of a few float operations.
SLACK = 1e-9


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector's integers, of 16 bits where all fit, else of 32."""
    short = np.abs(vectors).max(axis=1, initial=0) < 1 << 15
    return [v.astype(np.int16 if s else np.int32).tobytes() for v, s in zip(vectors, short.tolist())]


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    out = np.empty((len(column), dim), np.int64)
    for k, v in enumerate(column.to_pylist()):
        out[k] = np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.int32)
    return out


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        far = vectors - c
        out[:, k] = np.einsum("ij,ij->i", far, far)
    return out


def up(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x) * (1 + SLACK)


def scanned(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by a full scan; of equal distances the smaller number."""
    d = squared(vectors, centroids)
    own = d.argmin(axis=1).astype(np.int32)
    at = np.arange(len(d))
    upper = up(d[at, own])
    if len(centroids) == 1:
        return own, upper, np.full(len(d), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    return own, upper, np.sqrt(d.min(axis=1)) * (1 - SLACK)


def loosened(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after each centroid has moved by ``drift``: others by the largest drift of those not one's own."""
    order = np.argsort(-drift, kind="stable")
    first, second = order[0], drift[order[1]] if len(drift) > 1 else 0.0
    others = np.where(own == first, second, drift[first])
    return (upper + drift[own]) * (1 + SLACK), lower - others - SLACK * (np.abs(lower) + others)


def halfway(centroids: np.ndarray) -> np.ndarray:
    """For each centroid half the distance to the next one, rounded down."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    d = squared(centroids, centroids)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    return np.sqrt(d.min(axis=1)) / 2 * (1 - SLACK)


def reassigned(vectors, own, upper, lower, centroids, drift) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, ambiguous) after the centroids have moved."""
    upper, lower = loosened(upper, lower, own, drift)
    bound = np.maximum(lower, halfway(centroids)[own])
    open_ = np.flatnonzero(upper >= bound)
    far = vectors[open_] - centroids[own[open_]]
    upper[open_] = up(np.einsum("ij,ij->i", far, far))
    open_ = open_[upper[open_] >= bound[open_]]
    own = own.copy()
    own[open_], upper[open_], lower[open_] = scanned(vectors[open_], centroids)
    ambiguous = np.zeros(len(own), bool)
    ambiguous[open_] = True
    return own, upper, lower, ambiguous


def kept_vectors(rows: DataFrame, id_col: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, vec): the vectors of ``dim`` finite components, as packed integers floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    whole = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.select(F.col(id_col).alias("id"), F.when(whole, x).alias("x")).where("x IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = np.floor(batch.column(1).flatten().to_numpy().reshape(-1, dim) * scale)
            if np.abs(v).max(initial=0) > MOST:
                raise OverflowError(f"a component times {scale} is over {MOST}: a squared distance may not fit a long")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed(v.astype(np.int64)), pa.binary())], names=["id", "vec"]
            )

    return rows.mapInArrow(tidy(run), f"id {kind}, vec binary")


def starts(kept: DataFrame, k: int, salt: str, dim: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; null ids come last, equal ids in the vectors' order."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.select("vec", h.alias("h")).orderBy(F.asc_nulls_last("h"), "vec").limit(k).collect()
    return unpacked(pa.array([bytes(r.vec) for r in rows], pa.binary()), dim)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each cluster's componentwise floor of the mean; an empty cluster's centroid stays."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            v, own = unpacked(batch.column(1), dim), batch.column(0).to_numpy()
            n += np.bincount(own, minlength=k)
            np.add.at(sums, own, v)
        some = np.flatnonzero(n)
        cols = [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", "sums"])

    parts = state.select("cluster", "vec").mapInArrow(tidy(run), "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    exact = F.sum(F.col("x").cast("decimal(38,0)"))
    out = centroids.copy()
    for r in each.groupBy("cluster", "i").agg(exact.alias("x"), F.sum("n").alias("n")).collect():  # k x dim rows
        out[r.cluster, r.i] = int(r.x) // r.n
    return out


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    far = new - old
    return up(np.einsum("ij,ij->i", far, far))


def cluster(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 16,
    dim: int = 64,
    rounds: int = 3,
    scale: int = 64,
    salt: str = "1:",
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, scans) of every kept row, and the centroids; scans counts a vector's full scans.

    Rows whose vector is null, of another length, or has a null, NaN or infinite component are left out. Repeated
    rows count each time, so equal vectors may start as several centroids: of equal distances the smaller number
    wins. With fewer vectors than ``k`` there are as many centroids; an empty table gives an empty result. Other
    columns are ignored. A component times ``scale`` over 2^27 is an error, as its squared distance may not fit a long.
    """
    kept = cut(kept_vectors(rows, id_col, vector, dim, scale))
    kind = kept.schema["id"].dataType.simpleString()
    fields = f"id {kind}, vec binary, cluster int, upper double, lower double, scans int"
    centroids = starts(kept, k, salt, dim)
    if not len(centroids):
        return kept.selectExpr("id", "0 AS cluster", "0L AS distance", "0 AS scans"), centroids

    def batch_of(batch, own, upper, lower, scans):
        cols = [batch.column(0), batch.column(1), *(pa.array(c) for c in (own.astype(np.int32), upper, lower, scans))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "vec", "cluster", "upper", "lower", "scans"])

    def first(batches, centroids=centroids):
        for batch in batches:
            found = scanned(unpacked(batch.column(1), dim), centroids)
            yield batch_of(batch, *found, np.ones(batch.num_rows, np.int32))

    state = cut(kept.mapInArrow(tidy(first), fields))
    for _ in range(rounds):
        moved = means(state, centroids)

        def again(batches, centroids=moved, drift=drifts(centroids, moved)):
            for batch in batches:
                own, upper, lower = (batch.column(i).to_numpy().copy() for i in (2, 3, 4))
                *found, full = reassigned(unpacked(batch.column(1), dim), own, upper, lower, centroids, drift)
                yield batch_of(batch, *found, batch.column(5).to_numpy() + full.astype(np.int32))

        state, centroids = cut(state.mapInArrow(tidy(again), fields)), moved
        release(rows.sparkSession)

    def distances(batches, centroids=centroids):
        for batch in batches:
            own = batch.column(2).to_numpy()
            far = unpacked(batch.column(1), dim) - centroids[own]
            d = np.einsum("ij,ij->i", far, far)
            cols = [batch.column(0), batch.column(2), pa.array(d), batch.column(5)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "cluster", "distance", "scans"])

    return cut(state.mapInArrow(tidy(distances), f"id {kind}, cluster int, distance bigint, scans int")), centroids


def clustered(rows: DataFrame, id_col: str = "vec_id", **more) -> DataFrame:
    """Per kept row: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scans."""
    found, centroids = cluster(rows, id_col, **more)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.x) for r in found.groupBy("cluster").agg(total.alias("x")).collect()}  # k rows at most
    inertia = sum(sums.values())
    if max(inertia, 0) >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    told = [
        (i, sums.get(i, 0), inertia, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    each = rows.sparkSession.createDataFrame(told, schema)  # k rows
    out = found.join(F.broadcast(each), "cluster")
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("scans")


def oracle(k: int = 16, dim: int = 64, rounds: int = 3) -> str:
    """DuckDB SQL with every distance of every round computed."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e
  FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, e, k, d FROM (
  SELECT v.vec_id, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e
  FROM (SELECT k, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.k AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)"""


ORACLE = oracle()
