"""Force-directed positions of a graph's nodes, in two or three dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import communities, within
from .project import Graph


def positions(keys: list[str], edges: list[tuple[int, int]], rounds: int = 320, dims: int = 2, seed: dict[str, tuple] | None = None, groups: list | None = None, gravity: float = 0.5, cohesion: float = 0.2) -> np.ndarray:
    """Springs along edges, repulsion between all, a pull to the middle and to the community's own.

    Repulsion is exact, a block of rows at a time; a log's hosts are few enough. Starts are a spiral, or
    the positions given, so equal inputs give equal layouts.
    """
    n = len(keys)
    if not n:
        return np.zeros((0, dims))
    side = np.sqrt(n) * 60.0 if dims == 2 else np.cbrt(n) * 80.0
    k, i = side / max(n, 1) ** (1 / dims), np.arange(n)
    angle, r = i * np.pi * (3 - np.sqrt(5)), side / 2 * np.sqrt((i + 0.5) / n)
    p = np.stack([r * np.cos(angle), r * np.sin(angle), *([side / 2 * (2 * (i + 0.5) / n - 1)] if dims == 3 else [])], 1)
    for j, key in enumerate(keys):
        if seed and key in seed:
            p[j] = seed[key]
    e = np.array(edges, int).reshape(-1, 2)
    group = np.unique(groups, return_inverse=True)[1] if groups is not None else None
    for step in range(rounds):
        move = -gravity * p * 0.1
        for a in range(0, n, 512):
            d = p[a : a + 512, None] - p[None]
            dist2 = np.maximum((d**2).sum(2), 1e-4)
            move[a : a + 512] += (d * (k * k / dist2)[..., None]).sum(1)
        if len(e):
            d = p[e[:, 0]] - p[e[:, 1]]
            pull = d * (np.sqrt((d**2).sum(1)) / k)[:, None]
            np.add.at(move, e[:, 0], -pull)
            np.add.at(move, e[:, 1], pull)
        if group is not None:
            size = np.bincount(group)
            middle = np.stack([np.bincount(group, p[:, x]) / size for x in range(dims)], 1)
            move -= cohesion * (p - middle[group])
        length = np.maximum(np.sqrt((move**2).sum(1)), 1e-9)
        p = p + move * (np.minimum(length, side / 10 * (1 - step / rounds)) / length)[:, None]
    return p


def layout(g: Graph, dims: int = 2, rounds: int = 320, cohesive: bool = True, start: DataFrame | None = None) -> DataFrame:
    """key, x, y[, z]: one group, since every node moves every other.

    ``start`` has positions (key, x, y[, z]) of a layout before, where its nodes begin; others begin on the spiral.
    """
    com = communities(g) if cohesive else g.nodes.select("key", F.lit(None).cast("string").alias("community"))
    rows = com.select("key", "community", F.lit(None).cast("string").alias("dst")).unionByName(within(g).select(F.col("src").alias("key"), F.lit(None).cast("string").alias("community"), "dst")).withColumn("one", F.lit(0))
    axes = "xyz"[:dims]
    if start is not None:
        rows = rows.join(start.select("key", F.array(*axes).alias("at")), "key", "left")
    else:
        rows = rows.withColumn("at", F.lit(None).cast("array<double>"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["dst"].isna()].sort_values("key")
        keys = nodes["key"].tolist()
        at = {x: i for i, x in enumerate(keys)}
        edges = sorted((at[a], at[b]) for a, b in pdf[pdf["dst"].notna()][["key", "dst"]].itertuples(index=False) if a in at and b in at)
        seed = {k: tuple(x) for k, x in zip(keys, nodes["at"]) if x is not None and not any(v is None or v != v for v in x)}
        p = positions(keys, edges, rounds, dims, seed, groups=nodes["community"].tolist() if cohesive else None)
        return pd.DataFrame({"key": keys, **{c: p[:, k] for k, c in enumerate("xyz"[:dims])}})

    return rows.groupBy("one").applyInPandas(run, "key string, " + ", ".join(f"{c} double" for c in "xyz"[:dims]))
