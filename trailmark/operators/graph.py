"""Graph analytics over a projection's nodes and edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import settled
from .project import Graph


def within(g: Graph) -> DataFrame:
    """Edges whose ends are both nodes."""
    keys = g.nodes.select("key")
    return g.edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")


def hubs(g: Graph, n: int) -> DataFrame:
    """key, weight: in and out; nodes without edges count zero."""
    ends = within(g).select(F.inline(F.array(F.struct(F.col("src").alias("key"), "weight"), F.struct(F.col("dst").alias("key"), "weight"))))
    by = ends.groupBy("key").agg(F.sum("weight").alias("weight"))
    return g.nodes.select("key").join(by, "key", "left").select("key", F.coalesce("weight", F.lit(0)).alias("weight")).orderBy(F.desc("weight"), "key").limit(n)


def launch_pads(g: Graph, n: int) -> DataFrame:
    return within(g).groupBy(F.col("src").alias("key")).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "key").limit(n)


def destinations(g: Graph, n: int) -> DataFrame:
    return within(g).groupBy(F.col("dst").alias("key")).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "key").limit(n)


def search_destinations(g: Graph, n: int) -> DataFrame:
    return g.edges.where("kind_search_link > 0").groupBy(F.col("dst").alias("key")).agg(F.sum("kind_search_link").alias("weight")).orderBy(F.desc("weight"), "key").limit(n)


def next_hops(g: Graph, min_out: int = 4, n: int = 6) -> DataFrame:
    """Each source's heaviest edge and its share of the source's weight."""
    by = g.edges.groupBy("src").agg(F.min(F.struct((-F.col("weight")).alias("w"), "dst")).alias("best"), F.sum("weight").alias("total")).where(F.col("total") >= min_out)
    out = by.select("src", F.col("best.dst").alias("dst"), (-F.col("best.w")).alias("weight"), (-F.col("best.w") / F.col("total")).alias("share"))
    return out.orderBy(F.desc("share"), F.desc("weight"), "src", "dst").limit(n)


def reciprocal_pairs(g: Graph, n: int) -> DataFrame:
    """a < b with traffic both ways: one aggregation by the unordered pair, no self join."""
    up = F.col("src") < F.col("dst")
    by = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.when(up, F.col("weight"))).alias("ab"), F.sum(F.when(~up, F.col("weight"))).alias("ba"))
    return by.where("ab > 0 and ba > 0").orderBy(F.desc(F.least("ab", "ba")), "a", "b").limit(n)


def ego(g: Graph, focus: str) -> Graph:
    """The focus, its neighbours and the edges among them; empty where the focus is absent."""
    near = g.edges.where((F.col("src") == focus) | (F.col("dst") == focus)).select(F.inline(F.array(F.struct(F.col("src").alias("key")), F.struct(F.col("dst").alias("key")))))
    there = g.nodes.where(F.col("key") == focus).select("key")
    keep = near.unionByName(there).distinct().join(F.broadcast(there.withColumnRenamed("key", "f")))  # no row without the focus
    nodes = g.nodes.join(keep.select("key"), "key", "left_semi")
    return Graph(nodes, within(Graph(nodes, g.edges)))


def component(g: Graph, focus: str) -> Graph:
    """The nodes connected with the focus, a step outwards at a time until none is new."""
    both = within(g).select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))).distinct()
    seen = g.nodes.where(F.col("key") == focus).select("key")
    fresh = seen
    while True:
        step = both.join(fresh.withColumnRenamed("key", "a"), "a", "left_semi").select(F.col("b").alias("key")).distinct().join(seen, "key", "left_anti")
        fresh = settled(step)
        if fresh.isEmpty():
            break
        seen = settled(seen.unionByName(fresh))
    nodes = g.nodes.join(seen, "key", "left_semi")
    return Graph(nodes, within(Graph(nodes, g.edges)))


def node_connections(g: Graph, node: str, n: int) -> DataFrame:
    """direction, host, weight: the heaviest each way."""
    ins = g.edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("host"), "weight")
    outs = g.edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("host"), "weight")
    place = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("weight"), "host"))
    return ins.unionByName(outs).withColumn("place", place).where(F.col("place") <= n)


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 40, every: int = 4) -> DataFrame:
    """key, rank: weighted, the rank of nodes without out-edges shared by all; lineage is cut every few rounds."""
    e = within(g).where("weight > 0")
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    e = settled(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    nodes = settled(g.nodes.select("key").join(out.select(F.col("src").alias("key"), F.lit(True).alias("has")), "key", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("key", F.lit(0.0).alias("rank"))
    ranks = nodes.select("key", "has", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("has").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        got = e.join(ranks.select(F.col("key").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        ranks = nodes.join(got, "key", "left").crossJoin(F.broadcast(loose)).select("key", "has", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if k % every == every - 1:
            ranks = settled(ranks)
    return ranks.select("key", "rank")


def moved_to_rest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Communities of n nodes after single moves until none gains; of equal gains the smallest community is taken.

    a, b and w hold every link both ways, loops once with their weight doubled. Gains are told times the total weight, so
    those of whole weights are whole numbers, and equal ones are equal however large the weights are.
    """
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    first = np.searchsorted(a, np.arange(n + 1))
    strength = np.bincount(a, w, n)
    total, group, seen = strength.sum(), np.arange(n), set()
    inside = strength.copy()  # strength of each community
    while group.tobytes() not in seen:  # moves of no gain can't lead round in a circle
        seen.add(group.tobytes())
        for i in range(n):
            near, links = b[first[i] : first[i + 1]], w[first[i] : first[i + 1]]
            others = near != i
            inside[group[i]] -= strength[i]
            choice, at = np.unique(np.append(group[near[others]], group[i]), return_inverse=True)
            gain = np.bincount(at[:-1], links[others], len(choice)) * total - inside[choice] * strength[i]
            group[i] = choice[np.flatnonzero(gain >= gain.max() - 1e-12 * total)[0]]
            inside[group[i]] += strength[i]
    return group


def louvain_labels(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Community of each of n nodes: single moves, then communities as nodes, until nothing moves any more."""
    a, b, w = (np.array(c, float if k == 2 else np.int64) for k, c in enumerate(zip(*edges))) if edges else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    member = np.arange(n)
    while w.sum() > 0:
        size = int(max(a.max(), b.max(), member.max())) + 1
        names, group = np.unique(moved_to_rest(size, a, b, w), return_inverse=True)
        member = group[member]
        if len(names) == size:
            break
        pair, at = np.unique(group[a] * len(names) + group[b], return_inverse=True)
        a, b, w = pair // len(names), pair % len(names), np.bincount(at, w)
    return member.tolist()


def communities(g: Graph) -> DataFrame:
    """key, community (named by its first member): Louvain over the symmetric weighted graph.

    The method is sequential; hosts of one person's log are few, so one group holds them all.
    """
    pairs = within(g).where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").cast("double").alias("w"))
    rows = pairs.unionByName(g.nodes.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("w"))).withColumn("one", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {k: i for i, k in enumerate(keys)}
        pdf = pdf.sort_values(["a", "b"])
        labels = louvain_labels(len(keys), [(at[a], at[b], w) for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"]) if w > 0])
        first: dict[int, str] = {}
        for k, c in zip(keys, labels):
            first.setdefault(c, k)
        return pd.DataFrame({"key": keys, "community": [first[c] for c in labels]})

    return rows.groupBy("one").applyInPandas(run, "key string, community string")


def betweenness(g: Graph, most_pairs: int = 5_000_000) -> DataFrame:
    """key, score: shortest paths through each node, unweighted and undirected; sources are dealt over tasks.

    Every source needs the whole graph, of one log's hosts, which is broadcast: over ``most_pairs`` linked pairs it is
    an error.
    """
    pairs = within(g).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = settled(pairs)
    if (n := pairs.count()) > most_pairs:
        raise ValueError(f"{n} linked pairs of hosts are more than the {most_pairs} that betweenness takes")
    rows = [(r.a, r.b) for r in pairs.toLocalIterator()]  # at most most_pairs
    keys = sorted({k for ab in rows for k in ab})
    at = {k: i for i, k in enumerate(keys)}
    adj: list[list[int]] = [[] for _ in keys]
    for a, b in sorted(rows):
        adj[at[a]].append(at[b])
        adj[at[b]].append(at[a])
    spark = g.nodes.sparkSession
    shared = spark.sparkContext.broadcast((keys, adj))

    def run(batches):
        names, near = shared.value
        score = np.zeros(len(names))
        for pdf in batches:
            for s in pdf["id"].tolist():
                dist, paths, order, before = {s: 0}, {s: 1.0}, [], {s: []}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in near[v]:
                        if w not in dist:
                            dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                part = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        score[w] += part[w]
        yield pd.DataFrame({"key": names, "score": score})

    each = spark.range(len(keys)).mapInPandas(run, "key string, score double").groupBy("key").agg((F.sum("score") / 2).alias("score"))
    return g.nodes.select("key").join(each, "key", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))


def bridges(g: Graph, n: int) -> DataFrame:
    """key, score of nodes on shortest paths whose neighbours are of two communities or more."""
    com = communities(g)
    near = within(g).where("src <> dst").select(F.inline(F.array(F.struct(F.col("src").alias("key"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("key"), F.col("src").alias("other"))))).distinct()
    spans = near.join(com.select(F.col("key").alias("other"), "community"), "other").groupBy("key").agg(F.count_distinct("community").alias("spans")).where("spans >= 2")
    return betweenness(g).where("score > 0").join(spans, "key", "left_semi").orderBy(F.desc("score"), "key").limit(n)


def community_table(g: Graph, groups: int = 10, members: int = 5) -> DataFrame:
    """community, size, place, key, visits: the largest communities and their busiest members."""
    m = communities(g).join(g.nodes.select("key", "visits"), "key")
    sizes = m.groupBy("community").agg(F.count("*").alias("size")).where("size >= 2").orderBy(F.desc("size"), "community").limit(groups)
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("visits"), "key"))
    return m.join(sizes, "community").withColumn("place", place).where(F.col("place") <= members).select("community", "size", "place", "key", "visits")
