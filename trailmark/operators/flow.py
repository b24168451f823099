"""Session flow: layered key-to-key flow of a session."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_edge
from ..schema import EDGE_KINDS, PROVENANCES, REDIRECT_WINDOW_MS
from .sequences import SO_FAR, tab_rows, tab_window, with_opener


def top_of(counts: Counter, names: tuple[str, ...]) -> str:
    return max(names, key=lambda n: (counts.get(n, 0), -names.index(n)))


def landings(events: DataFrame, by_domain: bool = False) -> DataFrame:
    """Every landing of a tab that came to rest: session, place, tab, src, dst, prov, kind.

    A quick redirect moves a landing on. src and kind are set where it is a link or form from another key: from
    the page the tab was opened from, else from the tab's page before. place is the id of the event that ended
    it; it is null for one that the session leaves standing.
    """
    before, so_far, after = tab_window()
    nav = F.col("step") == "nav"
    rows = tab_rows(events, by_domain).withColumn("cut", F.col("cuts") + F.count(F.when(F.col("step") == "close", 1)).over(so_far))
    rows = rows.withColumn("last", F.last(F.when(nav, F.struct("key", "ts", "cut")), True).over(before))
    near = F.col("redirect") & (F.col("ts") - F.col("last.ts") < REDIRECT_WINDOW_MS) & (F.col("cut") == F.col("last.cut"))
    rows = rows.withColumn("near", nav & F.coalesce(near, F.lit(False)))
    rows = rows.withColumn("other", nav & ~F.col("back") & (F.col("last").isNull() | (F.col("last.key") != F.col("key"))))
    # A redirect moves what is held, and something is held if any row of its unbroken run of redirects landed.
    rows = rows.withColumn("run", F.count(F.when(nav & ~F.col("near"), 1)).over(so_far))
    run = Window.partitionBy("session", "tab", "run").orderBy("id", "place").rowsBetween(*SO_FAR)
    rows = rows.withColumn("held", F.max(F.when(nav, F.col("other"))).over(run))
    rows = rows.withColumn("moved", F.col("near") & F.coalesce(F.last(F.when(nav, F.col("held")), True).over(before), F.lit(False)))
    rows = rows.withColumn("landing", F.col("other") & ~F.col("moved")).withColumn("number", F.count(F.when(F.col("landing"), 1)).over(so_far))
    changes = nav & (F.col("landing") | F.col("moved") | F.col("back"))
    page = F.when(F.col("last").isNotNull(), F.struct(F.col("last.key").alias("key"), F.last(F.when(changes, F.col("prov")), True).over(before).alias("prov")))
    rows = with_opener(rows.withColumn("page", page), F.col("page"), "number")
    origin = F.when(is_edge(F.col("prov")), F.coalesce("opener", "page"))
    ended = F.last(F.when((nav & ~F.col("moved")) | (F.col("step") == "close"), F.col("id")), True).over(after)
    rows = rows.withColumn("origin", F.when(F.col("landing"), origin)).withColumn("ended", F.least(ended, "restart")).where("landing or moved")
    rest = rows.groupBy("session", "tab", "number").agg(F.min_by("origin", "id").alias("origin"), F.max_by(F.struct("key", "prov", "ended"), "id").alias("at"))
    went = is_edge(F.col("at.prov")) & F.col("origin").isNotNull() & (F.col("origin.key") != F.col("at.key"))
    kind = F.when(F.col("origin.prov") == "search_origin", "search_link").otherwise(F.col("at.prov"))
    return rest.select("session", F.col("at.ended").alias("place"), "tab", F.when(went, F.col("origin.key")).alias("src"), F.col("at.key").alias("dst"), "at.prov", F.when(went, kind).alias("kind"))


@dataclass
class Flow:
    """nodes: (key, layer, throughput, prov); links: (from, to, weight, kind) by node index."""

    nodes: list = field(default_factory=list)
    links: list = field(default_factory=list)


def back_links(n: int, links: list[tuple[int, int]]) -> np.ndarray:
    """Which links lead to an ancestor (or the node itself) in a depth-first walk that takes nodes in order."""
    reach = np.zeros((n, n), bool)
    reach[tuple(np.array(links, np.int64).reshape(-1, 2).T)] = True
    above, seen = np.zeros((n, n), bool), np.zeros(n, bool)  # above[k]: the ancestors of k and k itself
    for root in range(n):
        path = [] if seen[root] else [root]
        if path:
            seen[root] = above[root, root] = True
        while path:
            fresh = np.flatnonzero(reach[path[-1]] & ~seen)
            if len(fresh):
                k = int(fresh[0])
                seen[k], above[k] = True, above[path[-1]]
                above[k, k] = True
                path.append(k)
            else:
                path.pop()
    return np.array([above[a, b] for a, b in links], bool)


def layers_of(n: int, links: list[tuple[int, int]], fixed: list[int]) -> np.ndarray:
    """The longest path to each node over the links that don't lead back; ``fixed`` nodes stay in column 0."""
    a, b = np.array(links, np.int64).reshape(-1, 2)[~back_links(n, links)].T if links else (np.empty(0, np.int64),) * 2
    layer = np.zeros(n, np.int64)
    while True:
        new = np.zeros(n, np.int64)
        np.maximum.at(new, b, layer[a] + 1)
        new[fixed] = 0
        if (new == layer).all():
            return layer
        layer = new


def layered(moves: list[tuple[str, str]], pinned: list[str], detached: list[str], provs: dict | None = None, kinds: dict | None = None) -> Flow:
    """Longest-path layers after back links are set aside; entries stand in column 0, detached ones as nodes of their own."""
    keys = list(dict.fromkeys([*(k for m in moves for k in m), *pinned]))  # in order of first appearance
    at, weight, lone = {k: i for i, k in enumerate(keys)}, Counter(moves), Counter(detached)
    links = sorted((at[a], at[b]) for a, b in weight)
    layer = layers_of(len(keys), links, [at[k] for k in pinned])
    passing = np.zeros((2, len(keys)), np.int64)
    for (a, b), n in weight.items():
        passing[0, at[a]] += n
        passing[1, at[b]] += n
    prov = lambda k: top_of(provs[k], PROVENANCES) if provs and provs.get(k) else "other"
    through = [max(1, int(passing[:, i].max()), 0 if layer[i] else lone[k]) for i, k in enumerate(keys)]
    flow = Flow([(k, int(layer[i]), through[i], prov(k)) for i, k in enumerate(keys)])
    # A second bar only for a key that stands further in.
    flow.nodes += [(k, 0, n, prov(k)) for k, n in sorted(lone.items()) if k not in at or layer[at[k]]]
    flow.links = [(a, b, weight[keys[a], keys[b]], top_of(kinds[keys[a], keys[b]], EDGE_KINDS) if kinds else "link") for a, b in links]
    return flow


def session_flow(rows: list[dict]) -> Flow:
    """The flow of one session's ``landings``."""
    rows = sorted(rows, key=lambda r: (r["place"] is None, r["place"] or 0, r["tab"]))
    moves = [(r["src"], r["dst"]) for r in rows if r["src"] is not None]
    entries = [r["dst"] for r in rows if r["src"] is None]
    provs: dict[str, Counter] = {}
    kinds: dict[tuple, Counter] = {}
    for r in rows:
        provs.setdefault(r["dst"], Counter())[r["prov"]] += 1
        if r["src"] is not None:
            kinds.setdefault((r["src"], r["dst"]), Counter())[r["kind"]] += 1
    reached = {b for _, b in moves}
    return layered(moves, [k for k in entries if k not in reached], [k for k in entries if k in reached], provs, kinds)


def split_orphans(flow: Flow) -> tuple[Flow, list[tuple[str, int]]]:
    """The linked part, and (host, throughput) of nodes that no link touches, largest first."""
    used = sorted({x for a, b, _, _ in flow.links for x in (a, b)})
    at = {k: i for i, k in enumerate(used)}
    loose = sorted(((n[0], n[2]) for i, n in enumerate(flow.nodes) if i not in at), key=lambda x: (-x[1], x[0]))
    return Flow([flow.nodes[i] for i in used], [(at[a], at[b], w, k) for a, b, w, k in flow.links]), loose


def focused(flow: Flow, up: int, down: int) -> Flow:
    """What leads to ``up`` and what ``down`` leads to, with the links among them."""

    def reach(start: int, pairs: list[tuple[int, int]]) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            k = todo.pop()
            for a, b in pairs:
                if a == k and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    pairs = [(a, b) for a, b, _, _ in flow.links]
    kept = sorted(reach(up, [(b, a) for a, b in pairs]) | reach(down, pairs))
    at = {k: i for i, k in enumerate(kept)}
    return Flow([flow.nodes[i] for i in kept], [(at[a], at[b], w, k) for a, b, w, k in flow.links if a in at and b in at])


def _by_session(events: DataFrame, by_domain: bool, rows_of, schema: str) -> DataFrame:
    columns = [c.split() for c in schema.split(", ")]
    kinds = pa.schema([(n, pa.int64() if kind == "bigint" else pa.string()) for n, kind in columns])

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        told = [(rows[0]["session"], *r) for r in rows_of(session_flow(rows))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*told) if told else [()] * len(kinds), kinds)], schema=kinds)

    return landings(events, by_domain).groupBy("session").applyInArrow(run, schema)


def flows(events: DataFrame, by_domain: bool = False) -> DataFrame:
    """Every session's flow links. A session's landings are one group, bounded by the session."""
    told = lambda f: [(f.nodes[a][0], f.nodes[a][1], f.nodes[b][0], f.nodes[b][1], w, k) for a, b, w, k in f.links]
    return _by_session(events, by_domain, told, "session bigint, src string, src_layer bigint, dst string, dst_layer bigint, weight bigint, kind string")


def flow_nodes(events: DataFrame, by_domain: bool = False) -> DataFrame:
    """Every session's flow nodes, with throughput and the provenance that most of its landings have."""
    return _by_session(events, by_domain, lambda f: f.nodes, "session bigint, key string, layer bigint, throughput bigint, prov string")
