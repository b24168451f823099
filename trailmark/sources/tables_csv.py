"""All tables of a view as one CSV document of sections, or as a folder for each."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import csv_field, dominant
from ..operators import graph, project
from ..schema import EDGE_KINDS, PROVENANCES

#: Labels of the document: fixed values.
RANGES = {"session": "This session", "day": "Today", "week": "This week", "month": "This month", "year": "This year"}
ORIGINS = dict(zip(PROVENANCES, ("Link", "Form", "Typed URL", "Search origin", "Bookmark", "External", "Reload", "Other")))
KIND_NAMES = dict(zip(EDGE_KINDS, ("Link", "SearchLink", "Form")))
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
RANKED = 50  # authorities that are told


@dataclass(frozen=True)
class Section:
    """A title, a header, and rows whose columns are named by it, in the order of ``order``."""

    title: str
    header: tuple[str, ...]
    rows: DataFrame
    order: tuple[Column, ...]
    always: bool = True  # told when it has no rows

    @classmethod
    def of(cls, title: str, header: tuple[str, ...], rows: DataFrame, columns: list, order: list, always: bool = True) -> Section:
        told = rows.select(*[F.col(c).alias(h) if isinstance(c, str) else c.alias(h) for h, c in zip(header, columns)], F.struct(*order).alias("__order"))
        return cls(title, header, told, (F.col("__order"),), always)


def _percent_of_most(rows: DataFrame, score: str, least: float = 0.0) -> DataFrame:
    """Adds pct, the score in hundredths of the largest."""
    top = rows.agg(F.greatest(F.max(score), F.lit(least)).alias("__top"))  # one row
    return rows.crossJoin(F.broadcast(top)).withColumn("pct", F.round(F.col(score) / F.col("__top") * 100).cast("long")).drop("__top")


def _named(column: str, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)]


def sections(nodes: DataFrame, days: DataFrame, g: project.Graph, range_: str, anchor: str | None = None, offset_hours: int = 0, n: int = 10_000, iterative: bool = True) -> list[Section]:
    """The document's sections, at most ``n`` rows each, as the reports are.

    ``iterative`` also tells authorities and bridge sites, which are computed in rounds.
    """
    of, down = Section.of, lambda c: (-F.col(c)).alias(c)
    stats = project.range_stats(nodes, range_, anchor)
    told = F.array(*[F.struct(F.lit(m).alias("m"), v.cast("string").alias("v")) for m, v in (("Range", F.lit(RANGES[range_])), ("Sites", F.col("hosts")), ("Visits", F.col("visits")), ("Newly discovered", F.col("new_hosts")), ("Revisit rate", F.concat(F.round(F.col("revisit_rate") * 100).cast("int").cast("string"), F.lit("%"))))])
    dwell = g.nodes.select("key", "dwell_ms", "fg_dwell_ms")
    prov = project.origination(nodes)
    place = F.array_position(F.array(*map(F.lit, PROVENANCES)), F.col("provenance"))
    rhythm = project.rhythm(days, offset_hours).where("visits > 0")
    hour = F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00"))
    out = [
        of("Range summary", ("Metric", "Value"), stats.select(F.posexplode(told).alias("at", "s")), [F.col("s.m"), F.col("s.v")], ["at"]),
        of("Top hubs", ("Host", "Degree", "Dwell est (ms)", "Foreground (ms)"), graph.hubs(g, n).join(dwell, "key", "left"), ["key", "weight", F.coalesce("dwell_ms", F.lit(0)), F.coalesce("fg_dwell_ms", F.lit(0))], [down("weight"), "key"]),
        of("Launch pads", ("Host", "Outbound"), graph.launch_pads(g, n), ["key", "weight"], [down("weight"), "key"]),
        of("Destinations", ("Host", "Inbound"), graph.destinations(g, n), ["key", "weight"], [down("weight"), "key"]),
    ]
    if iterative:
        ranks = graph.pagerank(g).where("rank > 0").orderBy(F.desc("rank"), "key").limit(RANKED)
        out.append(of("Authorities (PageRank)", ("Host", "Score"), _percent_of_most(ranks, "rank"), ["key", "pct"], [down("rank"), "key"], False))
        out.append(of("Bridge sites", ("Host", "Score"), _percent_of_most(graph.bridges(g, n), "score", 1.0), ["key", "pct"], [down("score"), "key"], False))
    surging = project.surging(nodes, range_, anchor, 3, n)
    return [
        *out,
        of("Surging this period", ("Host", "Now", "Before"), surging, ["host", "now", "prev"], [(-F.col("now") / F.greatest("prev", F.lit(1))).alias("r"), down("now"), "host"], False),
        of("Where you usually go next", ("From", "To", "Share %"), graph.next_hops(g, 4, n), ["src", "dst", F.round(F.col("share") * 100).cast("long")], [down("share"), down("weight"), "src", "dst"], False),
        of("Back-and-forth", ("A", "B", "A→B", "B→A"), graph.reciprocal_pairs(g, n), ["a", "b", "ab", "ba"], [(-F.least("ab", "ba")).alias("m"), "a", "b"], False),
        of("Where your searches went", ("Destination", "From searches"), graph.search_destinations(g, n), ["key", "weight"], [down("weight"), "key"], False),
        of("Top edges", ("From", "To", "Weight", "Kind"), project.top_edges(g, n).withColumn("kind", dominant("kind_", EDGE_KINDS)), ["src", "dst", "weight", _named("kind", KIND_NAMES)], [down("weight"), "src", "dst"]),
        of("Origination", ("Provenance", "Count"), prov, [_named("provenance", ORIGINS), "n"], [place.alias("at")]),
        of("Rhythm (local time)", ("Weekday", "Hour", "Visits"), rhythm, [F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday").cast("int") + 1), hour, "visits"], ["weekday", "hour"], False),
    ]


def lines(tables: list[Section]) -> DataFrame:
    """section, row, line: a blank line before each section but the first, its title (-1), its header (0), its rows."""
    spark, parts = tables[0].rows.sparkSession, []
    for k, t in enumerate(tables):
        row = F.row_number().over(Window.orderBy(*t.order))  # a report's rows, at most its limit
        fields = [csv_field(F.coalesce(F.col(f"`{h}`").cast("string"), F.lit(""))) for h in t.header]
        body = t.rows.select(F.lit(k).alias("section"), row.alias("row"), F.concat_ws(",", *fields).alias("line"))
        head = [(k, -2, "")] * (k > 0) + [(k, -1, t.title), (k, 0, ",".join(t.header))]
        heads = spark.createDataFrame(head, "section int, row int, line string")
        parts += [heads if t.always else heads.join(body.limit(1).select("section"), "section", "left_semi"), body]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def write_document(tables: list[Section], folder: str) -> None:
    """The document as one file of text in ``folder``: a report of bounded size, in order of section and row."""
    lines(tables).orderBy("section", "row").coalesce(1).select("line").write.mode("overwrite").text(folder)


def write(tables: list[Section], folder: str) -> None:
    """A folder of CSV parts for each section."""
    for t in tables:
        rows = t.rows.orderBy(*t.order).select(*[F.col(f"`{h}`") for h in t.header])
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{t.title.lower().replace(' ', '_')}")
