"""Event logs: the adapter from the driver's tables, scans, import and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import described
from ..functions.urls import with_idna
from ..schema import KINDS, WIRE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The driver's events, or a stream of such rows, as a navigation log; pages give the URLs, hosts in IDNA form."""
    pages = with_idna(table(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), "url"))
    n, e = table(spark, sf_dir, "pages").count(), events if events is not None else table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    i, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    kind = F.when(i % 997 == 996, "start").when(i % 53 == 52, "link").when(i % 47 == 46, "close").when((i % 5 == 4) & (t == "error"), "wfocus").when(i % 5 == 3, "focus").otherwise("nav")
    transition = F.when(t == "click", "link").when(t == "purchase", "form_submit").when(t == "signup", "generated").when(t == "view", F.when(i % 3 == 0, "auto_bookmark").when(i % 3 == 1, "typed").otherwise("link")).otherwise("reload")
    rows = e.select(
        (i + 1).alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), (u % 8).alias("tab"),
        F.when((i % 5 == 4) & (t == "error") & (i % 3 == 0), F.lit(-1)).otherwise(u % 2 + 1).cast("long").alias("win"), ((u + 1) % 8).alias("new_tab"), (u % 8).alias("src_tab"),
        transition.alias("transition"), (i % 7 == 0).alias("redirect"), (i % 11 == 0).alias("back"), ((k * 31 + u) % n).alias("p"),
    )
    return rows.join(pages, "p").drop("p")


def from_wire(events: DataFrame) -> DataFrame:
    """Columns of the wire format to the log's; unknown kinds are dropped, other negative windows count as none.

    Hosts outside ASCII become IDNA.
    """
    q = F.coalesce("qualifiers", F.array().cast("array<string>"))
    window = F.coalesce(F.col("windowId").cast("long"), F.lit(0))
    rows = events.where(F.col("kind").isin(*KINDS)).select(
        F.col("id").cast("long").alias("id"), F.col("ts").cast("long").alias("ts"), "kind", F.col("tabId").cast("long").alias("tab"), F.when(window < 0, -1).otherwise(window).alias("win"),
        F.col("newTabId").cast("long").alias("new_tab"), F.col("sourceTabId").cast("long").alias("src_tab"), F.col("transitionType").alias("transition"),
        F.array_contains(q, "client_redirect").alias("redirect"), F.array_contains(q, "forward_back").alias("back"), F.col("toUrl").alias("url"),
    )
    return with_idna(rows)


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An export document's arrays, each as a table; missing arrays are empty."""
    doc = spark.read.schema("version bigint, events array<string>, spa array<string>, rollup_days array<string>, sessions array<string>, meta array<string>").json(path, multiLine=True)
    logs = {n: doc.select(F.explode(n).alias("j")).select(F.from_json("j", WIRE).alias("e")).select("e.*") for n in ("events", "spa")}
    return {n: from_wire(d) for n, d in logs.items()} | {n: doc.select(F.explode(n).alias("json")) for n in ("rollup_days", "sessions", "meta")}


def export_document(events: DataFrame, spa: DataFrame, **others: DataFrame) -> DataFrame:
    """One row, ``json``: {version: 1, events, spa, ...}. A document is one file by nature; use Parquet for large logs."""

    def gathered(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))

    out = events.sparkSession.range(1).select(F.lit(1).alias("version"))
    for name, df in {"events": events, "spa": spa, **others}.items():
        out = out.crossJoin(gathered(df, name))  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def materialise(sample: DataFrame, now_ms: int) -> DataFrame:
    """A sample log, whose ts count back from now and whose URLs may lack a scheme."""
    url = F.col("toUrl")
    return sample.withColumn("ts", F.lit(float(now_ms)) - F.col("ts")).withColumn("toUrl", F.when(url.isNotNull() & ~url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(F.lit("https://"), url)).otherwise(url))


def after(log: DataFrame, watermark: int) -> DataFrame:
    """Events with a larger id; the bound reaches the scan's row group statistics."""
    return log.where(F.col("id") > watermark)


def id_range(log: DataFrame, first: int, last: int) -> DataFrame:
    return log.where(F.col("id").between(first, last))


def head(log: DataFrame, n: int = 1000) -> DataFrame:
    return log.orderBy("id").limit(n)


def raw_page(log: DataFrame, kinds: tuple[str, ...] = KINDS, after_id: int | None = None, n: int = 1000) -> DataFrame:
    """A page of the raw log as lines: id, ts, kind, line, and total, the number of events of these kinds.

    The first ``n`` events in order of id, or those after a page's last id.
    """
    rows = log.where(F.col("kind").isin(*kinds))
    total = rows.agg(F.count("*").alias("total"))  # one row
    if after_id is not None:
        rows = after(rows, after_id)
    return head(rows, n).select("id", "ts", "kind", described().alias("line")).crossJoin(F.broadcast(total))


def recent_navs(log: DataFrame, lo: int, hi: int, budget: int = 20_000) -> DataFrame:
    """Navs with lo <= ts < hi among the newest ``budget`` events, up to the first older than lo; with ``capped``."""
    newest = log.orderBy(F.desc("id")).limit(budget)
    w = Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)  # at most `budget` rows
    seen = newest.withColumn("older", F.sum((F.col("ts") < lo).cast("int")).over(w))
    whole = seen.agg(((F.count("*") >= budget) & (F.max("older") == 0)).alias("capped"))
    return seen.where((F.col("older") == 0) & (F.col("kind") == "nav") & (F.col("ts") < hi)).drop("older").crossJoin(F.broadcast(whole))


def merged(events: DataFrame, spa: DataFrame) -> DataFrame:
    """Both streams in order of ts without reordering either; ties to events. ``seq`` is the new order.

    A stream's place is its running maximum of ts, which is made in two levels like the epoch.
    """

    def placed(df: DataFrame, source: int) -> DataFrame:
        rows = df.withColumn("block", F.shiftright("id", 17))
        blocks = rows.groupBy("block").agg(F.max("ts").alias("m"))
        blocks = blocks.select("block", F.max("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("m0"))
        run = F.max("ts").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
        return rows.join(blocks, "block").withColumn("place", F.greatest(run, F.coalesce("m0", run))).withColumn("source", F.lit(source)).drop("block", "m0")

    both = placed(events, 0).unionByName(placed(spa, 1), allowMissingColumns=True)
    return both.withColumn("seq", F.struct("place", "source", "id")).drop("place")


def names_domain(hosts: DataFrame, domain: str) -> DataFrame:
    """(host): those of ``hosts`` (host) that are ``domain`` or have it as their registrable domain."""
    from ..functions.urls import registrable

    told = registrable(hosts.where("host IS NOT NULL").distinct())
    return told.where((F.col("host") == domain) | (F.col("registrable") == domain)).select("host")


def forget(log: DataFrame, domain: str) -> DataFrame:
    """The log without navs whose host or registrable domain is ``domain``.

    Distinct hosts are looked up, of which only those that end like the domain can match; an anti join by host takes
    out the navs. Rows without a host match nothing and aren't looked up.
    """
    from ..functions.urls import host

    navs = log.where("kind = 'nav'").withColumn("__host", host(F.col("url")))
    like = navs.select(F.col("__host").alias("host")).where(F.rtrim("host", F.lit(".")).endswith(domain.rstrip(".")))
    gone = names_domain(like, domain).withColumnRenamed("host", "__host")
    return log.where("kind <> 'nav'").unionByName(navs.join(gone, "__host", "left_anti").drop("__host"))


def delete_range(log: DataFrame, first_ts: int, last_ts: int) -> DataFrame:
    return log.where(~F.col("ts").between(first_ts, last_ts))
