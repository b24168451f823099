"""URL functions: host, registrable domain, page key, search terms."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHORITY = r"(?i)^\s*https?://(?:[^/?#@\\]*@)?(\[[0-9a-f:.]+\]|[^/:?#\\\s<>^|%]+)(?::\d*)?(?:[/?#\\]|\s*$)"
#: The same for a host with percent-encoded bytes.
CODED = r"(?i)^\s*https?://(?:[^/?#@\\]*@)?([^/:?#\\\s<>^|]*%[0-9a-f]{2}[^/:?#\\\s<>^|]*)(?::\d*)?(?:[/?#\\]|\s*$)"
#: Search engines: name, host pattern, path pattern, parameter. Fixed values.
ENGINES = (
    ("Google", r"google\..+", "/search", "q"), ("Bing", r"bing\.com", "/search", "q"), ("DuckDuckGo", r"duckduckgo\.com", None, "q"),
    ("Brave", r"search\.brave\.com", "/search", "q"), ("Ecosia", r"ecosia\.org", "/search", "q"), ("Startpage", r"startpage\.com", None, "query"),
    ("YouTube", r"(?:m\.)?youtube\.com", "/results", "search_query"),
)


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) URL without port, brackets kept on IPv6; null for anything else.

    A host with percent signs is decoded first. Hosts outside ASCII are told in IDNA form where the log went
    through ``with_idna``.
    """
    found = F.lower(F.regexp_extract(url, AUTHORITY, 1))
    coded = F.lower(F.try_url_decode(F.regexp_extract(url, CODED, 1)))
    return F.rtrim(F.when(found != "", found).when((coded != "") & ~coded.rlike(r"[\s<>^|%/?#@]"), coded))


def with_idna(rows: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with the hosts of ``url`` in IDNA form, for a log as it is taken in; a host without one makes the URL null.

    Only rows with a host outside ASCII go through Python.
    """
    told = host(F.col(url))
    odd = F.coalesce(F.octet_length(told) != F.char_length(told), F.lit(False))
    at = rows.columns.index(url)

    def run(batches):
        for batch in batches:
            urls = []
            for u in batch.column(at).to_pylist():
                m = re.search(AUTHORITY, u) or re.search(CODED, u)
                name = idna(unquote(m.group(1)).lower())
                urls.append(u[: m.start(1)] + name + u[m.end(1) :] if name else None)
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.where(~odd).unionByName(rows.where(odd).mapInArrow(run, rows.schema))


def idna(name: str | None) -> str | None:
    """IDNA form of a host; null where it has none."""
    try:
        return name if name is None or name.isascii() else name.encode("idna").decode("ascii")
    except UnicodeError:
        return None


def path_query(url: Column, limit: int = 48) -> Column:
    """Path and a non-empty query, cut to ``limit`` characters with an ellipsis; an empty path is '/'."""
    path = F.regexp_extract(url, r"(?i)^\s*https?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.when(F.char_length(query) > limit, F.concat(F.substring(query, 1, limit), F.lit("…"))).otherwise(query)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def with_search(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds engine and terms (decoded, trimmed) of search result URLs; both null for other URLs and empty terms."""
    engines = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"^(?:{hosts})$").alias("hosts"), F.lit(path).alias("path"), F.lit(param).alias("param")) for name, hosts, path, param in ENGINES])
    rows = df.withColumn("__at", F.struct(F.regexp_replace(host(F.col(url)), r"^www\.", "").alias("h"), F.regexp_extract(url, r"(?i)^\s*https?://[^/?#]*([^?#]*)", 1).alias("p")))
    hit = F.filter(engines, lambda e: F.rlike(F.col("__at.h"), e["hosts"]) & (e["path"].isNull() | (F.col("__at.p") == e["path"])))
    rows = rows.withColumn("__e", F.try_element_at(hit, F.lit(1)))
    rows = rows.withColumn("__raw", F.call_function("regexp_extract", F.col(url), F.concat(F.lit(r"^[^?#]*\?(?:[^#]*?&)?"), F.col("__e.param"), F.lit("=([^&#]*)")), F.lit(1)))
    rows = rows.withColumn("terms", F.nullif(F.trim(F.coalesce(F.try_url_decode("__raw"), F.col("__raw"))), F.lit("")))
    return rows.withColumn("engine", F.when(F.col("terms").isNotNull(), F.col("__e.name"))).drop("__at", "__e", "__raw")


#: Where no suffix list is found: country suffixes with second-level registries, by rule. Fixed values.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "mil", "net", "org")
COUNTRIES = ("ar", "au", "bd", "br", "cn", "co", "eg", "hk", "id", "il", "in", "jp", "ke", "kr", "my", "ng", "nz", "ph", "pk", "sg", "th", "tr", "tw", "ua", "uk", "vn", "za")


def suffix_text(spark: SparkSession) -> str | None:
    """The public suffix list: spark.trailmark.suffixList, else that of Spark's HTTP client, on its class path or in its jars."""
    given = spark.conf.get("spark.trailmark.suffixList", None)
    if given:
        return "\n".join(r.value for r in spark.read.text(given, wholetext=True).collect())  # one file of fixed size
    name = "mozilla/public-suffix-list.txt"
    jvm = getattr(spark, "_jvm", None)
    stream = jvm and jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(name)
    if stream:
        return jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()
    import glob
    import os
    import zipfile

    import pyspark

    for home in (os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)):
        for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient*.jar"))):
            with zipfile.ZipFile(jar) as z:
                if name in z.namelist():
                    return z.read(name).decode()
    return None


_RULES: dict[str, list[tuple[str, str]]] = {}


def suffix_rules(spark: SparkSession) -> list[tuple[str, str]]:
    """(suffix, kind) of the ICANN section of the public suffix list; without a list that of SECOND_LEVELS.

    Rules of other scripts are told in IDNA form too, as hosts are.
    """
    key = spark.conf.get("spark.trailmark.suffixList", None) or ""
    if key not in _RULES:
        text = suffix_text(spark)
        if text is None:
            rules = ["*", *(f"{s}.{c}" for c in COUNTRIES for s in SECOND_LEVELS)]
        else:
            part = text.split("===BEGIN ICANN DOMAINS===")[-1].split("===END ICANN DOMAINS===")[0]
            rules = [x.strip().split()[0] for x in part.split("\n") if x.strip() and not x.startswith("//")]
        _RULES[key] = sorted({(form, kind) for r in rules for kind, name in [("top", "") if r == "*" else ("wild", r[2:]) if r.startswith("*.") else ("except", r[1:]) if r.startswith("!") else ("exact", r)] for form in (name, idna(name) or name)})
    return _RULES[key]


def registrable(hosts: DataFrame, column: str = "host") -> DataFrame:
    """Adds ``registrable`` to ``hosts``: the public suffix and one label more, by the longest matching rule.

    Every suffix of a distinct host is looked up in the rules, a list of fixed size. Hosts without a rule,
    IP addresses and hosts that are themselves suffixes stay as they are; a trailing dot goes.
    """
    spark = hosts.sparkSession
    known = suffix_rules(spark)
    every = ("", "top") in known  # any last label is a suffix
    rules = spark.createDataFrame([x for x in known if x[1] != "top"], "suffix string, rule string")
    names = hosts.select(column).where(F.col(column).isNotNull()).distinct().withColumn("h", F.regexp_replace(column, r"\.$", ""))
    address = F.col("h").rlike(r"^\d+(\.\d+){3}$|^\[")
    parts = names.withColumn("labels", F.split("h", r"\.")).withColumn("n", F.size("labels"))
    each = parts.select(column, "h", "labels", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    each = each.withColumn("suffix", F.array_join(F.slice(F.col("labels"), F.col("n") - F.col("k") + 1, F.col("k")), "."))
    hit = each.join(F.broadcast(rules), "suffix")
    size = F.when(F.col("rule") == "except", F.col("k") - 1 + 1000).when(F.col("rule") == "wild", F.least(F.col("k") + 1, F.col("n"))).otherwise(F.col("k"))
    best = hit.groupBy(column).agg(F.max(size).alias("size")).withColumn("size", F.col("size") % 1000)
    out = parts.join(best, column, "left").withColumn("size", F.coalesce("size", F.when(F.lit(every) & (F.col("n") > 1), 1))).withColumn("keep", F.col("size") + 1)
    domain = F.when(address | F.col("size").isNull() | (F.col("keep") > F.col("n")), F.col("h")).otherwise(F.array_join(F.slice(F.col("labels"), F.greatest(F.col("n") - F.col("keep") + 1, F.lit(1)), F.col("keep")), "."))
    return hosts.join(out.select(column, domain.alias("registrable")), column, "left")


def register(spark: SparkSession) -> None:
    """SQL functions url_host, page_key and search_terms for users' own queries."""
    from . import sql

    sql.register(spark)
