"""SQL forms of the URL and time functions, as temporary functions: they stay inside the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .urls import AUTHORITY, ENGINES, suffix_rules


def _text(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


PATH, QUERY = r"(?i)^\s*https?://[^/?#]*([^?#]*)", r"^[^?#]*\?([^#]*)"


def _domain(spark: SparkSession) -> str:
    """The public suffix and one label more of a host ``h``: the rules, a list of fixed size, are a map by last label."""
    rules = suffix_rules(spark)
    least = "IF(size(labels) > 1, 1, 0)" if ("", "top") in rules else "0"
    by_last: dict[str, list[str]] = {}
    for suffix, kind in rules:
        if kind != "top":
            by_last.setdefault(suffix.rsplit(".", 1)[-1], []).append(f"{kind} {_text(suffix)}")
    # One text that is split once, as a plan of thousands of literals is slow to make.
    known = ";".join(f"{_text(last)}=,{','.join(names)}," for last, names in sorted(by_last.items()))
    name = "array_join(slice(labels, size(labels) - k + 1, k), '.')"
    has = lambda kind: f"contains(told, concat(',{kind} ', {name}, ','))"
    size = f"CASE WHEN {has('except')} THEN k - 1 + 1000 WHEN {has('wild')} THEN least(k + 1, size(labels)) WHEN {has('exact')} THEN k ELSE 0 END"
    best = f"array_max(transform(sequence(1, size(labels)), k -> {size})) % 1000"
    return f"""(SELECT CASE WHEN bare RLIKE '^[0-9]+([.][0-9]+){{3}}$' OR startswith(bare, '[') OR n = 0 OR n + 1 > size(labels) THEN bare
      ELSE array_join(slice(labels, size(labels) - n, n + 1), '.') END
      FROM (SELECT bare, labels, greatest({best}, {least}) AS n
      FROM (SELECT bare, labels, try_element_at(str_to_map('{known}', ';', '='), element_at(labels, -1)) AS told
      FROM (SELECT bare, split(bare, '[.]') AS labels FROM (SELECT regexp_replace(h, '[.]$', '') AS bare)))))"""


def register(spark: SparkSession) -> None:
    """url_host, url_page, url_engine, url_terms, url_domain (of a host), utc_hour, utc_day."""
    make = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    make("url_host(url STRING) RETURNS STRING", f"nullif(lower(regexp_extract(url, '{_text(AUTHORITY)}', 1)), '')")
    make("utc_hour(ts BIGINT) RETURNS INT", "cast(pmod(ts, 86400000) div 3600000 as int)")
    make("utc_day(ts BIGINT) RETURNS DATE", "date_from_unix_date(cast(floor(ts / 86400000) as int))")
    path, query = f"regexp_extract(url, '{_text(PATH)}', 1)", f"regexp_extract(url, '{_text(QUERY)}', 1)"
    cut = f"CASE WHEN {query} = '' THEN '' WHEN char_length({query}) > 48 THEN concat('?', substring({query}, 1, 48), '…') ELSE concat('?', {query}) END"
    make("url_page(url STRING) RETURNS STRING", f"concat(if({path} = '', '/', {path}), {cut})")
    host = f"regexp_replace(nullif(lower(regexp_extract(url, '{_text(AUTHORITY)}', 1)), ''), '^www[.]', '')"
    of = lambda f: "CASE " + " ".join(f"WHEN {host} RLIKE '^(?:{_text(h)})$'" + (f" AND {path} = '{p}'" if p else "") + f" THEN {f(n, q)}" for n, h, p, q in ENGINES) + " END"
    raw = lambda n, q: f"regexp_extract(url, '^[^?#]*[?](?:[^#]*?&)?{q}=([^&#]*)', 1)"
    terms = of(lambda n, q: f"nullif(trim(coalesce(try_url_decode({raw(n, q)}), {raw(n, q)})), '')")
    make("url_terms(url STRING) RETURNS STRING", terms)
    make("url_engine(url STRING) RETURNS STRING", f"CASE WHEN ({terms}) IS NOT NULL THEN {of(lambda n, q: repr(n))} END")
    make("url_domain(h STRING) RETURNS STRING", _domain(spark))
