"""Taxonomy, time and label functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_MS, PROVENANCES, TRANSITIONS


def provenance(transition: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TRANSITIONS.items() for x in kv])
    return F.coalesce(table[transition], F.lit("other"))


def is_ignored(prov: Column) -> Column:
    return prov.isin("reload", "other")


def is_edge(prov: Column) -> Column:
    return prov.isin("link", "form")


def is_rootless(prov: Column) -> Column:
    return prov.isin("typed_url", "search_origin", "bookmark", "start")


def display(prov: Column) -> Column:
    return F.when(prov == "reload", "other").otherwise(prov)


def utc_day(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts / DAY_MS).cast("int"))


def utc_hour(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(DAY_MS)) / 3_600_000).cast("int")


def dominant(prefix: str, names: tuple[str, ...] = PROVENANCES) -> Column:
    """Name of the largest of the columns prefix + name; ties go to the earlier name."""
    best = F.greatest(*[F.struct(F.col(prefix + n).alias("n"), F.lit(-k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(names)])
    return best["name"]


def histogram(column: str, prefix: str, names: tuple[str, ...]) -> list[Column]:
    """One conditional count for each name."""
    return [F.count_if(F.col(column) == n).alias(prefix + n) for n in names]


def rhythm_level(value: Column, most: Column) -> Column:
    """0 for none, then 1 to 4 by quarters of the most; a boundary belongs to the lower level."""
    share = value / most
    return F.when((value <= 0) | (most <= 0), 0).when(share > 0.75, 4).when(share > 0.5, 3).when(share > 0.25, 2).otherwise(1)


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, F.round((now - before) / before * 100).cast("long"))


def _whole(x: Column, suffix: str) -> Column:
    return F.concat(F.floor(x).cast("string"), F.lit(suffix))


def dwell_label(ms: Column) -> Column:
    """Seconds, minutes, hours and minutes, or days and hours."""
    s = F.floor(ms / 1000)
    return (
        F.when(s < 60, _whole(s, "s")).when(s < 3600, _whole(s / 60, "m"))
        .when(s < 86_400, F.concat(_whole(s / 3600, "h "), _whole(s % 3600 / 60, "m"))).otherwise(F.concat(_whole(s / 86_400, "d "), _whole(s % 86_400 / 3600, "h")))
    )


def dwell_display(signal: Column, estimate_ms: Column, fg_ms: Column) -> Column:
    """Foreground time where there is a focus signal, else the estimate behind a sign; a dash under a second."""
    ms = F.when(signal, fg_ms).otherwise(estimate_ms)
    return F.when(ms < 1000, "—").otherwise(F.concat(F.when(signal, "").otherwise("≈"), dwell_label(ms)))


def human_bytes(n: Column) -> Column:
    """Binary units to one decimal; whole bytes below a kilobyte."""
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for k, unit in ((4, "GB"), (3, "MB"), (2, "KB")):
        out = F.when(n < 1024**k, F.format_string(f"%.1f {unit}", n / 1024.0 ** (k - 1))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def date_label(day: Column) -> Column:
    """'Jul 1, 2026'; text that is no date stays as it is."""
    d = F.try_to_date(day, "yyyy-MM-dd")
    return F.coalesce(F.date_format(d, "MMM d, yyyy"), day)


def window_label(range_: str, lo: Column, hi: Column) -> Column:
    """A day's weekday and date, or a span that names what its ends don't share."""
    if range_ in ("day", "session"):
        return F.date_format(hi, "EEE, MMM d")
    dash, short, long = F.lit(" – "), "MMM d", "MMM d, yyyy"
    same_year, same_month = F.year(lo) == F.year(hi), F.month(lo) == F.month(hi)
    return F.when(~same_year, F.concat(F.date_format(lo, long), dash, F.date_format(hi, long))).when(same_month, F.concat(F.date_format(lo, short), dash, F.date_format(hi, "d"))).otherwise(F.concat(F.date_format(lo, short), dash, F.date_format(hi, short)))


def hour_label(hour: Column) -> Column:
    return F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.when(hour < 12, " AM").otherwise(" PM"))


def day_key(ts: Column, tz: str = "UTC") -> Column:
    """Sortable local day: year, month from zero, day."""
    t = F.from_utc_timestamp(F.timestamp_millis(ts), tz)
    return F.year(t) * 10_000 + (F.month(t) - 1) * 100 + F.dayofmonth(t)


#: When a reminder to back up shows: fixed values.
LARGE_LOG, STALE_MS, SNOOZE_MS = 5_000, 60 * DAY_MS, 30 * DAY_MS


def backup_nudge(events: Column, last_export: Column, snoozed_until: Column, now: Column) -> Column:
    """hidden, snoozed or show: a recent backup outranks a snooze."""
    recent = F.coalesce(now - last_export < STALE_MS, F.lit(False))
    return F.when((events <= LARGE_LOG) | recent, "hidden").when(F.coalesce(now <= snoozed_until, F.lit(False)), "snoozed").otherwise("show")


def node_radius(visits: Column, scale: float = 1.0) -> Column:
    return F.least(F.greatest(F.greatest(F.lit(8.0), 2.6 * F.sqrt(visits)) * scale, F.lit(2.0)), F.lit(64.0))


def edge_width(weight: Column, least: float) -> Column:
    return F.least(F.greatest(least * F.sqrt(weight), F.lit(least)), F.lit(5 * least))


def described() -> Column:
    """A line on an event of the log's columns."""
    n = lambda c: F.col(c).cast("string")
    marks = F.array_join(F.filter(F.array(F.when(F.col("redirect"), "client_redirect"), F.when(F.col("back"), "forward_back")), lambda x: x.isNotNull()), ",")
    nav = F.concat(F.lit("tab "), n("tab"), F.lit(" → "), F.col("url"), F.lit(" ["), F.col("transition"), F.when(marks == "", "").otherwise(F.concat(F.lit(" "), marks)), F.lit("]"))
    kind = F.col("kind")
    return (
        F.when(kind == "nav", nav).when(kind == "link", F.concat(F.lit("tab "), n("src_tab"), F.lit(" → new tab "), n("new_tab"))).when(kind == "close", F.concat(F.lit("tab "), n("tab")))
        .when(kind == "focus", F.concat(F.lit("tab "), n("tab"), F.lit(" active in window "), n("win"))).when((kind == "wfocus") & (F.col("win") < 0), "browser blurred")
        .when(kind == "wfocus", F.concat(F.lit("window "), n("win"), F.lit(" focused"))).when(kind == "start", "browser start")
    )


def csv_field(value: Column) -> Column:
    return F.when(value.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def flag_on(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def percent_encode(value: Column) -> Column:
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
