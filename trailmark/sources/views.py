"""Saved views and preferences: small documents that never break a session."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from ..operators.project import Filters
from ..schema import RANGE_DAYS


@dataclass(frozen=True)
class View:
    name: str
    range: str = "week"
    by_domain: bool = False
    filters: Filters = field(default_factory=Filters)
    spa: bool = False


@dataclass(frozen=True)
class Preferences:
    view: str = "graph"
    range: str = "week"
    by_domain: bool = False
    min_visits: int = 0
    hide_search_hubs: bool = False
    hide_isolated: bool = False
    spa: bool = False
    locked: bool = False
    site_icons: bool = True
    three_d: bool = False


def _same(a: str, b: str) -> bool:
    return a.strip().lower() == b.strip().lower()


def upsert(views: list[View], view: View) -> list[View]:
    """With the view in place of one of its name (trimmed, any case), in order of name."""
    new = View(view.name.strip(), view.range, view.by_domain, view.filters, view.spa)
    return sorted([*(v for v in views if not _same(v.name, new.name)), new], key=lambda v: v.name.lower())


def remove(views: list[View], name: str) -> list[View]:
    return [v for v in views if not _same(v.name, name)]


def find(views: list[View], name: str) -> View | None:
    return next((v for v in views if _same(v.name, name)), None)


def dump(value: list[View] | Preferences) -> str:
    return json.dumps([asdict(v) for v in value] if isinstance(value, list) else asdict(value))


def load_views(text: str | None) -> list[View]:
    """Anything malformed is an empty list."""
    try:
        rows = [View(**{**r, "filters": Filters(**{**r["filters"], "provenance": tuple(p) if (p := r["filters"].get("provenance")) is not None else None})}) for r in json.loads(text or "")]
        return rows if all(v.range in RANGE_DAYS for v in rows) else []
    except (ValueError, TypeError, KeyError, AttributeError):
        return []


def load_preferences(text: str | None) -> Preferences:
    """Missing fields have their defaults; anything malformed gives all defaults."""
    try:
        doc, kinds = json.loads(text or ""), {f.name: type(getattr(Preferences(), f.name)) for f in fields(Preferences)}
        known = {k: v for k, v in doc.items() if k in kinds}
        return Preferences(**known) if all(type(v) is kinds[k] for k, v in known.items()) and known.get("range", "week") in RANGE_DAYS else Preferences()
    except (ValueError, TypeError, AttributeError):
        return Preferences()
