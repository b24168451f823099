"""DuckDB SQL for the registered queries, written apart from the engine with plain global windows."""

from __future__ import annotations

from ..functions.urls import AUTHORITY
from ..schema import PROVENANCES

HOST = "nullif(lower(regexp_extract({}, '" + AUTHORITY + "', 1)), '')"
PROVS = ", ".join(f"count(*) FILTER (prov = '{p}') AS prov_{p}" for p in PROVENANCES)

#: The driver's tables as a log, then visits (v), foreground (fg) and sessions (s), then rollups (rn, re, rh).
PARTS = {
    "log": """log AS (
  SELECT e.event_id + 1 AS id, epoch_us(e.ts) // 1000 AS ts,
    CASE WHEN event_id % 997 = 996 THEN 'start' WHEN event_id % 53 = 52 THEN 'link' WHEN event_id % 47 = 46 THEN 'close'
         WHEN event_id % 5 = 4 AND event_type = 'error' THEN 'wfocus' WHEN event_id % 5 = 3 THEN 'focus' ELSE 'nav' END AS kind,
    user_id % 8 AS tab, CASE WHEN event_id % 5 = 4 AND event_type = 'error' AND event_id % 3 = 0 THEN -1 ELSE user_id % 2 + 1 END AS win,
    (user_id + 1) % 8 AS new_tab, user_id % 8 AS src_tab,
    CASE event_type WHEN 'click' THEN 'link' WHEN 'purchase' THEN 'form' WHEN 'signup' THEN 'search_origin'
      WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'bookmark' WHEN 1 THEN 'typed_url' ELSE 'link' END ELSE 'reload' END AS prov,
    event_id % 7 = 0 AS redirect, event_id % 11 = 0 AS back, p.url
  FROM events e, pages p WHERE p.page_id = (CAST(json_extract(e.props, '$.k') AS BIGINT) * 31 + e.user_id) % (SELECT count(*) FROM pages)),
q AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (ORDER BY id) AS epoch, lead(ts) OVER (ORDER BY id) AS nts, lead(id) OVER (ORDER BY id) AS nid FROM log)""",
    "v": f"""t0 AS (
  SELECT epoch, id, ts, url, prov, redirect, back, tab AS t, kind AS step, 1 AS place FROM q WHERE kind = 'close' OR kind = 'nav' AND prov NOT IN ('reload', 'other')
  UNION ALL SELECT epoch, id, ts, url, prov, redirect, back, new_tab, 'link', 1 FROM q WHERE kind = 'link'
  UNION ALL SELECT epoch, id, ts, url, prov, redirect, back, src_tab, 'source', 0 FROM q WHERE kind = 'link'),
t1 AS (SELECT *, sum(CASE WHEN step IN ('close', 'link') THEN 1 ELSE 0 END) OVER w AS inc,
    last_value(CASE WHEN step IN ('close', 'link') THEN id END IGNORE NULLS) OVER w AS oid, last_value(CASE WHEN step IN ('close', 'link') THEN step END IGNORE NULLS) OVER w AS ostep
  FROM t0 WINDOW w AS (PARTITION BY epoch, t ORDER BY id, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ends AS (SELECT epoch, t, inc - 1 AS inc, step AS cstep, ts AS cts, id AS cid FROM t1 WHERE step IN ('close', 'link')),
pend AS (SELECT s.id AS lid, arg_max(n.url, n.id) AS purl, arg_max(n.prov, n.id) AS pprov FROM t1 s JOIN t1 n ON n.epoch = s.epoch AND n.t = s.t AND n.inc = s.inc AND n.step = 'nav' AND n.id < s.id WHERE s.step = 'source' GROUP BY s.id),
n1 AS (SELECT *, coalesce(redirect AND ts - lag(ts) OVER w < 1000, false) AS near, NOT back AS fresh, lag(url) OVER w AS lurl, lag(prov) OVER w AS lprov, lead(ts) OVER w AS xts, lead(id) OVER w AS xid,
    sum(CASE WHEN back THEN 0 ELSE 1 END) OVER w AS g FROM t1 WHERE step = 'nav' WINDOW w AS (PARTITION BY epoch, t, inc ORDER BY id)),
n2 AS (SELECT *, g > 0 AND bool_and(fresh OR near) OVER (PARTITION BY epoch, t, inc, g ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS buffered FROM n1),
n3 AS (SELECT *, near AND coalesce(lag(buffered) OVER (PARTITION BY epoch, t, inc ORDER BY id), false) AS gone FROM n2),
n4 AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY epoch, t, inc ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM n3),
b AS (SELECT epoch, t, inc, burst, arg_min(buffered, id) AS hb, arg_min(lurl, id) FILTER (NOT gone) AS lurl, arg_min(lprov, id) FILTER (NOT gone) AS lprov, arg_min(fresh, id) AS hf, arg_min(g, id) AS hg,
    max(id) AS id, arg_max(ts, id) AS ts, arg_max(url, id) AS url, arg_max(prov, id) AS prov, CASE WHEN max(id) < max(xid) THEN max(xid) END AS xid, any_value(oid) AS oid, any_value(ostep) AS ostep
  FROM n4 GROUP BY epoch, t, inc, burst),
b2 AS (SELECT b.*, x.ts AS xts, c.cstep, c.cts, c.cid, st.ts AS sts, st.id AS sid, p.purl, p.pprov, {HOST.format("b.url")} AS host,
    {HOST.format("CASE WHEN p.pprov IS NOT NULL THEN p.purl ELSE b.lurl END")} AS src0, CASE WHEN p.pprov IS NOT NULL THEN p.pprov ELSE b.lprov END AS sprov
  FROM b LEFT JOIN q x ON x.id = b.xid LEFT JOIN ends c ON c.epoch = b.epoch AND c.t = b.t AND c.inc = b.inc
  LEFT JOIN q st ON st.kind = 'start' AND st.epoch = b.epoch + 1 LEFT JOIN pend p ON p.lid = b.oid AND b.ostep = 'link' AND b.hf AND b.hg = 1 WHERE b.hb),
v AS (SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS date, CAST((ts // 3600000) % 24 AS INT) AS hour, host, prov, ts, id,
    CAST(CASE WHEN coalesce(xts, cts, sts) IS NULL THEN 0 ELSE greatest(least(coalesce(xts, cts, sts) - ts, 1800000), 0) END AS BIGINT) AS dwell_ms, coalesce(xid, cid, sid, id) AS trigger_id, coalesce(xid, cid, sid) IS NULL AS provisional,
    CASE WHEN prov IN ('link', 'form') AND src0 IS NOT NULL AND src0 <> host THEN src0 END AS src,
    CASE WHEN prov IN ('link', 'form') AND src0 IS NOT NULL AND src0 <> host THEN CASE WHEN sprov = 'search_origin' THEN 'search_link' WHEN prov = 'form' THEN 'form' ELSE 'link' END END AS edge_kind
  FROM b2 WHERE host IS NOT NULL AND NOT (xid IS NULL AND coalesce(cstep = 'link', false)))""",
    "fg": f"""f1 AS (SELECT epoch, id, ts, nid, greatest(least(nts - ts, 1800000), 0) AS ms, last_value(CASE WHEN kind = 'wfocus' THEN win END IGNORE NULLS) OVER (PARTITION BY epoch ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM q),
f2 AS (SELECT s.epoch, s.id, s.ts, s.nid, s.ms, f.tab, f.id AS fid FROM f1 s ASOF JOIN (SELECT epoch, win, id, tab FROM q WHERE kind = 'focus') f ON f.epoch = s.epoch AND f.win = s.w AND s.id >= f.id WHERE s.w >= 0 AND s.ms > 0 AND s.nid IS NOT NULL),
f3 AS (SELECT s.*, n.id AS navid, n.url FROM f2 s ASOF JOIN (SELECT epoch, t, id, url FROM t0 WHERE step = 'nav') n ON n.epoch = s.epoch AND n.t = s.tab AND s.id >= n.id),
f4 AS (SELECT s.*, c.id AS bid FROM f3 s ASOF LEFT JOIN (SELECT epoch, t, id FROM t0 WHERE step IN ('close', 'link')) c ON c.epoch = s.epoch AND c.t = s.tab AND s.id >= c.id),
f5 AS (SELECT s.*, c.id AS closeid FROM f4 s ASOF LEFT JOIN (SELECT epoch, t, id FROM t0 WHERE step = 'close') c ON c.epoch = s.epoch AND c.t = s.tab AND s.id >= c.id),
fg AS (SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS date, {HOST.format("url")} AS host, CAST(ms AS BIGINT) AS fg_ms, nid AS trigger_id FROM f5 WHERE navid > coalesce(bid, -1) AND fid > coalesce(closeid, -1) AND {HOST.format("url")} IS NOT NULL)""",
    "s": f"""s0 AS (SELECT epoch, win, id, ts, {HOST.format("url")} AS host, coalesce(greatest(ts - lag(ts) OVER (PARTITION BY epoch, win ORDER BY id), 0) > 1800000, false) AS gap FROM q WHERE kind = 'nav'),
s1 AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY epoch, win ORDER BY id) AS run FROM s0),
s AS (SELECT min(id) AS id, win, arg_min(ts, id) AS start_ts, arg_max(ts, id) AS end_ts, min(id) AS start_id, max(id) AS end_id, count(*) AS nav_count,
    max(run) = (SELECT max(run) FROM s1 z WHERE z.epoch = s1.epoch AND z.win = s1.win) AND epoch = (SELECT max(epoch) FROM q) AS open FROM s1 GROUP BY epoch, win, run)""",
    "rn": f"""rn AS (SELECT date, host, count(prov) AS visits, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms, CAST(sum(fg_ms) AS BIGINT) AS fg_dwell_ms, {PROVS}
  FROM (SELECT date, host, prov, dwell_ms, 0 AS fg_ms FROM v WHERE NOT provisional UNION ALL SELECT date, host, NULL, 0, fg_ms FROM fg) GROUP BY date, host)""",
    "re": """re AS (SELECT date, src, host AS dst, count(*) AS weight, count(*) FILTER (edge_kind = 'link') AS kind_link, count(*) FILTER (edge_kind = 'search_link') AS kind_search_link, count(*) FILTER (edge_kind = 'form') AS kind_form
  FROM v WHERE edge_kind IS NOT NULL AND NOT provisional GROUP BY date, src, host)""",
    "g": "gn AS (SELECT host AS key, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms, CAST(sum(fg_dwell_ms) AS BIGINT) AS fg_dwell_ms, " + ", ".join(f"CAST(sum(prov_{p}) AS BIGINT) AS prov_{p}" for p in PROVENANCES) + " FROM rn GROUP BY host),\nge AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(kind_link) AS BIGINT) AS kind_link, CAST(sum(kind_search_link) AS BIGINT) AS kind_search_link, CAST(sum(kind_form) AS BIGINT) AS kind_form FROM re GROUP BY src, dst)",
    "ch": f"""ce AS (SELECT s.id AS session, q.id, q.ts, q.kind, q.prov, q.redirect, q.back, q.tab, q.new_tab, q.src_tab, {HOST.format("q.url")} AS k FROM s JOIN q ON q.id BETWEEN s.start_id AND s.end_id),
c0 AS (SELECT session, id, ts, k, prov, redirect, back, tab AS t, kind AS step, 1 AS place FROM ce WHERE kind = 'close' OR kind = 'nav' AND k IS NOT NULL AND prov NOT IN ('reload', 'other')
  UNION ALL SELECT session, id, ts, NULL, prov, redirect, back, new_tab, 'spawn', 1 FROM ce WHERE kind = 'link' UNION ALL SELECT session, id, ts, NULL, prov, redirect, back, src_tab, 'source', 0 FROM ce WHERE kind = 'link'),
c1 AS (SELECT *, count(*) FILTER (step = 'close') OVER w AS life, step = 'nav' AND redirect AND coalesce(ts - last_value(CASE WHEN step = 'nav' THEN ts END IGNORE NULLS) OVER b < 1000, false) AS mv
  FROM c0 WINDOW w AS (PARTITION BY session, t ORDER BY id, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY session, t ORDER BY id, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT *, step = 'nav' AND NOT mv AND NOT back AS land, coalesce(bool_or(step = 'nav' AND NOT mv AND NOT back) OVER (PARTITION BY session, t, life ORDER BY id, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS begun FROM c1),
c3 AS (SELECT *, last_value(CASE WHEN land OR mv AND begun THEN k END IGNORE NULLS) OVER (PARTITION BY session, t, life ORDER BY id, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM c2),
c4 AS (SELECT *, land AND (e IS NULL OR e <> k) AS fresh FROM c3),
c5 AS (SELECT *, count(*) FILTER (fresh) OVER w AS part, count(*) FILTER (fresh AND (e IS NULL OR prov NOT IN ('link', 'form'))) OVER w AS num FROM c4 WINDOW w AS (PARTITION BY session, t ORDER BY id, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c6 AS (SELECT f.session, f.t, f.num, (SELECT arg_max(o.e, o.id) FROM c5 o JOIN c5 n ON n.session = o.session AND n.id = o.id AND n.step = 'spawn' WHERE o.step = 'source' AND o.e IS NOT NULL AND n.session = f.session AND n.t = f.t AND n.part = f.part - 1 AND n.id < f.id) AS o
  FROM c5 f WHERE f.fresh AND f.e IS NULL AND f.prov IN ('link', 'form')),
c7 AS (SELECT session, t, num, part, arg_max(k, id) AS k FROM c5 WHERE land OR mv AND begun GROUP BY ALL),
chains AS (SELECT c.session, c.t, c.num, concat_ws('>', any_value(o.o), string_agg(c.k, '>' ORDER BY c.part)) AS chain FROM c7 c LEFT JOIN c6 o USING (session, t, num) GROUP BY c.session, c.t, c.num HAVING count(*) + count(DISTINCT o.o) >= 2)""",
    "jo": """recent AS (SELECT row_number() OVER () AS who, string_split(chain, '>') AS c FROM chains WHERE session IN (SELECT id FROM s ORDER BY start_ts DESC, id LIMIT 150)),
p1 AS (SELECT DISTINCT who, c, i, [c[i]] AS ks FROM (SELECT who, c, unnest(range(1, len(c) + 1)) AS i FROM recent)), p2 AS (SELECT DISTINCT who, c, j AS i, list_append(ks, c[j]) AS ks FROM (SELECT *, unnest(range(i + 1, len(c) + 1)) AS j FROM p1)),
p3 AS (SELECT DISTINCT who, c, j AS i, list_append(ks, c[j]) AS ks FROM (SELECT *, unnest(range(i + 1, len(c) + 1)) AS j FROM p2)), p4 AS (SELECT DISTINCT who, c, j AS i, list_append(ks, c[j]) AS ks FROM (SELECT *, unnest(range(i + 1, len(c) + 1)) AS j FROM p3)),
p5 AS (SELECT DISTINCT who, c, j AS i, list_append(ks, c[j]) AS ks FROM (SELECT *, unnest(range(i + 1, len(c) + 1)) AS j FROM p4)),
pats AS (SELECT who, ks FROM p2 UNION SELECT who, ks FROM p3 UNION SELECT who, ks FROM p4 UNION SELECT who, ks FROM p5)""",
}
NEEDS = {"ch": ["log", "s"], "jo": ["log", "s", "ch"], "log": [], "v": ["log"], "fg": ["log", "v"], "s": ["log"], "rn": ["log", "v", "fg"], "re": ["log", "v"], "g": ["log", "v", "fg", "rn", "re"]}


def sql(body: str, *parts: str) -> str:
    """``body`` after the named parts and what they need."""
    wanted = {n for p in parts for n in [*NEEDS[p], p]}
    ctes = [text for name, text in PARTS.items() if name in wanted]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
