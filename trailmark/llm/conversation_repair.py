"""Conversation structure repair by a cost-to-go table and a greedy walk over it.

Turns are put in order, faults are told, and the cheapest edits are found that give a conversation the roles
``(s?(ua)+)?``: a turn is kept, given another role or deleted, and empty turns are inserted. The cost to go is
computed backwards over (turn, state of the grammar); the walk forward takes of all edits that are on some cheapest
way the one whose letter is least, D, I, K, R, so that the audit is the ASCII-least of the cheapest ones.

A conversation may be very long. Rows are ordered by range over all tasks, and their positions are dealt into
segments of ``1 << SEGMENT`` positions. A conversation that lies within a segment is settled there. For one that runs
over segments, each piece tells the cheapest cost from each state to each, and which of its ways comes first; these
few numbers are chained over the pieces, backwards for the costs and forwards for the states, and with its state and
the cost to go behind it each piece is walked by itself. Only the SHA-256 of a whole conversation, which has no other
way, is made by one task for each conversation, and that reads the turns as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy

SEGMENT = 14
SPACES = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after s, after u, after a. Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What an inserted turn leads to from each state, and the cost of ending in it.
NEXT, END, FAR = (2, 2, 3, 2), (0, 2 * INSERT, INSERT, 0), 1 << 60
ROLE = {2: "user", 3: "assistant"}
#: Codes of a turn: its role's initial (0 u, 1 a, 2 s, 3 other), and bits for its faults.
IS_TRUNCATED, IS_BLANK, IS_DUPLICATE = 4, 8, 16
KEPT = {(0, 0): 2, (0, 1): 2, (0, 3): 2, (1, 2): 3, (2, 0): 1}


def steps(code: int) -> tuple[int, tuple[int, ...]]:
    """(cost of leaving a turn undeleted, state after keeping it from each state or -1)."""
    if code & (IS_BLANK | IS_DUPLICATE):
        return FAR, (-1,) * 4
    return TRUNCATED * bool(code & IS_TRUNCATED), tuple(KEPT.get((code & 3, s), -1) for s in range(4))


STEPS = [steps(c) for c in range(32)]


def costs_to_go(codes: list[int], goal: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each turn, and behind the last, the cheapest cost from each state; ``goal`` is the cost behind the last."""
    out = [goal]
    for code in reversed(codes):
        w, (stay, kept) = out[-1], STEPS[code]
        own = [DELETE + w[s] for s in range(4)]
        if stay < FAR:
            for s in range(4):
                own[s] = min(own[s], stay + REROLE + w[NEXT[s]], stay + KEEP + w[kept[s]] if kept[s] >= 0 else FAR)
        x2, x3 = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
        out.append((min(own[0], INSERT + x2), min(own[1], INSERT + x2), x2, x3))
    out.reverse()
    return out


def walked(codes: list[int], costs: list[tuple[int, ...]], state: int) -> tuple[list[tuple[int, str, int]], int]:
    """The edits (turn, letter, state after it) of the ASCII-least cheapest way from ``state``, and where it ends."""
    edits = []
    for i, code in enumerate(codes):
        (stay, kept), w = STEPS[code], costs[i + 1]
        while True:
            left = costs[i][state]
            if DELETE + w[state] == left:
                edits.append((i, "D", state))
                break
            if INSERT + costs[i][NEXT[state]] == left:
                state = NEXT[state]
                edits.append((i, "I", state))
                continue
            if kept[state] >= 0 and stay + KEEP + w[kept[state]] == left:
                state = kept[state]
                edits.append((i, "K", state))
            else:
                state = NEXT[state]
                edits.append((i, "R", state))
            break
    return edits, state


def closing(state: int) -> list[int]:
    """The states after each turn that must be inserted at a conversation's end."""
    return {1: [2, 3], 2: [3]}.get(state, [])


def ways(codes: list[int]) -> tuple[list[int], list[int]]:
    """From each state to each (4 x s + e): the least cost, and that way's place among those from s, by its letters."""
    cost, rank, words = [FAR] * 16, [0] * 16, [""] * 16
    for e in range(4):
        table_ = costs_to_go(codes, tuple(0 if s == e else FAR for s in range(4)))
        for s in range(4):
            if table_[0][s] < FAR:
                cost[4 * s + e] = table_[0][s]
                words[4 * s + e] = "".join(x[1] for x in walked(codes, table_, s)[0])
    for s in range(4):
        for place, k in enumerate(sorted(range(4 * s, 4 * s + 4), key=lambda k: words[k])):
            rank[k] = place
    return cost, rank


def chained(pieces: list[tuple[list[int], list[int]]]) -> list[tuple[int, tuple[int, ...]]]:
    """For each piece of one conversation, in order: the state it begins in and the cost to go behind it."""
    goals = [END]
    for cost, _ in reversed(pieces[1:]):
        v = goals[-1]
        goals.append(tuple(min(cost[4 * s + e] + v[e] for e in range(4)) for s in range(4)))
    goals.reverse()
    out, s = [], 0
    for (cost, rank), v in zip(pieces, goals):
        out.append((s, v))
        s = min(range(4), key=lambda e: (cost[4 * s + e] + v[e], rank[4 * s + e]))
    return out


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, gone) with ``pos``: by conversation and turn, nulls first.

    Turns of one number come by role, then by the first 64 characters of their texts, then by their texts' XXH64.
    Equal turns are told apart by their row's number only, so that very many of them are many tasks' work.
    """
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "start", "hash", "row"]
    told = turns.select(
        "*", F.left("text", F.lit(64)).alias("start"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    ordered = told.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(ordered.select("conv_id", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("pos")))


def code_of(role: Column, text: Column) -> Column:
    shown = F.rtrim(text, F.lit(SPACES))
    initial = F.left(role, F.lit(1))
    base = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    fault = F.when(shown == "", IS_BLANK).when(F.right(shown, F.lit(1)).isin(*".!?"), 0).otherwise(IS_TRUNCATED)
    return (base + fault).cast("int")


def segments(ordered: DataFrame) -> DataFrame:
    """Rows (segment, conv_id, pos, code, first): each turn's code, and once more the turns that repeat no earlier one."""
    present = ordered.where("NOT gone")
    code = code_of(F.col("role"), F.col("text"))
    codes = present.select("conv_id", "pos", code.alias("code"), F.lit(False).alias("first"))
    same = present.groupBy("conv_id", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"))
    firsts = same.agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(0).alias("code"), F.lit(True).alias("first"))
    return codes.unionByName(firsts).withColumn("segment", F.shiftright("pos", SEGMENT))


def laid_out(group: pa.Table) -> tuple[pa.Array, np.ndarray, list[int], list[int]]:
    """A segment's turns in order: conversations, positions, codes, and where conversations begin (and the end)."""
    pos, first = group.column("pos").to_numpy(), group.column("first").to_numpy()
    turns = np.flatnonzero(~first)
    turns = turns[np.argsort(pos[turns], kind="stable")]
    at = pos[turns]
    code = group.column("code").to_numpy()[turns].copy()
    again = ~np.isin(at, pos[first]) & (code & IS_BLANK == 0)
    code[again] |= IS_DUPLICATE
    conv = group.column("conv_id").combine_chunks().take(pa.array(turns))
    of = pc.dictionary_encode(conv, null_encoding="encode").indices.to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() if len(of) else []
    return conv, at, code.tolist(), [*begins, len(of)]


def edit_script(ordered: DataFrame) -> DataFrame:
    """The edits of each conversation (conv_id, pos, step, edit, role, code), in the order of pos and step.

    ``role`` is that which a turn is given (I, R); ``code`` has the faults of a D, K or R turn. An insertion has the
    position of the turn it stands before, or of the last turn behind which it stands.
    """
    rows = segments(ordered)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def measure(key: tuple, group: pa.Table) -> pa.Table:
        conv, at, codes, begins = laid_out(group)
        ends = list(dict.fromkeys([(begins[0], begins[1]), (begins[-2], begins[-1])])) if len(at) else []
        found = [ways(codes[a:b]) for a, b in ends]
        return pa.table(
            {
                "conv_id": conv.take(pa.array([a for a, _ in ends], pa.int64())),
                "pos": pa.array([int(at[a]) for a, _ in ends], pa.int64()),
                "cost": pa.array([x[0] for x in found], pa.list_(pa.int64())),
                "rank": pa.array([x[1] for x in found], pa.list_(pa.int32())),
            }
        )

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        told = chained(list(zip(group.column("cost").to_pylist(), group.column("rank").to_pylist())))
        last = [False] * (len(told) - 1) + [True]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.bool_()]
        more = [pa.array(c, k) for c, k in zip(([x[0] for x in told], [list(x[1]) for x in told], last), kinds)]
        return pa.table([group.column("conv_id"), group.column("pos"), *more], names=["conv_id", "pos", "state", "goal", "last"])

    pieces = rows.groupBy("segment").applyInArrow(measure, f"conv_id {kind}, pos bigint, cost array<bigint>, rank array<int>")
    # Pieces at the edges of segments only: two for each segment, however many turns there are.
    known = cut(pieces).groupBy("conv_id").applyInArrow(
        chain, f"conv_id {kind}, pos bigint, state int, goal array<bigint>, last boolean"
    )

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        conv, at, codes, begins = laid_out(left)
        told = {p: x for p, *x in zip(*(right.column(c).to_pylist() for c in ("pos", "state", "goal", "last")))}
        where, out = [], {"pos": [], "step": [], "edit": [], "role": [], "code": []}
        for a, b in zip(begins, begins[1:]):
            state, goal, last = told.get(int(at[a]), (0, END, True))
            edits, state = walked(codes[a:b], costs_to_go(codes[a:b], tuple(goal)), state)
            edits += [(b - a - 1, "I", s) for s in closing(state)] if last else []
            before, step = -1, 0
            for i, letter, s in edits:
                step = step + 1 if i == before else 0
                before = i
                where.append(a + i)
                out["pos"].append(int(at[a + i]))
                out["step"].append(step)
                out["edit"].append(letter)
                out["role"].append(ROLE[s] if letter in "IR" else None)
                out["code"].append(codes[a + i] if letter != "I" else None)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        cols = [conv.take(pa.array(where, pa.int64())), *(pa.array(out[n], t) for n, t in zip(out, kinds))]
        return pa.table(cols, names=["conv_id", *out])

    known = known.withColumn("segment", F.shiftright("pos", SEGMENT))
    schema = f"conv_id {kind}, pos bigint, step int, edit string, role string, code int"
    return rows.groupBy("segment").cogroup(known.groupBy("segment")).applyInArrow(walk, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations' turns (conv_id, pos, step, edit, turn, role, text), in the order of pos and step.

    ``turns`` as ``repair_report`` takes them. A turn with an inserted one behind it keeps its own position.
    """
    ordered = in_order(prepared(turns))
    script = edit_script(ordered).where("edit <> 'D'").withColumnRenamed("role", "given")
    both = script.join(ordered.select("pos", "turn", "role", "text"), "pos")
    own = F.col("edit") != "I"
    return both.select(
        "conv_id", "pos", "step", "edit", F.when(own, F.col("turn")).alias("turn"),
        F.coalesce("given", "role").alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"),
    )


def prepared(turns: DataFrame) -> DataFrame:
    """Only the columns that matter; null roles and texts are one space, ``gone`` is false where it isn't given."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *space, gone.alias("gone"))


class Digest:
    """One conversation's counts, audit and hash, from its turns and edits in order."""

    def __init__(self):
        self.turns: list[int] = []  # least, largest
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before, self.audit, self.hash, self.lines = None, [], hashlib.sha256(), 0

    def turn(self, turn: int | None, role: str) -> None:
        if turn is not None:
            if not self.turns or turn != self.turns[1]:
                self.distinct += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]

    def edit(self, edit: str, given: str | None, code: int | None, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "I":
            self.blank += bool(code & IS_BLANK)
            self.duplicate += bool(code & IS_DUPLICATE)
            late = bool(code & IS_TRUNCATED) and not code & IS_DUPLICATE
            self.truncated += late
            self.cost += TRUNCATED * (late and edit != "D")
        self.cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit]
        if edit != "D":
            line = f"{given or role}:{text if edit != 'I' else ''}"
            self.hash.update(("\n" * (self.lines > 0) + line).encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return (*counts, "".join(self.audit), self.hash.hexdigest())


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text, and gone if there are absent turns).

    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, of the turns that aren't ``gone``;
    a conversation of such ones only has zeros, an empty audit and the hash of nothing. Null roles and texts count as
    one space; turns without a number come first; null ids are one conversation. Turns of one number are ordered as
    ``in_order`` says; repeated rows are duplicates. An empty table gives an empty result, other columns are ignored,
    and texts are read whole. An audit is one string, of a letter or more for each turn.
    """
    ordered = in_order(prepared(turns))
    kind = ordered.schema["conv_id"].dataType.simpleString()
    script = edit_script(ordered)
    # Each position's turn comes first, then its edits.
    texts = ordered.withColumns({"step": F.lit(-1), "edit": F.lit(None).cast("string"), "code": F.lit(None).cast("int")})
    none = {"turn": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string"), "gone": F.lit(False)}
    both = texts.unionByName(script.withColumns(none)).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step")

    def run(batches: Iterator[pa.RecordBatch]):
        conv, digest, out = None, None, []
        role = text = ""

        def packed():
            cols = [pa.array([r[0] for r in out], id_type), *(pa.array([r[i] for r in out], pa.int64()) for i in range(1, 7))]
            cols += [pa.array([r[i] for r in out], pa.string()) for i in (7, 8)]
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            names = ("conv_id", "step", "turn", "role", "text", "gone", "edit", "code")
            for c, step, turn, r, t, gone, edit, code in zip(*(batch.column(n).to_pylist() for n in names)):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, *digest.row()))
                    conv, digest = c, Digest()
                if step < 0:
                    if not gone:
                        digest.turn(turn, r)
                        role, text = r, t
                else:
                    digest.edit(edit, r, code, role, text)
            if len(out) >= 2000:
                yield packed()
                out = []
        if digest is not None:
            out.append((conv, *digest.row()))
            yield packed()

    longs = ", ".join(f"{c} bigint" for c in COUNTS)
    return both.mapInArrow(tidy(run), f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults that the CRC-32 of ``conv_id:turn`` deals out; dropped turns stay as ``gone`` ones."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(k == 3, 1).otherwise(0)))
    told = rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (k == 0).alias("gone"), copies.alias("copy")
    )
    return told.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string: a bit at a time, with the reversed polynomial."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    first = "[CAST(4294967295 AS BIGINT)]"
    chars = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_concat({first}, {chars}), lambda c, b: {byte}), 4294967295)"


def oracle() -> str:
    """DuckDB SQL: turn by turn the cheapest, then ASCII-least (cost, audit, repaired) that ends in each state."""

    def best(s: int) -> str:
        ways_ = ["CASE WHEN q{s}.c < 1000000 THEN {{c: q{s}.c + 4, a: q{s}.a || 'D', r: q{s}.r}} END".format(s=s)]
        for p in range(4):
            for code, initial in ((0, "u"), (1, "a"), (2, "s")):
                if KEPT.get((code, p)) == s:
                    ways_.append(f"CASE WHEN NOT t.gone AND q{p}.c < 1000000 AND t.i = '{initial}' THEN {{c: q{p}.c + t.late, a: q{p}.a || 'K', r: q{p}.r || chr(10) || t.role || ':' || t.text}} END")
            if NEXT[p] == s:
                ways_.append(f"CASE WHEN NOT t.gone AND q{p}.c < 1000000 THEN {{c: q{p}.c + 3 + t.late, a: q{p}.a || 'R', r: q{p}.r || chr(10) || '{ROLE[s]}:' || t.text}} END")
        return f"list_min([{', '.join(ways_)}])"

    def inserted(s: int) -> str:
        """With up to three insertions from any state; more never pay."""
        ways_ = [f"o{s}"]
        for p in range(4):
            path, x = [], p
            for _ in range(3):
                x = NEXT[x]
                path.append(ROLE[x])
                if x == s:
                    lines = " || ".join(f"chr(10) || '{r}:'" for r in path)
                    ways_.append(f"CASE WHEN o{p} IS NOT NULL THEN {{c: o{p}.c + {3 * len(path)}, a: o{p}.a || '{'I' * len(path)}', r: o{p}.r || {lines}}} END")
        return f"list_min([{', '.join(ways_)}])"

    far = "{c: 1000000, a: '', r: ''}"
    o = ", ".join(f"coalesce({best(s)}, {far}) AS o{s}" for s in range(4))
    q = ", ".join(f"{inserted(s)} AS q{s}" for s in range(4))
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, LATERAL (SELECT unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy) WHERE k <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM o),
t AS MATERIALIZED (SELECT conv_id, turn, n, role, text, role[1:1] AS i, shown = '' AS blank, shown <> '' AND again > 1 AS dup,
  shown <> '' AND again = 1 AND right(shown, 1) NOT IN ('.', '!', '?') AS cut,
  shown = '' OR again > 1 AS gone, CASE WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS late,
  coalesce(lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1:1] NOT IN ('su', 'ua', 'au'), false) AS bad FROM n),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {{c: 0, a: '', r: ''}} AS q0, {far} AS q1, {{c: 3, a: 'I', r: chr(10) || 'user:'}} AS q2,
  {{c: 6, a: 'II', r: chr(10) || 'user:' || chr(10) || 'assistant:'}} AS q3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, n, {q} FROM (SELECT w.conv_id, t.n, {o} FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1)),
e AS (SELECT conv_id, n, list_min([q0, q3]) AS b FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate,
  sum(cut::INT) AS truncated, sum(bad::INT) AS illegal FROM t GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(CASE WHEN s.conv_id IS NULL AND gaps IS NULL THEN 0 ELSE b.c END AS BIGINT) AS cost,
  CASE WHEN gaps IS NULL THEN '' ELSE b.a END AS audit, sha256(CASE WHEN gaps IS NULL THEN '' ELSE substr(b.r, 2) END) AS repaired_sha256
FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE = oracle()
