"""PII: surrogate generation.

Detected entities get replacements that a keyed hash draws from their own kind and format: digits for
digits, letters for letters of the same script and case, valid octets, card numbers that keep their
checksum's validity, names that keep their title's gender and their script. An entity has one surrogate
wherever it occurs, however it is written (coreference). All distinct entities' surrogates are checked
together: two entities with one surrogate, or a surrogate that is itself an entity of the corpus, make
the later one draw again, until there is none (distinctness).
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, table

#: Titles and the gender of who bears them (f, m, or n where it is open): fixed values.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f",
    "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = re.compile(
    r"(?P<email>[^\W_][\w.%+-]*@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[abp])[-_][0-9A-Za-z_-]{16,})(?![0-9A-Za-z]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    rf"|(?P<ip>(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    # A name is taken with what hyphens and apostrophes join to it.
    rf"|(?P<person>\b(?:{'|'.join(TITLES)})\.? [^\W\d_]+(?:['’-][^\W\d_]+)*(?: [^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:['’-][^\W\d_]+)*)?(?![^\W\d_]))"
)
#: What every entity but a person has: a superset of PATTERN, so that no text with one is skipped.
WORTH = re.compile(r"[\d@]|AKIA|(?:sk|pk|ghp|gho|xox[abp])[-_]|[a-f]{32}|[A-F]{32}")
TITLE_HINTS = tuple(f"{t}{dot} " for t in TITLES for dot in ("", "."))
#: Onset and rhyme syllables and gendered endings by script, for surrogate names: fixed values.
SYLLABLES = {
    "latin": ("ba be bo da de di fa fe ga go ha he ka ke ko la le li lo ma me mi na ne no pa pe ra re ri ro sa se ta te ti va ve vi zo".split(), {"f": ("na", "la", "ria", "lia"), "m": ("n", "s", "rd", "ck"), "n": ("l", "r", "x", "th")}),
    "cyrillic": ("ба бе бо да де ди га го ка ке ла ле ли ма ме ми на не но па пе ра ре ро са се та те ва ве ви".split(), {"f": ("на", "ла", "ова"), "m": ("н", "в", "ков"), "n": ("л", "р", "й")}),
    "greek": ("βα βε γα γο δα δε κα κο λα λε μα με να νο πα πε ρα ρε σα σε τα τε".split(), {"f": ("να", "λα", "ρία"), "m": ("νος", "λης", "ρας"), "n": ("ξ", "ψ", "ρ")}),
}


class Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, what: str):
        self.key, self.what, self.n, self.bytes = key, what.encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, self.what + b"|%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return x % n

    def like(self, c: str) -> str:
        """A character of the same class: digit, or letter of the same script and case."""
        if c.isdigit():
            return str(self.below(10))
        if not c.isalpha():
            return c
        low = c.lower()
        first, n = (("а", 32) if "а" <= low <= "я" else ("α", 25) if "α" <= low <= "ω" else ("a", 26))
        got = chr(ord(first) + self.below(n))
        got = "σ" if got == "ς" else got
        return got.upper() if c.isupper() else got


KEY_PREFIX = re.compile(r"AKIA|(?:sk|pk|ghp|gho|xox[abp])[-_]")


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "greek" if re.search("[Ͱ-Ͽ]", name) else "latin"


def luhn(digits: str) -> int:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def canonical(kind: str, found: str) -> str:
    """What all spellings of one entity share."""
    if kind in ("phone", "card", "ssn"):
        head = "+" if found.startswith("+") else ""
        return head + "".join(c for c in found if c.isdigit())
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "person":
        title, _, name = found.partition(" ")
        return f"{TITLES[title.rstrip('.')]} {name}"
    if kind == "secret":  # digits of a hash are one number in either case, keys are not
        return found if KEY_PREFIX.match(found) else found.lower()
    return found.lower() if kind == "email" else found


#: Country calling codes of two digits; those of 1 and 7 have one, all others three. Fixed values of E.164.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_digits(number: str) -> int:
    """Digits of the country code of a number that begins with a plus sign."""
    return 1 if number[1:2] in ("1", "7") else 2 if number[1:3] in TWO_DIGITS else 3


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The canonical surrogate of a canonical entity."""
    d = Draw(key, f"{kind}|{entity}|{attempt}")
    if kind == "email":
        local, _, domain = entity.partition("@")
        head, _, tail = domain.rpartition(".example.") if ".example." in domain else domain.rpartition(".")
        tail = f".example.{tail}" if ".example." in domain else f".{tail}"
        more = "".join(d.like("a") for _ in range(attempt // 8))  # where those of its length are taken, it gets longer
        return "".join(map(d.like, local)) + more + "@" + "".join(map(d.like, head)) + tail
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "card":
        body = entity[0] + "".join(str(d.below(10)) for _ in entity[1:-1])
        valid = next(c for c in "0123456789" if luhn(body + c) == 0)
        return body + (valid if luhn(entity) == 0 else str((int(valid) + 1 + d.below(9)) % 10))
    if kind == "phone":
        fixed = 1 + country_digits(entity) if entity.startswith("+") else 0
        return entity[:fixed] + "".join(map(d.like, entity[fixed:]))
    if kind == "secret":
        prefix = KEY_PREFIX.match(entity)
        n = prefix.end() if prefix else 0
        hexa = not n
        return entity[:n] + "".join("0123456789abcdef"[d.below(16)] if hexa else d.like(c) for c in entity[n:])
    if kind == "iban":
        return entity[:2] + "".join(map(d.like, entity[2:]))
    if kind == "person":
        gender, _, name = entity.partition(" ")
        parts, endings = SYLLABLES[script_of(name)]
        words = ["".join(parts[d.below(len(parts))] for _ in range(2 + attempt // 4)) + endings[gender][d.below(len(endings[gender]))] for _ in name.split()]
        return f"{gender} " + " ".join(w.capitalize() for w in words)
    return "".join(map(d.like, entity))


def rendered(kind: str, found: str, new: str) -> str:
    """The canonical surrogate in the format of the spelling found."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new)
        return "".join(next(chars) if c.isalnum() or c == "+" else c for c in found)
    if kind == "person":
        return found.partition(" ")[0] + " " + new.partition(" ")[2]
    return new.upper() if kind in ("email", "secret") and found.isupper() else new  # of keys all letters are upper then


def find(text: str | None):
    """(kind, start, end, spelling) of each entity of a text, from left to right."""
    if text and (WORTH.search(text) or any(h in text for h in TITLE_HINTS)):
        for m in PATTERN.finditer(text):
            yield m.lastgroup, m.start(), m.end(), m.group()


def entities(docs: DataFrame, text: str) -> DataFrame:
    """Distinct (kind, entity) of all texts; repeats are folded in each task before they move."""

    def run(batches):
        for batch in batches:
            seen = {(k, canonical(k, s)) for t in batch.column(0).to_pylist() for k, _, _, s in find(t)}
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in seen], pa.string()), "entity": pa.array([e for _, e in seen], pa.string())})

    return docs.select(text).mapInArrow(run, "kind string, entity string").distinct()


def with_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) -> with surrogate."""

    def run(batches):
        for batch in batches:
            new = [surrogate(key, *x) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "entity", "attempt", "surrogate"])

    return found.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, surrogate string")


def exceptions(found: DataFrame, key: bytes, rounds: int = 30) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate was taken; all have distinct surrogates then."""
    found = cut(found)
    now = cut(with_surrogates(found.withColumn("attempt", F.lit(0)), key))
    for _ in range(rounds):
        twice = now.groupBy("kind", "surrogate").agg(F.min("entity").alias("keep"), F.count("*").alias("n")).where("n > 1")
        late = attach(now, twice, ["kind", "surrogate"], "inner").where("entity <> keep").select("kind", "entity")
        own = now.join(found.select(F.col("kind").alias("k"), F.col("entity").alias("e")), (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("e")), "left_semi").select("kind", "entity")
        bad = cut(late.unionByName(own).distinct())
        if bad.isEmpty():
            return now.where("attempt > 0").select("kind", "entity", "attempt")
        again = now.join(bad, ["kind", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = cut(now.join(bad, ["kind", "entity"], "left_anti").unionByName(with_surrogates(again, key)))
    raise RuntimeError("surrogates still collide")


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", key: bytes | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text with surrogates, n_entities, spans.

    ``key`` is the secret of the surrogates, else the session's spark.trailmark.pii.key; the name of this package
    where neither is set, as in tests. spans are (kind, start, end) in the new text. A null text stays null and has no entities; repeated rows
    give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    key = key if key is not None else docs.sparkSession.conf.get("spark.trailmark.pii.key", "trailmark").encode()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    taken = cut(exceptions(entities(base, "text"), key))
    few = taken.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        shared = {(r.kind, r.entity): r.attempt for r in taken.collect()}  # at most broadcast_rows
        rows = base.withColumn("own", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        shared, keyed = {}, cut(base.withColumn("row", F.monotonically_increasing_id()))

        def refer(batches):
            for batch in batches:
                for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seen = sorted({(k, canonical(k, s)) for k, _, _, s in find(t)})
                    yield pa.RecordBatch.from_pydict({"row": pa.array([r] * len(seen), pa.int64()), "kind": pa.array([k for k, _ in seen], pa.string()), "entity": pa.array([e for _, e in seen], pa.string())})

        refs = keyed.select("row", "text").mapInArrow(refer, "row bigint, kind string, entity string")
        own = attach(refs, taken, ["kind", "entity"], "inner").groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("own"))
        rows = attach(keyed, own, ["row"]).drop("row")

    def run(batches):
        for batch in batches:
            texts, counts, spans = [], [], []
            for t, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                attempts = {(x["kind"], x["entity"]): x["attempt"] for x in mine} if mine else shared
                out, at, size, places = [], 0, 0, []
                for kind, a, b, s in find(t):
                    entity = canonical(kind, s)
                    new = rendered(kind, s, surrogate(key, kind, entity, attempts.get((kind, entity), 0)))
                    out += [t[at:a], new]
                    size += a - at + len(new)
                    places.append({"kind": kind, "start": size - len(new), "end": size})
                    at = b
                texts.append(t if t is None or not places else "".join([*out, t[at:]]))
                counts.append(len(places))
                spans.append(places)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=["doc_id", "text", "n_entities", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_kind}, text string, n_entities bigint, spans array<struct<kind:string,start:int,end:int>>")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
