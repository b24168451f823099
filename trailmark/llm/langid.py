"""Language ID: script ranges, per-word scores and Viterbi with a switching penalty.

A word is a run of letters (category L) and their marks in one script; a longer one than LONGEST, as in scripts
without spaces, is taken in pieces of that length. A word's script leaves the languages that were seen in that
script; a character n-gram model scores the word, whole, for each of them; Viterbi over a text's words, with a
penalty for each switch, labels spans of mixed-language text. A text's language is the one with most letters on
the best path, the first in the alphabet of equal ones.

The model is fitted on at most ``train_docs`` labelled documents, those with the smallest hash of their
id; its n-grams are counted on the executors and the ``features`` commonest of each length are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 32  # letters of a word; a longer run is several words
#: Scripts by code point range: fixed values of the Unicode standard. A script of -1 is any other.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
_RANGES = sorted((a, b, k) for k, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name])
_STARTS, _ENDS, _KINDS = (np.array(c) for c in zip(*_RANGES))
SIZES = (1, 2, 3, 4)  # lengths of the character n-grams
_CLASSES = ["".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own) for own in SCRIPTS.values()]
_SPLIT = regex.compile("|".join(f"[{c}\\p{{M}}]+" for c in _CLASSES) + f"|[^{''.join(_CLASSES)}]+")
#: Below U+0250 all letters are Latin and none is a mark; U+2010 to U+2027 are punctuation.
_BEYOND = re.compile("[^\\x00-\u024f\u2010-\u2027]")
_LATIN = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+")
UNLIKELY = -60.0  # a word's score for a language that its script rules out


def script(word: str) -> int:
    """Script number of the word's first letter, -1 for one in no range."""
    c = ord(word[0])
    k = int(np.searchsorted(_STARTS, c, "right")) - 1
    return _RANGES[k][2] if k >= 0 and c <= _RANGES[k][1] else -1


def scripts_of(first: np.ndarray) -> np.ndarray:
    """As ``script``, of many first letters."""
    k = np.searchsorted(_STARTS, first, "right") - 1
    return np.where((k >= 0) & (first <= _ENDS[k]), _KINDS[k], -1)


def words_of(text: str | None) -> list[str]:
    """The words of a whole text, in lower case."""
    low = (text or "").lower()
    if not _BEYOND.search(low):
        found = _LATIN.findall(low)
        if max(map(len, found), default=0) <= LONGEST:
            return found
    return [run[k : k + LONGEST] for w in WORD.findall(low) for run in _SPLIT.findall(w) for k in range(0, len(run), LONGEST)]


def slices(batch: pa.RecordBatch, column: int, rows: int = 4096, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and, but for one row alone, ``size`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and (k - at >= rows or held + n > size):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in SIZES for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_keys(line: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n code points from each place."""
    key = np.full(max(0, len(line) - n + 1), n, np.uint64)
    for k in range(n):
        key = (key ^ line[k : k + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Model:
    """Log-probabilities of n-grams by language, and what languages each script has."""

    langs: list[str]
    rows: dict[str, int]
    logs: np.ndarray
    scripts: dict[int, list[int]]
    penalty: float
    most: int = 12  # letters that a word's weight in the path counts at most
    limit: int = 400_000
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": np.empty((0, 0), np.float32)}

    def __post_init__(self):
        keys = np.array([gram_keys(points(g), len(g))[0] for g in self.rows], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.order = np.fromiter(self.rows.values(), np.int64, len(self.rows))[self.order]

    def fresh(self, words: list[str]) -> np.ndarray:
        """A row for each word: mean log-probability of its n-grams times its length; scripts narrow the languages."""
        sizes, out = np.zeros(len(words)), np.zeros((len(words), len(self.langs)))
        long = np.fromiter(map(len, words), np.int64, len(words))
        line = points(" " + "  ".join(words) + " ")  # every word between two spaces of its own
        owner = np.repeat(np.arange(len(words)), long + 2)
        for n in SIZES if len(self.keys) and words else ():
            keys = gram_keys(line, n)
            own = owner[: len(keys)]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[at] == keys) & (own == owner[n - 1 :]))
            rows, own = self.order[at[hit]], own[hit]
            sizes += np.bincount(own, minlength=len(words))
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(own, self.logs[rows, k], len(words))
        out *= (np.minimum(long, self.most) / np.maximum(sizes, 1))[:, None]
        kinds = scripts_of(np.fromiter((ord(w[0]) for w in words), np.int64, len(words)))
        for kind in np.unique(kinds).tolist():
            if kind not in self.scripts:
                out[kinds == kind] = 0
            elif len(self.scripts[kind]) < len(self.langs):
                ruled_out = np.setdiff1d(np.arange(len(self.langs)), self.scripts[kind])
                out[np.ix_(kinds == kind, ruled_out)] = UNLIKELY
        return out.astype(np.float32)

    def forget(self) -> None:
        self.known, self.table = {}, np.empty((0, 0), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word. The first ``limit`` words are remembered, later ones scored anew in each batch."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        base, table = len(self.known), self.table if len(self.known) else np.empty((0, len(self.langs)), np.float32)
        self.known.update(zip(new, range(base, base + len(new))))
        table = np.concatenate([table, *[self.fresh(new[k : k + 20_000]) for k in range(0, len(new), 20_000)]])
        out = table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
        if base + len(new) <= self.limit:
            self.table = table
        else:
            for w in new:
                del self.known[w]
        return out


def constant(scores: np.ndarray, penalty: float) -> int | None:
    """The state that is best throughout, where staying in it is surely the best path, else None.

    It has the largest sum, and no stretch of another state gains more than half a switch over it. A path
    of m other stretches pays for m switches, or for m - 1 where it never visits the state: no gain.
    """
    sums = np.cumsum(scores, axis=0, dtype=float)
    best = int(sums[-1].argmax())
    gain = sums - sums[:, best : best + 1]
    before = np.minimum(np.concatenate([np.zeros((1, gain.shape[1])), np.minimum.accumulate(gain, axis=0)[:-1]]), 0)
    return best if (gain - before).max() <= penalty / 2 else None


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best path of each sequence (an array of steps by states), every switch costing ``penalty``.

    Sequences of like lengths take their steps together.
    """
    paths: list[np.ndarray] = [np.empty(0, np.int8)] * len(scores)
    order = []
    for k, x in enumerate(scores):
        if len(x):
            best = constant(x, penalty)
            if best is None:
                order.append(k)
            else:
                paths[k] = np.full(len(x), best, np.int8)
    order.sort(key=lambda k: len(scores[k]))
    while order:
        least = len(scores[order[0]])
        n = next((i for i, k in enumerate(order) if len(scores[k]) > 2 * least + 16), len(order))
        n = min(n, max(1, 4_000_000 // (len(scores[order[n - 1]]) * scores[order[0]].shape[1])))
        group, order = order[:n], order[n:]
        length, states = max(len(scores[k]) for k in group), scores[group[0]].shape[1]
        s = np.zeros((length, n, states), np.float32)
        for i, k in enumerate(group):
            s[: len(scores[k]), i] = scores[k]
        back = np.empty((length, n, states), np.int8)
        v, stay = s[0].copy(), np.arange(states, dtype=np.int8)[None]
        for t in range(1, length):
            best = v.argmax(axis=1)
            most = v[np.arange(n), best][:, None] - penalty
            back[t] = np.where(most > v, best[:, None].astype(np.int8), stay)
            v = np.maximum(v, most) + s[t]  # steps past a sequence's end add nothing and switch nothing
        at, rows = v.argmax(axis=1), np.arange(n)
        path = np.empty((length, n), np.int8)
        for t in range(length - 1, -1, -1):
            path[t] = at
            if t:
                at = back[t, rows, at]
        for i, k in enumerate(group):
            paths[k] = path[: len(scores[k]), i]
    return paths


def label_all(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]] | None]]:
    """(language, share of letters in it, spans) of each text; spans are (language, first word, end word)."""
    words = [words_of(t) for t in texts]
    every = model.scores([w for ws in words for w in ws])
    stops = np.cumsum([len(ws) for ws in words])
    parts = np.split(every, stops[:-1]) if len(texts) else []
    out = []
    for ws, path in zip(words, viterbi(parts, model.penalty)):
        if not ws:
            out.append(("und", 0.0, []))
            continue
        letters = np.bincount(path, weights=np.fromiter(map(len, ws), float, len(ws)), minlength=len(model.langs))
        best = int(letters.argmax())
        edges = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(ws)]
        out.append((model.langs[best], float(letters[best] / letters.sum()), [(model.langs[path[a]], a, b) for a, b in zip(edges, edges[1:])]))
    return out


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % parts == part, F.lit(False))


def sample_of(labelled: DataFrame, id_col: str, n: int) -> DataFrame:
    """The rows whose id's hash is among the ``n`` smallest; ids alone are read to find the bound."""
    h = F.xxhash64(F.col(id_col))
    last = labelled.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return labelled.where(h <= last) if last is not None else labelled.limit(0)


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = 8000, features: int = 20_000, penalty: float = 12.0) -> Model:
    """Fits the n-gram model on at most ``train_docs`` rows with text and language."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = sample_of(rows, id_col, train_docs).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches):
        totals: dict = {}
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words: dict[str, int] = {}
                for w in words_of(t):
                    words[w] = words.get(w, 0) + 1
                for w, n in words.items():
                    key = (x, "", script(w))
                    totals[key] = totals.get(key, 0) + n
                    for g in grams(w):
                        totals[(x, g, 0)] = totals.get((x, g, 0), 0) + n
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in totals], "gram": [k[1] for k in totals], "script": pa.array([k[2] for k in totals], pa.int32()), "n": pa.array(totals.values(), pa.int64())})

    counted = cut(rows.mapInArrow(tidy(count), "lang string, gram string, script int, n bigint").groupBy("lang", "gram", "script").agg(F.sum("n").alias("n")))
    share: dict[int, dict[str, int]] = {}
    for r in counted.where("gram = ''").collect():  # a row for each language and script
        share.setdefault(r.script, {})[r.lang] = r.n
    langs = sorted({x for by in share.values() for x in by})
    by_gram = counted.where("gram <> ''").groupBy("gram").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    kept = [r for n in SIZES for r in by_gram.where(F.length("gram") == n).orderBy(F.desc("total"), "gram").limit(features).collect()]
    counts = np.array([[r["by"].get(x, 0) for x in langs] for r in kept], float).reshape(len(kept), len(langs)) + 0.5
    logs = np.zeros_like(counts)
    size = np.array([len(r["gram"]) for r in kept], int)
    for n in SIZES:
        if (size == n).any():
            logs[size == n] = np.log(counts[size == n] / counts[size == n].sum(axis=0))
    if logs.size:
        logs -= logs.mean(axis=1, keepdims=True)
    # By a language's own words, so that one with few documents keeps its script beside one with very many.
    own = {x: sum(by.get(x, 0) for by in share.values()) for x in langs}
    scripts = {s: [k for k, x in enumerate(langs) if by.get(x, 0) > 0.001 * own[x]] for s, by in share.items()}
    return Model(langs, {r["gram"]: k for k, r in enumerate(kept)}, logs.astype(np.float32), scripts, penalty)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """(id, lang_pred, score[, spans]) of each row: 'und' with score 0 for a null text or one without letters.

    Only the text is looked at, whole and whatever its length. Repeated rows give repeated results, an empty
    table an empty one; other columns are ignored. Without any labelled document every row is 'und'.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by features

    def run(batches):
        mine = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                got = label_all(mine, part.column(1).to_pylist()) if mine.langs else [("und", 0.0, [])] * part.num_rows
                cols = [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                if spans:
                    cols.append(pa.array([[dict(zip(("lang", "start", "end"), s)) for s in g[2]] for g in got], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * spans
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run, lambda: shared.value.forget()), schema)


def identified(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is 'und' (null texts, texts without a letter); a null language is filled in.

    All columns stay as they are named. A model without languages rejects the same rows and fills nothing in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, lang_at = docs.columns.index(text), docs.columns.index(lang)

    def run(batches):
        mine = shared.value
        for batch in batches:
            for part in slices(batch, at):
                texts, told = part.column(at).to_pylist(), part.column(lang_at)
                if mine.langs:
                    pred = pa.array([g[0] for g in label_all(mine, texts)], pa.string())
                    keep, told = pc.not_equal(pred, "und"), pc.coalesce(told.cast(pa.string()), pred)
                else:
                    keep = pa.array([bool(WORD.search(t or "")) for t in texts], pa.bool_())
                cols = [told if k == lang_at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(keep)

    return docs.mapInArrow(tidy(run, lambda: shared.value.forget()), docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = label(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
