"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two strings sums, over their common subsequences of three characters, a decay to the power of
the lengths they span, so gaps and inserted characters lower it without losing the match. Landmarks are
character windows of labelled toxic sentences, in any language, that stand in them more often than chance
allows, and common clean words; a stem with many endings is one window. A string's features are its kernels
with the landmarks, whitened by the landmarks' own kernel matrix. The machine is trained on labelled sentences:
the highest one of each toxic document, every one of the clean ones, each standing for its highest token, with
garbled spellings added. A text's margin is its largest token's; a logistic curve, fitted on labelled documents
that did not train, turns it into a score.

The fit uses at most ``per_class`` labelled documents of either class, those with the smallest hash of their id;
further bounds are parameters of ``fit``. Kernels with a landmark of which under 60 % of the letters occur in a
string count as zero. Scoring reads whole texts; a token's margin is worked out once for each worker.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut as cut_lineage
from .common import table, tidy
from .langid import held_out, sample_of

SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
EDGES = ".,;:!?\"'()[]{}|%&$#*-_/\\<>«»¿¡…"
SENTENCE = re.compile(r"(?<=[.!?])\s|\n")
WINDOWS = (4, 10)  # characters of a landmark: from, below
WIDTH, STRIDE = 12, 3  # characters of a piece, steps between pieces: any landmark stands whole in a piece


def tokens(text: str | None) -> list[str]:
    """Lower-case words without outer punctuation; a run of single characters is joined to one token."""
    t = (text or "").lower()
    joined = [m.group().replace(" ", "") for m in SPACED.finditer(t)]
    out = [w.strip(EDGES) for w in t.split()]
    return [w for w in out if w] + joined


def bounded(token: str) -> str:
    """The token between marks of its ends, which are characters to the kernel like any other."""
    return f"<{token}>"


def pieces(token: str) -> list[str]:
    """The token cut to the kernel's width, and so without inner punctuation where it has some."""
    plain = re.sub(r"[\W_]+", "", token)
    return cut(bounded(token)) + (cut(bounded(plain)) if plain and plain != token else [])


def cut(token: str) -> list[str]:
    return [token[k : k + WIDTH] for k in range(0, max(1, len(token) - WIDTH + STRIDE), STRIDE)] if len(token) > WIDTH else [token]


def codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for k, w in enumerate(words):
        out[k, : min(len(w), width)] = [ord(c) for c in w[:width]]
    return out


def kernel(s: np.ndarray, t: np.ndarray, decay: float = 0.75) -> np.ndarray:
    """The subsequence kernel of length three of each pair of rows (character codes, padded with zeros)."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    d2 = np.float32(decay * decay)
    match = [[np.where((s[:, i] == t[:, j]) & (s[:, i] > 0), d2, np.float32(0)) for j in range(b)] for i in range(a)]
    before = None  # of prefixes (i, j): subsequences of the length before, weighted to the prefixes' ends
    for _ in range(2):
        rows = [[np.zeros(n, np.float32) for _ in range(b + 1)]]
        for i in range(a):
            row, run = [np.zeros(n, np.float32)], np.zeros(n, np.float32)
            for j in range(b):
                run = np.float32(decay) * run + (match[i][j] if before is None else match[i][j] * before[i][j])
                row.append(np.float32(decay) * rows[i][j + 1] + run)
            rows.append(row)
        before = rows
    return sum(match[i][j] * before[i][j] for i in range(a) for j in range(b))


def letter_counts(c: np.ndarray) -> np.ndarray:
    out = np.zeros((len(c), 32), np.int8)
    for j in range(c.shape[1]):
        k = np.flatnonzero(c[:, j])
        np.add.at(out, (k, c[k, j] & 31), 1)
    return out


@dataclass
class Machine:
    """Landmarks and weights; ``margin`` of a token is weights . features + bias."""

    landmarks: list[str]
    shared: float = 0.6
    insults: int = 0  # so many landmarks are windows of toxic sentences; the others are clean words
    white: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    limit: int = 500_000
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.codes = codes(self.landmarks, WINDOWS[1])
        self.counts = letter_counts(self.codes)
        self.norms = self._self(self.codes)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    @staticmethod
    def _self(c: np.ndarray) -> np.ndarray:
        return np.maximum(np.sqrt(kernel(c, c)), 1e-6) if len(c) else np.empty(0, np.float32)

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernels with each landmark, zero where fewer than ``shared`` of its letters occur."""
        c = codes(words, WIDTH)
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        size = self.counts.sum(axis=1)
        have = letter_counts(c)
        near = np.stack([np.minimum(have, x).sum(axis=1) >= max(3, self.shared * n) for x, n in zip(self.counts, size)], 1) if len(words) else np.zeros((0, 0), bool)
        rows, cols = np.nonzero(near)
        used = np.unique(rows)
        norms = np.ones(len(words), np.float32)
        used = used[np.argsort((c[used] > 0).sum(axis=1), kind="stable")]
        for k in range(0, len(used), 8192):
            own = c[used[k : k + 8192]]
            norms[used[k : k + 8192]] = self._self(own[:, : (own > 0).sum(axis=1).max()])
        long = (c > 0).sum(axis=1)  # pairs of like lengths go together, without their padding
        order = np.lexsort((long[rows], size[cols]))
        rows, cols = rows[order], cols[order]
        for k in range(0, len(rows), 8192):
            i, j = rows[k : k + 8192], cols[k : k + 8192]
            out[i, j] = kernel(c[i][:, : long[i].max()], self.codes[j][:, : size[j].max()]) / (norms[i] * self.norms[j])
        return out

    def features(self, words: list[str]) -> np.ndarray:
        return self.kernels(words) @ self.white

    def heights(self, parts: list[str]) -> np.ndarray:
        """Margin of each piece; before training, its largest kernel with an insult's landmark."""
        if not len(self.weights):
            return self.kernels(parts)[:, : self.insults].max(axis=1, initial=0.0)
        return self.features(parts) @ self.weights + self.bias

    def best_pieces(self, words: list[str]) -> list[str]:
        """The highest piece of each token."""
        parts = [(k, p) for k, w in enumerate(words) for p in pieces(w)]
        best: dict[int, tuple[float, str]] = {}
        for (k, p), h in zip(parts, self.heights([p for _, p in parts]).tolist()):
            best[k] = max(best.get(k, (-math.inf, "")), (h, p))
        return [best[k][1] for k in range(len(words))]

    def margins(self, words: list[str]) -> list[float]:
        """Margin of each token: that of its highest piece. At most ``limit`` tokens and a batch's are remembered."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for k in range(0, len(new), 20_000):
            cut = [(w, p) for w in new[k : k + 20_000] for p in pieces(w)]
            for (w, _), m in zip(cut, self.heights([p for _, p in cut]).tolist()):
                self.known[w] = max(m, self.known.get(w, -np.inf))
        return list(map(self.known.__getitem__, words))

    def text_margins(self, texts: list[str | None]) -> np.ndarray:
        words = [tokens(t) for t in texts]
        every = self.margins([w for ws in words for w in ws])
        out, at = np.full(len(texts), self.bias), 0
        for k, ws in enumerate(words):
            out[k] = max([self.bias, *every[at : at + len(ws)]])
            at += len(ws)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.text_margins(texts) + self.offset, -30, 30)))


def garbled(word: str, rng: random.Random) -> list[str]:
    """Spellings with inserted and repeated characters."""
    k = rng.randrange(1, len(word)) if len(word) > 1 else 0
    marks = rng.choice(".-*_ ").strip()
    doubled = word[:k] + word[k : k + 1] * rng.randrange(1, 3) + word[k:]
    return [marks.join(word), word[:k] + rng.choice(".-*_x") + word[k:], doubled, word[:k] + rng.choice("*x") + word[k + 1 :]]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 3000.0) -> tuple[np.ndarray, float]:
    """Linear machine with a squared hinge, by Newton's steps over the support vectors."""
    xb, weight = np.hstack([x, np.ones((len(x), 1))]), weight / weight.sum()
    rest = np.append(np.ones(x.shape[1]), 1e-6)
    w, before = np.zeros(xb.shape[1]), None
    for _ in range(60):
        inside = y * (xb @ w) < 1
        if before is not None and (inside == before).all():
            break
        v, before = xb[inside] * weight[inside, None], inside
        w = np.linalg.solve(np.diag(rest) + 2 * c * v.T @ xb[inside], 2 * c * v.T @ y[inside])
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's steps."""
    p = np.zeros(2)
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        p = p - np.linalg.solve(h, x.T @ (q - label) + 1e-3 * p)
    return float(p[0]), float(p[1])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> distinct (w, place, y): each token of each sentence with a hash of its two neighbours."""
    from xxhash import xxh64_intdigest as h

    for batch in batches:
        out: set[tuple] = set()
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for s in SENTENCE.split(t):
                ws = tokens(s)
                for before, w, after in zip(["", *ws], ws, [*ws[1:], ""]):
                    out.add((w, (h(f"{before} {after}".encode("utf-8", "surrogatepass")) >> 1), y))
        yield pa.RecordBatch.from_pydict({"w": pa.array([o[0] for o in out], pa.string()), "place": pa.array([o[1] for o in out], pa.int64()), "y": pa.array([o[2] for o in out], pa.int32())})


def windows(token: str) -> set[str]:
    """Runs of WINDOWS characters of a token and the marks of its ends."""
    w = bounded(token)
    return {w[i : i + n] for n in range(*WINDOWS) for i in range(len(w) - n + 1)}


def evidence(n1: float, n0: float, rate: float, lift: float = 4.0) -> float:
    """Minus the log-probability, at most, of n1 or more toxic ones among n1 + n0 places, each toxic by ``rate``.

    Zero where the odds are under ``lift`` times those of all places: a language that is oftener toxic isn't an insult.
    """
    n = n1 + n0
    if n1 * (1 - rate) < lift * max(n0, 0.5) * rate:
        return 0.0
    return n1 * math.log(n1 / n / rate) + (n0 * math.log(n0 / n / (1 - rate)) if n0 else 0.0)


def choose(found: list[tuple[str, int, int]], words: list[tuple[str, int]], rate: float, enough: float, most: int) -> list[str]:
    """Windows of significant evidence, strongest first; tokens that one of them explains count no more for others.

    ``found`` has (window, toxic places, clean places), ``words`` (token, toxic places). Of equal windows the
    longest is taken, then the smallest.
    """
    n0 = {w: c for w, _, c in found}
    of: dict[str, list[int]] = {w: [] for w in n0}
    for k, (w, _) in enumerate(words):
        for x in windows(w) & n0.keys():
            of[x].append(k)
    left = {w: sum(words[k][1] for k in of[w]) for w in n0}
    rank = lambda w: (evidence(left[w], n0[w], rate), len(w), w)
    covered: set[int] = set()
    out: list[str] = []
    while left and len(out) < most:
        best = max(left, key=lambda w: (rank(w)[0], rank(w)[1], [-ord(c) for c in w]))
        if rank(best)[0] < enough:
            break
        out.append(best)
        for k in of[best]:
            if k not in covered:
                covered.add(k)
                for x in windows(words[k][0]) & n0.keys():
                    left[x] -= words[k][1]
        del left[best]
    return out


def landmarks_of(rows: DataFrame, most: int, common: int, candidates: int = 50_000) -> tuple[list[str], list[str]]:
    """(windows of toxic sentences, common clean words): the landmarks, from labelled texts (text, y).

    A token's places are its distinct pairs of neighbours, so that copies of a text count once; a place that
    a clean document has too is clean. Windows are tested against chance, with a level of one in a hundred
    for all of them together, not against each other: a rare insult counts like a frequent one.
    """
    seen = rows.mapInArrow(contexts, "w string, place bigint, y int").groupBy("w", "place").agg(F.min("y").alias("y"))
    words = cut_lineage(seen.groupBy("w").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")))
    total = words.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    if not total.n1 or not total.n0:
        return [], []
    rate = total.n1 / (total.n1 + total.n0)

    def explode(batches):
        for batch in batches:
            n: dict[str, int] = {}
            for w, n1 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in windows(w):
                    n[x] = n.get(x, 0) + n1
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(n), pa.string()), "n1": pa.array(list(n.values()), pa.int64())})

    by_window = cut_lineage(words.where("n1 > 0").select("w", "n1").mapInArrow(explode, "x string, n1 bigint").groupBy("x").agg(F.sum("n1").alias("n1")))
    enough = math.log(100 * max(1, by_window.count()))
    least = enough / -math.log(rate)  # fewer places can't be significant
    likely = {r.x for r in by_window.where(F.col("n1") >= least).orderBy(F.desc("n1"), "x").limit(candidates).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(likely)  # at most ``candidates``

    def held(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            got = [(x, n1, n0) for w, n1, n0 in zip(*cols) for x in windows(w) & shared.value]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*got)) or [()] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["x", "n1", "n0"])

    tested = words.mapInArrow(held, "x string, n1 bigint, n0 bigint").groupBy("x").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    found = [(r.x, r.n1, r.n0) for r in tested.collect() if evidence(r.n1, r.n0, rate) >= enough]  # at most ``candidates``
    shared = rows.sparkSession.sparkContext.broadcast({x for x, _, _ in found})

    def having(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(windows(w) & shared.value) for w in batch.column(0).to_pylist()], pa.bool_()))

    insults = [(r.w, r.n1) for r in words.where("n1 > 0").select("w", "n1").mapInArrow(having, "w string, n1 bigint").collect()] if found else []
    plain = [r.w for r in words.where((F.length("w").between(5, WINDOWS[1] - 3)) & (F.col("n1") <= 2 * rate * (F.col("n1") + F.col("n0")))).orderBy(F.desc("n0"), "w").limit(common).collect()]
    return choose(found, sorted(insults), rate, enough, most), [bounded(w) for w in plain]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3000, landmarks: int = 64, common: int = 8, negatives: int = 4000, rounds: int = 5) -> Machine | None:
    """Fits on at most ``per_class`` documents of either class; None where a class is missing or nothing sets it apart.

    Four fifths of them train, the others calibrate. Of every toxic document the sentence with the highest
    margin is an example of its class, of a clean document every sentence is; a sentence stands for its
    highest token. Margins come from the kernels with the landmarks at first, then from the machine, until no
    other clean token is on the wrong side or ``rounds`` are done. In each round the ``negatives`` highest of the
    clean sentences' tokens are added to those learned from, and as many by their hash.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    # Proven bound: 2 x per_class ids.
    ids = sample_of(known.where("y = 1"), id_col, per_class).unionByName(sample_of(known.where("y = 0"), id_col, per_class))
    apart = F.pmod(F.xxhash64(F.lit("apart"), F.col(id_col)), F.lit(5)) == 0
    rows = cut_lineage(docs.select(id_col, F.col(text).alias("text")).where(F.col(text).isNotNull()).join(F.broadcast(ids), id_col).select("text", "y", apart.alias("apart")))
    taught = rows.where("not apart").select("text", "y")
    sizes = {r.y: r.n for r in taught.groupBy("y").agg(F.count("*").alias("n")).collect()}
    insults, plain = landmarks_of(taught, landmarks, common)
    if not insults:
        return None
    m = Machine([*insults, *plain], insults=len(insults))
    own = m.kernels(m.landmarks)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(own)))
    m.white = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    spark, rng = docs.sparkSession, random.Random(42)

    def examples(machine: Machine) -> DataFrame:
        shared = spark.sparkContext.broadcast(machine)

        def run(batches):
            for batch in batches:
                out: dict[tuple, tuple] = {}
                texts = [[ws for s in SENTENCE.split(t) if (ws := tokens(s))] for t in batch.column(0).to_pylist()]
                every = sorted({w for sentences in texts for ws in sentences for w in ws})
                height = dict(zip(every, shared.value.margins(every)))
                for sentences, y in zip(texts, batch.column(1).to_pylist()):
                    best = [(height[w], w) for ws in sentences for w in [max(ws, key=lambda w: (height[w], w))]]
                    for margin, w in [max(best)] if y and best else best:
                        out[w, y] = (margin, out.get((w, y), (0, 0))[1] + 1)
                yield pa.RecordBatch.from_pydict({"w": pa.array([k[0] for k in out], pa.string()), "y": pa.array([k[1] for k in out], pa.int32()), "margin": pa.array([v[0] for v in out.values()], pa.float64()), "n": pa.array([v[1] for v in out.values()], pa.int64())})

        return cut_lineage(taught.mapInArrow(run, "w string, y int, margin double, n bigint").groupBy("w", "y").agg(F.max("margin").alias("margin"), F.sum("n").alias("n")))

    bad: dict[str, int] = {}
    for _ in range(rounds):
        told = examples(m)
        good = [(r.w, r.n) for r in told.where("y = 1").collect()]  # at most per_class
        clean = told.where("y = 0")
        new = {r.w: r.n for part in (clean.orderBy(F.desc("margin"), "w"), clean.orderBy(F.xxhash64("w"), "w")) for r in part.limit(negatives).collect()}
        if bad and not any(r.margin > 0 and r.w not in bad for r in clean.orderBy(F.desc("margin")).limit(len(bad) + 1).collect()):
            break  # no clean sentence is on the wrong side but by a token that was learned from
        bad |= new
        # A token of both sides is an example of either, by its share of the documents; one that is no oftener toxic is not.
        good = sorted((w, n) for w, n in good if n * sizes[0] > bad.get(w, 0) * sizes[1]) or [(w.strip("<>"), 1) for w in insults]
        extra = sorted((v, 0.25) for w in {x for x, _ in good} | {x.strip("<>") for x in insults} for v in garbled(w, rng) if len(v) >= 3)
        sides = [*good, *extra, *sorted(bad.items())]
        x, y = m.features(m.best_pieces([w for w, _ in sides])), np.repeat([1.0, -1.0], [len(good) + len(extra), len(bad)])
        n = np.array([float(n) for _, n in sides])
        m = replace(m, known={})
        m.weights, m.bias = train(x, y, n / np.where(y > 0, n[y > 0].sum(), n[y < 0].sum()))
    shared = spark.sparkContext.broadcast(m)

    def margins(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.text_margins(batch.column(0).to_pylist()), pa.float64()), batch.column(1)], names=["m", "y"])

    both = rows.where("apart").agg(F.count_distinct("y")).first()[0] == 2
    pairs = rows.where("apart" if both else "true").select("text", "y").mapInArrow(margins, "m double, y int").toPandas()  # at most 2 x per_class
    m.slope, m.offset = calibrate(pairs["m"].to_numpy(float), pairs["y"].to_numpy(float))
    return m


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row; null and empty texts get the score of a text without any match.

    Without a machine (no labelled rows of a class) every score is zero. Repeated rows give repeated
    results; only the text is looked at, whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        mine = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                got = mine.scores(part.column(1).to_pylist()) if mine else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run, lambda: machine and shared.value.known.clear()), f"doc_id {kind}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    machine = fit(docs, table(spark, sf_dir, "labels").where(~out))
    return score(docs, machine).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
