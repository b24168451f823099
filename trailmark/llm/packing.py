"""Packing by vector bin packing with the dot-product heuristic.

A partition packs its own documents, so no text is shuffled. An example is a vector of tokens, segments
(one) and loss-bearing tokens; a bin has a limit on each. A bin takes, of a pool of waiting examples that
fit, the one whose vector, scaled by the limits, has the largest dot product with the bin's remaining
room; when none fits, an example is cut to fill the rest. Bins of a partition that end up short are cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: For texts in Latin-1: the tokenizer's splitting pattern, as sets of characters; and for ASCII alone.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
_LATIN = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|{_SUFFIX}|[^\\x09-\\x0d\\x20\\x85\\xa0{_LETTERS}{_DIGITS}]+")
_ASCII = re.compile(f"[a-z]+|[0-9]|{_SUFFIX}|[^\\x09-\\x0d\\x20a-z0-9]+")
_ODD = re.compile("<\\||[\\x1c-\\x1f]")


class _Codes(dict):
    """Numbers words as they are first looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class Encoder:
    """Token ids of whole texts; equal to the tokenizer's own, but a word is tokenized once and remembered.

    The first ``limit`` words are remembered; later ones are tokenized anew in each batch. Texts outside
    Latin-1, and texts with a special token's string, go to the tokenizer as they are.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.codes = _Codes()
        self.stops, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def forget(self) -> None:
        self.codes, self.stops, self.ids = _Codes(), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _learn(self) -> None:
        """Tokenizes the new words in one go; a word's last token is marked in the vocabulary."""
        got = np.array(self.tokenizer.encode_batch_fast([" ".join(self.codes.new)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[got]) + 1
        assert len(stops) == len(self.codes.new), "a word must have one end"
        self.stops = np.concatenate([self.stops, self.stops[-1] + stops])
        self.ids = np.concatenate([self.ids, got])

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, each followed by ``end``."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, words, counts = [], [], []
        for k, t in enumerate(texts):
            split = _ASCII if t.isascii() else _LATIN
            if split is _LATIN:
                try:
                    t.encode("latin-1")
                except UnicodeEncodeError:
                    split = None
            if split is None or _ODD.search(t):
                out[k] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], np.uint32)
            else:
                found = split.findall(t.lower())
                plain.append(k)
                words += found
                counts.append(len(found))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            self._learn()
        starts = self.stops[codes]
        sizes = self.stops[codes + 1] - starts
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(stops[-1]) + np.repeat(starts - stops[:-1], sizes)]
        at = 0
        for k, n in zip(plain, counts):
            out[k] = np.append(ids[stops[at] : stops[at + n]], np.uint32(end))
            at += n
        if len(self.codes) > self.limit:
            for w in self.codes.new:
                del self.codes[w]
            self.stops = self.stops[: len(self.codes) + 1].copy()
            self.ids = self.ids[: self.stops[-1]].copy()
        self.codes.new = []
        return out  # type: ignore[return-value]


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """The worker's encoder: the vocabulary outlives a task, remembered words do not."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Fills bins from a pool of examples; ``loss`` counts of an example's tokens fall on any of its pieces in proportion."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int, slack: int):
        self.limit = np.array([tokens, segments, loss], float)
        self.tokens, self.pool, self.slack = tokens, pool, slack
        self.waiting: list[tuple] = []  # (doc, ids, start, doc_tokens, loss share)
        self.weights = np.empty((0, 3))

    def add(self, doc, ids: np.ndarray, share: float = 1.0) -> None:
        self.waiting.append((doc, ids, 0, len(ids), share))

    def bins(self, final: bool):
        """Lists of (doc, ids, start, doc_tokens) for full bins; with ``final`` for all that waits."""
        size = lambda w: len(w[1]) - w[2]
        while len(self.waiting) > self.pool or final and self.waiting:
            items = self.waiting
            n = np.fromiter(map(size, items), float, len(items))
            share = np.fromiter((w[4] for w in items), float, len(items))
            vectors = np.stack([n, np.ones(len(n)), n * share], 1) / self.limit
            free, room, taken, got = np.ones(len(n), bool), np.ones(3), [], []
            enough = final or len(items) > self.pool // 2
            while enough and room[0] * self.tokens >= 1 and room[1] * self.limit[1] >= 1 - 1e-9:
                fits = free & (vectors <= room + 1e-12).all(1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, vectors @ room, -1.0)))
                    cut = int(n[k])
                elif room[0] * self.tokens > self.slack and free.any() and room[2] > 0:
                    k = int(np.argmax(np.where(free, n, -1.0)))  # the longest gives a piece that fills the bin
                    left = min(room[0] * self.tokens, room[2] * self.limit[2] / share[k] if share[k] else np.inf)
                    cut = min(int(round(room[0] * self.tokens)), int(left + 1e-6))
                    if not cut:
                        break
                else:
                    break
                doc, ids, start, whole, s = items[k]
                got.append((doc, ids[start : start + cut], start, whole))
                room = room - np.array([cut, 1, cut * s]) / self.limit
                free[k] = False
                taken.append(k)
                if start + cut < len(ids):
                    items[k] = (doc, ids, start + cut, whole, s)
                    taken.pop()
            for k in sorted(taken, reverse=True):
                items.pop(k)
            yield got


def powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """A short bin cut into sequences whose lengths are powers of two."""
    total, out, at = sum(len(p[1]) for p in pieces), [], 0
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        got = []
        while room:
            doc, ids, start, whole = pieces[at]
            take = min(room, len(ids))
            got.append((doc, ids[:take], start, whole))
            room -= take
            pieces[at] = (doc, ids[take:], start + take, whole)
            at += take == len(ids)
        if got:
            out.append(got)
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", tokens: int = 4096, segments: int = 256, loss: int = 4096, end: int = 2, pool: int = 512, slack: int = 8, loss_share: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every text, null as empty, is tokenized whole and followed by ``end``; each id is in exactly one
    piece. ``loss_share`` names a column with the share of a text's tokens that bear loss (null counts as all);
    without it all do. A piece bears loss by its document's share. Sequences keep to the three limits; sequence_id is unique in the
    result. Repeated rows are packed one by one, an empty table gives an empty result, other columns are
    ignored. Of equal dot products the example that waits longest is taken. The pool is bounded in examples.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder = shared_encoder(tokenizer)
        packer, next_id = Packer(tokens, segments, loss, pool, slack), TaskContext.get().partitionId() << 40

        def rows(sequences):
            nonlocal next_id
            cols: list[list] = [[] for _ in range(7)]
            for pieces in sequences:
                at = 0
                for doc, ids, start, whole in pieces:
                    for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), whole, next_id, at)):
                        c.append(v)
                    at += len(ids)
                next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(cols[0], out_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

        names, out_type = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], None
        for batch in batches:
            out_type = batch.column(0).type
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, ids, share in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()], end), part.column(2).to_pylist()):
                    packer.add(doc, ids, min(1.0, max(0.0, share)))
                yield rows(packer.bins(False))
        if out_type is not None:
            done = list(packer.bins(True))
            full = [b for b in done if sum(len(p[1]) for p in b) == tokens]
            short = [b for b in done if sum(len(p[1]) for p in b) != tokens]
            yield rows([*full, *[s for b in short for s in powers_of_two(b)]])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    share = F.coalesce(F.col(loss_share).cast("double"), F.lit(1.0)) if loss_share else F.lit(1.0)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), share.alias("share")).mapInArrow(tidy(run, lambda: shared_encoder(tokenizer).forget()), schema)


def conversations(turns: DataFrame, bearing: str = "assistant") -> DataFrame:
    """(conv_id, text, share): a conversation's turns in order, a line each, and the share of its characters that bear loss.

    Null roles bear none, null texts are empty; a conversation's turns are one row, as its example is one text.
    """
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"), F.sum(F.when(F.col("role") == bearing, size).otherwise(0)).alias("own"), F.sum(size).alias("all"))
    return parts.select("conv_id", F.array_join(F.col("t")["text"], "\n").alias("text"), (F.col("own") / F.col("all")).alias("share"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
