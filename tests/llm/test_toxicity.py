"""Toxicity: rare insults, stems with endings, copies, the kernel's features, and held-out figures by language."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import toxicity

from .test_learned import brute_kernel


def corpus(seed: int = 4):
    """Texts in two made-up languages; of the second's insults only stems are fixed, and they are rare."""
    r = random.Random(seed)
    word = {"a": lambda: "".join(r.choice(["ran", "tel", "mos", "kin", "er", "ing"]) for _ in range(r.randrange(2, 4))), "b": lambda: "".join(r.choice(["ção", "lho", "que", "da", "ém", "os"]) for _ in range(r.randrange(2, 4)))}
    bad = {"a": lambda: r.choice(["blatherskite"] * 8 + ["clodpate"]), "b": lambda: "zuvrim" + r.choice(["ção", "lho", "que", "da", "ém", "os"])}
    rows = []
    for k in range(1200):
        lang = "b" if k % 3 == 0 else "a"
        ws = [word[lang]() for _ in range(25)]
        if toxic := r.random() < (0.25 if lang == "a" else 0.35):
            ws[r.randrange(25)] = bad[lang]()
        rows.append((k, " ".join(ws[:12]) + ". " + " ".join(ws[12:]) + ".", lang, int(toxic)))
    copy = "moser raner telkin erran ingtel moskin raning teler kinmos."
    return rows + [(2000 + k, f"{copy} {word['a']()}", "a", 1) for k in range(60)], bad


@pytest.fixture(scope="module")
def fitted(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_by_language(fitted):
    """A rare insult beside a frequent one and a stem with endings are learned; words of copies are not insults."""
    rows, _ = corpus(5)
    rows = rows[:1200]
    got = fitted.scores([t for _, t, _, _ in rows]) >= 0.5
    for lang in ("a", "b"):
        for toxic, least in ((1, 0.9), (0, 0.95)):
            own = [g == bool(toxic) for g, (_, _, x, y) in zip(got, rows) if x == lang and y == toxic]
            assert np.mean(own) >= least, (lang, toxic, np.mean(own))
    assert (fitted.scores(["a clodpate here", "moser raner telkin erran ingtel moskin raning teler kinmos."]) >= 0.5).tolist() == [True, False]


def test_features_are_kernels(fitted):
    words = ["<zuvrimda>", "<clod-pate>", "<moskin>", "<telraner>"]
    got = fitted.kernels(words)
    for i, w in enumerate(words):
        for j, x in enumerate(fitted.landmarks):
            w_, x_ = w[: toxicity.WIDTH], x
            exact = brute_kernel(w_, x_) / np.sqrt(brute_kernel(w_, w_) * brute_kernel(x_, x_))
            low = lambda s: [ord(c) & 31 for c in s]  # noqa: E731  as letter_counts() tells letters apart
            shared = sum(min(low(w_).count(c), low(x_).count(c)) for c in set(low(x_)))
            assert got[i, j] == pytest.approx(exact if shared >= max(3, 0.6 * len(x_)) else 0.0, rel=1e-3, abs=1e-6)


def test_query_contract(spark, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame([(k, t, x, "s", 1) for k, t, x, _ in rows] + [(5000, None, None, None, 0), (5001, "", "a", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, y, 1) for k, _, _, y in rows] + [(None, 1, 1), (7, None, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op6_toxicity(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows) + 2
    assert out.where((F.col("predicted") != (F.col("score") >= 0.5).cast("int")) | ~F.col("score").between(0, 1)).isEmpty()
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).isEmpty()
    assert {r.doc_id: r.predicted for r in out.where("doc_id >= 5000").collect()} == {5000: 0, 5001: 0}


def test_evidence():
    assert toxicity.evidence(5, 0, 0.5) == pytest.approx(5 * np.log(2)) and toxicity.evidence(3, 1, 0.5) == 0
    found, words = [("abcd", 9, 0), ("bcde", 9, 0), ("zzzz", 2, 0)], [("xabcdey", 9), ("zzzz", 2)]
    assert toxicity.choose(found, words, 0.1, 6.0, 10) == ["abcd"]  # the second explains the same token, the third is too rare
