"""The pipeline's stages keep the schema and take effect."""

import re

import corpus_pipeline
from trailmark.llm import queries


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]


STAGE = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_awkward_rows(spark, docs, rows, none, tmp_path):
    """Nulls, repeats, clashing column names and empty tables, stage by stage, against plain Python."""
    given = written(docs, tmp_path / "docs")
    ids = lambda name, d: sorted(r.doc_id for r in STAGE[name](spark, d, SF).collect())
    texts = [(k, t) for k, t, *_ in rows]
    assert ids("language_id", given) == sorted(k for k, t in texts if t and any(c.isalpha() for c in t))
    first: dict[str, int] = {}
    for k, t in sorted(texts, key=lambda x: x[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), k)
    assert ids("exact_dedup", given) == sorted(first.values())

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    alike = lambda a, b: not a and not b or bool(a | b) and len(a & b) / len(a | b) >= 0.8
    group = {k: k for k, _ in texts}
    every = [(k, shingles(t)) for k, t in texts]
    for i, (a, x) in enumerate(every):
        for b, y in every[:i]:
            if alike(x, y):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    assert ids("simhash_near_dedup", given) == sorted(set(group.values()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, written(none, tmp_path / f"none_{name}"), SF).count() == 0
        if name != "packing":
            assert stage(spark, given, SF).columns == given.columns
    packed = STAGE["packing"](spark, given, SF).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert len(packed) == len({k for k, _ in texts})


def test_clean_and_leaking_documents(spark, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    d = [(1, f"some words before {item} and after", "x", True, 1), (2, "nothing of it here", "y", False, 2), (2, None, "y", None, 3), (None, f"{item}", "z", None, 4)]
    given = written(spark.createDataFrame(d, "doc_id long, text string, spans string, contaminated boolean, n_words long"), tmp_path / "d")
    got = STAGE["decontaminate"](spark, given, SF)
    assert got.columns == given.columns and sorted((r.doc_id, r.n_words) for r in got.collect()) == [(2, 2), (2, 3)]


def test_one_id_with_two_texts(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(60))
    d = [(1, long), (5, long + " more"), (5, "another text of its own"), (5, "another text of its own"), (None, "a text without id")]
    given = written(spark.createDataFrame(d, "doc_id long, text string"), tmp_path / "d")
    got = STAGE["simhash_near_dedup"](spark, given, SF)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a text without id"), (1, long), (5, "another text of its own")]


def test_language_stage_without_labels(spark, tmp_path):
    given = written(spark.createDataFrame([(1, "words", None), (2, "12 ½", None), (3, None, None)], "doc_id long, text string, lang string"), tmp_path / "d")
    assert [(r.doc_id, r.lang) for r in STAGE["language_id"](spark, given, SF).collect()] == [(1, None)]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
