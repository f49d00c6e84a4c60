"""The pipeline's stages on the documents table, each against what it was given."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(pipeline.STAGES) - 1:
            assert now.columns == columns
        if name == "language_id":
            assert now.count() >= 0.98 * before
        if name == "exact_dedup":
            seen = [re.sub(r"\s", "", r["text"]) for r in now.collect()]
            assert len(seen) == len(set(seen)) == len({re.sub(r"\s", "", r["text"]) for r in docs.collect()})
        if name == "near_dedup":
            gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in now.collect()}
            sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in docs.collect() for w in [r["text"].lower().split()]}
            like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
            left = [r["doc_id"] for r in now.collect()]
            assert not any(like(sets[a], sets[b]) for a in left for b in left if a < b)
            assert all(any(like(sets[a], sets[b]) for b in sets if b != a) for a in gone)
        if name == "encoding":
            assert all(r["decodes"] and len(r["ids"]) == r["n_tokens"] for r in now.collect())
        docs = now


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "encoding"]


@pytest.mark.parametrize("kind", ["odd", "empty", "unlabelled"])
def test_odd_tables(spark, tmp_path, kind):
    """Nulls in every column, empty and long texts, repeated rows, no rows at all, no labels: no stage breaks, and columns stay."""
    long = "the of and in " * 30_000
    rows = [(1, "the of and in to nd " * 9, "en", "a", 1), (1, "the of and in to nd " * 9, "en", "a", 1), (2, None, None, None, None), (None, "der die das und ist " * 9, "de", None, 1), (3, "", "en", "b", 0), (4, " \n", "de", "b", 2), (5, long, "en", "a", 9), (6, long + "x", "en", "a", 9), (7, "42 !", None, "c", 1)]
    if kind == "empty":
        rows = []
    if kind == "unlabelled":
        rows = [(a, b, None, d, e) for a, b, _, d, e in rows]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, "unused").write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert now.columns == docs.columns
        if name == "near_dedup" and kind == "odd":
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in now.collect() if r["doc_id"] is not None) == [(False, 1), (False, 5)]
        docs = now
    assert docs.where("not decodes").count() == 0


def test_near_copies_of_null_and_shared_ids(spark):
    """One of each group stays, whatever its ids are; texts without words are no copies."""
    group = lambda word: [" ".join([word] + [f"{word}{i}" for i in range(60)] + [f"end{k}"]) for k in range(3)]
    a, b, c = group("a"), group("b"), group("c")
    rows = [(None, a[0]), (None, a[1]), (None, a[2]), (4, b[0]), (4, b[1]), (5, b[2]), (None, c[0]), (7, c[1]), (6, c[2]), (None, ""), (None, " "), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in pipeline.STAGES[2][1](spark, docs, "unused").collect()]
    assert [sum(x in g for _, x in left) for g in (a, b, c)] == [1, 1, 1]
    assert {i for i, x in left if x in b or x in c} == {4, 6} and len(left) == 6
