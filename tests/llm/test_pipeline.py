"""The pipeline's stages on repeated and missing ids, nulls, empty tables and further columns."""

import pytest
from compare import SF

import corpus_pipeline as pipeline
from sqlsift.llm.common import stored

A, B = "a b c d e f g h i j", "z y x w v u t s r q p"
ROWS = [(1, A), (1, B), (0, A), (2, A), (2, A), (None, B), (None, "one two three four five six seven"), (None, "one two three four five six seven"), (5, None), (6, ""), (7, "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `x.y` int, TEXT_ string"


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "e") for i, t in ROWS], SCHEMA).coalesce(1).toDF("doc_id", "text", "lang", "source", "n_chars", "x_y", "TEXT_"), "edge")


def test_one_row_of_each_group_stays(spark, docs):
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(0, A), (1, B), (None, "one two three four five six seven"), (5, None), (6, ""), (7, "")], key=str)


def test_every_stage_on_odd_and_no_rows(spark, docs):
    for some in (docs, docs.limit(0), docs.filter("text is null")):
        for name, stage in pipeline.STAGES[:-1]:
            some = stored(stage(spark, some, SF), name)
            assert some.columns == list(pipeline.COLUMNS)
        assert set(pipeline.packing(spark, some, SF).columns) >= {"doc_id", "sequence_id"}


def test_texts_without_letters_go(spark, docs):
    got = [r.text for r in pipeline.language_id(spark, docs, "").collect()]
    assert sorted(got) == sorted(t for _, t in ROWS if t)


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, monkeypatch):
    texts = [f"{k} one two three four five six seven eight {k}" for k in range(300)]
    rows = [(k, texts[k % 200], "en", "s", 1) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = pipeline.near_components

    def then_other_splits(*a, **k):
        out = stored(found(*a, **k), "groups")
        spark.conf.set("spark.sql.files.minPartitionNum", 16)
        return out

    monkeypatch.setattr(pipeline, "near_components", then_other_splits)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        kept = pipeline.near_duplicates(spark, docs, "")
        assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
