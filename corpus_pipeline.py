"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
docs of the next; columns beside COLUMNS are dropped by the first. Nulls, empty texts, empty tables and repeated rows are
treated as the operators' docstrings define: only documents without a letter or in no learned language go for their
language, lines go and stay by their number of documents, a row goes as a copy or for a benchmark passage by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.llm.common import dropped, settled, stored, table
from sqlsift.llm.decontaminate import decontaminate
from sqlsift.llm.langid import fitting, predict, train
from sqlsift.llm.line_dedup import line_dedup
from sqlsift.llm.ngram_join import near_components
from sqlsift.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language reaches this posterior, if it has no letter, or if its n-grams do not fit its language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; learns from all labelled ones."""
    model = train(docs)
    # written: the rows are read twice, for the languages' means and for the decision
    judged = stored(predict(docs.select(*COLUMNS), model, per_gram=True).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), "judged")
    return fitting(judged, model).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that ten documents or more share; documents that lose no line stay as they are."""
    out = line_dedup(docs)
    return out.select("doc_id", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of least id, of equal ids the first row, of rows without id the first if no other has one.

    Rows are told apart by a number that is written with them before anything is decided: however the table is split when it
    is read again, a row keeps it. Rows without words stay.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    groups = near_components(rows.select(key.alias("key"), "text"), id_col="key")
    found = stored(groups.filter("doc_id <> component_id").select(F.col("doc_id.row").alias("__row")), "copies")
    few = found.count() <= 1 << 20  # 8 bytes each
    return rows.join(F.broadcast(found) if few else found, "__row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The tokenizer of the last stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way, and its input, are deleted when its result is written; the last stage's input stays, as its rows are read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
