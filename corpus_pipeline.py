"""The corpus pipeline: five of the operators one after another.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next
stage's ``docs``.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm import decontaminate, line_dedup, near_dedup, pieces, quality_model
from simtrail.session import materialize, release, written_so_far


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (learnt from the labelled ones among ``docs``)."""
    return quality_model.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of duplicate lines; a document that loses its whole text goes."""
    out = line_dedup.without_duplicate_lines(docs, exact_words=line_dedup.EXACT_WORDS)
    lost = (F.col("n_lines_removed") > 0) & (F.trim("text") == "")
    return out.where(~lost).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (the least doc_id)."""
    return near_dedup.keep_one_of_each(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs, items).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text exactly."""
    vocabulary = pieces.Pieces.load()
    done = pieces.decode(pieces.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary), vocabulary)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", "ids", "n_tokens", exact.alias("exact"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece", encoding),
]

# Fitted models, SimHash groups and Viterbi paths have no SQL form; tests/llm holds the operators against brute force
# and runs all stages on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; every stage's rows are written and reread, and what a stage wrote on the way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written_so_far()
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i + 1}")
        release(spark, mark, (docs,))
    return docs
