"""A training corpus from raw documents: five stages, each a Parquet table for the next.

In every stage: a null text is an empty one; rows without a doc_id are documents of their own; repeated rows are judged
alike, each by its own text, and come out once each where they stay; an empty table gives an empty one with the same
columns; extra columns pass unchanged, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeworks.llm import decontamination, lines, packing, quality, simhash_wide
from lodeworks.llm.common import read, stored
from lodeworks.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Under five labels of a kind it warns and keeps all; ties
    with the threshold stay."""
    return quality.good_only(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars, where there is such a column, follows the text. All documents
    stay, those without a line left with an empty text; rows of one doc_id count as one document."""
    found = lines.drop_frequent_lines(docs, threshold=10).select(docs.columns)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of five-word shingles of about 0.8 or more, the document of the smallest
    doc_id stays. Blank texts are one group; rows without a doc_id stay; of rows that share a doc_id each goes by its own
    text."""
    return simhash_wide.keep_one(docs, similarity=0.8, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within a tenth of its characters, go; null and empty items match nothing."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece, in op3's columns. A null text is its end token alone;
    repeated rows are placed once each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The first stage's classifier and the last one's tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
