"""Five stages over ``documents``: quality, near duplicates, repeats, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's documents.  All
but the last return the columns of ``documents``.  Nulls, empty and blank texts,
repeated rows and extra columns are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srclens.llm import chosen_path, mixing, packing, quality, repeats
from srclens.llm.common import table, written

#: No SQL: the stages learn a model, join near duplicates and tokenize.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents predicted to be of label 0 go.

    The model learns from the labels of all folds but the held-out one.
    """
    counted = written(quality.count_documents(docs))
    return quality.keep_good(docs, quality.train(counted, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the least doc_id stays."""
    return chosen_path.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages of 200 bytes that repeat are cut out of every text."""
    return repeats.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: nine tenths of all words, by the weights of the domain tree, each document once at most."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack(written(packing.cut(docs)))


STAGES = [
    ("quality_classifier", quality_stage), ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage), ("mixing_to_weights", mixing_stage), ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
