"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)). Its result is written as Parquet and read
again as the next one's documents. Stages but the last keep the columns of the documents they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import pii, quality
from gaugeline.llm.minhash import MOST_IDS_SENT, keep_one
from gaugeline.llm.packing import pack
from gaugeline.llm.queries import importable, table
from gaugeline.llm.repetition import keep_passing
from gaugeline.session import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; a null or empty text goes."""
    importable(spark)
    return keep_passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by a model of the labelled ones among them; without labels, all."""
    importable(spark)
    labels = table(spark, sf_dir, "labels")
    # The model needs the statistics of labelled documents only; the score takes its own of all.
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct()
    few = known.count() <= MOST_IDS_SENT
    labelled = docs.join(F.broadcast(known) if few else known, "doc_id", "left_semi")
    stats = settle(quality.document_statistics(labelled))
    return quality.keep_good(docs, quality.fit(quality.training_rows(stats, labels, "quality")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group linked at 80 percent of five-word shingles."""
    importable(spark)
    return keep_one(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; `n_chars` follows the text."""
    importable(spark)
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    importable(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fitted models, components and a linear program have no SQL form; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
