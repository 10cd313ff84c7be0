"""A corpus pipeline: toxic texts go, poor texts go, one of each near-duplicate group stays, the rest is packed.

Every stage works on what the stage before it kept. All but the last return the columns of
``documents``. Classifiers are fitted on the labelled rows among a stage's own input that are not
held out. Rows with equal ids count as one document; nulls and empty texts are scored like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import minhash, packing, quality, toxicity
from tracewell.llm.common import materialize, split_remainder, table
from tracewell.llm.queries import tokenizer

THRESHOLD = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored below THRESHOLD stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), split_remainder(F.col("id"), 4) == 2)
    score = toxicity.scorer(spark, model)
    return docs.where(score(docs["text"]) < THRESHOLD)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored THRESHOLD or above stay."""
    stats = quality.document_statistics(docs)
    train = quality.labelled(stats, table(spark, sf_dir, "labels"), split_remainder(F.col("id"), 5) == 0)
    score = quality.scorer(spark, quality.fit(materialize(train, "quality-train")))
    return docs.where(score(docs["text"]) >= THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays: five-word shingles, similarity of 0.8 or more."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences with their ids."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
