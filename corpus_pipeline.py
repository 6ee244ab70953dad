"""The corpus pipeline: toxicity filter, near-duplicate removal, removal of repeated passages, packing.

``run`` writes what each stage returns and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerscope.llm.bagminhash import near_duplicate_stage
from offerscope.llm.common import materialize, table
from offerscope.llm.packing import pack_documents
from offerscope.llm.repeats import substring_stage
from offerscope.llm.toxicity import toxicity_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, ready to be laid into sequences."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", substring_stage),
    ("packing", packing_stage),
]

# The classifier and the signatures cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
