"""Corpus pipeline: documents to a training mix, in five stages.

Each stage reads all that its predecessor kept; all but the last return the
columns of ``documents``.  ``run`` writes every stage's result as Parquet under
the shared scratch folder and reads it again, so that a lost executor costs at
most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftspark.llm.cuckoo import drop_copies
from shiftspark.llm.decontaminate import drop_contaminated
from shiftspark.llm.mixing import mix_stage
from shiftspark.llm.near_dup import keep_one_of_each
from shiftspark.llm.toxicity import reject_toxic
from shiftspark.session import write_and_read
from shiftspark.sources.tables import read_table

STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix_stage),
]

#: Models, sketches and seeded hashes have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the documents that stay."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
