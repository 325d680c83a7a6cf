"""A pipeline over documents; each stage is written as Parquet and read again by the next.

toxicity: documents scored as toxic go. line_dedup: repeated lines go, and documents of which
nothing is left. near_dedup: of each group of near copies the document with the smallest id stays.
mix_sources: all documents in the order of the mix of all sources by their tempered weights.
bpe: token ids. All but the last stage return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from lexforge.llm.common import delete, drop_written, shared_dir, standing

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mix_sources", mixing.stage),
    ("bpe", bpe.stage),
]

#: Class models, edit distances, registers and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids. What a stage has read and its own tables go when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home, path = f"{shared_dir(spark)}/lexforge-pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        before, since = path, standing()
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_written(spark, since)
        if before:
            delete(spark, before)
        docs = spark.read.parquet(path)
    return docs
