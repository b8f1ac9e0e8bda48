"""Corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes a stage's result as Parquet below the shared
folder of spark.checkpoint.dir and reads it again for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import shared_folder
from tracelake.llm.decontamination import drop_leaks
from tracelake.llm.near_dedup import keep_one
from tracelake.llm.packing import pack_stage
from tracelake.llm.quality_rules import keep_good
from tracelake.llm.suffix_dedup import drop_repeats

STAGES = [
    ("quality rules", keep_good),
    ("minhash near-dedup", keep_one),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_stage),
]

#: SQL cannot express trained scores, sampling and packing; tests/llm compares each stage with plain methods, and `run` with the stages in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's table is removed once the next one's is whole.

    Null and empty texts, null and equal doc_ids, empty tables and further columns are dealt with as each stage's module says.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
