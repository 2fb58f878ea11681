"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing and sharding, one stage after another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlark.llm.common import checkpoint_folder
from knowlark.llm.decontaminate import clean
from knowlark.llm.mixing import mixed
from knowlark.llm.sharding import sharded
from knowlark.llm.simhash import keep_one
from knowlark.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    cut = clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in docs.columns:  # follows the text
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)
    return cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their targets: documents are repeated or left out."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of the mix, with its shard and slot."""
    return sharded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the classifier, XXH64 or label propagation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, read = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            if read:
                _delete(spark, read)
            read = f"{folder}/{name}"
            docs = spark.read.parquet(read)
        # The last stage holds its rows in the shared folder, so what it read isn't needed when its result is.
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
