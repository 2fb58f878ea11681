"""How rows lie in partitions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """A file scan over all cores if it has fewer splits than those: a small file is often one row group, and so one task's work.

    Larger inputs stay as they lie, without a shuffle. Only for scans: the partitions of other plans aren't known before they run.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none, one of our own in local mode, as in tests; a cluster
    must name one that all its machines share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """df, written as Parquet to a folder of its own in the shared folder and read again: lineage is cut, columns are compressed, and a plan
    that needs some columns reads those alone. options are the writer's."""
    folder = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.parquet(folder)


def numbered(rows: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """rows plus their number from 1 in the whole table's order, without one task that sorts them all: rows are dealt by ranges and sorted
    there, and each partition begins where those before it end. The order should have no ties."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_id", F.monotonically_increasing_id()))  # partition << 33 | place in it
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    begins = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    return placed.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + place + 1).drop("_part", "_begin", "_id")
