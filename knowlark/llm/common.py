"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlark.operators.layout import checkpoint_folder, checkpointed, written  # noqa: F401

WHITESPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit in which group bounds are stated."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(column: str) -> Column:
    """The text as a string that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (they are counted), else as it is.

    df should be cheap to count: checkpointed, or an aggregate of a checkpointed table.
    """
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df


def hot_pieces(keyed: DataFrame, key: str, bound: int) -> DataFrame:
    """Keys with more than `bound` rows and the number of pieces that brings each piece to about `bound` rows.

    It has at most rows / bound rows. A bound that follows rows / partitions keeps that under a few
    times the number of partitions at any input size, which is what lets callers broadcast it.
    """
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound)
    return counts.select(key, F.ceil(F.col("_n") / F.lit(bound)).cast("int").alias("_pieces"))


def join_unique(rows: DataFrame, table: DataFrame, key: str, bound: int, how: str = "left") -> DataFrame:
    """rows with the columns of table, which has one row for each key at most.

    Keys of over `bound` rows are looked up by broadcast, so their rows stay where they are: they are at most rows / bound. The rest is
    a join by key, in which no key has more than `bound` rows. rows is read twice and should be checkpointed or cheap.
    """
    hot = checkpointed(hot_pieces(rows.select(key), key, bound).select(key))
    if not hot.limit(1).count():
        return rows.join(table, key, how)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.where("_hot is null").drop("_hot").join(table, key, how)
    few = table.join(F.broadcast(hot), key, "left_semi")
    return cold.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(few), key, how))


def bound_for(n: int, spark: SparkSession, least: int = 64) -> int:
    """Rows of a key from which it is hot: a quarter of a partition of n rows."""
    return max(least, n // (4 * partitions(spark)))
