"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts, each partition is sorted (Spark's external sort),
and neighbours are compared in full: a window over the sorted run gives each text's keeper. The range partitioning
already satisfies the window's distribution, so the texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowlark.llm.common import WHITESPACE, bound_for, checkpointed, hot_pieces, partitions, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_piece: int = 64, lead: int = 24) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of `[\\x20\\x09-\\x0D]`; null counts as empty, and all
    empty texts are one group. The row with most code points in its original text stays, then the smallest
    id (a null id comes last). Of repeated rows with one id, one is kept. Other columns of docs are ignored.

    Splitters are sampled from (first `lead` characters, hash, piece), which keeps the sample that goes to the driver small
    whatever the texts' lengths (Spark samples a million rows at most); rows are sorted by these and then the whole text, very long
    ones too. An empty table gives an empty result.

    Hot texts: one with more rows than rows / (4 x partitions) is dealt out to pieces by the rows' places in the input, so that
    repeated rows spread too. The input must come in the same order when a task is tried again, as files do. Inside a piece texts
    are compared in full; the pieces of one hot text, at most one row each, are joined by SHA-256.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.monotonically_increasing_id().alias("_place")).select(
        "_id", "_place", F.char_length("_text").alias("_points"), F.regexp_replace("_text", WHITESPACE, "").alias("_norm")
    )
    hashed = base.withColumn("_h", F.xxhash64("_norm"))
    hot = checkpointed(hot_pieces(hashed.select("_h"), "_h", bound_for(docs.count(), spark, min_piece)))
    dealt = hashed.join(F.broadcast(hot), "_h", "left").select(
        "_id", "_points", "_norm", "_h", F.substring("_norm", 1, lead).alias("_lead"), "_pieces", F.coalesce(F.expr("pmod(xxhash64(_place), _pieces)"), F.lit(0)).alias("_piece")
    )
    run = Window.partitionBy("_lead", "_h", "_norm", "_piece")
    order = run.orderBy(F.desc("_points"), F.asc_nulls_last("_id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = checkpointed(
        dealt.repartitionByRange(count, "_lead", "_h", "_piece").select(
            "_id",
            "_pieces",
            "_piece",
            F.row_number().over(order).alias("_rank"),
            F.first("_id").over(whole).alias("_best"),
            F.first("_points").over(whole).alias("_most"),
            F.count(F.lit(1)).over(whole).alias("_n"),
            F.sha2("_norm", 256).alias("_sha"),
        )
    )
    heads = rows.where("_pieces is not null and _rank = 1")
    among = Window.partitionBy("_sha").orderBy(F.desc("_most"), F.asc_nulls_last("_best"), "_piece").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    merged = heads.select(
        "_sha",
        F.first("_best").over(among).alias("_keep"),
        F.first("_piece").over(among).alias("_in"),
        F.sum("_n").over(among).alias("_size"),
    ).distinct()
    joined = rows.join(F.broadcast(merged), "_sha", "left")
    keep = F.when(F.col("_size").isNull(), F.col("_best")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_size", "_n").cast("long").alias("group_size"),
        ((F.col("_rank") == 1) & (F.coalesce("_in", "_piece") == F.col("_piece"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
