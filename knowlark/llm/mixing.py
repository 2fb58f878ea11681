"""Mixing sources to target weights by nested hash-threshold histograms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowlark.llm.common import WORD, checkpointed, small, text_of

#: Histogram levels and the bits of a row's hash that each resolves, from the top.
LEVELS, BITS = 3, 14


def source_targets(sizes: DataFrame, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> plus target: sources by code point, null last, weigh 1..cycle repeating.

    They share the total by weight; a target stops at cap x the source's size and the excess is reshared by weight
    until none is above. The fixed point is found at once: with sources sorted by cap / weight, those capped
    are a prefix, and the rest get one common level. The window is over one row per source.
    """
    ranked = sizes.withColumn("_w", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % cycle + 1)
    ranked = ranked.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    open_ = ranked.withColumn("_level", level).withColumn("_open", F.when(F.col("_level") < F.col("_ratio"), F.col("_level")))
    first = F.first("_open", ignorenulls=True).over(every)
    return open_.withColumn("_common", first).select(
        "source",
        "source_size",
        F.when(F.col("_common").isNull() | (F.col("_ratio") <= F.col("_common")), F.col("_cap")).otherwise(F.col("_common") * F.col("_w")).cast("double").alias("target"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    size is the number of `[^\\x20\\x09-\\x0D]+` in the text (null or empty: 0). A source's target is met by whole
    copies of each of its documents and one more copy of those whose hash of (id, text) is under the source's
    threshold. Thresholds come from histograms of size by (source, hash bucket): each level finds the bucket in which the
    budget ends and the next level splits that bucket alone, so nothing is sorted. Rows that share the hash value at the threshold
    (repeated rows) are split by a second hash, of their places in the input. A second round fills what the
    document at the threshold would overshoot with documents that fit. Reruns agree. An empty table gives an empty result; a null
    source is a source, a null id a value like others. Very long texts are counted where they lie.
    """
    slim, bounds = _decided(_hashed(docs, id_col, text_col, source_col), cycle, cap)
    return (
        slim.join(small(bounds), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", _copies("size", "_place"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """docs with each row as often as mix() takes it, in its own columns, whatever they are called. Texts are hashed again where they
    lie, not shuffled. Rows without words are never taken; nulls, repeated rows and an empty table are as in mix().

    Rows that share the hash value at a threshold are written to the shared folder and split there, so that each is counted and taken by
    one and the same place.
    """
    names = docs.columns
    own = docs.toDF(*(f"_column{k}" for k in range(len(names))))  # whatever the columns are called, none clashes
    at = [f"_column{names.index(c)}" for c in (id_col, text_col, source_col)]
    _, bounds = _decided(_hashed(docs, id_col, text_col, source_col), cycle, cap)
    taken = own.select("*", *_measures(*at)).join(small(bounds), F.col("_source").eqNullSafe(F.col("_s")))
    if bounds.where("_ties > 0").limit(1).count():
        tied = (F.col("_ties") > 0) & (F.col("_h") == F.col("_end")) & (F.col("_size") > 0)
        ends = checkpointed(taken.where(tied).drop("_ties").withColumn("_place", _place()))
        again = _tie(ends.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_place").alias("_h")), bounds.select("_s", "_before"))
        ends = ends.join(small(again.select("_s2", "_ties")), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
        taken = taken.where(~F.coalesce(tied, F.lit(False))).withColumn("_place", F.lit(0).cast("long")).unionByName(ends.select(*taken.columns, "_place"))
    else:
        taken = taken.withColumn("_place", F.lit(0).cast("long"))
    taken = taken.withColumn("_n", _copies("_size", "_place")).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return taken.select(*own.columns).toDF(*names)


def _bits(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BITS * LEVELS)


def _place() -> Column:
    """A hash of the row's place in the input."""
    return _bits(F.xxhash64(F.monotonically_increasing_id()))


def _measures(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [
        F.col(source_col).cast("string").alias("_source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_size"),
        _bits(F.xxhash64(id_col, text_of(text_col))).alias("_h"),
    ]


def _hashed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source, size, hashed = _measures(id_col, text_col, source_col)
    return docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), size.alias("size"), hashed, _place().alias("_place"))


def _copies(size: str, place: str) -> Column:
    at_end = (F.col("_h") == F.col("_end")) & (F.col(place) < F.col("_ties"))
    beyond = (F.col("_h") > F.col("_end")) & (F.col(size) <= F.col("_fits")) & (F.col("_h") < F.col("_end2"))
    extra = (F.col("_h") < F.col("_end")) | at_end | beyond
    return F.when(F.col(size) > 0, F.col("_whole") + extra.cast("int")).otherwise(0).cast("long")


def _tie(ends: DataFrame, budget: DataFrame) -> DataFrame:
    """(_s2, _ties, _fits): of the rows at each source's threshold those with a place under _ties are taken; _fits is what is left then."""
    cut = _thresholds(ends, budget.select("_s", F.col("_before").alias("_left")), nearer=False)
    return cut.select(F.col("_s").alias("_s2"), F.col("_end").alias("_ties"), F.col("_left").alias("_fits"))


def _decided(hashed: DataFrame, cycle: int, cap: float) -> tuple[DataFrame, DataFrame]:
    """The slim table of all rows, checkpointed, and each source's whole copies and thresholds."""
    slim = checkpointed(hashed)
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = targets.select(
        F.col("source").alias("_s"), "source_size", "target", whole.cast("long").alias("_whole"), (F.col("target") - whole * F.col("source_size")).alias("_left")
    )
    budget = checkpointed(budget)
    open_ = slim.where("size > 0").select("source", "size", "_h", "_place")
    first = _thresholds(open_, budget, nearer=False).withColumnRenamed("_left", "_before")
    near = open_.join(small(first), F.col("source").eqNullSafe(F.col("_s")))
    ends = near.where(F.col("_h") == F.col("_end")).select("source", "size", F.col("_place").alias("_h"))
    if ends.groupBy("source").count().where("count > 1").limit(1).count():
        ties = _tie(ends, first.select("_s", "_before"))
    else:
        ties = first.select(F.col("_s").alias("_s2"), F.lit(0).cast("long").alias("_ties"), F.col("_before").alias("_fits"))
    first = checkpointed(first.join(small(ties), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2"))
    beyond = (
        open_.join(small(first), F.col("source").eqNullSafe(F.col("_s"))).where((F.col("_h") > F.col("_end")) & (F.col("size") <= F.col("_fits"))).select("source", "size", "_h")
    )
    second = _thresholds(beyond, first.select("_s", F.col("_fits").alias("_left")), nearer=True).select(F.col("_s").alias("_s2"), F.col("_end").alias("_end2"))
    bounds = checkpointed(first.join(small(second), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2"))
    return slim, bounds


def _thresholds(rows: DataFrame, budget: DataFrame, nearer: bool) -> DataFrame:
    """budget plus _end: rows (source, size, _h) with _h < _end sum to at most _left, which is lowered by their sum.

    nearer: the rows of the hash value at the threshold count too if that brings the sum nearer. A source whose rows
    all fit gets an _end above every hash.
    """
    state = budget.withColumns({"_prefix": F.lit(0).cast("long"), "_own": F.lit(0).cast("long"), "_fit": F.lit(False)})
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(small(state), rows["source"].eqNullSafe(F.col("_s")) & ~F.col("_fit"))
        if level:
            inside = inside.where(F.shiftright("_h", shift + BITS) == F.col("_prefix"))
        sums = inside.groupBy("_s", F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_sum"), F.first("_left").alias("_left"))
        upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ended = (
            sums.withColumn("_upto", F.sum("_sum").over(upto))
            .groupBy("_s")
            .agg(
                F.min(F.when(F.col("_upto") > F.col("_left"), F.struct(F.col("_b").alias("b"), (F.col("_upto") - F.col("_sum")).alias("under"), F.col("_sum").alias("own")))).alias("_at"),
                F.sum("_sum").alias("_all"),
            )
            .select(F.col("_s").alias("_e"), "_at", "_all")
        )
        at = F.col("_at.b")
        state = checkpointed(
            state.join(small(ended), F.col("_s").eqNullSafe(F.col("_e")), "left").select(
                *budget.columns[:-1],
                (F.col("_left") - F.when(at.isNotNull(), F.col("_at.under")).otherwise(F.coalesce("_all", F.lit(0)))).alias("_left"),
                F.coalesce(at, F.col("_prefix")).alias("_prefix"),
                F.coalesce(F.col("_at.own"), F.lit(0)).cast("long").alias("_own"),
                (F.col("_fit") | at.isNull()).alias("_fit"),
            )
        )
    takes = F.lit(nearer) & ~F.col("_fit") & (2 * F.col("_left") >= F.col("_own"))
    end = F.when(F.col("_fit"), F.lit(1 << (BITS * LEVELS))).otherwise(F.col("_prefix") + takes.cast("long"))
    return checkpointed(state.select(*budget.columns, end.alias("_end")))
