"""Fusion and reranking of hits, batched over queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowlark.functions.text import lenient_json, round4
from knowlark.operators.layout import checkpointed
from knowlark.operators.lexical import forward, keyword_scores

RRF_K = 60
SCORE_WEIGHT, KEYWORD_WEIGHT = 0.65, 0.35


def ranked(hits: DataFrame, name: str = "rank") -> DataFrame:
    """hits plus their rank from 1 in each query by score, then chunk_id."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def minmax(hits: DataFrame) -> DataFrame:
    """Scores of a query scaled to 0..1; kept where a query has one hit or no spread."""
    w = Window.partitionBy("query_id")
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count(F.lit(1)).over(w)
    return hits.withColumn("score", F.when((n < 2) | (high - low < 1e-9), F.col("score")).otherwise((F.col("score") - low) / (high - low)))


def rrf(vector_hits: DataFrame, keyword_hits: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, score). min_score is for vector hits alone, which rank after it. A union and
    one aggregation stand in for a full outer join."""
    sides = [
        ranked(hits.select("query_id", "chunk_id", "score")).select("query_id", "chunk_id", (1.0 / (RRF_K + F.col("rank"))).alias("part"), F.lit(name).alias("side"))
        for hits, name in ((vector_hits.where(F.col("score") >= min_score), "vector"), (keyword_hits, "keyword"))
    ]
    both = sides[0].unionByName(sides[1]).groupBy("query_id", "chunk_id")
    return both.agg(F.sum("part").alias("score"), F.when(F.count_distinct("side") > 1, "both").otherwise(F.min("side")).alias("source"))


def merge_graph(hits: DataFrame, graph_hits: DataFrame) -> DataFrame:
    """Graph hits (query_id, chunk_id, score) beside hits with a source: greater score and `both` where they meet, else appended."""
    g = graph_hits.select("query_id", "chunk_id", F.col("score").alias("gscore"))
    joined = hits.select("query_id", "chunk_id", "score", "source").join(g, ["query_id", "chunk_id"], "full_outer")
    source = F.when(F.col("score").isNull(), "graph").when(F.col("gscore").isNull(), F.col("source")).otherwise("both")
    return joined.select("query_id", "chunk_id", F.greatest("score", "gscore").alias("score"), source.alias("source"))


def settled(score: Column) -> Column:
    """Nine places. What is within 1e-11 of an edge goes up, so that the order of additions can't change a score."""
    return F.round(score + F.lit(1e-11), 9)


def keyword_scored(hits: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, query, content, ...) plus keyword_score; as they are if they have it."""
    if "keyword_score" in hits.columns:
        return hits
    # A chunk of several hits is tokenized once.
    rows = forward(hits.select(F.lit(0).alias("kb_id"), "chunk_id", "content").dropDuplicates(["chunk_id"]))
    scores = keyword_scores(hits, hits.select("query_id", "query").dropDuplicates(["query_id"]), rows)
    return hits.join(scores, ["query_id", "chunk_id"])


def _hybrid(score: Column) -> Column:
    return settled(SCORE_WEIGHT * F.greatest(score, F.lit(0.0)) + KEYWORD_WEIGHT * F.col("keyword_score"))


def hybrid_rerank(hits: DataFrame, top_k: int) -> DataFrame:
    """hits with query and content, or keyword_score: 0.65 x score (not below 0) + 0.35 x keyword score; the best top_k of each query."""
    return ranked(keyword_scored(hits).withColumn("score", _hybrid(F.col("score"))).drop("keyword_score")).where(F.col("rank") <= top_k)


def no_rerank(hits: DataFrame, top_k: int) -> DataFrame:
    return ranked(hits).where(F.col("rank") <= top_k)


def llm_rerank(hits: DataFrame, top_k: int) -> DataFrame:
    """hits with a model's answer per query: `{"scores": [...]}` out of 10, one for each candidate in rank order; otherwise hybrid."""
    scores = F.from_json(lenient_json(F.col("answer")), "scores array<double>")["scores"]
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    given = ranked(keyword_scored(hits).withColumn("_scores", scores)).withColumn("_n", n)
    fits = F.col("_scores").isNotNull() & (F.size("_scores") == F.col("_n"))
    new = F.when(fits, F.element_at("_scores", F.col("rank")) / 10).otherwise(_hybrid(F.col("score")))
    return ranked(given.withColumn("score", settled(new)).drop("_scores", "_n", "keyword_score")).where(F.col("rank") <= top_k)


def api_rerank(hits: DataFrame, top_k: int) -> DataFrame:
    """hits with an interface's answer per query: `results` of (index, relevance_score) replace scores, indices out of range are
    dropped and what isn't named goes; a query without any usable result falls back to hybrid."""
    kind = T.StructType([T.StructField("results", T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("relevance_score", T.DoubleType())])))])
    base = ranked(keyword_scored(hits)).withColumn("_results", F.from_json("answer", kind)["results"])
    mine = F.filter("_results", lambda r: r["index"] == F.col("rank") - 1)
    named = base.withColumn("_score", F.get(mine, F.lit(0))["relevance_score"])
    usable = F.max(F.col("_score").isNotNull()).over(Window.partitionBy("query_id"))
    named = named.withColumn("_usable", usable).where(~F.col("_usable") | F.col("_score").isNotNull())
    new = F.when(F.col("_usable"), F.col("_score")).otherwise(_hybrid(F.col("score")))
    out = named.withColumn("score", settled(new)).withColumn("source", F.when(F.col("_usable"), "rerank").otherwise(F.col("source")))
    return ranked(out.drop("_results", "_score", "_usable", "keyword_score")).where(F.col("rank") <= top_k)


RERANKERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"none": no_rerank, "hybrid": hybrid_rerank, "llm": llm_rerank, "rerank_model": api_rerank}


def upper_medians(values: DataFrame, keys: list[str], column: str, ranges: int = 1 << 12, times: str | None = None) -> DataFrame:
    """(keys, n, low, high, mean, median): of the n values of each group that aren't null, the one with n / 2 before it, exactly.

    Values are counted in even ranges between a group's least and greatest; the counts say which range the median is in, and the
    different values of that range alone are counted again. No group's values are collected or sorted in one task, and equal ones are one
    row. values are read three times and should be stored or cheap. times is a column that says how many values a row stands for.
    """
    many = (F.col(times) if times else F.lit(1)).cast("long")
    some = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_x"), many.alias("_w"))
    mean = F.sum(F.col("_x") * F.col("_w")) / F.sum("_w") if times else F.avg("_x")
    found = checkpointed(some.groupBy(*keys).agg(F.sum("_w").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"), mean.alias("mean")))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    alike = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))  # also null keys, and none
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("_x") - F.col("low")) / (F.col("high") - F.col("low")) * ranges)).otherwise(0).cast("long")
    dealt = some.join(found.select(*named, "n", "low", "high"), alike)
    dealt = dealt.select(*keys, "_x", "_w", "n", place.alias("_range"))

    def holding(counted: DataFrame, by: str, start: str | None) -> DataFrame:
        """Of each group the row in whose count the median falls, with the number of values before it."""
        w = Window.partitionBy(*keys).orderBy(by)
        before = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c") + (F.col(start) if start else F.lit(0))
        middle = F.floor(F.col("n") / 2)
        return counted.withColumn("_before", before).where((F.col("_before") <= middle) & (middle < F.col("_before") + F.col("_c")))

    counts = dealt.groupBy(*keys, "n", "_range").agg(F.sum("_w").alias("_c"))  # ranges + 1 rows a group at most
    hit = checkpointed(holding(counts, "_range", None).select(*named, F.col("_range").alias("_r"), F.col("_before").alias("_start")))
    inside = dealt.join(hit, alike & (F.col("_range") == F.col("_r")))
    inside = inside.groupBy(*keys, "n", "_start", "_x").agg(F.sum("_w").alias("_c"))
    medians = holding(inside, "_x", "_start").select(*named, F.col("_x").alias("median"))
    return found.join(medians, alike).select(*keys, "n", "low", "high", "mean", "median")


def score_distribution(hits: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """count, min, max, avg and p50 (the upper median) of scores, to four places, and the suggested threshold band. times: how many hits a
    row stands for."""

    def twentieth(c: Column) -> Column:
        return F.floor(c * 20 + F.lit(0.5)) / 20

    return upper_medians(hits, keys, "score", times=times).select(
        *keys,
        "n",
        *(round4(F.col(c)).alias(a) for c, a in (("low", "min_score"), ("high", "max_score"), ("mean", "avg_score"), ("median", "p50_score"))),
        round4(F.greatest(F.lit(0.0), twentieth(F.col("mean")))).alias("band_low"),
        round4(F.least(F.lit(1.0), twentieth(F.col("median") + (F.col("high") - F.col("median")) * 0.3))).alias("band_high"),
    )
