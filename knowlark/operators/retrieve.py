"""Hybrid retrieval, batched over a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowlark.operators.fusion import RERANKERS, merge_graph, minmax, rrf
from knowlark.operators.layout import checkpointed
from knowlark.operators.lexical import bm25_rows, keyword_scores, store
from knowlark.operators.vector import hash_search


@dataclass(frozen=True)
class Params:
    """Knobs of a retrieval; values are clamped as a request's would be."""

    top_k: int = 8
    multiplier: int = 3
    min_score: float = 0.1
    hybrid: bool = True
    rerank: str = "hybrid"
    score_norm: str = "none"

    @classmethod
    def of(cls, **given: object) -> Params:
        """A request's knobs, of which null ones take their defaults."""
        return cls(**{k: v for k, v in given.items() if v is not None})

    @property
    def limit(self) -> int:
        return max(1, min(50, self.top_k))

    @property
    def recall(self) -> int:
        return min(100, self.limit * min(5, max(1, self.multiplier)))


def stages(chunks: DataFrame, queries: DataFrame, params: Params = Params(), graph_hits: DataFrame | None = None, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """vector, keyword, fused and reranked hits (query_id, chunk_id, score, source, ...) of chunks (kb_id, chunk_id, content) for
    queries (query_id, query). Every stage is one plan over all queries. If queries have a column `search`, words and vectors are searched by
    it (a rewritten query); if they have `passage`, vectors by that (a hypothetical document). Reranking goes by the query. rows are
    the chunks' stored lexical.forward() rows; without them chunks are tokenized here, once."""
    by_words = queries.withColumn("query", F.col("search")) if "search" in queries.columns else queries
    by_vector = queries.withColumn("query", F.col("passage")) if "passage" in queries.columns else by_words
    store_min = 0.0 if params.hybrid else params.min_score
    rows = store(chunks) if rows is None else rows
    vector = hash_search(rows, by_vector, params.recall, store_min).select("query_id", "chunk_id", "score")
    if params.score_norm == "minmax":
        vector = minmax(vector)
    # Hits are few: held once, they serve every stage behind them, and texts are joined to the best alone.
    vector = checkpointed(vector)
    if params.hybrid:
        keyword = checkpointed(bm25_rows(rows, by_words, params.recall).select("query_id", "chunk_id", "score"))
        fused = rrf(vector, keyword, params.min_score)
    else:
        keyword = vector.limit(0)
        fused = vector.where(F.col("score") >= params.min_score).withColumn("source", F.lit("vector"))
    if graph_hits is not None:
        fused = merge_graph(fused, graph_hits)
    fused = checkpointed(fused)
    scores = keyword_scores(fused, queries, rows)
    best = checkpointed(RERANKERS[params.rerank](fused.join(scores, ["query_id", "chunk_id"]), params.limit))
    reranked = best.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    return {"vector": vector.withColumn("source", F.lit("vector")), "keyword": keyword.withColumn("source", F.lit("keyword")), "fused": fused, "reranked": reranked}


def retrieve(chunks: DataFrame, queries: DataFrame, params: Params = Params(), graph_hits: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    return stages(chunks, queries, params, graph_hits, rows)["reranked"]


def parent_expand(chunks: DataFrame) -> DataFrame:
    """content becomes meta's `parent` where there is one."""
    return chunks.withColumn("content", F.coalesce(F.get_json_object("meta", "$.parent"), F.col("content")))


def doc_names(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_name: meta's fileName, the document's file name, or 文档 and its id."""
    named = chunks.join(documents.select("doc_id", "file_name"), "doc_id", "left")
    name = F.coalesce(F.get_json_object("meta", "$.fileName"), F.col("file_name"), F.concat(F.lit("文档"), F.col("doc_id").cast("string")))
    return named.withColumn("doc_name", name).drop("file_name")


def known_items(documents: DataFrame, items: DataFrame, width: int = 8) -> DataFrame:
    """(query_id, doc_id): the first document (doc_id, text) whose text holds an item (query_id, query) as it is.

    Documents and items meet by an equi-join on the hash of a few consecutive words, behind the item's first one, which may be glued to
    others where it stands; then the whole item is compared.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    sized = items.select("query_id", "query", words("query").alias("w")).where(F.size("w") > 0)
    least = sized.agg(F.min(F.size("w"))).first()[0] or 1
    begin, run = (2, min(width, least - 2)) if least > 2 else (1, 1)
    asked = sized.select("query_id", "query", F.xxhash64(F.slice("w", begin, run)).alias("key"))
    split = documents.select("doc_id", "text", F.explode(F.array(words("text"))).alias("w")).where(F.size("w") >= run)
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - run + 1), lambda i: F.xxhash64(F.slice("w", i, F.lit(run)))))
    spots = split.select("doc_id", F.explode(keys).alias("key")).join(asked, "key").select("query_id", "doc_id", "query")
    found = spots.join(documents.select("doc_id", "text"), "doc_id").where(F.contains("text", "query"))
    return found.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))


def hit_at_k(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: questions, hits among them, and the rate in percent to one place. expected is (query_id, doc_id)."""
    found = hits.select("query_id", "doc_id").join(expected, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    each = expected.select("query_id").distinct().join(found, "query_id", "left")
    total, good = F.count(F.lit(1)), F.count("hit")
    return each.agg(total.alias("total"), good.alias("hits"), F.when(total == 0, 0.0).otherwise(F.floor(good * 1000 / total + 0.5) / 10).alias("hit_rate"))
