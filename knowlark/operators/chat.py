"""Conversations: history, context for a prompt, citations, export, and answers' structured parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW = 200


def history_tail(messages: DataFrame, last: int) -> DataFrame:
    """The last messages of each conversation (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).drop("_n")


def _joined(items: Column, order: str, text: str, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x[text]), glue)


def build_context(hits: DataFrame) -> DataFrame:
    """(query_id, context) of hits (query_id, query, rank, doc_name, position, source, content): numbered sources, then the question.
    A query without hits isn't in hits; empty_context() is its text."""
    graph = F.when(F.col("source") == "graph", "【图谱召回】").otherwise("")
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 来源："), "doc_name", F.lit("（第"), (F.col("position") + 1).cast("string"), F.lit("段）"), graph, F.lit("\n"), "content")
    made = hits.groupBy("query_id", "query").agg(_joined(F.struct("rank", part.alias("part")), "rank", "part", "\n\n").alias("parts"))
    return made.select("query_id", F.concat("parts", F.lit("\n\n【问题】"), "query").alias("context"))


def empty_context(query: Column) -> Column:
    return F.concat(F.lit("（知识库中没有检索到相关资料）\n\n【问题】"), query)


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Sources that answers (query_id, answer) cite as [n], each once by first mention; n from 1 to the query's number of hits."""
    found = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1)).alias("pos", "digits"))
    number = found.select("query_id", "pos", F.expr("try_cast(digits as int)").alias("rank")).where("rank >= 1")
    first = number.groupBy("query_id", "rank").agg(F.min("pos").alias("pos"))
    cited = first.join(hits, ["query_id", "rank"])
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return cited.select("query_id", order.alias("ord"), F.col("rank").alias("cited"), "chunk_id", "doc_name", (F.col("position") + 1).alias("paragraph"), F.substring("content", 1, PREVIEW).alias("preview"))


def export_markdown(messages: DataFrame) -> DataFrame:
    """(conv_id, content): each conversation as Markdown, turns in order."""
    part = F.concat(F.lit("## "), F.when(F.col("role") == "user", "用户").when(F.col("role") == "assistant", "助手").otherwise(F.col("role")), F.lit("\n\n"), "text")
    return messages.groupBy("conv_id").agg(_joined(F.struct("turn", part.alias("part")), "turn", "part", "\n\n").alias("content"))


def contextual_headers(batches: DataFrame) -> DataFrame:
    """(batch_id, number, head) from a model's lines `number: head`; other lines are ignored, of a number's lines the last counts."""
    lines = batches.select("batch_id", F.posexplode(F.split("answer", "\n")).alias("pos", "line"))
    pattern = r"^\s*(\d+)[:：]\s*(.+)$"
    parsed = lines.where(F.col("line").rlike(pattern)).select("batch_id", "pos", F.regexp_extract("line", pattern, 1).try_cast("int").alias("number"), F.trim(F.regexp_extract("line", pattern, 2)).alias("head"))
    return parsed.where("number is not null").groupBy("batch_id", "number").agg(F.max_by("head", "pos").alias("head"))
