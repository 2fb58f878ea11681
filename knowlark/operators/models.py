"""Steps that a model answers, as plans: a caller's function takes a prompt and gives a text, in Arrow batches on the executors.

The prompts, the fallbacks and what becomes of an answer are here; a model that fails or says nothing never ends a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowlark.functions.text import lenient_json, strip

Model = Callable[[str], str | None]
#: Characters of a rewritten query and of a hypothetical passage. Fixed values.
REWRITTEN, PASSAGE = 200, 400


def ask(rows: DataFrame, prompt: Column, model: Model, name: str = "answer") -> DataFrame:
    """rows plus `name`: the model's trimmed answer to each row's prompt; null where it fails or is blank."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    told = (model(text or "") or "").strip()
                except Exception:  # noqa: BLE001  any failure is no answer
                    told = ""
                out.append(told or None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], [*batch.schema.names[:-1], name])

    return rows.withColumn(name, prompt).mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def rewrite(queries: DataFrame, model: Model, history: DataFrame | None = None) -> DataFrame:
    """queries (query_id, query, ...) plus search: the query that a model made of it and of its history (query_id, turn, role, text), cut to
    200 characters, or the query itself."""
    prompt = F.concat(F.lit("Rewrite this question as a search query: "), F.coalesce("query", F.lit("")))
    asked = queries
    if history is not None:
        line = F.concat("role", F.lit(": "), "text", F.lit("\n"))
        said = history.where("text is not null").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").alias("_said"))
        asked = queries.join(said, "query_id", "left")
        prompt = F.concat(F.when(F.col("_said").isNotNull(), F.concat(F.lit("Said before:\n"), "_said", F.lit("\n"))).otherwise(""), prompt)
    told = ask(asked, prompt, model, "_told").drop("_said")
    return told.withColumn("search", F.coalesce(F.substring("_told", 1, REWRITTEN), F.col("query"))).drop("_told")


def hypothetical(queries: DataFrame, model: Model, on: str = "search") -> DataFrame:
    """queries plus passage: what a document that answers the query might say, cut to 400 characters; the query itself without one. It
    is for the vector side alone: words are searched by the query."""
    told = ask(queries, F.concat(F.lit("Write a short passage that answers: "), F.coalesce(on, F.lit(""))), model, "_told")
    return told.withColumn("passage", F.coalesce(F.substring("_told", 1, PASSAGE), F.col(on))).drop("_told")


def merge_decision(answer: Column) -> Column:
    """True if a model's answer says `{"merge": true}`, false if it says otherwise, null if it says neither."""
    said = F.lower(F.trim(F.get_json_object(lenient_json(answer), "$.merge")))
    return F.when(said.isNotNull(), said == "true")


def decide_merges(pairs: DataFrame, model: Model, merge: float = 0.92, band: float = 0.15) -> DataFrame:
    """pairs (a, b, name_a, name_b, similarity) plus same: true from `merge`, a model's decision in the band below it, else false."""
    unsure = (F.col("similarity") < merge) & (F.col("similarity") >= merge - band)
    prompt = F.concat(F.lit('Do both names mean one thing? Answer {"merge": true} or {"merge": false}.\nfirst: '), "name_a", F.lit("\nsecond: "), "name_b")
    told = ask(pairs.where(unsure), prompt, model, "_told")
    decided = told.withColumn("same", F.coalesce(merge_decision(F.col("_told")), F.lit(False))).drop("_told")
    return pairs.where(~unsure).withColumn("same", F.col("similarity") >= merge).unionByName(decided)


def prompt_batches(chunks: DataFrame, size: int = 4) -> DataFrame:
    """(kb_id, batch_id, chunk_ids, prompt) of chunks (kb_id, batch_id, chunk_id, content) that share a call, in order."""
    w = Window.partitionBy("kb_id", "batch_id").orderBy("chunk_id")
    numbered = chunks.withColumn("_k", F.row_number().over(w))
    part = F.concat(F.lit("[passage "), F.col("_k").cast("string"), F.lit("]\n"), "content", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("_k", "chunk_id", part.alias("part"))))
    made = numbered.groupBy("kb_id", "batch_id").agg(rows.alias("_rows"))
    return made.select("kb_id", "batch_id", F.transform("_rows", lambda r: r["chunk_id"]).alias("chunk_ids"), F.array_join(F.transform("_rows", lambda r: r["part"]), "").alias("prompt"))


def trimmed(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))
