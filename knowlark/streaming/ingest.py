"""Incremental ingest: a stream of documents to chunks, postings and embeddings, one set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knowlark.operators.chunk import chunked
from knowlark.operators.lexical import postings
from knowlark.operators.vector import hash_embed

DOCUMENT = "doc_id long, kb_id long, text string"
TABLES = ("chunks", "postings", "vectors", "documents")


def prepared(docs: DataFrame, strategy: str = "fixed", size: int = 600, overlap: int = 100) -> dict[str, DataFrame]:
    """chunks, postings and sparse vectors of docs (doc_id, kb_id, text). A chunk's id is a hash of its document and place, so a
    retry gives the same ids."""
    parts = chunked(docs.select("doc_id", "text"), strategy, size, overlap).join(docs.select("doc_id", "kb_id"), "doc_id")
    chunks = parts.withColumn("chunk_id", F.xxhash64("kb_id", "doc_id", "position"))
    owner = chunks.select("chunk_id", "doc_id")
    return {"chunks": chunks, "postings": postings(chunks).join(owner, "chunk_id"), "vectors": hash_embed(chunks).join(owner, "chunk_id")}


def write_batch(docs: DataFrame, batch: int, folder: str, **options) -> None:
    """Write a batch's tables to its own folder, whole each time: a batch that runs again after a failure replaces itself.

    Of a document's several versions in one batch the one with the greatest hash stays. The table of documents comes last: a document
    counts as INDEXED with its batch, and with nothing in the other tables if its text is blank; one without an id or kb is FAILED.
    """
    version = F.xxhash64("kb_id", "text")
    docs = docs.groupBy("doc_id").agg(F.max_by(F.struct("kb_id", "text"), version).alias("_d")).select("doc_id", "_d.kb_id", "_d.text")
    docs.persist()
    bad = F.when(F.col("doc_id").isNull(), "no doc_id").when(F.col("kb_id").isNull(), "no kb_id")
    for name, table in prepared(docs.where(bad.isNull()), **options).items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    _write_changes(docs.sparkSession, docs, batch, folder)
    status = F.when(bad.isNull(), "INDEXED").otherwise("FAILED")
    docs.select("doc_id", "kb_id", status.alias("status"), bad.alias("error_message")).write.mode("overwrite").parquet(f"{folder}/documents/batch={batch}")
    docs.unpersist()


def ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Start an ingest of Parquet documents that arrive in source. It ends when all that is there has been read."""
    stream = spark.readStream.schema(DOCUMENT).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, folder, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, kb_id, status, error_message, batch) of each document's latest batch."""
    rows = spark.read.parquet(f"{folder}/documents")
    latest = F.max_by(F.struct("kb_id", "status", "error_message"), "batch").alias("_d")
    return rows.groupBy("doc_id").agg(latest, F.max("batch").alias("batch")).select("doc_id", "_d.kb_id", "_d.status", "_d.error_message", "batch")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with the latest batch of each document: re-ingesting a document replaces it, also where nothing is left of it."""
    newest = documents(spark, folder).where("status = 'INDEXED'").select("doc_id", "batch")
    return spark.read.parquet(f"{folder}/{name}").join(newest, ["doc_id", "batch"], "left_semi").drop("batch")


def pending(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Documents of the source that no batch has taken yet, or that failed: (doc_id, status)."""
    known = documents(spark, folder).select("doc_id", "status")
    there = spark.read.schema(DOCUMENT).parquet(source).select("doc_id").distinct().join(known, "doc_id", "left")
    return there.select("doc_id", F.coalesce("status", F.lit("PENDING")).alias("status")).where("status <> 'INDEXED'")


def without(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows whose document isn't among the deleted ones (doc_id)."""
    return rows.join(deleted.select("doc_id"), "doc_id", "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _write_changes(spark: SparkSession, docs: DataFrame, batch: int, folder: str) -> None:
    """Write what a batch changes in the corpus statistics: its chunks and terms count one more, those of the versions that its documents
    replace, with a blank or a failed one too, one less. Versions of earlier batches alone are looked at, so a batch that runs again writes the same."""
    changes = spark.read.parquet(f"{folder}/postings/batch={batch}").select("kb_id", "chunk_id", "term", "tf", F.lit(1).alias("sign"))
    if _exists(spark, f"{folder}/documents"):
        known = spark.read.parquet(f"{folder}/documents").where((F.col("batch") < batch) & (F.col("status") == "INDEXED"))
        taken = known.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("batch").alias("batch"))
        old = spark.read.parquet(f"{folder}/postings").where(F.col("batch") < batch).join(taken, ["doc_id", "batch"], "left_semi")
        changes = changes.unionByName(old.select("kb_id", "chunk_id", "term", "tf", F.lit(-1).alias("sign")))
    changes = changes.persist()
    terms = changes.groupBy("kb_id", "term").agg(F.sum("sign").alias("df")).where("df <> 0")
    terms.write.mode("overwrite").parquet(f"{folder}/frequency/batch={batch}")
    chunks = changes.groupBy("kb_id", "chunk_id", "sign").agg(F.sum("tf").alias("dl"))
    totals = chunks.groupBy("kb_id").agg(F.sum("sign").alias("n_chunks"), F.sum(F.col("sign") * F.col("dl")).alias("tokens"))
    totals.write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")
    changes.unpersist()


def _summed(spark: SparkSession, folder: str, name: str, keys: list[str], values: list[str]) -> DataFrame:
    """The sum of a table of changes: the latest snapshot and the batches behind it."""
    rows, base = spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}_snapshots"
    if _exists(spark, base):
        whole = spark.read.parquet(base)
        last = whole.agg(F.max("upto")).first()[0]
        rows = rows.where(F.col("batch") > last).select(*keys, *values).unionByName(whole.where(F.col("upto") == last).select(*keys, *values))
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """(kb_id, term, df) of the corpus as it stands."""
    return _summed(spark, folder, "frequency", ["kb_id", "term"], ["df"]).where("df > 0")


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """(kb_id, n_chunks, avg_len) of the corpus as it stands."""
    found = _summed(spark, folder, "totals", ["kb_id"], ["n_chunks", "tokens"]).where("n_chunks > 0")
    return found.select("kb_id", "n_chunks", (F.col("tokens") / F.col("n_chunks")).alias("avg_len"))


def compact(spark: SparkSession, folder: str) -> None:
    """Fold the changes so far into a snapshot, so that reading sums few rows. A snapshot counts once it is whole; batches that come meanwhile
    stand behind it."""
    for name, keys, values in (("frequency", ["kb_id", "term"], ["df"]), ("totals", ["kb_id"], ["n_chunks", "tokens"])):
        upto = spark.read.parquet(f"{folder}/{name}").agg(F.max("batch")).first()[0]
        if upto is not None:
            summed = _summed(spark, folder, name, keys, values)
            summed.where(" or ".join(f"{v} <> 0" for v in values)).write.mode("overwrite").parquet(f"{folder}/{name}_snapshots/upto={upto}")


def incremental_stats(old: DataFrame, added: DataFrame) -> DataFrame:
    """Corpus statistics (kb_id, n_chunks, avg_len) with those of new chunks: exact, without counting anything twice."""
    both = old.unionByName(added)
    total = both.groupBy("kb_id").agg(F.sum("n_chunks").alias("n_chunks"), F.sum(F.col("n_chunks") * F.col("avg_len")).alias("_all"))
    return total.select("kb_id", "n_chunks", (F.col("_all") / F.col("n_chunks")).alias("avg_len"))
