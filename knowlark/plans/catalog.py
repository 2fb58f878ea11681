"""How the driver's tables stand in for a knowledge base, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlark.operators.layout import spread


#: Tables whose rows are much work each.
HEAVY = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in HEAVY else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of four knowledge bases."""
    kb = F.substring("source", 4, 9).cast("long") % 4
    return table(spark, sf_dir, "documents").select(kb.alias("kb_id"), F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("kb_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is a query."""
    return vectors(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")


SUPPLIER = 1_000_000_000


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers; suppliers' ids are moved behind the parts'."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.lit(1).cast("long").alias("kb_id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
    return parts.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("entity_id"), F.lit(1).cast("long").alias("kb_id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("entity_type")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation per line item, from its part to its supplier."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("relation_id"),
        F.lit(1).cast("long").alias("kb_id"),
        F.col("l_partkey").alias("source_id"),
        (F.col("l_suppkey") + SUPPLIER).alias("target_id"),
        F.col("l_returnflag").alias("relation_type"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part was seen in the document whose id is its order's number modulo the number of documents; the same link comes again."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), (F.col("l_orderkey") % documents).cast("long").alias("chunk_id"))


def entity_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different links, dealt by chunk before they are made distinct, so that a join with chunks finds them where they are."""
    return links(spark, sf_dir).repartition("chunk_id").distinct()


CHUNKS = "chunks as (select cast(substr(source, 4) as bigint) % 4 as kb_id, doc_id as chunk_id, doc_id, text as content from documents)"
QUERIES = "queries as (select item_id as query_id, text as query from benchmark)"
VECTORS = "vectors as (select cast(label as bigint) as kb_id, vec_id as chunk_id, cast(embedding as double[]) as vec from embeddings)"
QUERY_VECTORS = "qvec as (select chunk_id as query_id, vec as q from vectors where chunk_id % 50 = 0)"
ENTITIES = f"""entities as (
  select p_partkey as entity_id, 1::bigint as kb_id, p_name as name, p_type as entity_type from part
  union all select s_suppkey + {SUPPLIER}, 1::bigint, s_name, 'SUPPLIER' from supplier)"""
RELATIONS = f"""relations as (
  select cast(l_orderkey * 8 + l_linenumber as bigint) as relation_id, 1::bigint as kb_id, l_partkey as source_id,
         l_suppkey + {SUPPLIER} as target_id, l_returnflag as relation_type from lineitem)"""
ENTITY_CHUNK = "entity_chunk as (select distinct l_partkey as entity_id, cast(l_orderkey % (select count(*) from documents) as bigint) as chunk_id from lineitem)"
#: Tokens of Latin text; the tables hold no Han characters.
TOKENS = "list_transform(regexp_extract_all({}, '[a-zA-Z0-9]+'), lambda x: 'w' || lower(x))"
SIZED = f"""sized as (
  select kb_id, chunk_id, terms, len(terms) as dl from (select kb_id, chunk_id, {TOKENS.format("content")} as terms from chunks) where len(terms) > 0)"""
BM25 = f"""
  stats as (select kb_id, count(*) as n_chunks, avg(dl) as avg_len from sized group by 1),
  asked as (select distinct query_id, unnest({TOKENS.format("query")}) as term from queries),
  posted as (
    select kb_id, chunk_id, dl, term, count(*) as tf from (select kb_id, chunk_id, dl, unnest(terms) as term from sized)
    where term in (select term from asked) group by all),
  df as (select kb_id, term, count(*) as df from posted group by all),
  bm as (
    select query_id, p.kb_id, chunk_id,
           round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(1e-6, avg_len)))), 9) as score
    from posted p join df on p.kb_id = df.kb_id and p.term = df.term join stats s on p.kb_id = s.kb_id join asked a on a.term = p.term
    group by all)"""
EMBED = """
  {name}_tf as (select kb_id, chunk_id, term, count(*) as tf from (select kb_id, chunk_id, unnest(terms) as term from {source}) group by all),
  {name}_h as (
    select term, list_reduce(list_transform(string_split(term, ''), lambda c: cast(ascii(c) as bigint)), lambda a, c: (a * 31 + c) % 4294967296, 0::bigint) as h
    from (select distinct term from {name}_tf)),
  {name}_raw as (
    select kb_id, chunk_id, cast(h % 512 as integer) as slot,
           sum(tf * case when h >= 2147483648 then -1 else 1 end * least(2.5, 0.8 + (length(term) - 1) * 0.25)) as raw
    from {name}_tf join {name}_h using (term) group by all),
  {name} as (
    select kb_id, chunk_id, slot, case when n = 0 then raw else raw / n end as value
    from (select *, sqrt(sum(raw * raw) over (partition by kb_id, chunk_id)) as n from {name}_raw))"""
