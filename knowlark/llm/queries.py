"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlark.llm.alignment import counted
from knowlark.llm.decontaminate import decontaminate
from knowlark.llm.exact_dedup import exact_dedup
from knowlark.llm.hard_negatives import mine
from knowlark.llm.mixing import mix
from knowlark.llm.packing import pack
from knowlark.llm.quality import quality
from knowlark.llm.sharding import shard
from knowlark.llm.simhash import near_duplicates
from knowlark.llm.suffix_dedup import suffix_dedup
from knowlark.llm.token_counts import token_counts
from knowlark.llm.toxicity import toxicity
from knowlark.llm.url_filter import filter_urls
from knowlark.operators.layout import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # in the files' own order


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: (verdict, host, path). Fixed values.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    rows = counted(_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    return rows.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where("label is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = rows.where(finite).select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), whole.alias("vec"))
    scores = (F.col(c).cast("long").alias(c) for c in ("positive_score", "negative_score"))
    return mine(vectors, F.col("id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", *scores)


def queries() -> dict[str, Query]:
    ops = (
        op1_exact_dedup,
        op2_quality,
        op3_toxicity,
        op4_mixing,
        op5_decontaminate,
        op6_sharding,
        op7_simhash,
        op8_suffix_dedup,
        op9_token_counts,
        op10_url_filter,
        op11_packing,
        op12_alignment,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
            with d as (
              select doc_id, length(coalesce(text, '')) as points,
                     regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
              from documents),
            w as (
              select doc_id, norm,
                     first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id,
                     row_number() over (partition by norm order by points desc, doc_id) as rn,
                     count(*) over (partition by norm) as group_size
              from d)
            select doc_id, keep_id, group_size, rn = 1 as kept, sha256(norm) as text_sha256 from w""",
        "op13_hard_negatives": """
            with v as (
              select vec_id as id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                     list_transform(embedding, lambda x: floor(cast(x as double) * 256)) as vec
              from embeddings
              where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            s as (
              select a.id as anchor_id, b.id, a.label = b.label as same,
                     cast(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])) as bigint) as score
              from v a join v b on a.id % 100 = 0 and a.id <> b.id),
            pos as (
              select anchor_id, id as positive_id, score as positive_score from s where same
              qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
            select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank,
                   id as negative_id, positive_score, score as negative_score
            from pos p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
            qualify rank <= 10""",
        "op5_decontaminate": r"""
            with d as (
              select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
              from documents),
            b as (
              select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
              from benchmark),
            items as (select cast(item_id as varchar) as item, w, least(10, len(w)) as k from b where len(w) > 0),
            windows as (
              select distinct item, k, array_to_string(w[p:p + k - 1], ' ') as win
              from (select item, w, k, unnest(range(1, len(w) - k + 2)) as p from items)),
            spots as (
              select doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') as win
              from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p
                    from d cross join (select distinct k from items) where len(w) >= k)),
            found as (select s.doc_id, s.p, s.k, i.item from spots s join windows i on s.k = i.k and s.win = i.win),
            hits as (select doc_id, count(distinct h) as n_hit from (select doc_id, unnest(range(p, p + k)) as h from found) group by 1),
            names as (
              select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha
              from (select distinct doc_id, item from found) group by 1)
            select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
                   coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
            from d left join hits using (doc_id) left join names using (doc_id)""",
    }
