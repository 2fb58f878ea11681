"""Registered queries: tokens, lexical and vector search, fusion, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlark.functions.text import STOP_BIGRAMS, STOP_CHARS, tokens
from knowlark.functions.vectors import l2_normalize
from knowlark.operators import fusion, index, knn_graph, lexical, retrieve, vector
from knowlark.operators.layout import checkpointed
from knowlark.plans import catalog as c
from knowlark.plans.catalog import BM25, CHUNKS, EMBED, QUERIES, QUERY_VECTORS, SIZED, TOKENS, VECTORS

FIXED_QUERY = "the nation of this and edition with heron"
#: Han sentences for the tokenizer, as the driver's tables hold none.
HAN = ((1, "数据库索引可以加速查询,我们使用PostgreSQL"), (2, "今天天气非常好"), (3, "的"), (4, ""), (5, "Wörld 2024 倒排"))


def one_query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, FIXED_QUERY)], "query_id long, query string")


def bm25_search(spark, sf):
    chunks = c.chunks(spark, sf).withColumn("kb_id", F.lit(0).cast("long"))
    return lexical.bm25(chunks, one_query(spark), 10).select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_batch(spark, sf):
    return lexical.bm25(c.chunks(spark, sf), c.queries(spark, sf), 10).select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_indexed(spark, sf):
    """bm25_batch from a stored index: postings in blocks, whose bounds say which are read."""
    made = index.stored(lexical.store(c.chunks(spark, sf)))
    six = F.round(F.col("score") * 1e6) / 1e6  # as the SQL's engine rounds; F.round(score, 6) takes the decimal digits' edge
    return index.search(made, c.queries(spark, sf), 10).select("query_id", "kb_id", "chunk_id", six.alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_stats(spark, sf):
    posted = lexical.postings(c.chunks(spark, sf))
    return lexical.corpus_stats(lexical.lengths(posted)).select("kb_id", "n_chunks", F.round("avg_len", 6).alias("avg_len"))


def doc_freq(spark, sf):
    return lexical.document_frequency(lexical.postings(c.chunks(spark, sf)))


def term_freq(spark, sf):
    return lexical.postings(c.chunks(spark, sf))


def tokenize(spark, sf):
    rows = spark.createDataFrame(HAN, "doc_id long, text string").unionByName(c.table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    return rows.select("doc_id", F.array_join(F.sort_array(tokens(F.col("text"))), " ").alias("tokens"))


def _keyword_pairs(spark, sf):
    """One query beside every chunk."""
    return c.chunks(spark, sf).select(F.lit(1).cast("long").alias("query_id"), F.lit(FIXED_QUERY).alias("query"), "chunk_id", "content")


def keyword_score(spark, sf):
    return fusion.keyword_scored(_keyword_pairs(spark, sf)).select("chunk_id", fusion.settled(F.col("keyword_score")).alias("score"))


def vector_topk(spark, sf):
    return vector.search(c.vectors(spark, sf).withColumn("kb_id", F.lit(0).cast("long")), c.query_vectors(spark, sf), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def vector_retrieve(spark, sf):
    hits = vector.search(c.vectors(spark, sf), c.query_vectors(spark, sf), 24, 0.1)
    return hits.select("query_id", "kb_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _graph_vectors(spark, sf):
    return c.vectors(spark, sf).select(F.col("chunk_id").alias("id"), "vec")


def knn_links(spark, sf):
    """The graph of nearest neighbours: ten links of each vector."""
    return knn_graph.build(_graph_vectors(spark, sf)).where("rank <= 10").select("id", "other", "score", F.col("rank").cast("long").alias("rank"))


def knn_topk(spark, sf):
    """vector_topk's queries by walks over the graph."""
    rows = _graph_vectors(spark, sf)
    return knn_graph.search(knn_graph.build(rows), rows, c.query_vectors(spark, sf), 10)


def plain_retrieve(spark, sf):
    """Retrieval by vectors alone, with scaled scores."""
    params = retrieve.Params(hybrid=False, score_norm="minmax", rerank="none", min_score=0.2)
    return retrieve.retrieve(c.chunks(spark, sf), c.queries(spark, sf), params).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def l2_topk(spark, sf):
    return vector.nearest(c.vectors(spark, sf), c.query_vectors(spark, sf), 10).select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


def l2_norm(spark, sf):
    v = c.vectors(spark, sf).select("chunk_id", l2_normalize(F.transform("vec", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("chunk_id", F.posexplode("v").alias("i", "x")).select("chunk_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def ann_topk(spark, sf):
    return vector.ann_search(c.vectors(spark, sf), c.query_vectors(spark, sf), 10)


def hash_embed(spark, sf):
    return vector.hash_embed(c.chunks(spark, sf)).select("chunk_id", "slot", F.round("value", 6).alias("value"))


def hash_embed_sim(spark, sf):
    return vector.sparse_search(c.chunks(spark, sf), c.queries(spark, sf), 10).select("query_id", "kb_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _sides(spark, sf):
    found = retrieve.stages(c.chunks(spark, sf), c.queries(spark, sf))
    return found["vector"], found["keyword"]


def rrf_fusion(spark, sf):
    vec, key = _sides(spark, sf)
    return fusion.rrf(vec, key, 0.1).select("query_id", "chunk_id", fusion.settled(F.col("score")).alias("score"), "source")


def minmax_norm(spark, sf):
    return fusion.minmax(_sides(spark, sf)[0]).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def score_distribution(spark, sf):
    return fusion.score_distribution(_sides(spark, sf)[0], ["query_id"])


def similarity_distribution(spark, sf):
    """The distribution of all queries' positive scores with all vectors, in one group."""
    every = vector.score_counts(c.vectors(spark, sf), c.query_vectors(spark, sf))
    return fusion.score_distribution(checkpointed(every.select(F.lit("all").alias("scope"), "score", F.col("n").alias("times"))), ["scope"], "times")


def hybrid_rerank(spark, sf):
    hits = _keyword_pairs(spark, sf).withColumn("score", (F.col("chunk_id") % 7 - 2) / 10.0)
    return fusion.hybrid_rerank(hits, 20).select("chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_retrieve(spark, sf):
    return retrieve.retrieve(c.chunks(spark, sf), c.queries(spark, sf)).select("query_id", "chunk_id", "score", "source", F.col("rank").cast("long").alias("rank"))


def retrieve_stages(spark, sf):
    found = retrieve.stages(c.chunks(spark, sf), c.queries(spark, sf))
    out = [found[s].select("query_id", F.lit(s).alias("stage"), "chunk_id", fusion.settled(F.col("score")).alias("score"), "source") for s in ("vector", "keyword", "fused", "reranked")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def hit_at_k(spark, sf):
    """Known-item questions: an item's document is the first that holds it."""
    expected = retrieve.known_items(c.table(spark, sf, "documents"), c.queries(spark, sf))
    hits = retrieve.retrieve(c.chunks(spark, sf), c.queries(spark, sf)).select("query_id", F.col("chunk_id").alias("doc_id"))
    return retrieve.hit_at_k(hits, expected)


_TOP = "row_number() over (partition by {} order by score desc, chunk_id)"
_Q1 = f"queries as (select 1::bigint as query_id, '{FIXED_QUERY}' as query)"
_KW = f"""
  qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({TOKENS.format("query")}) as term from queries) group by all),
  qn as (select query_id, count(*) as n, sum(least(qtf, 2)) as total from qt group by 1),
  ct as (select chunk_id, term, count(*) as ctf from (select chunk_id, unnest(terms) as term from sized) group by all)"""
_KWS = """
    select query_id, chunk_id, 0.7 * count(*) / any_value(n) + 0.3 * sum(least(ctf, 2)) / any_value(total) as kw
    from qt join ct using (term) join qn using (query_id) group by all"""
_STAGES = f"""with {CHUNKS}, {QUERIES}, {SIZED}, {BM25},
  qsized as (select 0 as kb_id, query_id as chunk_id, {TOKENS.format("query")} as terms from queries),
  {EMBED.format(name="de", source="sized")}, {EMBED.format(name="qe", source="qsized")},
  sim as (
    select q.chunk_id as query_id, d.kb_id, d.chunk_id, round(sum(d.value * q.value), 6) as score
    from de d join qe q on d.slot = q.slot group by all having round(sum(d.value * q.value), 6) > 0),
  vec as (select query_id, chunk_id, score from sim qualify row_number() over (partition by query_id, kb_id order by score desc, chunk_id) <= 24),
  kwd as (select query_id, chunk_id, score from bm qualify row_number() over (partition by query_id, kb_id order by score desc, chunk_id) <= 24),
  parts as (
    select query_id, chunk_id, 1.0 / (60 + {_TOP.format("query_id")}) as part, 'vector' as side from vec where score >= 0.1
    union all select query_id, chunk_id, 1.0 / (60 + {_TOP.format("query_id")}) as part, 'keyword' from kwd),
  fused as (
    select query_id, chunk_id, sum(part) as score, case when count(distinct side) > 1 then 'both' else min(side) end as source from parts group by all),
  {_KW}, kws as ({_KWS}),
  rescored as (
    select f.query_id, f.chunk_id, round(0.65 * greatest(f.score, 0) + 0.35 * coalesce(kw, 0) + 1e-11, 9) as score, source
    from fused f left join kws using (query_id, chunk_id)),
  reranked as (select *, {_TOP.format("query_id")} as rank from rescored qualify rank <= 8)"""

SQL = {
    "bm25_search": f"""with chunks as (select 0::bigint as kb_id, doc_id as chunk_id, text as content from documents), {_Q1}, {SIZED}, {BM25}
        select chunk_id, round(score, 6) as score, {_TOP.format("query_id")} as rank from bm qualify rank <= 10""",
    "bm25_batch": f"""with {CHUNKS}, {QUERIES}, {SIZED}, {BM25}
        select query_id, kb_id, chunk_id, round(score, 6) as score, {_TOP.format("query_id, kb_id")} as rank from bm qualify row_number() over (partition by query_id, kb_id order by bm.score desc, chunk_id) <= 10""",
    "plain_retrieve": f"""{_STAGES}, strong as (select query_id, kb_id, chunk_id, score from sim where score >= 0.2),
          few as (select query_id, chunk_id, score from strong qualify row_number() over (partition by query_id, kb_id order by score desc, chunk_id) <= 24),
          w as (select *, min(score) over p as low, max(score) over p as high, count(*) over p as n from few window p as (partition by query_id)),
          m as (select query_id, chunk_id, case when n < 2 or high - low < 1e-9 then score else (score - low) / (high - low) end as score from w)
        select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by m.score desc, chunk_id) as rank from m where m.score >= 0.2
        qualify row_number() over (partition by query_id order by m.score desc, chunk_id) <= 8""",
    "bm25_stats": f"with {CHUNKS}, {SIZED} select kb_id, count(*) as n_chunks, round(avg(dl), 6) as avg_len from sized group by 1",
    "doc_freq": f"with {CHUNKS}, {SIZED} select kb_id, term, count(*) as df from (select distinct kb_id, chunk_id, unnest(terms) as term from sized) group by all",
    "term_freq": f"with {CHUNKS}, {SIZED} select kb_id, chunk_id, term, count(*) as tf from (select kb_id, chunk_id, unnest(terms) as term from sized) group by all",
    "tokenize": f"""with d as (
          select doc_id + 100 as doc_id, text from documents union all select * from (values {", ".join(f"({i}::bigint, '{t}')" for i, t in HAN)}) v(doc_id, text)),
          h as (select doc_id, {TOKENS.format("text")} as words, regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fa5}}]', '', 'g') as han from d)
        select doc_id, array_to_string(list_sort(list_concat(words, list_filter(flatten(list_transform(range(1, length(han) + 1), lambda i: [
            case when not contains('{STOP_CHARS}', substr(han, i, 1)) then 'c1' || substr(han, i, 1) end,
            case when i < length(han) and substr(han, i, 2) not in ({", ".join(f"'{b}'" for b in STOP_BIGRAMS)}) then 'c2' || substr(han, i, 2) end,
            case when i + 1 < length(han) then 'c3' || substr(han, i, 3) end])), lambda t: t is not null))), ' ') as tokens from h""",
    "keyword_score": f"""with {CHUNKS}, {_Q1}, {SIZED}, {_KW}, k as ({_KWS})
        select c.chunk_id, round(coalesce(kw, 0) + 1e-11, 9) as score from chunks c left join k using (chunk_id)""",
    "vector_topk": f"""with {VECTORS}, {QUERY_VECTORS}, s as (
          select query_id, chunk_id, round(list_sum(list_transform(list_zip(vec, q), lambda p: p[1] * p[2])), 6) as score from vectors, qvec)
        select query_id, chunk_id, score, {_TOP.format("query_id")} as rank from s where score > 0 qualify rank <= 10""",
    "vector_retrieve": f"""with {VECTORS}, {QUERY_VECTORS}, s as (
          select query_id, kb_id, chunk_id, round(list_sum(list_transform(list_zip(vec, q), lambda p: p[1] * p[2])), 6) as score from vectors, qvec)
        select query_id, kb_id, chunk_id, score, {_TOP.format("query_id, kb_id")} as rank from s where score >= 0.1 qualify rank <= 24""",
    "l2_topk": f"""with {VECTORS}, {QUERY_VECTORS}, s as (
          select query_id, chunk_id, round(sqrt(list_sum(list_transform(list_zip(vec, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) as distance from vectors, qvec)
        select query_id, chunk_id, distance, row_number() over (partition by query_id order by distance, chunk_id) as rank from s qualify rank <= 10""",
    "l2_normalize": f"""with {VECTORS}, v as (select chunk_id, list_transform(vec, lambda x: x * 3) as t from vectors),
          n as (select chunk_id, t, sqrt(list_sum(list_transform(t, lambda x: x * x))) as s from v)
        select chunk_id, i - 1 as i, round(t[i] / s, 6) as x from (select chunk_id, t, s, unnest(range(1, len(t) + 1)) as i from n)""",
    "hash_embed": f"with {CHUNKS}, {SIZED}, {EMBED.format(name='e', source='sized')} select chunk_id, slot, round(value, 6) as value from e",
    "hash_embed_sim": f"{_STAGES} select query_id, kb_id, chunk_id, score, {_TOP.format('query_id, kb_id')} as rank from sim qualify rank <= 10",
    "rrf_fusion": f"{_STAGES} select query_id, chunk_id, round(score + 1e-11, 9) as score, source from fused",
    "minmax_norm": f"""{_STAGES}, w as (select *, min(score) over p as low, max(score) over p as high, count(*) over p as n from vec window p as (partition by query_id))
        select query_id, chunk_id, round(case when n < 2 or high - low < 1e-9 then score else (score - low) / (high - low) end, 6) as score from w""",
    "score_distribution": f"""{_STAGES}, a as (
          select query_id, count(*) as n, min(score) as lo, max(score) as hi, avg(score) as av, list_sort(list(score)) as s from vec group by 1),
          b as (select *, s[cast(floor(n / 2) as bigint) + 1] as md from a)
        select query_id, n, floor(lo * 10000 + 0.5) / 10000 as min_score, floor(hi * 10000 + 0.5) / 10000 as max_score, floor(av * 10000 + 0.5) / 10000 as avg_score,
               floor(md * 10000 + 0.5) / 10000 as p50_score, floor(greatest(0, floor(av * 20 + 0.5) / 20) * 10000 + 0.5) / 10000 as band_low,
               floor(least(1, floor((md + (hi - md) * 0.3) * 20 + 0.5) / 20) * 10000 + 0.5) / 10000 as band_high from b""",
    "similarity_distribution": f"""with {VECTORS}, {QUERY_VECTORS}, s as (
          select round(list_sum(list_transform(list_zip(vec, q), lambda p: p[1] * p[2])), 6) as score from vectors, qvec),
          a as (select count(*) as n, min(score) as lo, max(score) as hi, avg(score) as av, list_sort(list(score)) as s from s where score > 0),
          b as (select *, s[cast(floor(n / 2) as bigint) + 1] as md from a)
        select 'all' as scope, n, floor(lo * 10000 + 0.5) / 10000 as min_score, floor(hi * 10000 + 0.5) / 10000 as max_score, floor(av * 10000 + 0.5) / 10000 as avg_score,
               floor(md * 10000 + 0.5) / 10000 as p50_score, floor(greatest(0, floor(av * 20 + 0.5) / 20) * 10000 + 0.5) / 10000 as band_low,
               floor(least(1, floor((md + (hi - md) * 0.3) * 20 + 0.5) / 20) * 10000 + 0.5) / 10000 as band_high from b""",
    "hybrid_rerank": f"""with {CHUNKS}, {_Q1}, {SIZED}, {_KW}, k as ({_KWS}),
          s as (select c.chunk_id, round(0.65 * greatest((c.chunk_id % 7 - 2) / 10.0, 0) + 0.35 * coalesce(kw, 0) + 1e-11, 9) as score from chunks c left join k using (chunk_id))
        select chunk_id, score, row_number() over (order by score desc, chunk_id) as rank from s qualify rank <= 20""",
    "hybrid_retrieve": f"{_STAGES} select query_id, chunk_id, score, source, rank from reranked",
    "retrieve_stages": f"""{_STAGES}
        select query_id, 'vector' as stage, chunk_id, round(score + 1e-11, 9) as score, 'vector' as source from vec
        union all select query_id, 'keyword', chunk_id, round(score + 1e-11, 9), 'keyword' from kwd
        union all select query_id, 'fused', chunk_id, round(score + 1e-11, 9), source from fused
        union all select query_id, 'reranked', chunk_id, round(score + 1e-11, 9), source from reranked""",
    "hit_at_k": f"""{_STAGES}, expected as (
          select q.query_id, min(d.doc_id) as doc_id from queries q join documents d on contains(d.text, q.query) group by 1),
          hit as (select distinct query_id from reranked r join expected e using (query_id) where r.chunk_id = e.doc_id)
        select count(*) as total, count(h.query_id) as hits, floor(count(h.query_id) * 1000 / count(*) + 0.5) / 10 as hit_rate
        from expected e left join hit h using (query_id)""",
}

SQL["bm25_indexed"] = SQL["bm25_batch"]

QUERIES_OF = {
    "bm25_search": bm25_search, "bm25_batch": bm25_batch, "bm25_indexed": bm25_indexed, "knn_links": knn_links, "knn_topk": knn_topk, "plain_retrieve": plain_retrieve, "bm25_stats": bm25_stats, "doc_freq": doc_freq, "term_freq": term_freq, "tokenize": tokenize,
    "keyword_score": keyword_score, "vector_topk": vector_topk, "vector_retrieve": vector_retrieve, "l2_topk": l2_topk, "l2_normalize": l2_norm, "ann_topk": ann_topk,
    "hash_embed": hash_embed, "hash_embed_sim": hash_embed_sim, "rrf_fusion": rrf_fusion, "minmax_norm": minmax_norm, "score_distribution": score_distribution, "similarity_distribution": similarity_distribution,
    "hybrid_rerank": hybrid_rerank, "hybrid_retrieve": hybrid_retrieve, "retrieve_stages": retrieve_stages, "hit_at_k": hit_at_k,
}
