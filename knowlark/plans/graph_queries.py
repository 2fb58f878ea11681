"""Registered queries over a graph of parts, suppliers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlark.operators import fusion, graph
from knowlark.plans import catalog as c
from knowlark.plans.catalog import ENTITIES, ENTITY_CHUNK, RELATIONS, SUPPLIER

ASKED = ((1, "Supplier 000000001 parts"), (2, "an almond steel part?"), (3, ""))


def graph_degree(spark, sf):
    return graph.degrees(c.relations(spark, sf)).select("entity_id", "degree")


def graph_top_nodes(spark, sf):
    return graph.top_nodes(c.entities(spark, sf), c.relations(spark, sf), 400).select("entity_id", "name", "degree")


def graph_stats(spark, sf):
    e = c.entities(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("what"), "n")
    r = c.relations(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relations").alias("what"), "n")
    k = c.entity_chunk(spark, sf).agg(F.count_distinct("chunk_id").alias("n")).select(F.lit("chunks").alias("what"), "n")
    return e.unionByName(r).unionByName(k)


def graph_bfs(spark, sf):
    seeds = spark.createDataFrame([(SUPPLIER + 1,), (SUPPLIER + 2,)], "node long")
    return graph.bfs(c.relations(spark, sf), seeds, 2).select("node", F.col("depth").cast("long").alias("depth"))


def graph_view(spark, sf):
    focus = spark.createDataFrame([(SUPPLIER + k,) for k in range(1, 9)], "entity_id long")
    return graph.focus_view(c.entities(spark, sf), c.relations(spark, sf), focus).select("relation_id", "source_id", "target_id")


def graph_multi_merge(spark, sf):
    split = c.relations(spark, sf).withColumn("kb_id", F.col("relation_id") % 3)
    return graph.multi_merge(split)


def relation_dedup(spark, sf):
    return graph.relation_dedup(c.relations(spark, sf)).select("relation_id", "source_id", "target_id", "relation_type")


def entity_provenance(spark, sf):
    found = graph.provenance(c.entities(spark, sf).drop("kb_id"), c.links(spark, sf), c.chunks(spark, sf))
    return found.select("entity_id", "name", "chunk_id", "content")


def entity_match(spark, sf):
    asked = spark.createDataFrame(ASKED, "query_id long, query string")
    return graph.match_entities(c.entities(spark, sf), asked).select("query_id", "entity_id", "score", F.col("rank").cast("long").alias("rank"))


def _matched(spark, sf):
    return spark.createDataFrame([(1, 10, 0.9), (1, 20, 0.4), (2, 10, 0.3), (2, SUPPLIER + 3, 0.8)], "query_id long, entity_id long, score double")


def graph_retrieve(spark, sf):
    found = graph.graph_retrieve(_matched(spark, sf), c.relations(spark, sf), c.entity_chunk(spark, sf))
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def graph_merge(spark, sf):
    hits = spark.range(0, 60).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("chunk_id"), (F.col("id") % 11 / 11.0).alias("score"), F.lit("vector").alias("source"))
    near = spark.range(30, 90).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("chunk_id"), F.lit(0.5).alias("score"))
    return fusion.merge_graph(hits, near).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source")


def _spellings(spark, sf, suppliers=False):
    """All parts, and every tenth once more under a longer spelling; suppliers on demand. (Suppliers' names differ in digits alone, so each is
    like all others, and their similar pairs are as many as their square.)"""
    n = c.entities(spark, sf).select("entity_id", "name")
    n = n if suppliers else n.where(F.col("entity_id") < SUPPLIER)
    other = n.where((F.col("entity_id") < SUPPLIER) & (F.col("entity_id") % 10 == 0)).select((F.col("entity_id") + 2 * SUPPLIER).alias("entity_id"), F.concat("name", F.lit("s")).alias("name"))
    return n.unionByName(other).withColumn("kb_id", F.lit(1).cast("long")).withColumn("description", F.concat(F.lit("d"), F.col("entity_id").cast("string")))


def entity_fuzzy_pairs(spark, sf):
    """Pairs among different names, each by its first entity."""
    return graph.fuzzy_pairs(graph.merge_descriptions(_spellings(spark, sf))).select("a", "b", "similarity")


def entity_resolve(spark, sf):
    return graph.resolve(_spellings(spark, sf), 0.85)


def entity_merge(spark, sf):
    return graph.merge_descriptions(_spellings(spark, sf, suppliers=True)).select("name", "entity_id", "description")


def graph_full_view(spark, sf):
    return graph.full_view(c.entities(spark, sf), c.relations(spark, sf)).select("relation_id", "source_id", "target_id")


def _answers(spark, sf):
    text = F.concat(
        F.lit('ok {"entities":[{"name":"'), F.col("n_name"), F.lit('","type":"nation","description":"x","more":1},{"name":" ","type":"t"}],"relations":[{"source":"'), F.col("n_name"),
        F.lit('","target":"'), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("WORLD"), F.lit('","type":"in"},]} bye'),
    )
    return c.table(spark, sf, "nation").select(F.lit(1).alias("kb_id"), F.col("n_nationkey").alias("batch_id"), text.alias("answer"))


def graph_from_json(spark, sf):
    entities, relations = graph.from_json(_answers(spark, sf))
    a = entities.select("batch_id", F.lit("entity").alias("kind"), "name", F.lit(None).cast("string").alias("target"))
    return a.unionByName(relations.select("batch_id", F.lit("relation").alias("kind"), F.col("source").alias("name"), "target"))


_EDGES = "few as (select * from relations), ends as (select source_id as node, target_id as other from few union select target_id, source_id from few)"
_SPELLINGS = f"""spellings as (
  select p_partkey as entity_id, p_name as name from part union all select p_partkey + {2 * SUPPLIER}, p_name || 's' from part where p_partkey % 10 = 0)"""
SQL = {
    "graph_degree": f"with {RELATIONS} select entity_id, count(*) as degree from (select source_id as entity_id from relations union all select target_id from relations) group by 1",
    "graph_top_nodes": f"""with {ENTITIES}, {RELATIONS}, d as (select entity_id, count(*) as degree from (select source_id as entity_id from relations union all select target_id from relations) group by 1)
        select entity_id, name, coalesce(degree, 0) as degree from entities left join d using (entity_id) order by degree desc, entity_id limit 400""",
    "graph_stats": f"with {ENTITIES}, {RELATIONS}, {ENTITY_CHUNK} select 'entities' as what, count(*) as n from entities union all select 'relations', count(*) from relations union all select 'chunks', count(distinct chunk_id) from entity_chunk",
    "graph_bfs": f"""with {RELATIONS}, {_EDGES}, s as (select * from (values ({SUPPLIER + 1}::bigint), ({SUPPLIER + 2}::bigint)) v(node)),
          one as (select distinct other as node from ends where node in (select node from s)), two as (select distinct other as node from ends where node in (select node from one))
        select node, min(depth)::bigint as depth from (select node, 0 as depth from s union all select node, 1 from one union all select node, 2 from two) group by 1""",
    "graph_view": f"""with {ENTITIES}, {RELATIONS}, {_EDGES}, s as (select {SUPPLIER} + i as node from range(1, 9) t(i)),
          n as (select node from s union select other from ends where node in (select node from s))
        select relation_id, source_id, target_id from few where source_id in (select node from n) and target_id in (select node from n)
          and source_id in (select entity_id from entities) and target_id in (select entity_id from entities)""",
    "graph_multi_merge": f"""with {RELATIONS}, k as (select relation_id, relation_id % 3 as kb, (relation_id % 3) || ':' || source_id as source_key, (relation_id % 3) || ':' || target_id as target_key, relation_type from relations)
        select relation_id, source_key, target_key, relation_type from k
        qualify row_number() over (partition by least(source_key, target_key), greatest(source_key, target_key) order by kb, relation_id) = 1""",
    "relation_dedup": f"with {RELATIONS} select relation_id, source_id, target_id, relation_type from relations where source_id <> target_id qualify row_number() over (partition by source_id, target_id, relation_type order by relation_id) = 1",
    "entity_provenance": f"with {ENTITIES}, {ENTITY_CHUNK} select e.entity_id, e.name, k.chunk_id, d.text as content from entities e join entity_chunk k using (entity_id) join documents d on d.doc_id = k.chunk_id",
    "entity_match": rf"""with {ENTITIES}, q as (select * from (values (1::bigint, '{ASKED[0][1]}'), (2::bigint, '{ASKED[1][1]}')) v(query_id, query)),
          p as (select query_id, query, regexp_replace(query, '[\s[:punct:]]+', '', 'g') as plain from q),
          g as (select distinct query_id, unnest(list_concat(list_transform(regexp_extract_all(query, '[a-zA-Z0-9]+'), lambda x: 'w' || lower(x)), list_transform(range(1, length(plain)), lambda i: substr(plain, i, 2)))) as gram from p),
          n as (select query_id, count(*) as n from g group by 1),
          cand as (select distinct query_id, entity_id, name from g join entities on contains(lower(name), lower(gram))),
          s as (select c.query_id, entity_id, round(0.4 * (select count(*) from g where g.query_id = c.query_id and contains(c.name, gram)) / n + 0.2 * case when contains(query, c.name) then 1 else 0 end, 6) as score
                from cand c join n using (query_id) join q using (query_id))
        select query_id, entity_id, score, row_number() over (partition by query_id order by score desc, entity_id) as rank from s qualify rank <= 5""",
    "graph_retrieve": f"""with {RELATIONS}, {ENTITY_CHUNK}, {_EDGES},
          m as (select * from (values (1::bigint, 10::bigint, 0.9::double), (1, 20, 0.4), (2, 10, 0.3), (2, {SUPPLIER + 3}, 0.8)) v(query_id, entity_id, score)),
          one as (select distinct query_id, other as node from m join ends on entity_id = node), two as (select distinct query_id, e.other as node from one join ends e using (node)),
          r as (select query_id, entity_id as node from m union select * from one union select * from two),
          s as (select query_id, chunk_id, coalesce(max(score), 0.5) as score from (
                  select query_id, chunk_id, score from m join entity_chunk using (entity_id)
                  union all select query_id, chunk_id, null from r join entity_chunk on node = entity_id) group by all)
        select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 15""",
    "graph_merge": """select i % 3 as query_id, i as chunk_id, round(case when i < 30 then (i % 11) / 11.0 when i < 60 then greatest((i % 11) / 11.0, 0.5) else 0.5 end, 6) as score,
          case when i < 30 then 'vector' when i < 60 then 'both' else 'graph' end as source from range(0, 90) t(i)""",
    "entity_fuzzy_pairs": f"""with {_SPELLINGS}, n as (select name, min(entity_id) as entity_id from spellings group by 1),
          p as (select a.entity_id as a, b.entity_id as b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) as similarity
                from n a join n b on a.entity_id < b.entity_id and lower(substr(a.name, 1, 2)) = lower(substr(b.name, 1, 2)))
        select * from p where similarity >= 0.77""",
    "entity_resolve": f"with {_SPELLINGS} select entity_id, min(entity_id) over (partition by case when entity_id >= {2 * SUPPLIER} then name[:-2] else name end) as root from spellings",
    "entity_merge": f"with {_SPELLINGS} select name, min(entity_id) as entity_id, arg_max('d' || entity_id, length('d' || entity_id) * 10000000000 - entity_id) as description from (from spellings union all select s_suppkey + {SUPPLIER}, s_name from supplier) group by 1",
    "graph_full_view": f"""with {ENTITIES}, {RELATIONS}, d as (select entity_id, count(*) as degree from (select source_id as entity_id from relations union all select target_id from relations) group by 1),
          n as (select entity_id from entities left join d using (entity_id) order by coalesce(degree, 0) desc, entity_id limit 400)
        select relation_id, source_id, target_id from relations where source_id in (select entity_id from n) and target_id in (select entity_id from n)""",
    "graph_from_json": "select n_nationkey as batch_id, 'entity' as kind, n_name as name, null::varchar as target from nation union all select n_nationkey, 'relation', n_name, 'WORLD' from nation where n_nationkey % 2 = 1",
}
QUERIES_OF = {
    f.__name__: f
    for f in (
        graph_degree, graph_top_nodes, graph_stats, graph_bfs, graph_view, graph_multi_merge, relation_dedup, entity_provenance, entity_match, graph_retrieve, graph_merge,
        entity_fuzzy_pairs, entity_resolve, entity_merge, graph_full_view, graph_from_json,
    )
}
