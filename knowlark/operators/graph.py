"""Entity graph: entities, directed typed relations and provenance as DataFrames, walked by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowlark.functions.text import lenient_json, levenshtein_similarity, normalize_name, tokens
from knowlark.operators.layout import checkpointed, numbered, written
from knowlark.operators.models import trimmed

UNCATEGORISED = "未分类"
#: Grams of all queries that are sent to every task.
SOUGHT = 200_000
#: Bytes of different texts of a task, about, so that hardly any has over the 1 MB of a Parquet dictionary; entities whose names are sent to every task.
TEXTS, NAMED = 700_000, 1 << 16


def undirected(relations: DataFrame) -> DataFrame:
    """(kb_id, node, other): each relation from both ends, for equi-joins instead of a disjunction."""
    ends = relations.select("kb_id", F.col("source_id").alias("node"), F.col("target_id").alias("other"))
    return ends.unionByName(ends.select("kb_id", F.col("other").alias("node"), F.col("node").alias("other")))


def degrees(relations: DataFrame) -> DataFrame:
    return undirected(relations).groupBy("kb_id", F.col("node").alias("entity_id")).agg(F.count(F.lit(1)).alias("degree"))


def top_nodes(entities: DataFrame, relations: DataFrame, limit: int = 400) -> DataFrame:
    """The entities of the highest degree, then smallest id; those without relations have degree 0."""
    with_degree = entities.join(degrees(relations), ["kb_id", "entity_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return with_degree.orderBy(F.desc("degree"), "entity_id").limit(limit)


def adjacency(relations: DataFrame, piece: int = 1024) -> DataFrame:
    """(node, others): each node's different neighbours, in rows of about `piece`; a hub has as many rows as it needs. Written once, for walks
    of several hops, each of which reads it without building it."""
    edges = undirected(relations).select("node", "other").where("node is not null and other is not null").distinct()
    sizes = edges.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / piece).alias("pieces")).where("pieces > 1")
    dealt = edges.join(sizes, "node", "left").withColumn("piece", F.pmod(F.xxhash64("other"), F.coalesce("pieces", F.lit(1))))
    return written(dealt.groupBy("node", "piece").agg(F.collect_list("other").alias("others")).select("node", "others"))


def bfs(relations: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, depth) within max(1, hops) undirected hops of seeds (node): one join with the adjacency a hop, less what was reached before. What is
    reached is held after each hop, so that none is walked again."""
    lists = adjacency(relations)
    reached = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for hop in range(1, max(1, hops) + 1):
        step = frontier.select("node").join(lists, "node").select(F.explode("others").alias("node")).distinct()
        frontier = checkpointed(step.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def induced(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with both ends among nodes (entity_id)."""
    a = nodes.select(F.col("entity_id").alias("source_id"))
    b = nodes.select(F.col("entity_id").alias("target_id"))
    return relations.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")


def focus_view(entities: DataFrame, relations: DataFrame, focus: DataFrame) -> DataFrame:
    """Relations among the focus nodes (entity_id) and their direct neighbours."""
    near = bfs(relations, focus.select(F.col("entity_id").alias("node")), 1).select(F.col("node").alias("entity_id"))
    return induced(relations, near.join(entities.select("entity_id"), "entity_id", "left_semi"))


def query_grams(queries: DataFrame, strict: bool = True) -> DataFrame:
    """(query_id, gram): what names are searched for: adjacent pairs of the query without white space and punctuation, and tokens.

    strict keeps token grams as they count in the score: `c` tokens without the c but with their level digit, words with w.
    """
    plain = F.regexp_replace(F.coalesce("query", F.lit("")), r"[\s\p{Punct}]+", "")
    pairs = F.when(F.length(plain) > 1, F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substr(plain, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.filter(tokens(F.col("query")), lambda t: F.length(t) >= 2), lambda t: F.when(F.substring(t, 1, 1) == "c", F.substr(t, F.lit(2), F.length(t))).otherwise(t))
    grams = F.array_distinct(F.concat(named, pairs) if strict else pairs)
    return queries.select("query_id", F.explode(grams).alias("gram"))


def match_entities(entities: DataFrame, queries: DataFrame, top: int = 5, strict: bool = True, vector_scores: DataFrame | None = None) -> DataFrame:
    """(query_id, entity_id, score): 0.4 x cosine (from vector_scores, not below 0) + 0.4 x share of the query's grams in the name +
    0.2 if the query holds the name; the best `top`.

    Candidates are names that hold a gram in any case. Two-character grams are joined on the names' own pairs. Longer ones
    only count in the share, for candidates; a name that only a longer gram finds also holds its pairs.

    Either the queries' grams go to every task, or, where they are very many, both sides are shuffled. Never the names' pairs: the planner takes
    them for no larger than the file of names and would gather them on the driver.
    """
    grams = query_grams(queries, strict)
    size = grams.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_grams"))
    named = entities.select("entity_id", F.coalesce("name", F.lit("")).alias("name"))
    lowered = F.lower("name")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(lowered) - 1, F.lit(1))), lambda i: F.substr(lowered, i, F.lit(2))))
    found = named.select("entity_id", "name", F.explode(pairs).alias("pair"))
    seek = grams.select("query_id", F.lower("gram").alias("gram"), F.substring(F.lower("gram"), 1, 2).alias("pair")).distinct()
    seek = checkpointed(seek)
    how = "broadcast" if seek.limit(SOUGHT + 1).count() <= SOUGHT else "merge"
    candidates = found.join(seek.hint(how), "pair").where(F.contains(F.lower("name"), F.col("gram"))).select("query_id", "entity_id", "name").distinct()
    lists = grams.groupBy("query_id").agg(F.collect_list("gram").alias("grams"))  # one query's grams
    asked = queries.select("query_id", "query").join(lists, "query_id").join(size, "query_id")
    overlap = F.size(F.filter("grams", lambda g: F.contains(F.col("name"), g)))
    scored = candidates.join(asked.hint(how), "query_id")
    inside = F.when(F.contains(F.col("query"), F.col("name")), 1.0).otherwise(0.0)
    text = 0.4 * overlap / F.col("n_grams") + 0.2 * inside
    if vector_scores is not None:
        scored = scored.join(vector_scores.select("query_id", "entity_id", "cosine"), ["query_id", "entity_id"], "left")
        text = 0.4 * F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)) + text
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return scored.select("query_id", "entity_id", F.round(text, 6).alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def full_view(entities: DataFrame, relations: DataFrame, limit: int = 400) -> DataFrame:
    """Relations among the entities of the highest degree."""
    return induced(relations, top_nodes(entities, relations, limit).select("entity_id"))


def graph_retrieve(matched: DataFrame, relations: DataFrame, entity_chunk: DataFrame, hops: int = 2, cap: int = 15) -> DataFrame:
    """(query_id, chunk_id, score): chunks of matched entities (query_id, entity_id, score) by their best score, those of their
    neighbours at 0.5 where they have none; the best `cap` of each query."""
    lists = adjacency(relations)
    reached = matched.select("query_id", F.col("entity_id").alias("node")).distinct()
    frontier = reached
    for _ in range(max(1, hops)):
        step = frontier.join(lists, "node").select("query_id", F.explode("others").alias("node")).distinct()
        frontier = checkpointed(step.join(reached, ["query_id", "node"], "left_anti"))
        reached = reached.unionByName(frontier)
    own = matched.join(entity_chunk, "entity_id").select("query_id", "chunk_id", "score", F.lit(1).alias("own"))
    near = reached.join(entity_chunk, F.col("node") == F.col("entity_id")).select("query_id", "chunk_id", F.lit(0.5).alias("score"), F.lit(0).alias("own"))
    scored = own.unionByName(near).groupBy("query_id", "chunk_id").agg(F.coalesce(F.max(F.when(F.col("own") == 1, F.col("score"))), F.lit(0.5)).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap)


def provenance(entities: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """entities with the chunks that links (entity_id, chunk_id) name; a link that comes again is taken once.

    A chunk's text is in as many rows as it has links. Chunks are dealt to so many tasks that one has about TEXTS bytes of different texts, which
    Parquet's writer then holds in a dictionary; beyond it every row's text would be written. Links meet names first, where they are made distinct.
    """
    size = chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    pieces = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXTS))
    if entities.count() <= NAMED:
        named = links.repartition(pieces, "chunk_id").distinct().join(F.broadcast(entities), "entity_id")
    else:
        named = links.repartition("entity_id").distinct().join(entities, "entity_id").repartition(pieces, "chunk_id")
    return named.join(chunks.repartition(pieces, "chunk_id").hint("merge"), "chunk_id")


def multi_merge(relations: DataFrame) -> DataFrame:
    """Relations of several kbs with nodes `kb:id`; of those between two nodes, in either direction, the first by (kb_id,
    relation_id) stays."""
    keyed = relations.withColumn("source_key", F.concat_ws(":", "kb_id", "source_id")).withColumn("target_key", F.concat_ws(":", "kb_id", "target_id"))
    pair = Window.partitionBy(F.least("source_key", "target_key"), F.greatest("source_key", "target_key")).orderBy("kb_id", "relation_id")
    return keyed.withColumn("_n", F.row_number().over(pair)).where("_n = 1").select("relation_id", "source_key", "target_key", "relation_type")


def relation_dedup(relations: DataFrame) -> DataFrame:
    """Without blank or self relations; the first of each (kb, source, target, type)."""
    good = relations.where("source_id is not null and target_id is not null and source_id <> target_id")
    first = Window.partitionBy("kb_id", "source_id", "target_id", "relation_type").orderBy("relation_id")
    return good.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fuzzy_pairs(entities: DataFrame, least: float = 0.77, prefix: int = 2) -> DataFrame:
    """(kb_id, a, b, name_a, name_b, similarity) of names in one kb with equal first characters and a similarity of at least `least`, a < b.

    Names of n characters that are so alike are at most k = (1 - least) x n edits apart, and then one of k + 1 even pieces of the shorter name
    is in the longer one unchanged, at most k places off: names meet by their first characters, the shorter one's length and such a
    piece, not in whole blocks. The distance is computed once for each pair that meets.
    """
    named = entities.where("name is not null and name <> ''").select("kb_id", "entity_id", "name", F.lower(F.substring("name", 1, prefix)).alias("block"), F.length("name").alias("n"))
    # The shorter name has m characters; the longer one at most m / least, so k is at most (1 - least) x m / least.
    edits = F.floor((1 - least) * F.floor(F.col("n") / F.lit(least) + 1e-9) + 1e-9).cast("int")
    left = named.withColumn("k", F.least(edits, F.col("n") - 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
    begin, end = F.floor(F.col("j") * F.col("n") / (F.col("k") + 1)).cast("int"), F.floor((F.col("j") + 1) * F.col("n") / (F.col("k") + 1)).cast("int")
    left = left.select("kb_id", "block", F.col("entity_id").alias("a"), F.col("name").alias("name_a"), F.col("n").alias("m"), "j", F.substr("name", begin + 1, end - begin).alias("piece"))
    # A longer (or equally long) name offers, for each possible shorter length, the pieces at places up to k off.
    longer = named.withColumn("m", F.explode(F.sequence(F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int"), F.col("n"))))
    edits = F.floor((1 - least) * F.floor(F.col("m") / F.lit(least) + 1e-9) + 1e-9).cast("int")
    longer = longer.withColumn("k", F.least(edits, F.col("m") - 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
    begin, end = F.floor(F.col("j") * F.col("m") / (F.col("k") + 1)).cast("int"), F.floor((F.col("j") + 1) * F.col("m") / (F.col("k") + 1)).cast("int")
    longer = longer.withColumn("at", F.explode(F.sequence(F.greatest(begin - F.col("k"), F.lit(0)), F.least(begin + F.col("k"), F.greatest(F.col("n") - (end - begin), F.lit(0))))))
    right = longer.select("kb_id", "block", F.col("entity_id").alias("b"), F.col("name").alias("name_b"), F.col("n").alias("n_b"), "m", "j", F.substr("name", F.col("at") + 1, end - begin).alias("piece")).distinct()
    met = left.join(right, ["kb_id", "block", "m", "j", "piece"]).where((F.col("n_b") > F.col("m")) | (F.col("a") < F.col("b"))).where("a <> b")
    first = F.col("a") < F.col("b")
    pairs = met.select(
        "kb_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("name_a")).otherwise(F.col("name_b")).alias("name_a"), F.when(first, F.col("name_b")).otherwise(F.col("name_a")).alias("name_b")
    ).distinct()
    return pairs.withColumn("similarity", F.round(levenshtein_similarity(F.col("name_a"), F.col("name_b")), 6)).where(F.col("similarity") >= least)


def resolve(entities: DataFrame, merge: float = 0.92, decided: DataFrame | None = None) -> DataFrame:
    """(entity_id, root): equal names in a kb are one entity, and so are names linked by a similarity of at least `merge`; the root
    is the smallest id. Names between merge and a lower similarity are for a model to decide: decided are pairs (a, b) that it merged.

    Each round takes the least root among a node's neighbours and then its root's root, so a path's length at least halves; lineage is
    cut by a checkpoint every round.
    """
    same = entities.withColumn("root", F.min("entity_id").over(Window.partitionBy("kb_id", "name")))
    heads = same.where("entity_id = root").select("kb_id", "entity_id", "name")
    edges = fuzzy_pairs(heads, merge).select("a", "b")
    if decided is not None:
        edges = edges.unionByName(decided.select("a", "b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    state = checkpointed(heads.select(F.col("entity_id").alias("node"), F.col("entity_id").alias("top")))
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("top").alias("near"))
        moved = checkpointed(state.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("top").alias("was"), F.least("top", F.coalesce("near", "top")).alias("top")))
        over = moved.select(F.col("node").alias("_head"), F.col("top").alias("_over"))
        state = checkpointed(moved.join(over, F.col("top") == F.col("_head")).select("node", "was", F.col("_over").alias("top")))
        changed = state.where("top <> was").limit(1).count()
        state = state.select("node", "top")
        if not changed:
            break
    return same.join(state, F.col("root") == F.col("node")).select("entity_id", F.col("top").alias("root"))


def merge_descriptions(entities: DataFrame) -> DataFrame:
    """One row per (kb_id, name): the smallest id and the longest description, of equally long ones the smaller id's."""
    return entities.groupBy("kb_id", "name").agg(
        F.min("entity_id").alias("entity_id"), F.max_by("description", F.struct(F.coalesce(F.length("description"), F.lit(-1)), -F.col("entity_id"))).alias("description")
    )


def extract_batches(chunks: DataFrame, size: int = 4) -> DataFrame:
    """(kb_id, batch_id, chunk_id): chunks of a kb in order, `size` to a model call."""
    placed = numbered(chunks.select("kb_id", "doc_id", "position", "chunk_id"), "kb_id", "doc_id", "position", "chunk_id")
    begins = placed.groupBy("kb_id").agg(F.min("n").alias("_first"))
    return placed.join(begins, "kb_id").select("kb_id", F.floor((F.col("n") - F.col("_first")) / size).cast("int").alias("batch_id"), "chunk_id")


def built(entities: DataFrame, relations: DataFrame, batches: DataFrame, known: DataFrame, merge: float = 0.92, decided: DataFrame | None = None) -> dict[str, DataFrame]:
    """entities, relations and entity_chunk of extracted entities (kb_id, batch_id, name, entity_type, description) and relations (kb_id,
    batch_id, source, target, relation_type, description), beside known entities (entity_id, kb_id, name, entity_type, description).

    Names are trimmed, blank ones skipped. A name is a known entity's, or merged with one (as in resolve(), known ones first), or new, with
    the type 概念 where none is given. The longest description of a name stays. Every entity of a batch is linked to every chunk of the
    batch (batches: kb_id, batch_id, chunk_id). A relation's ends are found by normalised name in its batch, then by exact name, and
    else become entities of the type 未分类 without chunks; relations of an end to itself by name are skipped and each (source, target,
    type) stays once. New ids are hashes of kb and name.
    """
    named = entities.select("kb_id", "batch_id", trimmed(F.col("name")).alias("name"), trimmed(F.col("entity_type")).alias("entity_type"), trimmed(F.col("description")).alias("description")).where("name <> ''")
    ends = relations.select(
        "kb_id", "batch_id", trimmed(F.col("source")).alias("source"), trimmed(F.col("target")).alias("target"), trimmed(F.col("relation_type")).alias("relation_type"), trimmed(F.col("description")).alias("description")
    ).where("source <> '' and target <> '' and source <> target")
    ids = F.pmod(F.xxhash64("kb_id", "name"), F.lit(1 << 62)) + F.lit(1 << 62)
    old = known.select("entity_id", "kb_id", "name", "entity_type", F.coalesce("description", F.lit("")).alias("description"), F.lit(0).alias("new"))
    fresh = named.select(ids.alias("entity_id"), "kb_id", "name", F.when(F.col("entity_type") == "", "概念").otherwise(F.col("entity_type")).alias("entity_type"), "description", F.lit(1).alias("new"))
    order = F.struct("new", "entity_id", "entity_type")
    all_ = old.unionByName(fresh).groupBy("kb_id", "name").agg(
        F.min(order).alias("_first"), F.max_by("description", F.struct(F.length("description"), -F.col("new"), F.col("description"))).alias("description")
    )
    all_ = checkpointed(all_.select("kb_id", "name", F.col("_first.entity_id").alias("entity_id"), F.col("_first.entity_type").alias("entity_type"), "description"))
    of = checkpointed(all_.join(resolve(all_, merge, decided), "entity_id").select("kb_id", "name", F.col("root").alias("entity_id")))
    kept = all_.join(of.select("entity_id").distinct(), "entity_id", "left_semi")
    in_batch = named.join(of, ["kb_id", "name"]).select("kb_id", "batch_id", "name", "entity_id").distinct()
    links = in_batch.join(batches, ["kb_id", "batch_id"]).select("entity_id", "chunk_id").distinct()
    by_norm = in_batch.groupBy("kb_id", "batch_id", normalize_name(F.col("name")).alias("norm")).agg(F.min("entity_id").alias("in_batch"))

    def with_end(rows: DataFrame, end: str) -> DataFrame:
        found = rows.withColumn("norm", normalize_name(F.col(end))).join(by_norm, ["kb_id", "batch_id", "norm"], "left")
        found = found.join(of.select("kb_id", F.col("name").alias(end), F.col("entity_id").alias("by_name")), ["kb_id", end], "left")
        new = F.pmod(F.xxhash64("kb_id", end), F.lit(1 << 62)) + F.lit(1 << 62)
        made = F.col("in_batch").isNull() & F.col("by_name").isNull()
        return found.withColumn(f"{end}_id", F.coalesce("in_batch", "by_name", new)).withColumn(f"{end}_new", made).drop("norm", "in_batch", "by_name")

    tied = checkpointed(with_end(with_end(ends, "source"), "target"))
    extra = tied.where("source_new").select(F.col("source_id").alias("entity_id"), "kb_id", F.col("source").alias("name")).unionByName(tied.where("target_new").select(F.col("target_id").alias("entity_id"), "kb_id", F.col("target").alias("name")))
    extra = extra.distinct().select("entity_id", "kb_id", "name", F.lit(UNCATEGORISED).alias("entity_type"), F.lit("").alias("description"))
    made = tied.groupBy("kb_id", "source_id", "target_id", "relation_type").agg(F.min("description").alias("description"))
    return {"entities": kept.select(*extra.columns).unionByName(extra), "relations": made, "entity_chunk": links}


def from_json(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a model's answers (kb_id, batch_id, answer), by lenient JSON; unknown fields are ignored."""
    schema = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,type:string,description:string>>"
    parsed = answers.select("kb_id", "batch_id", F.from_json(lenient_json(F.col("answer")), schema).alias("g"))
    entities = parsed.select("kb_id", "batch_id", F.inline("g.entities")).withColumnRenamed("type", "entity_type").where("trim(name) <> ''")
    relations = parsed.select("kb_id", "batch_id", F.inline("g.relations")).withColumnRenamed("type", "relation_type")
    return entities, relations.where("trim(source) <> '' and trim(target) <> '' and source <> target")
