"""What went wrong on larger tables, on small ones."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from knowlark.functions.vectors import hashed_token, hashed_tokens
from knowlark.operators import chunk, fusion, graph, knn_graph, lexical, tiles, vector
from knowlark.plans import graph_queries, table_queries
from tests.conftest import SF


def test_names_are_not_gathered(spark):
    """The planner takes the pairs of names for as small as the names: they must not be what is broadcast."""
    entities = spark.range(50).select(F.col("id").alias("entity_id"), F.concat(F.lit("red fox "), F.col("id").cast("string")).alias("name"))
    queries = spark.createDataFrame([(1, "red fox 7"), (2, "nothing")], "query_id long, query string")
    found = graph.match_entities(entities, queries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    kept = graph.SOUGHT
    try:
        graph.SOUGHT = 1
        many = graph.match_entities(entities, queries)
        assert "strategy=merge" in many._jdf.queryExecution().optimizedPlan().toString() and "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, found.collect())) and found.count() == 5
    finally:
        graph.SOUGHT = kept


def test_rerank_llm_short_group(spark, tmp_path):
    """Groups of fewer than five passages: the answer has as many scores as passages, or too few."""
    rows = [(k, f"text {k}", "en", "src1", 6) for k in (0, 1, 5, 10, 11, 12, 13, 14)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in table_queries.rerank_llm(spark, str(tmp_path)).collect()}
    assert got == {(0, 1): (0, 0.9), (0, 2): (1, 0.1), (1, 1): (5, 0.325), (2, 1): (12, 0.9), (2, 2): (14, 0.7), (2, 3): (11, 0.5)}


def test_slices_by_size():
    """A batch of long texts is taken in slices of about TEXT bytes; a longer text is alone, and none is lost."""
    texts = ["x" * 400_000] * 5 + ["y" * 3_000_000, None, "", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    sizes = [b.num_rows for b in tiles.by_size([batch])]
    assert sizes == [2, 2, 1, 1, 3] and [x for b in tiles.by_size([batch]) for x in b.column(0).to_pylist()] == list(range(len(texts)))
    lists = pa.RecordBatch.from_arrays([pa.array([[1] * 100_000, None, [2] * 100_000])], ["values"])
    assert [b.num_rows for b in tiles.by_size([lists])] == [2, 1]
    assert [b.num_rows for b in lexical._counted([batch])] == sizes


def test_hashed_tokens():
    names = ["", "w", "wword", "c1的", "c2数据", "c3数据库", "cx", "w" + "long" * 50, "😀"]
    slots, weights = hashed_tokens(names)
    assert list(zip(slots.tolist(), weights.tolist(), strict=True)) == [hashed_token(n) for n in names]


def test_best_leave_tiles(spark):
    """BM25 by tiles gives a plain loop's rows; no more than the best of each tile leave it."""
    rows = [(k % 2, k, "fox " * (k % 5 + 1) + f"red w{k % 7} " + "pad " * (k % 11)) for k in range(300)] + [(None, 999, "fox"), (1, 1000, "")]
    chunks = spark.createDataFrame(rows, "kb_id long, chunk_id long, content string")
    queries = spark.createDataFrame([(1, "fox"), (2, "red w3 fox"), (3, "none of it"), (4, "")], "query_id long, query string")
    stored = lexical.store(chunks)
    got = {(r["query_id"], r["kb_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in lexical.bm25_rows(stored, queries, 4).collect()}
    want = {}
    for q, query in ((1, {"fox"}), (2, {"red", "w3", "fox"})):
        for kb in (0, 1):
            texts = {c: t.split() for b, c, t in rows if b == kb and t}
            mean = sum(map(len, texts.values())) / len(texts)
            idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w in query if (n := sum(w in t for t in texts.values()))}
            scores = {c: round(sum(i * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w, i in idf.items()), 9) for c, t in texts.items()}
            for n, (c, s) in enumerate(sorted(((c, s) for c, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:4], 1):
                want[q, kb, n] = (c, s)
    assert got == want
    plan = lexical.bm25_rows(stored, queries, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_short_texts_by_the_loop(spark):
    """Texts of a few chunks are cut by the loop too, in whole batches, with the rows of the built-in expressions."""
    texts = [("Some words here. " * k + "tail\r\n\n" * (k % 3)) for k in range(0, 120, 7)] + [None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for name in ("fixed", "paragraph", "parent_child"):
        got, want = (sorted(map(tuple, chunk.chunked(docs, name, long=n).collect())) for n in (chunk.LONG, 1 << 30))
        assert got == want
    assert chunk.LONG <= 1000


def test_links_are_shuffled_once(spark):
    """Links dealt by chunk meet texts where they are: one exchange of the links, none between their distinct and the join with texts."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = graph_queries.entity_provenance(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    links = plan[: plan.index("l_orderkey")]
    assert links.count("Exchange hashpartitioning") == 1, plan


def test_texts_are_written_once(spark, tmp_path):
    """A text is in the rows of all its links, but about once in a Parquet file, whether names are broadcast or meet links by a shuffle; links that come
    again are taken once."""
    text = F.concat(*(F.sha2(F.concat("id", F.lit(f" {k}")), 512) for k in range(80)))
    spark.range(800).select(F.col("id").alias("chunk_id"), text.alias("content")).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    entities = spark.range(60).select(F.col("id").alias("entity_id"), F.concat(F.lit("name "), "id").alias("name"))
    links = spark.range(800 * 16).select(F.expr("(id div 800 % 8 * 7 + id % 800) % 64").alias("entity_id"), (F.col("id") % 800).alias("chunk_id"))
    want = {(e, k % 800) for k in range(800 * 16) if (e := (k // 800 % 8 * 7 + k % 800) % 64) < 60}
    kept = graph.NAMED
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for graph.NAMED in (kept, 1):
            found = graph.provenance(entities, links, chunks).select("entity_id", "name", "chunk_id", "content")
            assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (graph.NAMED == kept)
            found.write.parquet(str(tmp_path / f"found{graph.NAMED}"))
            size = sum(f.stat().st_size for f in (tmp_path / f"found{graph.NAMED}").glob("*.parquet"))
            assert size < 1.5 * 800 * 80 * 128 < 5 * 800 * 80 * 128 < found.count() * 80 * 128
            rows = found.join(chunks.withColumnRenamed("content", "own"), "chunk_id").select("entity_id", "chunk_id", "name", (F.col("content") == F.col("own")).alias("same")).collect()
            assert len(rows) == len(want) and {(r["entity_id"], r["chunk_id"]) for r in rows} == want and all(r["same"] and r["name"] == f"name {r['entity_id']}" for r in rows)
    finally:
        graph.NAMED = kept
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_scores_as_counts(spark):
    """Pairs leave a tile as counts of different scores; their distribution is that of the pairs."""
    vectors = spark.createDataFrame([(1, k, [float(k % 3), float(k % 2) - 0.5]) for k in range(60)], "kb_id long, chunk_id long, vec array<double>")
    queries = vectors.where("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), "vec")
    pairs = vector.search(vectors, queries, 1 << 30)
    counts = vector.score_counts(vectors, queries)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.groupBy("score").count().collect())) and counts.count() < pairs.count()
    one = fusion.score_distribution(pairs.select(F.lit(1).alias("g"), "score"), ["g"]).collect()
    assert fusion.score_distribution(counts.select(F.lit(1).alias("g"), "score", "n"), ["g"], "n").collect() == one


def test_meetings_keep_what_may_stay():
    """Of neighbours that meet, pairs with a fresh one leave, from each end that they are good enough for."""
    kind = pa.list_(pa.struct([("other", pa.int64()), ("fresh", pa.bool_()), ("least", pa.float64()), ("vec", pa.list_(pa.float32()))]))
    unit = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    row = [{"other": 10 + k, "fresh": k == 1, "least": (0.7, 0.5, -np.inf)[k], "vec": v} for k, v in enumerate(unit)]
    batch = pa.RecordBatch.from_arrays([pa.array([row, row[:1], []], kind)], ["seen"])
    got = [tuple(r.values()) for b in knn_graph._introduced([batch]) for r in b.to_pylist()]
    assert sorted(got) == [(11, 10, 0.6), (11, 12, 0.8), (12, 11, 0.8)]
