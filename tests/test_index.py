"""The stored index, the neighbour graph and medians against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowlark.functions import text as t
from knowlark.operators import fusion, index, knn_graph, lexical, vector
from knowlark.plans import search_queries as registered
from tests.conftest import SF


def brute_bm25(chunks, queries, limit, per_kb):
    words = {(kb, i): Counter((text or "").split()) for kb, i, text in chunks if (text or "").split()}
    out = []
    for q, text in queries:
        scores = {}
        for kb in {k for k, _ in words}:
            mine = {i: c for (k, i), c in words.items() if k == kb}
            mean = sum(sum(c.values()) for c in mine.values()) / len(mine)
            for term in set((text or "").split()):
                df = sum(term in c for c in mine.values())
                for i, c in mine.items():
                    if term in c:
                        idf = math.log(1 + (len(mine) - df + 0.5) / (df + 0.5))
                        scores[kb, i] = scores.get((kb, i), 0) + idf * c[term] * 2.5 / (c[term] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
        for kb in {k for k, _ in scores} if per_kb else {None}:
            best = sorted((-round(s, 9), i) for (k, i), s in scores.items() if kb in (None, k))[:limit]
            out += [(q, i, -s, n) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("per_kb", [True, False])
def test_index(spark, tmp_path, per_kb):
    """Scores as by a plain loop; frequent words find no candidates of their own and weak blocks aren't read."""
    rnd = random.Random(4)
    common, rare = ["the", "of", "and"], [f"r{k}" for k in range(300)]
    chunks = []
    for i in range(600):
        words = [rnd.choice(common) for _ in range(rnd.randint(1, 60))] + [rnd.choice(rare) for _ in range(rnd.choice([0, 1, 1, 20]))]
        chunks.append((i % 2, i, " ".join(rnd.sample(words, len(words)))))
    chunks += [(0, 9001, None), (1, 9002, ""), (0, 9003, "the " * 400)]
    queries = [(1, "the r1 r2"), (2, "the"), (3, "r7 r7 of"), (4, None), (5, "zzz"), (6, "r1 r2 r3 r4 r5 the of and"), (7, "the and")]
    rows = lexical.store(spark.createDataFrame(chunks, "kb_id long, chunk_id long, content string"))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    want = brute_bm25(chunks, queries, 5, per_kb)
    made = index.build(rows, block=4)
    made.save(str(tmp_path))
    loaded = index.Index.load(spark, str(tmp_path))
    assert loaded.blocks.agg(F.max("n")).first()[0] < 40
    found = index.searched(loaded, asked, 5, per_kb)

    def same(hits):
        got = sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in hits.collect())
        assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want] and all(abs(g[2] - w[2]) < 2e-9 for g, w in zip(got, want))

    same(found["hits"])
    same(lexical.bm25_rows(rows, asked, 5, per_kb))
    parts = {(r["query_id"], r["part"]): r["count"] for r in found["blocks"].groupBy("query_id", "part").count().collect()}
    assert parts[2, "skip"] > parts[2, "seek"] > 0 and parts[1, "score"] > parts[1, "seek"]
    assert "content" not in found["hits"]._jdf.queryExecution().analyzed().toString()


def test_postings_are_shuffled_once(spark):
    """Postings leave a slice as blobs, which are dealt once; forward rows aren't written again. A frequent term's slices are dealt apart, and all
    postings are in blocks, none of which is too large."""
    rows = lexical.store(spark.createDataFrame([(k % 3, k, f"all w{k % 9} r{k} " + "pad " * (k % 4)) for k in range(900)] + [(None, 900, "all"), (1, 901, "")], "kb_id long, chunk_id long, content string"))
    made = index.build(rows, block=8)
    assert made.blocks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    kept = index.stored(rows, block=8)
    assert kept.forward is rows
    got = kept.blocks.select("kb_id", "term", F.inline("entries")).select("kb_id", "chunk_id", "dl", "term", "tf")
    want = rows.where("dl > 0 and kb_id is not null").select("kb_id", "chunk_id", "dl", F.inline("terms"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert kept.blocks.where("n > 8 or n <> size(entries) or most_tf <> array_max(entries.tf) or least_dl <> array_min(entries.dl)").count() == 0
    assert kept.blocks.groupBy("kb_id", "term", "block").count().where("count > 1").count() == 0
    held = rows.where("dl > 0 and kb_id is not null").toArrow().to_batches()
    size = index.HELD
    try:
        index.HELD = 500
        dealt = [r for b in index._dealt(iter([b.slice(k, 90) for b in held for k in range(0, b.num_rows, 90)]), 40, 32) for r in b.to_pylist()]
    finally:
        index.HELD = size
    kinds = index.pa.schema([("0", "int64"), ("1", "string"), ("2", "int32")])
    parts = {}
    for r in dealt:
        for x in index._unpacked(r["sizes"][0], r["terms"], kinds).to_pylist():
            parts.setdefault((x["0"], x["1"]), set()).add(r["part"])
    assert len(parts[0, "wall"]) > 1 and all(len(p) == 1 for (_, term), p in parts.items() if term.startswith("wr"))


def test_index_of_nothing(spark):
    none = spark.createDataFrame([(1, 1, "")], "kb_id long, chunk_id string, content string")
    asked = spark.createDataFrame([(1, "fox")], "query_id long, query string")
    assert index.search(index.stored(lexical.store(none)), asked, 3).count() == 0
    some = index.stored(lexical.store(none.unionByName(none.withColumn("chunk_id", F.lit("b")).withColumn("content", F.lit("a fox")))))
    assert [r["chunk_id"] for r in index.search(some, asked, 3).collect()] == ["b"] and index.search(some, asked.limit(0), 3).count() == 0


def test_forward_tokens(spark):
    """Tokens in Python are those of the expression, Han texts and odd letters too."""
    rnd = random.Random(8)
    texts = [None, "", "可以 PostgreSQL 数据库的", "İK ſtraße ÀB9", "的", "一" * 50] + ["".join(rnd.choice("ab9Z 数据库的可以我们.\nİK") for _ in range(40)) for _ in range(60)]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "kb_id long, chunk_id long, content string")
    want = {r["chunk_id"]: Counter(r["x"]) for r in rows.select("chunk_id", t.tokens(F.col("content")).alias("x")).collect()}
    for r in lexical.forward(rows).collect():
        assert {x["term"]: x["tf"] for x in r["terms"]} == want[r["chunk_id"]] and r["dl"] == want[r["chunk_id"]].total()


def test_graph(spark):
    """Recall of links and walks, repeated vectors in one bucket, vectors that come later, and none at all."""
    rng = np.random.default_rng(42)
    x = rng.normal(size=(1200, 24))
    x[900:] = x[900] + rng.normal(size=(300, 24)) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    graph = knn_graph.build(rows.where("id % 10 <> 3"), k=12).cache()
    assert graph.groupBy("id").count().where("count <> 12").count() == 0
    kept = [k for k in range(1200) if k % 10 != 3]
    near = {k: set(np.array(kept)[np.argsort(-np.where(np.array(kept) == k, -9, x[kept] @ x[k]))[:8]].tolist()) for k in kept if k < 900}
    links = {}
    for r in graph.collect():
        assert abs(r["score"] - round(float(x[r["id"]] @ x[r["other"]]), 6)) < 2e-6
        links.setdefault(r["id"], set()).add(r["other"])
    assert np.mean([len(near[k] & links[k]) / 8 for k in near]) >= 0.8
    whole = knn_graph.extend(graph, rows.where("id % 10 <> 3"), rows.where("id % 10 = 3"), k=12)
    asked = rows.where("id < 60").select(F.col("id").alias("query_id"), "vec")
    hits = {(r["query_id"], r["id"]) for r in knn_graph.search(whole, rows, asked, 5).collect()}
    exact = {(q, int(k)) for q in range(60) for k in np.argsort(-(x @ x[q]))[:5]}
    assert len(hits & exact) / len(exact) >= 0.9
    assert knn_graph.build(rows.limit(0)).count() == 0 and knn_graph.build(rows.limit(1)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_graph_registered(spark, sf):
    folder = SF.replace("sf0.001", sf)
    exact = {(r["query_id"], r["chunk_id"]) for r in registered.vector_topk(spark, folder).collect()}
    near = {(r["query_id"], r["id"]) for r in registered.knn_topk(spark, folder).collect()}
    assert len(exact & near) / len(exact) >= 0.95


def test_medians(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([rnd.random(), 0.5, rnd.gauss(0, 1e6)])) for k in ("a", None, "c") for _ in range({"a": 301, None: 40, "c": 1}[k])] + [("a", None), ("d", None)] + [("e", 2.0)] * 9
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    for ranges in (1 << 12, 3):
        got = {r["k"]: (r["n"], r["low"], r["high"], r["median"]) for r in fusion.upper_medians(df, ["k"], "x", ranges).collect()}
        of = {k: sorted(x for n, x in rows if n == k and x is not None) for k in ("a", None, "c", "e")}
        assert got == {k: (len(v), v[0], v[-1], v[len(v) // 2]) for k, v in of.items()}
    whole = fusion.upper_medians(df, [], "x").collect()
    every = sorted(x for _, x in rows if x is not None)
    assert [(r["n"], r["median"]) for r in whole] == [(len(every), every[len(every) // 2])]


def test_tiles_have_no_driver_block():
    import inspect

    source = inspect.getsource(vector)
    assert "toArrow" not in source
