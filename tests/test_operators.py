"""Cases that the tables don't hold: Han text, splitting, parsing, reranking, citations, streaming, settings."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowlark.functions import text as t
from knowlark.functions.vectors import from_bytes, to_bytes, token_hash
from knowlark.operators import chat, chunk, fusion, graph, lexical, models, relational, retrieve, vector
from knowlark.plans import search_queries as registered
from knowlark.settings import Settings, check_knowledge_base
from knowlark.sources import files
from knowlark.streaming import ingest
from tests.conftest import SF


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, "可以 PostgreSQL 数据库的", t.tokens)
    assert got[0] == "wpostgresql" and "c2可以" not in got and "c2数据" in got and "c1的" not in got and "c3数据库" in got
    assert one(spark, None, t.tokens) == [] and one(spark, "的", t.tokens) == []


def test_hash(spark):
    assert one(spark, "whello", token_hash) == -788936005 % 2**32


def test_levenshtein_and_names(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "a"), (None, "a"), ("", "")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(t.levenshtein_similarity(F.col("a"), F.col("b"))).collect()] == [0.667, 0.0, 0.0, 1.0]
    assert one(spark, " A-b_C! ", t.normalize_name) == "abc"
    assert one(spark, "a/b: c", t.safe_file_name) == "a_b_c" and one(spark, " ", t.safe_file_name) == "unnamed"


def test_fixed_chunks(spark):
    text = "数据库索引能够加速查询。" * 200
    parts = one(spark, text, lambda c: chunk.fixed(c, 200, 50))
    assert all(len(p) <= 220 for p in parts) and all(p.endswith("。") for p in parts)
    assert one(spark, "A" * 400, lambda c: chunk.fixed(c, 100, 20)) == ["A" * 100] * 4 + ["A" * 80]
    assert one(spark, " \n", chunk.fixed) == [] and one(spark, None, chunk.fixed) == []


def test_paragraph_chunks(spark):
    parts = one(spark, "one\r\n\r\ntwo\n \nthree\n\n" + "x" * 250, lambda c: chunk.paragraphs(c, 100, 10))
    assert parts[0] == "one\ntwo\nthree" and all(set(p) == {"x"} for p in parts[1:]) and len(parts) > 2
    pairs = one(spark, "s. " * 900, lambda c: chunk.parent_child(c, 600, 100))
    assert all(p["child"] in p["parent"] for p in pairs)


@pytest.mark.parametrize("strategy", ["fixed", "paragraph", "parent_child"])
def test_long_chunks(spark, strategy):
    """The loop for long texts gives what the expressions give."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abé数。. \n\r\t;"), n, p=[0.2, 0.2, 0.1, 0.1, 0.02, 0.05, 0.15, 0.1, 0.02, 0.03, 0.03])) for n in (1, 50, 700, 2500, 4000)] + ["x" * 900, " \n ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((300, 40), (120, 60)):
        want, got = (sorted(map(repr, chunk.chunked(df, strategy, size, overlap, long).collect())) for long in (10**6, 0))
        assert got == want and want


def test_bm25_ranking(spark):
    rows = [(1, 1, "数据库索引可以加速查询"), (1, 2, "内存数据库"), (1, 3, "今天天气很好"), (1, 4, "")]
    chunks = spark.createDataFrame(rows, "kb_id long, chunk_id long, content string")
    asked = spark.createDataFrame([(1, "数据库索引"), (2, ""), (3, None), (4, "的"), (5, "zebra")], "query_id long, query string")
    got = lexical.bm25(chunks, asked, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(1, 1), (1, 2)]


def test_rrf_and_minmax(spark):
    vec = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.05), (1, 3, 0.5)], "query_id long, chunk_id long, score double")
    key = spark.createDataFrame([(1, 3, 7.0), (1, 4, 3.0)], "query_id long, chunk_id long, score double")
    got = {r["chunk_id"]: (round(r["score"], 6), r["source"]) for r in fusion.rrf(vec, key, 0.1).collect()}
    assert got == {1: (round(1 / 61, 6), "vector"), 3: (round(1 / 62 + 1 / 61, 6), "both"), 4: (round(1 / 62, 6), "keyword")}
    assert sorted(r["score"] for r in fusion.minmax(vec).collect())[::2] == [0.0, 1.0]


def test_rerank_negative_and_keyword(spark):
    hits = spark.createDataFrame([(1, 1, -0.3, "v", "red fox", "blue"), (1, 2, 0.4, "v", "red fox", "a red fox")], "query_id long, chunk_id long, score double, source string, query string, content string")
    got = fusion.hybrid_rerank(hits, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 1] and got[1]["score"] == 0.0


def test_citations(spark):
    hits = spark.createDataFrame([(1, k, 10 + k, "d", 0, "c" * 301) for k in (1, 2)], "query_id long, rank int, chunk_id long, doc_name string, position int, content string")
    answers = spark.createDataFrame([(1, "[2] [1] [2] [abc] [0] [5] [99999999999]")], "query_id long, answer string")
    got = chat.citations(answers, hits).orderBy("ord").collect()
    assert [(r["cited"], r["chunk_id"]) for r in got] == [(2, 12), (1, 11)] and len(got[0]["preview"]) == 200


def test_ann_recall(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "kb_id long, chunk_id long, vec array<float>")
    queries = vectors.where("chunk_id < 50").select(F.col("chunk_id").alias("query_id"), "vec")
    exact = {(r["query_id"], r["chunk_id"]) for r in vector.search(vectors, queries, 10).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in vector.ann_search(vectors, queries, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.95
    pieces = {(r["query_id"], r["chunk_id"]) for r in vector.ann_search(vectors, queries, 10, piece=9).collect()}
    assert pieces == near


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_recall_registered(spark, sf):
    """The registered query with its own parameters, on the tables that it is run on."""
    folder = SF.replace("sf0.001", sf)
    exact = {(r["query_id"], r["chunk_id"]) for r in registered.vector_topk(spark, folder).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in registered.ann_topk(spark, folder).collect()}
    assert len(exact & near) / len(exact) >= 0.95


def test_search_by_tiles(spark, monkeypatch):
    """Tiles, ties and vectors of another length, against a plain loop."""
    rng = np.random.default_rng(3)
    x = [v.tolist() for v in rng.integers(-2, 3, (90, 3)).astype(float)] + [[1.0, 2.0], None]
    vectors = spark.createDataFrame([(k % 2, k, v) for k, v in enumerate(x)], "kb_id long, chunk_id long, vec array<double>").repartition(3)
    queries = vectors.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "vec")
    want = []
    for q in range(7):
        for kb in (0, 1):
            scores = sorted(((-float(np.dot(x[q], v)), k) for k, v in enumerate(x[:90]) if k % 2 == kb and np.dot(x[q], v) > 0))[:4]
            want += [(q, kb, k, -s, n) for n, (s, k) in enumerate(scores, 1)]
    for width, height in ((4096, 65_536), (2, 40)):
        monkeypatch.setattr(vector, "QUERIES", width)
        monkeypatch.setattr(vector, "VECTORS", height)
        got = vector.search(vectors, queries, 4).select("query_id", "kb_id", "chunk_id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="not of 3 dimensions"):
        vector.check_dimension(vectors, 3).collect()
    assert vector.search(vectors, queries.limit(0), 4).count() == 0
    low = vector.search(vectors, queries, 90, -100.0, positive=False)
    assert low.where("score < 0").count() > 0 and low.groupBy("query_id").count().where("count < 90").count() == 0
    two = queries.select("query_id", F.transform("vec", lambda x: x * 2).alias("vec"))
    assert sorted(map(tuple, vector.store_search(vectors, two, 4, 0.5).collect())) == sorted(map(tuple, vector.store_search(vectors, queries, 4, 0.5).collect()))


def test_graph_resolve(spark):
    rows = [(1, 1, "alpha corp"), (2, 1, "alpha corps"), (3, 1, "alpha corp"), (4, 1, "beta"), (5, 2, "alpha corp")]
    got = graph.resolve(spark.createDataFrame(rows, "entity_id long, kb_id long, name string"), 0.9)
    assert {(r["entity_id"], r["root"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_csv_and_markdown():
    rows = files.csv_rows('﻿a,b\r\n"x, ""y""", 2 \r\n\r\n,\n'.encode())
    assert rows == [["a", "b"], ['x, "y"', "2"]]
    parts = files.markdown("s", [["h"]] + [[str(k)] for k in range(1050)])
    assert len(parts) == 2 and all(p.count("| --- |") == 1 for p in parts)
    assert files.markdown("s", [])[0].endswith("（空表）")
    assert files.csv_rows("名,值\n甲,1".encode("gbk"))[0] == ["名", "值"]


def test_html():
    got = files.html_text("<html><head><title>T</title></head><body><nav>n</nav><h2>H</h2><p>a <b>b</b></p><script>s</script></body></html>")
    # Each text node is a line of its own.
    assert got == "# T\n\n\n## H\n\na\nb"
    assert files.html_text("<table><tr><td>x</td><th>y</th></tr></table>") == "| x\n | y"


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def files_of(spark, folder, name):
    return spark.read.format("binaryFile").load(f"{folder}/{name}")


def test_table_strategies(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,b\n1\n"x, y",2,3,4\n')
    (tmp_path / "p.png").write_bytes(b"x")

    def told(prompt):
        return " about numbers " if "1. {" in prompt else None

    def broken(prompt):
        raise ValueError

    def rows(**options):
        return [r["content"] for r in files.file_chunks(files_of(spark, tmp_path, "t.csv"), **options).orderBy("position").collect()]

    lines = ['{"sheet":"CSV","a":"1","b":""}', '{"sheet":"CSV","a":"x, y","b":"3"}']
    assert rows(strategy="table_json") == lines and rows(strategy="table_summary", summarise=broken) == lines
    assert rows(strategy="table_summary", summarise=told) == ["【表格摘要】about numbers", *lines]
    assert rows()[0].startswith("### Sheet: t.csv")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", ""), ("x, y", "3")]
    assert files.file_chunks(files_of(spark, tmp_path, "p.png")).first()["error"]
    # Files with other headers, in another order, and a header alone.
    (tmp_path / "u.csv").write_text("c,a\n5,6\n7\n")
    (tmp_path / "v.csv").write_text("z\n")
    got = files.read_csv(spark, str(tmp_path / "*.csv"))
    assert got.columns == ["a", "b", "c", "z"] and sorted(map(tuple, got.collect())) == [("", "", "7", ""), ("1", "", "", ""), ("6", "", "5", ""), ("x, y", "3", "", "")]


def test_file_pieces(spark, tmp_path):
    """Tables as text are split as any text, rows of tables are not, and failing files stay as an error."""
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{k},word {k}\n" for k in range(200)))
    (tmp_path / "n.md").write_text("one sentence. " * 100)
    (tmp_path / "p.png").write_bytes(b"x")
    every = spark.read.format("binaryFile").load(str(tmp_path))
    whole = {r["path"][-5:]: r["content"] for r in files.file_chunks(every).collect()}
    got = files.file_pieces(every, size=300, overlap=20).collect()
    for name in ("t.csv", "/n.md"):
        want = [r["content"] for r in chunk.chunked(spark.createDataFrame([(1, whole[name])], "doc_id long, text string"), "fixed", 300, 20).orderBy("position").collect()]
        assert [r["content"] for r in sorted(got, key=lambda r: r["position"]) if r["path"].endswith(name)] == want and len(want) > 3
    assert [(r["content"], bool(r["error"])) for r in got if r["path"].endswith("png")] == [(None, True)]
    rows = files.file_pieces(every, table="table_json").where("path like '%csv'")
    assert rows.count() == 200 and rows.where("content like '{%'").count() == 200


def test_model_steps(spark):
    asked = spark.createDataFrame([(1, "what about it?"), (2, "bad"), (3, None)], "query_id long, query string")
    history = spark.createDataFrame([(1, 1, "user", "red fox"), (1, 2, "assistant", "yes")], "query_id long, turn int, role string, text string")

    def model(prompt):
        if "bad" in prompt:
            raise ValueError
        return " red fox " + "x" * 500 if "red fox" in prompt and "yes" in prompt else " "

    got = {r["query_id"]: r for r in models.hypothetical(models.rewrite(asked, model, history), lambda p: "p" * 900 if "red" in p else None).collect()}
    assert got[1]["search"].startswith("red fox") and len(got[1]["search"]) == 200 and got[1]["passage"] == "p" * 400
    assert got[2]["search"] == got[2]["passage"] == "bad" and got[3]["search"] is None
    chunks = spark.createDataFrame([(1, 1, "red fox"), (1, 2, "blue whale")], "kb_id long, chunk_id long, content string")
    one_ = spark.createDataFrame([(1, "nothing", "blue", "red")], "query_id long, query string, search string, passage string")
    found = retrieve.stages(chunks, one_)
    assert [r["chunk_id"] for r in found["keyword"].collect()] == [2] and [r["chunk_id"] for r in found["vector"].collect()] == [1]
    pairs = spark.createDataFrame([(1, 2, "a", "b", 0.95), (1, 3, "a", "c", 0.8), (1, 4, "a", "d", 0.8), (1, 5, "a", "e", 0.7)], "a long, b long, name_a string, name_b string, similarity double")
    same = models.decide_merges(pairs, lambda p: 'so {"merge": "TRUE",}' if "second: c" in p else "no idea")
    assert {r["b"]: r["same"] for r in same.collect()} == {2: True, 3: True, 4: False, 5: False}


def test_graph_built(spark):
    known = spark.createDataFrame([(7, 1, "Alpha Corp", "ORG", "short")], "entity_id long, kb_id long, name string, entity_type string, description string")
    entities = spark.createDataFrame(
        [(1, 1, " Alpha Corp ", "ORG", "a longer text"), (1, 1, "Beta", None, None), (1, 2, "Alpha Corps", "ORG", "x"), (1, 2, " ", "t", "d")], "kb_id long, batch_id long, name string, entity_type string, description string"
    )
    relations = spark.createDataFrame(
        [(1, 1, "alpha-corp", "Beta", "owns", "d"), (1, 1, "Alpha Corp", "Beta", "owns", "e"), (1, 1, "Beta", "Beta", "is", ""), (1, 2, "Alpha Corps", "Gamma", "", None), (1, 2, None, "Beta", "x", "")],
        "kb_id long, batch_id long, source string, target string, relation_type string, description string",
    )
    batches = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (1, 2, 12)], "kb_id long, batch_id long, chunk_id long")
    got = graph.built(entities, relations, batches, known, 0.9)
    made = {r["name"]: r for r in got["entities"].collect()}
    assert set(made) == {"Alpha Corp", "Beta", "Gamma"} and made["Alpha Corp"]["entity_id"] == 7 and made["Alpha Corp"]["description"] == "a longer text"
    assert made["Beta"]["entity_type"] == "概念" and made["Gamma"]["entity_type"] == graph.UNCATEGORISED
    beta, gamma = made["Beta"]["entity_id"], made["Gamma"]["entity_id"]
    assert {(r["entity_id"], r["chunk_id"]) for r in got["entity_chunk"].collect()} == {(7, 10), (7, 11), (7, 12), (beta, 10), (beta, 11)}
    assert {(r["source_id"], r["target_id"], r["relation_type"]) for r in got["relations"].collect()} == {(7, beta, "owns"), (7, gamma, "")}


def test_fuzzy_pairs_all(spark):
    """Every pair that is similar enough, against all pairs."""
    rng = np.random.default_rng(5)
    names = ["ab" + "".join(rng.choice(list("cde"), rng.integers(0, 9))) for _ in range(120)]
    df = spark.createDataFrame([(k, 1, n) for k, n in enumerate(names)], "entity_id long, kb_id long, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for least in (0.77, 0.6):
        want = {(a, b) for b in range(120) for a in range(b) if round(1 - distance(names[a], names[b]) / max(len(names[a]), len(names[b])), 6) >= least}
        got = [(r["a"], r["b"]) for r in graph.fuzzy_pairs(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_names_secrets_and_bytes(spark):
    assert one(spark, "ＡＢＣ ﬁ-x", t.normalize_name) == "abcfix" and one(spark, None, t.normalize_name) == ""
    key = F.lit(b"0" * 32)
    assert one(spark, "sécret", lambda c: t.decrypt(t.encrypt(c, key), key)) == "sécret"
    assert one(spark, "x", lambda c: F.octet_length(F.unbase64(t.encrypt(c, key)))) == 12 + 1 + 16
    row = spark.createDataFrame([([1.0, -2.5],)], "v array<float>").select(to_bytes("v").alias("b")).select("b", from_bytes("b").alias("v")).first()
    assert bytes(row["b"]) == b"\x3f\x80\x00\x00\xc0\x20\x00\x00" and row["v"] == [1.0, -2.5]


def test_relational_guards(spark, tmp_path):
    e = spark.createDataFrame([(1, 1), (2, 2)], "entity_id long, kb_id long")
    left = relational.delete_knowledge_base({"entities": e, "chunks": e.select("kb_id"), "entity_chunk": e.select("entity_id")}, 1)
    assert {n: d.count() for n, d in left.items()} == {"entities": 1, "chunks": 1, "entity_chunk": 1} and left["entity_chunk"].first()[0] == 2
    tree = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "id long, parent_id long")
    assert [r["id"] for r in relational.deletable(tree, spark.createDataFrame([(3,)], "category_id long")).collect()] == [2]
    assert [r["id"] for r in relational.listed(tree, "-parent_id", "id").collect()] == [2, 1, 3]
    relational.save_evaluation(tree, str(tmp_path), "eval-1")
    assert spark.read.json(f"{tmp_path}/eval-1").count() == 3 and retrieve.Params.of(top_k=None, min_score=0.3) == retrieve.Params(min_score=0.3)


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = _zip({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>2.0</v></c></row></sheetData></worksheet>',
    })
    a = 'xmlns:a="http://a/" xmlns:p="http://p/"'
    pptx = _zip({"ppt/slides/slide1.xml": f"<p:sld {a}><p:txBody><a:p><a:r><a:t>slide</a:t></a:r></a:p></p:txBody></p:sld>"})
    epub = _zip({
        "META-INF/container.xml": '<container xmlns="c"><rootfile full-path="o/c.opf"/></container>',
        "o/c.opf": '<package xmlns="o" xmlns:dc="d"><dc:title>Book</dc:title><manifest><item id="x" href="x.html"/></manifest><spine><itemref idref="x"/></spine></package>',
        "o/x.html": "<html><head><title>One</title></head><body><p>text</p></body></html>",
    })
    for name, raw in (("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.epub", epub), ("e.txt", "数据".encode("gbk")), ("f.bin", b"x"), ("g.pdf", b"x"), ("h.docx", b"broken")):
        (tmp_path / name).write_bytes(raw)
    got = {r["path"][-6:]: (r["text"], r["error"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"][0] == "hello\na\tb" and "| k |  | 2 |" in got["b.xlsx"][0] and got["c.pptx"][0] == "## 第 1 页\nslide"
    assert files.file_chunks(files_of(spark, tmp_path, "b.xlsx"), "table_json").count() == 0  # a header alone
    assert got["d.epub"][0] == "# Book\n\n## 第 1 章：One\ntext" and got["/e.txt"][0] == "数据"
    assert got["/f.bin"][1] and got["/g.pdf"][1] and got["h.docx"][1]


def test_streaming_ingest(spark, tmp_path):
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, kb_id long, text string"
    spark.createDataFrame([(1, 1, "red fox. " * 100), (2, 1, "blue")], schema).write.parquet(source)
    ingest.ingest(spark, source, folder, state).awaitTermination()
    spark.createDataFrame([(2, 1, "green")], schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, folder, state).awaitTermination()
    chunks = ingest.table(spark, folder, "chunks")
    assert {r["content"] for r in chunks.where("doc_id = 2").collect()} == {"green"} and chunks.where("doc_id = 1").count() >= 2
    assert ingest.table(spark, folder, "postings").where("term = 'wblue'").count() == 0
    spark.createDataFrame([(2, 1, " "), (3, None, "no kb")], schema).write.mode("append").parquet(source)
    assert {r["doc_id"]: r["status"] for r in ingest.pending(spark, source, folder).collect()} == {3: "PENDING"}
    ingest.ingest(spark, source, folder, state).awaitTermination()
    for name in ("chunks", "postings", "vectors"):  # a document that is blank now has nothing left
        assert ingest.table(spark, folder, name).where("doc_id = 2").count() == 0
    status = {r["doc_id"]: r["status"] for r in ingest.documents(spark, folder).collect()}
    assert status == {1: "INDEXED", 2: "INDEXED", 3: "FAILED"} and ingest.without(chunks, chunks.where("doc_id = 1")).where("doc_id = 1").count() == 0


def test_streaming_statistics(spark, tmp_path):
    """After additions, replacements, deletions and a batch that runs again, the statistics are those of a rebuild; also over snapshots."""
    folder, schema = str(tmp_path / "out"), "doc_id long, kb_id long, text string"

    def same():
        kept = ingest.table(spark, folder, "postings")
        want = lexical.document_frequency(kept).collect()
        assert sorted(map(tuple, ingest.frequencies(spark, folder).collect())) == sorted(map(tuple, want)) and want
        want = lexical.corpus_stats(lexical.lengths(kept)).collect()
        assert sorted((r["kb_id"], r["n_chunks"], round(r["avg_len"], 9)) for r in ingest.statistics(spark, folder).collect()) == sorted((r["kb_id"], r["n_chunks"], round(r["avg_len"], 9)) for r in want)

    batches = [
        [(1, 1, "red fox. " * 100), (2, 1, "blue fox"), (3, 2, "red whale")],
        [(2, 1, "green"), (3, 2, " "), (4, 1, "a fox")],
        [(2, 2, "green fox moved"), (5, None, "no kb"), (1, 1, "red fox")],
        [(1, None, "fails, and the old one is gone"), (3, 2, "back again")],
    ]
    for n, rows in enumerate(batches):
        ingest.write_batch(spark.createDataFrame(rows, schema), n, folder)
        if n == 1:
            ingest.compact(spark, folder)
            ingest.write_batch(spark.createDataFrame(rows, schema), n, folder)  # again, as after a failure
        same()
    ingest.compact(spark, folder)
    assert {(r["kb_id"], r["term"]): r["df"] for r in ingest.frequencies(spark, folder).collect()} == {(1, "wfox"): 1, (1, "wa"): 1, (2, "wgreen"): 1, (2, "wfox"): 1, (2, "wmoved"): 1, (2, "wback"): 1, (2, "wagain"): 1}


def test_walks_with_hubs(spark):
    """A hub's neighbours are cut to pieces; walks reach what a plain loop reaches."""
    rows = [(k, 1, 0, k, "x") for k in range(1, 300)] + [(1000 + k, 1, k, k + 300, "x") for k in range(1, 300)] + [(5000, 1, 7, 7, "x"), (5001, 1, None, 7, "x"), (5002, 1, 600, 601, "x")]
    relations = spark.createDataFrame(rows, "relation_id long, kb_id long, source_id long, target_id long, relation_type string")
    assert graph.adjacency(relations, 50).where("node = 0").count() == 6 and graph.adjacency(relations, 50).agg(F.sum(F.size("others"))).first()[0] == 2 * 299 * 2 + 1 + 2
    got = {r["node"]: r["depth"] for r in graph.bfs(relations, spark.createDataFrame([(301,), (900,)], "node long"), 3).collect()}
    assert got == {301: 0, 900: 0, 1: 1, 0: 2} | {k: 3 for k in range(2, 300)}


def test_model_answers(spark):
    lines = spark.createDataFrame([(1, "1: one\nnoise\n 2： two ")], "batch_id long, answer string")
    assert {(r["number"], r["head"]) for r in chat.contextual_headers(lines).collect()} == {(1, "one"), (2, "two")}
    assert one(spark, 'x {"a":[1,],} y', t.lenient_json) == '{"a":[1]}' and one(spark, "none", t.lenient_json) is None


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    s = Settings(str(path))
    assert s.get("top_k") == 8
    s.set("top_k", "12")
    assert Settings(str(path)).get("top_k") == 12
    s.reset("top_k")
    assert Settings(str(path)).get("top_k") == 8
    path.write_text("{broken")
    assert Settings(str(path)).overrides == {}
    with pytest.raises(ValueError):
        check_knowledge_base("fixed", 50, 10)
    assert retrieve.Params(top_k=99, multiplier=9).recall == 100
