"""BM25 and keyword scores. A corpus is tokenized once, to `forward` rows: a chunk's length and its different terms with their counts; all
else is made of these, without the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from knowlark.functions.text import STOP_BIGRAMS, STOP_CHARS
from knowlark.operators.layout import written
from knowlark.operators.tiles import best, by_size, met

K1, B = 1.5, 0.75
#: Queries of a tile and tokens of its chunks, about.
QUERIES, TOKENS = 512, 1 << 22
TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))


def postings(chunks: DataFrame) -> DataFrame:
    """(kb_id, chunk_id, term, tf) of chunks (kb_id, chunk_id, content). Nothing is shuffled."""
    return forward(chunks).select("kb_id", "chunk_id", F.inline("terms")).withColumn("tf", F.col("tf").cast("long"))


def lengths(posted: DataFrame) -> DataFrame:
    """(kb_id, chunk_id, dl): tokens of each chunk that has any."""
    return posted.groupBy("kb_id", "chunk_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """(kb_id, n_chunks, avg_len)."""
    return dl.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("kb_id", "term").agg(F.count(F.lit(1)).alias("df"))


_WORD, _HAN = re.compile("[a-zA-Z0-9]+"), re.compile("[\u4e00-\u9fa5]+")
_STOP = frozenset(STOP_BIGRAMS)


def han_tokens(text: str) -> list[str]:
    """Tokens of a text's Han characters, as functions.text.tokens has them."""
    han = "".join(_HAN.findall(text))
    one = ["c1" + c for c in han if c not in STOP_CHARS]
    two = ["c2" + p for p in map("".join, zip(han, han[1:], strict=False)) if p not in _STOP]
    return one + two + ["c3" + "".join(t) for t in zip(han, han[1:], han[2:], strict=False)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (..., content) the number of tokens, and each different one with its count. Words are told apart once in a slice of a batch, as they
    are written; all else goes by their numbers."""
    for batch in by_size(batches):
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        cut = [_WORD.findall(t) for t in texts]
        han = [han_tokens(t) if not t.isascii() else [] for t in texts]
        flat = pa.array([w for words in cut for w in words], pa.string()).dictionary_encode()
        names = pa.array([*("w" + w.lower() for w in flat.dictionary.to_pylist()), *(t for some in han for t in some)], pa.string()).dictionary_encode()
        number, wide = np.asarray(names.indices, dtype=np.int64), max(1, len(names.dictionary))
        sizes, more = np.fromiter(map(len, cut), np.int64, len(cut)), np.fromiter(map(len, han), np.int64, len(han))
        code = np.concatenate([number[np.asarray(flat.indices, dtype=np.int64)], number[len(flat.dictionary) :]])
        row = np.concatenate([np.repeat(np.arange(len(cut)), sizes), np.repeat(np.arange(len(han)), more)])
        key, times = np.unique(row * wide + code, return_counts=True)
        ends = np.append(0, np.cumsum(np.bincount(key // wide, minlength=len(cut)))).astype(np.int32)
        found = pa.StructArray.from_arrays([names.dictionary.take(pa.array(key % wide)), pa.array(times.astype(np.int32))], ["term", "tf"])
        columns = [*batch.columns[:-1], pa.array((sizes + more).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), found)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "dl", "terms"])


def forward(chunks: DataFrame) -> DataFrame:
    """(kb_id, chunk_id, dl, terms array<struct<term, tf>>) of chunks (kb_id, chunk_id, content), those without tokens too. Nothing is shuffled."""
    rows = chunks.select("kb_id", "chunk_id", "content")
    return rows.mapInArrow(_counted, T.StructType([rows.schema["kb_id"], rows.schema["chunk_id"], T.StructField("dl", T.IntegerType()), T.StructField("terms", TERMS)]))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, tf) of queries (query_id, query)."""
    rows = forward(queries.select(F.lit(0).alias("kb_id"), F.col("query_id").alias("chunk_id"), F.col("query").alias("content")))
    return rows.select(F.col("chunk_id").alias("query_id"), F.inline("terms"))


def bm25(chunks: DataFrame, queries: DataFrame, limit: int, per_kb: bool = True) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank): the best `limit` chunks of each query in each knowledge base, or over all. Scores are rounded to nine places
    before ranking; ties go to the smaller chunk_id. Statistics are per knowledge base."""
    return bm25_rows(store(chunks), queries, limit, per_kb)


def bm25_rows(rows: DataFrame, queries: DataFrame, limit: int, per_kb: bool = True) -> DataFrame:
    """The same from forward() rows, which are read twice and should be stored: for a batch of queries that ask for much of the corpus, where
    an index's blocks can't be skipped. Postings of the queries' terms are shuffled once, to pieces of the corpus, where they meet pieces of the queries;
    the best of each query leave a piece, never all hits."""
    spark = rows.sparkSession
    sized = rows.where("dl > 0 and kb_id is not null")
    stats = sized.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_len"))
    asked = asked_terms(queries).select("query_id", "term")
    posted = sized.select("kb_id", "chunk_id", "dl", F.inline("terms")).join(asked.select("term").distinct(), "term", "left_semi")
    df = posted.groupBy("kb_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.join(stats, "kb_id").select("kb_id", "term", rarity(F.col("n_chunks"), F.col("df")).alias("idf"), "avg_len")
    wanted = asked.join(weights, "term").select("query_id", "kb_id", "term", "idf", "avg_len")
    size = sized.agg(F.sum("dl")).first()[0] or 0
    across = max(1, -(-queries.count() // QUERIES))
    down = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // across), -(-size // TOKENS))
    return ranked(posted, wanted, down, across, limit, per_kb)


def ranked(posted: DataFrame, wanted: DataFrame, down: int, across: int, limit: int, per_kb: bool = True) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank): the best of postings (kb_id, chunk_id, dl, term, tf) for the queries' terms (query_id, kb_id, term, idf,
    avg_len), by `down` pieces of chunks and `across` pieces of queries."""
    fields = [T.StructField(c, wanted.schema[c].dataType) for c in ("query_id", "kb_id")] + [T.StructField("chunk_id", posted.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())]
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    found = met(posted.select("kb_id", "chunk_id", "dl", "term", "tf"), wanted, "chunk_id", "query_id", down, across, lambda some, ask: _tile(some, ask, limit, per_kb, kinds), T.StructType(fields))
    ranks = Window.partitionBy(*(["query_id", "kb_id"] if per_kb else ["query_id"])).orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= limit)


def _codes(column: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    """Places of values in known; -1 for others."""
    return np.asarray(pc.fill_null(pc.index_in(column.combine_chunks(), known), -1), dtype=np.int64)


def _tile(some: pa.Table, ask: pa.Table, limit: int, per_kb: bool, kinds: pa.Schema) -> pa.Table:
    """The best of postings (kb_id, chunk_id, dl, term, tf) for queries' terms (query_id, kb_id, term, idf, avg_len). A term's weights in its chunks are
    added for the queries that have it, term after term in one order, so that equal chunks get equal sums."""
    if not (some.num_rows and ask.num_rows):
        return kinds.empty_table()
    kbs, terms, queries = (pc.unique(ask.column(c).combine_chunks()) for c in ("kb_id", "term", "query_id"))
    terms = terms.take(pc.sort_indices(terms))
    key = _codes(ask.column("kb_id"), kbs) * len(terms) + _codes(ask.column("term"), terms)
    query, order = _codes(ask.column("query_id"), queries), np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    edges, query, idf, mean = np.append(first, len(key)), query[order], ask.column("idf").to_numpy()[order][first], ask.column("avg_len").to_numpy()[order][first]
    kb, term = _codes(some.column("kb_id"), kbs), _codes(some.column("term"), terms)
    mine = np.flatnonzero((kb >= 0) & (term >= 0))
    mine = mine[np.isin(kb[mine] * len(terms) + term[mine], keys)]
    at = np.searchsorted(keys, kb[mine] * len(terms) + term[mine])
    mine, at = mine[np.argsort(at, kind="stable")], np.sort(at)
    ids = some.column("chunk_id").combine_chunks().dictionary_encode()
    held, row = np.unique(kb[mine] * len(ids.dictionary) + np.asarray(ids.indices, dtype=np.int64)[mine], return_inverse=True)  # a chunk of a kb
    tf, dl = (some.column(c).to_numpy().astype(float)[mine] for c in ("tf", "dl"))
    weight = idf[at] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / np.maximum(1e-6, mean[at]))))
    spot, where = np.unique(at * max(1, len(held)) + row, return_inverse=True)  # a chunk that stands in several rows is one
    weight, at, row = np.bincount(where, weight, len(spot)), spot // max(1, len(held)), spot % max(1, len(held))
    score = np.zeros((len(queries), len(held)))
    for k, (s, e) in enumerate(zip(np.searchsorted(at, np.arange(len(keys))), np.searchsorted(at, np.arange(len(keys)), "right"), strict=True)):
        score[query[edges[k] : edges[k + 1], None], row[s:e]] += weight[s:e]
    score = np.rint(score * 1e9) / 1e9
    base, place = held // len(ids.dictionary), np.asarray(ids.dictionary.take(pa.array(held % len(ids.dictionary))))
    parts = [np.flatnonzero(base == g) for g in range(len(kbs))] if per_kb else [np.arange(len(held))]
    out: list[tuple] = []
    for q in range(len(queries)):
        for part in parts:
            hit = part[score[q, part] > 0]
            hit = hit[best(score[q, hit], place[hit], limit)]
            out.append((np.full(len(hit), q), base[hit], hit, score[q, hit]))
    asked, base, hit, scores = (np.concatenate(c) for c in zip(*out, strict=True))
    chunk = ids.dictionary.take(pa.array(held[hit] % len(ids.dictionary)))
    return pa.Table.from_arrays([queries.take(pa.array(asked)), kbs.take(pa.array(base)), chunk, pa.array(scores)], schema=kinds)


def saturation(tf: Column, dl: Column, avg_len: Column) -> Column:
    """What a term's count gives in a chunk of this length, before the term's own weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(F.lit(1e-6), avg_len)))


def rarity(n_chunks: Column, df: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def keyword_scores(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, chunk_id, keyword_score) of pairs (query_id, chunk_id) and forward() rows: 0.7 x share of the query's different tokens that the
    chunk has + 0.3 x their occurrences (2 at most each) in the chunk over those in the query; 0 for a query without tokens."""
    pairs = pairs.select("query_id", "chunk_id").distinct()
    asked = asked_terms(queries).select("query_id", "term", F.least("tf", F.lit(2)).alias("_asked"))
    size = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_terms"), F.sum("_asked").alias("_total"), F.collect_list("term").alias("_wanted"))  # one query's terms
    held = pairs.join(size, "query_id").join(rows.select("chunk_id", "terms"), "chunk_id")
    found = F.filter("terms", lambda t: F.array_contains(F.col("_wanted"), t["term"]))
    times = F.aggregate(found, F.lit(0).cast("long"), lambda a, t: a + F.least(t["tf"], F.lit(2)))
    score = 0.7 * F.size(found) / F.col("_terms") + 0.3 * times / F.col("_total")
    scored = held.select("query_id", "chunk_id", score.alias("keyword_score"))
    return pairs.join(scored, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"))


def store(chunks: DataFrame) -> DataFrame:
    """forward() rows of chunks, written once to the shared folder."""
    return written(forward(chunks), compression="zstd")
