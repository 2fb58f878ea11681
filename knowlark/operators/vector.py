"""Vector search: exact, by distance, and approximate by inverted lists; all batched over queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from knowlark.functions.vectors import DIM, hashed_tokens, l2_normalize
from knowlark.operators.lexical import forward, store
from knowlark.operators.tiles import best, by_size, met


#: Queries and vectors of a tile, about, and numbers that one step of it may hold.
QUERIES, VECTORS, CELLS = 4096, 65_536, 1 << 21
#: Hashed embeddings of a tile: they are made dense there, DIM numbers each.
HASHED = 8192


def _top(scored: DataFrame, keys: list[str], k: int, order) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "chunk_id"))).where(F.col("rank") <= k)


def check_dimension(vectors: DataFrame, size: int) -> DataFrame:
    """vectors; a row whose vec isn't of `size` numbers fails the job, as a store of fixed dimension refuses it."""
    told = F.concat(F.lit(f"a vector is not of {size} dimensions: chunk "), F.col("chunk_id").cast("string"))
    return vectors.withColumn("vec", F.when(F.size("vec") == size, F.col("vec")).otherwise(F.raise_error(told).cast(vectors.schema["vec"].dataType)))


def _tiles(vectors: DataFrame, queries: DataFrame, pack: Callable, score: Callable, k: int, least: float | None, kb: bool, positive: bool = True, high: int | None = None) -> DataFrame:
    """Scores of vectors (kb_id, chunk_id, ...) for queries (query_id, ...), by a grid of tiles: vectors and queries are dealt to pieces, every piece of the one
    meets every piece of the other in a task, as a matrix product, and the best k of a query (and kb) go on. pack turns rows into a
    matrix, on either side; score makes (vectors x queries) of two. Both sides are dealt by joins, whatever their sizes; a vector is sent
    once for each QUERIES queries, a query once for each piece of vectors, of about `high` (VECTORS) of them."""
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-queries.count() // QUERIES))
    down = max(-(-partitions // across), -(-vectors.count() // (high or VECTORS)))
    kinds = {c: (vectors if c in vectors.columns else queries).schema[c].dataType for c in (["kb_id"] if kb else []) + ["query_id", "chunk_id"]} | {"score": T.DoubleType()}
    fields = [T.StructField(c, t) for c, t in kinds.items()]

    def each(some: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in fields]
        if some.num_rows and asked.num_rows:
            made, wanted = (pack(t.combine_chunks().to_batches()[0]) for t in (some, asked))
            ids, chunk = asked.column("query_id").to_pylist(), np.array(some.column("chunk_id").to_pylist())
            group = np.array(some.column("kb_id").to_pylist()) if kb else np.zeros(len(chunk), int)
            parts = [np.flatnonzero(group == g) for g in dict.fromkeys(group.tolist())]
            step = max(1, CELLS // len(chunk))
            for first in range(0, len(ids), step):
                table = score(made, wanted, slice(first, first + step))
                for q in range(table.shape[1]):
                    for part in parts:
                        mine = part if least is None else part[(table[part, q] >= least) & ((table[part, q] > 0) | (not positive))]
                        mine = mine[best(table[mine, q], chunk[mine], k)]
                        columns = ([group[mine]] if kb else []) + [[ids[first + q]] * len(mine), chunk[mine], table[mine, q]]
                        for c, x in zip(found, columns, strict=True):
                            c.extend(x)
        return pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(found, fields, strict=True)], list(kinds))

    return met(vectors, queries, "chunk_id", "query_id", down, across, each, T.StructType(fields))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of an array of lists: each row's length, each value's row, and the values. A null list is empty."""
    sizes = np.array(column.value_lengths().fill_null(0))
    return sizes, np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def _dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as a matrix, and which rows have that length; the others score nothing."""
    sizes, row, values = _lists(batch.column("vec"))
    width = int(sizes.max(initial=0))
    good = sizes == width
    out = np.zeros((len(sizes), width))
    out[good] = np.asarray(values, dtype=float)[good[row]].reshape(-1, width)
    return out, good


def _cosine(vectors: tuple, queries: tuple, some: slice) -> np.ndarray:
    (x, good), (q, fits) = vectors, queries
    if x.shape[1] != q.shape[1]:
        return np.zeros((len(x), len(q[some])))
    return np.round(x @ q[some].T, 6) * good[:, None] * fits[some]


def search(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, positive: bool = True) -> DataFrame:
    """Exact cosine top k of (kb_id, chunk_id, vec) for queries (query_id, vec) in each kb; scores are at least min_score and over 0, the
    latter only if positive (a database's own search keeps those of 0 and less where min_score lets them).

    Every query meets every vector, as an exact search must, in matrix products of a piece of the queries and one of the vectors;
    of each the best k alone leave the worker. A vector of another length than the others' scores 0; check_dimension refuses it.
    """
    scored = _tiles(vectors.select("kb_id", "chunk_id", "vec"), queries.select("query_id", "vec"), _dense, _cosine, k, min_score, True, positive)
    return _top(scored, ["query_id", "kb_id"], k, F.desc("score"))


def score_counts(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(score, n): how many pairs of a query and a vector have each positive score, as search() would give it without a limit. Every pair is scored;
    a tile's pairs leave it as counts of their different scores, which six places bound, not one by one."""
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-queries.count() // QUERIES))
    down = max(-(-partitions // across), -(-vectors.count() // VECTORS))
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())])
    kinds = pa.schema([("score", pa.float64()), ("n", pa.int64())])

    def each(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not (some.num_rows and asked.num_rows):
            return kinds.empty_table()
        made, wanted = (_dense(t.combine_chunks().to_batches()[0]) for t in (some, asked))
        step = max(1, CELLS // some.num_rows)
        values, times = np.zeros(0), np.zeros(0, np.int64)
        for first in range(0, asked.num_rows, step):
            table = _cosine(made, wanted, slice(first, first + step))
            more, n = np.unique(table[table > 0], return_counts=True)
            values, where = np.unique(np.concatenate([values, more]), return_inverse=True)
            times = np.bincount(where, np.concatenate([times, n]), len(values)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(values), pa.array(times)], schema=kinds)

    found = met(vectors.select("chunk_id", "vec"), queries.select("query_id", "vec"), "chunk_id", "query_id", down, across, each, schema)
    return found.groupBy("score").agg(F.sum("n").alias("n"))


def store_search(vectors: DataFrame, queries: DataFrame, top_k: int, min_score: float = 0.0, over: int = 4) -> DataFrame:
    """A store's search: queries are brought to unit length, `over` times top_k hits are fetched, those under min_score go, top_k stay."""
    unit = queries.select("query_id", l2_normalize(F.col("vec")).alias("vec"))
    return search(vectors, unit, over * top_k).where((F.col("score") >= min_score) & (F.col("rank") <= top_k))


def _distance(vectors: tuple, queries: tuple, some: slice) -> np.ndarray:
    x, q = vectors[0], queries[0][some]
    return -np.round(np.sqrt(np.stack([((x - v) ** 2).sum(1) for v in q], axis=1)), 6)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k least Euclidean distances of each query."""
    scored = _tiles(vectors.select("chunk_id", "vec"), queries.select("query_id", "vec"), _dense, _distance, k, None, False)
    return _top(scored.select("query_id", "chunk_id", (-F.col("score")).alias("distance")), ["query_id"], k, F.asc("distance"))


def centroids(vectors: DataFrame, lists: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 42, k: int = 10, recall: float = 0.97) -> tuple[np.ndarray, int]:
    """Spherical k-means on at most about `sample` vectors, chosen by the hash of their ids, and the number of nearest lists that holds
    the share `recall` of the k nearest neighbours of sampled vectors. lists: the square root of all vectors, up to 4096."""
    total = vectors.count()
    some = vectors if total <= sample else vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    x = np.array([r["vec"] for r in some.orderBy("chunk_id").select("vec").collect()], dtype=np.float32)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(lists or max(1, min(4096, round(total**0.5))), len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (mine := near == c).any():
                mean = x[mine].sum(0)
                centre[c] = mean / max(np.linalg.norm(mean), 1e-9)
    asked = x[rng.choice(len(x), min(400, len(x)), replace=False)]
    found = np.argsort(-(asked @ x.T), axis=1)[:, :k]  # itself included, as where queries are indexed
    order = np.argsort(np.argsort(-(asked @ centre.T), axis=1), axis=1)
    need = np.take_along_axis(order, (x @ centre.T).argmax(1)[found], axis=1) + 1
    return centre, int(np.sort(need, axis=None)[min(need.size - 1, int(recall * need.size))])


def ann_search(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, piece: int = 50_000) -> DataFrame:
    """Approximate cosine top k: each vector is in the list of its nearest centroid, and a query is compared with the vectors
    of its `probes` nearest lists, by default as many as reach a recall of 0.97 on the sample. Lists hold all their vectors; a join by
    list deals them out, and a list of over `piece` vectors in pieces, each of which meets the list's queries in a matrix product, whose best k leave it."""
    centre, enough = centroids(vectors, lists, k=k)
    probes = probes or enough
    shared = vectors.sparkSession.sparkContext.broadcast(centre)

    def listed(n: int):
        def each(batches):
            for batch in by_size(batches, batch_vec):
                x = np.asarray(batch.column(batch_vec).flatten(), dtype=np.float32).reshape(batch.num_rows, -1)
                near = -(x @ shared.value.T)
                order = np.argpartition(near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(order.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists_], [*batch.schema.names, "lists"])

        batch_vec = -1  # the last column
        return each

    def dealt(df: DataFrame, n: int) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
        return df.mapInArrow(listed(n), schema).withColumn("list", F.explode("lists")).drop("lists")

    q = dealt(queries.select(F.col("query_id").alias("query_id"), F.col("vec").alias("vec")), min(probes, len(centre)))
    all_ = dealt(vectors.select("kb_id", "chunk_id", "vec"), 1)
    sizes = {r["list"]: -(-r["n"] // piece) for r in all_.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    pieces = F.get(F.lit([sizes.get(c, 1) for c in range(len(centre))]), F.col("list"))
    all_ = all_.withColumn("piece", F.pmod(F.xxhash64("chunk_id"), pieces))
    q = q.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)))
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())]
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def each(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not (some.num_rows and asked.num_rows):
            return kinds.empty_table()
        made, wanted = (_dense(t.combine_chunks().to_batches()[0]) for t in (some, asked))
        ids, chunk = asked.column("query_id").combine_chunks(), np.asarray(some.column("chunk_id"))
        step, found = max(1, CELLS // len(chunk)), []
        for first in range(0, len(ids), step):
            table = _cosine(made, wanted, slice(first, first + step))
            for q in range(table.shape[1]):
                mine = np.flatnonzero(table[:, q] > 0)
                mine = mine[best(table[mine, q], chunk[mine], k)]
                found.append((np.full(len(mine), first + q), mine, table[mine, q]))
        asked_, mine, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_arrays([ids.take(pa.array(asked_)), pa.array(chunk[mine]), pa.array(score)], schema=kinds)

    scored = all_.select("list", "piece", "chunk_id", "vec").groupBy("list", "piece").cogroup(q.groupBy("list", "piece")).applyInArrow(each, T.StructType(fields))
    return _top(scored, ["query_id"], k, F.desc("score"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of forward() rows (kb_id, chunk_id, terms) the slots and values of their unit embedding. Each term is hashed once in a slice of a batch."""
    for batch in by_size(batches):
        sizes, row, terms = _lists(batch.column(2))
        flat = terms.field("term").dictionary_encode()
        slot, weight = hashed_tokens(flat.dictionary.to_pylist())
        code = np.asarray(flat.indices, dtype=np.int64)
        key = row * DIM + slot[code]
        there = np.unique(key)
        raw = np.bincount(np.searchsorted(there, key), weights=weight[code] * np.asarray(terms.field("tf")), minlength=len(there))
        norm = np.sqrt(np.bincount(there // DIM, weights=raw * raw, minlength=len(sizes)))[there // DIM]
        value = np.divide(raw, norm, out=raw.copy(), where=norm > 0)
        ends = np.append(0, np.cumsum(np.bincount(there // DIM, minlength=len(sizes)))).astype(np.int32)
        parts = pa.StructArray.from_arrays([pa.array((there % DIM).astype(np.int32)), pa.array(value)], ["slot", "value"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), parts)], [*batch.schema.names[:2], "parts"])


def hash_parts(rows: DataFrame) -> DataFrame:
    """Sparse unit embeddings (kb_id, chunk_id, parts array<struct<slot, value>>) of lexical.forward() rows that have terms."""
    some = rows.where(F.size("terms") > 0).select("kb_id", "chunk_id", "terms")
    parts = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())]))
    return some.mapInArrow(_hashed, T.StructType([*some.schema.fields[:2], T.StructField("parts", parts)]))


def hash_embed(texts: DataFrame) -> DataFrame:
    """Sparse unit embeddings (kb_id, chunk_id, slot, value) of texts (kb_id, chunk_id, content)."""
    return hash_parts(forward(texts)).select("kb_id", "chunk_id", F.inline("parts"))


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    sizes, row, parts = _lists(batch.column("parts"))
    out = np.zeros((len(sizes), DIM))
    out[row, np.asarray(parts.field("slot"))] = np.asarray(parts.field("value"))
    return out


def sparse_search(texts: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """Cosine top k per query and kb between hashed embeddings of texts (kb_id, chunk_id, content)."""
    return hash_search(store(texts), queries, k, min_score)


def hash_search(rows: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """The same of lexical.forward() rows, which are read twice and should be stored."""
    q = forward(queries.select(F.lit(0).alias("kb_id"), F.col("query_id").alias("chunk_id"), F.col("query").alias("content")))
    q = hash_parts(q).select(F.col("chunk_id").alias("query_id"), "parts")
    scored = _tiles(hash_parts(rows), q, _packed, lambda x, y, some: np.round(x @ y[some].T, 6), k, min_score, True, high=HASHED)
    return _top(scored, ["query_id", "kb_id"], k, F.desc("score"))


def embed(texts: DataFrame, model: Callable[[list[str]], list], batch: int = 16) -> DataFrame:
    """(kb_id, chunk_id, vec) of texts (kb_id, chunk_id, content): unit vectors by a model that takes a list of texts, `batch` at a time.
    A model that fails fails the task, which Spark tries again."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            some = [t or "" for t in got.column(2).to_pylist()]
            made = [v for at in range(0, len(some), batch) for v in model(some[at : at + batch])]
            unit = [(x / max(np.linalg.norm(x), 1e-300)).tolist() if (x := np.asarray(v, float)).any() else x.tolist() for v in made]
            yield pa.RecordBatch.from_arrays([*got.columns[:2], pa.array(unit, pa.list_(pa.float64()))], ["kb_id", "chunk_id", "vec"])

    some = texts.select("kb_id", "chunk_id", "content")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema.fields[:2])
    return some.mapInArrow(each, f"{kinds}, vec array<double>")
