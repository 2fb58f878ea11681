"""A stored index of chunks: tokenized once, searched without their texts.

`forward` has a row for each chunk: its length and its different terms with their counts. `blocks` has the postings: for each knowledge base
and term, chunks of a like count and length in blocks of BLOCK at most, with the block's greatest term count and least length. These two bound
the score of every chunk in the block whatever the corpus's mean length is when it is searched, so the bounds stay valid as the corpus grows.

A search reads the blocks' heads first (a column scan without their entries). The best blocks of each term give scores that the k-th result
has at least. By these, blocks that can't lift a chunk over that score for any query, even with all its other terms at their best, are left out.
The entries of the others meet the queries in tiles, once for all queries, and are scored whole; the best of each query leave a tile.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from knowlark.operators.layout import checkpoint_folder, checkpointed, written
from knowlark.operators.lexical import QUERIES, asked_terms, ranked, rarity, saturation
from knowlark.operators.tiles import by_size

#: Chunks of a block at most.
BLOCK = 256
#: Postings that a task holds at a time, about.
HELD = 1 << 20
#: Scores of a tile (queries x chunks), about.
SCORES = 1 << 24
#: Rows of a small table, up to which it is broadcast.
SMALL = 1 << 20
#: Scores are ranked by nine places, so what is within this of the bound may still be in.
SLACK = 1e-8


@dataclass(frozen=True)
class Index:
    """Tables of an index: forward (kb_id, chunk_id, dl, terms), blocks (kb_id, term, block, n, most_tf, least_dl, entries) and stats (kb_id,
    n_chunks, avg_len). A term's df is the sum of its blocks' n."""

    forward: DataFrame
    blocks: DataFrame
    stats: DataFrame

    NAMES = ("forward", "blocks", "stats")

    def save(self, folder: str, names: tuple[str, ...] = NAMES) -> None:
        """Write the tables. Blocks are made in order of kb and term, so that a search's terms are found by the files' statistics."""
        for name in names:
            getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in cls.NAMES))


def build(rows: DataFrame, block: int = BLOCK) -> Index:
    """The index of forward() rows, which should be stored.

    Postings are shuffled once, as compressed blobs: one for each part of the terms from each slice of the chunks. A term that is frequent in a
    slice goes to another part from each slice, and has blocks in many; no term's postings are held as a whole, however many chunks it is in.
    """
    spark = rows.sparkSession
    sized = rows.where("dl > 0 and kb_id is not null")
    stats = checkpointed(sized.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_len"), F.sum(F.size("terms")).alias("_postings")))
    postings = stats.agg(F.sum("_postings")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // HELD))
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("kb_id", "chunk_id")]
    blobs = sized.select("kb_id", "chunk_id", "dl", "terms").mapInArrow(lambda batches: _dealt(batches, parts, 4 * block), "part int, sizes array<int>, terms binary, entries binary")
    number = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType())])
    entry = T.StructType([T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
    fields = [rows.schema["kb_id"], T.StructField("term", T.StringType()), T.StructField("block", number), T.StructField("n", T.LongType())]
    fields += [T.StructField("most_tf", T.IntegerType()), T.StructField("least_dl", T.IntegerType()), T.StructField("entries", T.ArrayType(entry))]
    blocks = blobs.groupBy("part").applyInArrow(_blocks(*kinds, to_arrow_schema(T.StructType(fields)), block), T.StructType(fields))
    return Index(rows, blocks, stats.drop("_postings"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches (..., terms) cut and put together to about HELD postings."""
    some, size = [], 0
    for batch in by_size(batches):
        some.append(batch)
        size += len(batch.column(batch.num_columns - 1).flatten())
        if size >= HELD:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if size:
        yield pa.Table.from_batches(some)


def _packed(columns: list[pa.Array]) -> tuple[int, bytes]:
    """Columns as a compressed blob, and its size before."""
    held = pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))]).serialize()
    return held.size, pa.compress(held, "zstd", asbytes=True)


def _unpacked(size: int, blob: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.decompress(blob, size, "zstd"), schema)


def _dealt(batches: Iterator[pa.RecordBatch], parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of forward rows (kb_id, chunk_id, dl, terms), for each slice and part of the terms a row: terms (kb_id, term, n) and their entries (chunk_id,
    tf, dl), term after term. A term that more than `most` chunks of a slice have goes to a part by the slice as well."""
    for k, held in enumerate(_slices(batches)):
        kb, chunk, dl, lists = (held.column(c).combine_chunks() for c in range(4))
        sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
        name, tf = lists.flatten().flatten()
        names, kbs, row = name.dictionary_encode(), kb.dictionary_encode(), np.repeat(np.arange(len(sizes)), sizes)
        wide = max(1, len(names.dictionary))
        keys, at, n = np.unique(np.asarray(kbs.indices, dtype=np.int64)[row] * wide + np.asarray(names.indices, dtype=np.int64), return_inverse=True, return_counts=True)
        base, word = keys // wide, keys % wide
        hashed = np.fromiter((zlib.crc32(x.encode()) for x in names.dictionary.to_pylist()), np.int64, len(names.dictionary))
        salt = np.fromiter((zlib.crc32(str(x).encode()) for x in kbs.dictionary.to_pylist()), np.int64, len(kbs.dictionary))
        mixed = (hashed[word] * 31 + salt[base]) * 0x9E3779B1 % (1 << 32)
        first = zlib.crc32(str((chunk[0].as_py(), k)).encode())  # differs from slice to slice, the same when a task is tried again
        part = (mixed + np.where(n > most, first, 0)) % parts
        order = np.lexsort((keys, part))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        entry = np.argsort(place[at], kind="stable")
        kb_of, term_of, n, part = kbs.dictionary.take(pa.array(base[order])), names.dictionary.take(pa.array(word[order])), n[order].astype(np.int32), part[order]
        entries = [chunk.take(pa.array(row[entry])), tf.take(pa.array(entry)), dl.take(pa.array(row[entry]))]
        ends = np.append(0, np.cumsum(n, dtype=np.int64))
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        out = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            (a, terms), (b, some) = _packed([kb_of[s:e], term_of[s:e], pa.array(n[s:e])]), _packed([x[ends[s] : ends[e]] for x in entries])
            out.append((int(part[s]), [a, b], terms, some))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], ["part", "sizes", "terms", "entries"])


def _blocks(kb_kind: pa.DataType, chunk_kind: pa.DataType, schema: pa.Schema, block: int) -> Callable[[pa.Table], pa.Table]:
    """Of a part's blobs the blocks, in order of kb and term. A term's entries lie by count and length, so that a block's bound is close to what its
    chunks get; a term of few chunks is one block, and counts that many chunks have begin a new one."""
    of_term = pa.schema([("0", kb_kind), ("1", pa.string()), ("2", pa.int32())])
    of_entry = pa.schema([("0", chunk_kind), ("1", pa.int32()), ("2", pa.int32())])

    def made(blobs: pa.Table) -> pa.Table:
        sizes = blobs.column("sizes").to_pylist()
        heads = pa.Table.from_batches([_unpacked(s[0], x.as_buffer(), of_term) for s, x in zip(sizes, blobs.column("terms"), strict=True)])
        entries = pa.Table.from_batches([_unpacked(s[1], x.as_buffer(), of_entry) for s, x in zip(sizes, blobs.column("entries"), strict=True)])
        kb, term = (heads.column(c).combine_chunks().dictionary_encode() for c in ("0", "1"))
        ranks = []
        for x in (kb, term):
            rank = np.empty(len(x.dictionary), np.int64)
            rank[np.asarray(pa.compute.sort_indices(x.dictionary))] = np.arange(len(rank))
            ranks.append(rank[np.asarray(x.indices, dtype=np.int64)])
        head, n = ranks[0] * len(term.dictionary) + ranks[1], heads.column("2").to_numpy()
        key, tf, dl = np.repeat(head, n), entries.column("1").to_numpy(), entries.column("2").to_numpy()
        order = np.lexsort((dl, tf, key))
        key, tf, dl = key[order], tf[order], dl[order]
        total = len(key)
        new = np.diff(key, prepend=-1) != 0
        runs = np.flatnonzero(new)
        size = np.diff(np.append(runs, total))
        often = np.repeat(size > block, size)
        # A count that many chunks have, and what comes after it, begin anew.
        alike = np.flatnonzero(new | (np.diff(tf, prepend=-1) != 0))
        many = np.diff(np.append(alike, total)) >= max(1, block // 4)
        begins = new.copy()
        begins[alike] |= (many | np.append(False, many[:-1])) & often[alike]
        edges = np.flatnonzero(begins)
        inside = np.arange(total) - np.repeat(edges, np.diff(np.append(edges, total)))
        starts = np.flatnonzero(inside % block == 0)
        spots, where = np.unique(head, return_index=True)
        where = pa.array(where[np.searchsorted(spots, key[starts])])
        kb, term = (heads.column(c).take(where).combine_chunks() for c in ("0", "1"))
        part = pa.array(np.full(len(starts), blobs.column("part")[0].as_py(), np.int32))
        number = pa.StructArray.from_arrays([part, pa.array(np.arange(len(starts), dtype=np.int32))], ["part", "n"])
        entry = pa.StructArray.from_arrays([entries.column("0").combine_chunks().take(pa.array(order)), pa.array(tf), pa.array(dl)], ["chunk_id", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, total).astype(np.int32)), entry)
        counts = pa.array(np.diff(np.append(starts, total)))
        columns = [kb, term, number, counts, pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)), lists]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return made


def stored(rows: DataFrame, block: int = BLOCK) -> Index:
    """build(), written to the shared folder; rows, which are stored, stay as they are."""
    spark = rows.sparkSession
    folder, made = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}", build(rows, block)
    made.save(folder, ("blocks", "stats"))
    return Index(rows, *(spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "stats")))


def _small(rows: DataFrame) -> DataFrame:
    """Stored rows, broadcast if they are few: blocks then stay where they lie."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def search(index: Index, queries: DataFrame, limit: int, per_kb: bool = True) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank): what lexical.bm25 gives, from the index alone."""
    return searched(index, queries, limit, per_kb)["hits"]


def searched(index: Index, queries: DataFrame, limit: int, per_kb: bool = True) -> dict[str, DataFrame]:
    """hits, and the heads of all blocks with `part`, what they are for a query: `seek`, of terms that find candidates; `score`, of terms that are too
    small together to reach the bound; `skip`, not read unless another query needs them."""
    keys = ["query_id", "kb_id"] if per_kb else ["query_id"]
    asked = written(asked_terms(queries).select("query_id", "term"))
    mine = index.blocks.join(_small(written(asked.select("term").distinct())), "term", "left_semi")
    heads = written(mine.select("kb_id", "term", "block", "n", "most_tf", "least_dl"))
    df = heads.groupBy("kb_id", "term").agg(F.sum("n").alias("df"))
    weights = written(df.join(index.stats, "kb_id").select("kb_id", "term", rarity(F.col("n_chunks"), F.col("df")).alias("idf"), "avg_len"))
    wanted = written(asked.join(weights, "term").select("query_id", "kb_id", "term", "idf", "avg_len"))
    bound = F.col("idf") * saturation(F.col("most_tf"), F.col("least_dl"), F.col("avg_len"))
    bounds = heads.join(weights, ["kb_id", "term"]).withColumn("bound", bound).drop("most_tf", "least_dl")
    chunks, asking = index.stats.agg(F.sum("n_chunks")).first()[0] or 0, queries.count()

    def scored(blocks: DataFrame, size: int) -> DataFrame:
        """The best by the entries of blocks, of which there are `size`."""
        across = max(1, -(-asking // QUERIES))
        tasks = int(index.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        down = max(-(-tasks // across), -(-size // HELD), -(-min(size, chunks) * min(asking, QUERIES) // SCORES))
        return ranked(blocks.select("kb_id", "term", F.inline("entries")).select("kb_id", "chunk_id", "dl", "term", "tf"), wanted, down, across, limit, per_kb)

    # First pass: each term's best blocks, until they hold `limit` chunks. What they give is a part of a chunk's score, so no more than it.
    before = Window.partitionBy("kb_id", "term").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = written(bounds.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < limit).select("kb_id", "term", "block", "n"))
    best = index.blocks.join(_small(first.drop("n")), ["kb_id", "term", "block"], "left_semi")
    least = scored(best, first.agg(F.sum("n")).first()[0] or 0).where(F.col("rank") == limit).select(*keys, (F.col("score") - SLACK).alias("least"))
    # Each term's greatest gift, and what a block must give for any query.
    of_term = wanted.join(bounds.groupBy("kb_id", "term").agg(F.max("bound").alias("most")), ["kb_id", "term"])
    rising = Window.partitionBy("query_id", "kb_id").orderBy("most", "term")
    of_term = of_term.withColumn("below", F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("most").over(Window.partitionBy("query_id", "kb_id")))
    of_term = written(of_term.join(least, keys, "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).drop("idf", "avg_len"))
    need = written(of_term.groupBy("kb_id", "term").agg(F.min(F.col("least") - F.col("total") + F.col("most") - SLACK).alias("need")).join(weights, ["kb_id", "term"]))
    size = bounds.join(need.select("kb_id", "term", "need"), ["kb_id", "term"]).where("bound >= need").agg(F.sum("n")).first()[0] or 0
    left = index.blocks.join(_small(need), ["kb_id", "term"]).where(bound >= F.col("need"))
    reach = F.col("bound") + F.col("total") - F.col("most")
    part = F.when(reach < F.col("least"), "skip").when(F.col("below") < F.col("least"), "score").otherwise("seek")
    judged = bounds.join(of_term, ["kb_id", "term"]).select("query_id", "kb_id", "term", "block", "n", "idf", "avg_len", "bound", part.alias("part"), "least")
    return {"hits": scored(left, size), "blocks": judged}
